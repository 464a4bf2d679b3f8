"""Analyses described by a JSONC document: one signal in, results.json, metadata.json and summary.md out.

Each diagnostic is one lazily built frame; only its single result row reaches the driver.
"""

from __future__ import annotations

import json
import math
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasespark.operators import correlation, ordinal, recurrence
from phasespark.operators.embedding import embed
from phasespark.sources import signals as src
from phasespark.sources import simulate

SCHEMA_VERSION = "1.0"
DENSE_LIMIT_BYTES = 4 << 30
DIAGNOSTICS = ("permutation_entropy", "correlation_dimension", "rqa_streaming", "rqa_dense")


class WorkflowError(ValueError):
    """A mistake in a document or its input; the message is all that a user needs."""


def strip_comments(text: str) -> str:
    """JSON with // and /* */ comments taken out; those inside strings stay."""
    out, i, quoted = [], 0, False
    while i < len(text):
        two = text[i : i + 2]
        if quoted:
            step = 2 if text[i] == "\\" else 1
            quoted = text[i] != '"'
            out.append(text[i : i + step])
            i += step
        elif two == "//":
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
        elif two == "/*":
            end = text.find("*/", i + 2)
            if end < 0:
                raise WorkflowError("unterminated comment")
            i = end + 2
        else:
            quoted = text[i] == '"'
            out.append(text[i])
            i += 1
    return "".join(out)


def load_document(path: str | Path) -> dict[str, Any]:
    found = json.loads(strip_comments(Path(path).read_text(encoding="utf-8")))
    if not isinstance(found, dict):
        raise WorkflowError("the document must be an object")
    return found


def json_safe(value: Any) -> Any:
    """NaN and infinities become null, numpy values plain ones, at any depth."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if hasattr(value, "tolist"):
        return json_safe(value.tolist())
    return None if isinstance(value, float) and not math.isfinite(value) else value


def _object(of: dict, key: str, default: Any = None) -> dict[str, Any]:
    found = of.get(key, default)
    if not isinstance(found, dict):
        raise WorkflowError(f"{key} must be an object")
    return found


def load_signal(spark: SparkSession, document: dict[str, Any], folder: Path) -> tuple[DataFrame, dict[str, Any]]:
    """(signals, source) by ``input.path`` or ``input.generated``, one of which has to be there."""
    given = _object(document, "input", {})
    if ("path" in given) == ("generated" in given):
        raise WorkflowError("give one of input.path and input.generated")
    if "path" in given:
        path = (folder / str(given["path"])).resolve()
        if not path.exists():
            raise WorkflowError(f"there is no file {path}")
        try:
            return src.from_numpy(spark, str(path), given.get("npz_key")), {"kind": "file", "path": str(path), "npz_key": given.get("npz_key")}
        except (ValueError, OSError) as e:
            raise WorkflowError(str(e)) from e
    made = _object(given, "generated")
    if made.get("name") != "logistic":
        raise WorkflowError("only the logistic signal can be generated")
    n = int(made.get("n", 0))
    if n < 1:
        raise WorkflowError("generated.n has to be 1 or more")
    x0 = float(made["x0"]) if "x0" in made else float(np.random.default_rng(int(made.get("seed", 0))).uniform(0.05, 0.95))
    params = spark.range(1).select(F.col("id").alias("param_id"), F.lit(float(made.get("a", 1.99))).alias("a"), F.lit(x0).alias("x0"))
    walk = simulate.trajectories(params, "logistic", n, record_first=True)
    return walk.select(F.lit("0").alias("series_id"), "t", F.col("p0").alias("x")), {"kind": "generated", **made}


def reliability(name: str, parameters: dict[str, Any], length: int, note: str, unresolved: list[str]) -> dict[str, Any]:
    """What a reader has to know to trust a result."""
    return {
        "method_name": name,
        "backend": "spark",
        "parameters": parameters,
        "data_length": length,
        "data_shape": [length],
        "sampling_downsampling_note": note,
        "warnings": [],
        "unresolved": unresolved,
        "scale_evidence": None,
        "schema_version": SCHEMA_VERSION,
    }


def diagnostic(signals: DataFrame, spec: dict[str, Any], length: int, limit: int, allow_dense: bool) -> tuple[dict[str, Any], dict[str, Any]]:
    """(result, reliability record) of one diagnostic."""
    name = spec["name"]
    emb = _object(spec, "embedding", {})
    d, tau = int(emb.get("d", 1)), int(emb.get("tau", 1))
    if name == "permutation_entropy":
        p = {"d": int(spec.get("d", 5)), "tau": int(spec.get("tau", 1)), "normalise": bool(spec.get("normalise", True))}
        row = ordinal.permutation_entropy(signals, **p).first()
        return {"value": None if row is None else row["entropy"]}, reliability(name, p, length, "no sampling", [])
    if name == "correlation_dimension":
        p = {"n_r": int(spec.get("n_r", 50)), "theiler": int(spec.get("theiler_window", 0)), "norm": str(spec.get("norm", "chebyshev"))}
        row = correlation.correlation_dimension(embed(signals, d, tau), **p).first()
        found = {"D2": None, "D2_stderr": None} if row is None else {"D2": row["d2"], "D2_stderr": row["stderr"]}
        bad = found["D2"] is None or math.isnan(found["D2"])
        return found | {"embedding": {"d": d, "tau": tau}}, reliability(name, p, length, "all pairs", ["no scaling region"] if bad else [])
    n = length - (d - 1) * tau
    if name == "rqa_dense" and 8 * n * n > limit and not allow_dense:
        raise WorkflowError(f"rqa_dense would take {8 * n * n} bytes as a matrix, over the limit of {limit}; rqa_streaming has none")
    p = {"eps": None if spec.get("eps") is None else float(spec["eps"]), "metric": str(spec.get("metric", "euclidean")), "percentile": float(spec.get("percentile", 5)), "l_min": int(spec.get("l_min", 2)), "v_min": int(spec.get("v_min", 2))}
    row = recurrence.rqa(embed(signals, d, tau), **p).first()
    return ({} if row is None else {k: row[k] for k in ("rr", "det", "lam", "l", "tt", "entr", "lmax")}) | {"embedding": {"d": d, "tau": tau}}, reliability(name, p, length, "all pairs", [])


def run_workflow(spark: SparkSession, path: str | Path) -> dict[str, Any]:
    """Run the document at ``path``; write the three files below its ``output.dir`` and return the results."""
    path = Path(path)
    document = load_document(path)
    specs = document.get("diagnostics")
    if not isinstance(specs, list) or not specs or not all(isinstance(s, dict) for s in specs):
        raise WorkflowError("diagnostics must be a non-empty list of objects")
    names = [s.get("name") for s in specs]
    if bad := [n for n in names if n not in DIAGNOSTICS]:
        raise WorkflowError(f"unknown diagnostic {bad[0]}")
    if len(set(names)) != len(names):
        raise WorkflowError("a diagnostic is named twice")
    limits = _object(document, "scale_limits", {})
    allow = limits.get("allow_dense_rqa_beyond_envelope", False)
    if not isinstance(allow, bool):
        raise WorkflowError("scale_limits.allow_dense_rqa_beyond_envelope must be true or false")
    if "dir" not in _object(document, "output"):
        raise WorkflowError("output.dir says where to write, and is missing")
    signals, source = load_signal(spark, document, path.parent)
    length = signals.count()
    done = {s["name"]: diagnostic(signals, s, length, int(limits.get("dense_rqa_max_bytes", DENSE_LIMIT_BYTES)), allow) for s in specs}
    out = path.parent / str(_object(document, "output", {}).get("dir", "output"))
    out.mkdir(parents=True, exist_ok=True)
    results = json_safe({"schema_version": SCHEMA_VERSION, "diagnostics": {k: r for k, (r, _) in done.items()}})
    metadata = json_safe({"config_path": str(path), "input": source | {"length": length}, "reliability": {k: m for k, (_, m) in done.items()}})
    (out / "results.json").write_text(json.dumps(results, indent=2))
    (out / "metadata.json").write_text(json.dumps(metadata, indent=2))
    lines = [f"# {path.name}", "", f"Samples: {length}", ""]
    for name, found in results["diagnostics"].items():
        lines += [f"## {name}", "", "```json", json.dumps(found)[:500], "```", ""]
    (out / "summary.md").write_text("\n".join(lines))
    return results
