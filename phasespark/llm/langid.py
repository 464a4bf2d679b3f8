"""Language identification by compression.

A bounded, deterministic sample of labelled text becomes one raw-content zstandard dictionary per language. A text is encoded with
every dictionary; the language whose dictionary gives the fewest bytes wins, and a narrow lead is rejected. Long texts are encoded in
independent blocks, so that the dictionary and not the text's own past decides, and the sizes are added up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)
UNDETERMINED = "und"


@dataclass
class CompressionClassifier:
    """dictionaries: language -> raw content; priors: language -> share of the labelled rows (breaks exact ties)."""

    dictionaries: dict[str, bytes]
    priors: dict[str, float]
    level: int = 6
    strong_level: int = 19
    block_bytes: int = 4096
    reject_margin: float = 0.005
    _coders: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_coders": {}}

    def _coder(self, lang: str, level: int) -> zstandard.ZstdCompressor:
        if (lang, level) not in self._coders:
            made = zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level)
            self._coders[lang, level] = zstandard.ZstdCompressor(
                level=level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        return self._coders[lang, level]

    def _sizes(self, blocks: list[bytes], level: int) -> list[tuple[int, float, str]]:
        return sorted(
            (sum(len(code(b)) for b in blocks), -self.priors.get(lang, 0.0), lang)
            for lang in self.dictionaries
            for code in [self._coder(lang, level).compress]
        )

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected). Null, letterless text or no dictionary: ('und', 0, 0, True).

        A narrow margin is rejected. A text so short that the margin is less than a byte takes the more frequent of tied languages, with
        a score that shows the tie, and isn't rejected.
        """
        if text is None or not self.dictionaries or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0, True
        raw = text.lower().encode("utf-8", "replace")
        blocks = [raw[i : i + self.block_bytes] for i in range(0, len(raw), self.block_bytes)]
        sizes = self._sizes(blocks, self.level)
        if len(sizes) > 1 and sizes[1][0] - sizes[0][0] <= 2:
            sizes = self._sizes(blocks, self.strong_level)  # all but a tie, whatever the length: shorter matches count
        best = sizes[0][0]
        lead = sizes[1][0] - best if len(sizes) > 1 else best
        score = 1.0 / sum(2.0 ** -min(size - best, 60) for size, _, _ in sizes)
        margin = lead / max(1, best + lead)
        measurable = (best + lead) * self.reject_margin >= 1  # else a single byte is over the margin, and a tie says nothing
        return sizes[0][2], score, margin, measurable and margin < self.reject_margin


def learn(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    *,
    sample_docs: int = 128,
    sample_chars: int = 1024,
    max_languages: int = 1000,
    **parameters,
) -> CompressionClassifier:
    """Fit on ``sample_docs`` rows of each language, and of a longer one a run of ``sample_chars`` characters at a hashed place.

    The sample is the rows with the smallest hash of the key, so it is the same on every run. Rows with null text or language, or
    without text, are not used; a table without usable rows gives a classifier that answers 'und'. More than ``max_languages`` values
    of the language are an error, as each becomes a dictionary in every worker.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).cast("string").alias("k"))
    rows = rows.filter(F.col("t").isNotNull() & F.col("l").isNotNull() & (F.length("t") > 0))
    n_by_lang = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(n_by_lang) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not n_by_lang:
        return CompressionClassifier({}, {}, **parameters)
    grain = 1 << 40
    keep = {k: min(1.0, 4 * sample_docs / n) for k, n in n_by_lang.items()}
    bound = F.create_map(*[F.lit(x) for k, p in keep.items() for x in (k, int(p * grain))])
    h = F.pmod(F.xxhash64("k"), F.lit(grain))
    spare = F.greatest(F.length("t") - sample_chars, F.lit(0))
    start = F.pmod(F.xxhash64(F.lit("place"), "k"), spare + 1).cast("int") + 1
    drawn = rows.select("l", h.alias("h"), "k", F.substring("t", start, F.lit(sample_chars)).alias("t")).filter(F.col("h") <= bound[F.col("l")])
    order = Window.partitionBy("l").orderBy("h", "k", "t")
    sample = drawn.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample_docs).collect()
    found: dict[str, list[str]] = {}
    for row in sorted(sample, key=lambda r: (r["l"], r["r"])):
        found.setdefault(row["l"], []).append(row["t"])
    dictionaries = {k: "\n".join(v).lower().encode("utf-8", "replace") for k, v in found.items()}
    total = sum(n_by_lang.values())
    return CompressionClassifier(dictionaries, {k: n / total for k, n in n_by_lang.items()}, **parameters)


def predicted(text: Column, model: CompressionClassifier) -> Column:
    """A struct (lang_pred, score, margin, rejected) for a text column; the model reaches the workers once, by broadcast.

    Its size is bounded: ``dict_bytes`` for each language.
    """
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def classify(texts: pd.Series) -> pd.DataFrame:
        out = [shared.value.classify(t) for t in texts]
        return pd.DataFrame(out, columns=[f.name for f in RESULT.fields])

    return classify(text)


def identify(docs: DataFrame, model: CompressionClassifier, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``language``; all rows and columns stay (one named ``language`` is replaced)."""
    return docs.withColumn("language", predicted(F.col(text), model))
