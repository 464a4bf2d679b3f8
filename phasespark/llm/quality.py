"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams.

The model is fitted on the whole texts of one half of all trusted documents, the quantiles are taken over the other half. N-grams are packed
into longs, so counts, continuation counts and context sums are plain aggregations and joins on keys. The finished tables, of the distinct
n-grams, are broadcast, cut into shards by key, and each batch of documents counts its n-grams and joins the distinct ones with the shards in
the worker. A document passes if its perplexity, and that of its worst few characters, lie under a quantile of the trusted documents of its
language: a strange word in a long fluent text shows only in the latter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasespark.llm.common import in_fold, materialise, side

BITS = 12
BEGIN, OTHER, FIRST = 0, 1, 2  #: symbols: padding before a text, rare characters, then the alphabet
SLICE = 128


def packed(texts: list[str | None], alphabet: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the n-grams that end at each character of all texts in a row, characters of each text). Highest order; lower ones are
    the low bits."""
    lengths = np.array([len(t) if t else 0 for t in texts])
    joined = "".join(t for t in texts if t)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.minimum(np.searchsorted(alphabet, points), max(0, len(alphabet) - 1))
    symbol = np.where(alphabet[at] == points, at + FIRST, OTHER).astype(np.int64) if len(alphabet) else np.full(len(points), OTHER, np.int64)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = np.arange(len(symbol)) - starts
    key = symbol.copy()
    for j in range(1, order):
        before = np.where(inside >= j, np.roll(symbol, j), BEGIN)
        key |= before << (BITS * j)
    return key, lengths


@dataclass
class Shard:
    """Sorted keys of one order with values; the shards of an order are ranges of keys."""

    keys: np.ndarray
    values: np.ndarray


@dataclass
class KneserNey:
    """probability[n], backoff[n]: shards of order n (1..order): of n-grams, and of contexts of n - 1 characters."""

    alphabet: np.ndarray
    order: int
    probability: dict[int, list[Shard]]
    backoff: dict[int, list[Shard]]

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Natural log probabilities of distinct, sorted n-gram keys of the highest order."""
        out, weight, open_ = np.zeros(len(keys)), np.zeros(len(keys)), np.ones(len(keys), bool)
        for n in range(self.order, 0, -1):
            own = keys & ((1 << (BITS * n)) - 1)
            p = joined(self.probability.get(n, []), own, open_)
            hit = open_ & ~np.isnan(p)
            out[hit] = weight[hit] + np.log(p[hit])
            open_ &= ~hit
            g = joined(self.backoff.get(n, []), own >> BITS, open_)
            seen = open_ & ~np.isnan(g)
            weight[seen] += np.log(g[seen])
        out[open_] = weight[open_] - np.log(len(self.alphabet) + FIRST)
        return out


def joined(shards: list[Shard], wanted: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The values of the wanted keys, NaN where there is none: a join with each shard on the keys of its range."""
    out = np.full(len(wanted), np.nan)
    at = np.flatnonzero(where)
    for shard in shards:
        mine = at[(wanted[at] >= shard.keys[0]) & (wanted[at] <= shard.keys[-1])]
        found = np.searchsorted(shard.keys, wanted[mine])
        hit = shard.keys[found] == wanted[mine]
        out[mine[hit]] = shard.values[found[hit]]
    return out


def train(texts: DataFrame, *, order: int = 5, alphabet_size: int = 4000, shards: int = 4) -> KneserNey:
    """Fit on all rows of the column ``text``; the caller bounds them. No rows: a uniform model."""
    chars = texts.select(F.explode(F.split("text", "")).alias("c")).filter("c <> ''").groupBy("c").count()
    top = chars.orderBy(F.desc("count"), "c").limit(alphabet_size).collect()
    alphabet = np.array(sorted(ord(r["c"]) for r in top if len(r["c"]) == 1), dtype=np.uint32)

    def count(batches):
        for batch in batches:
            column = batch.column("text")
            for i in range(0, len(column), SLICE):
                key, _ = packed(column.slice(i, SLICE).to_pylist(), alphabet, order)
                k, c = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int64))], names=["k", "c"])

    grams = texts.select("text").mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
    levels = {order: materialise(grams, "grams")}
    for n in range(order - 1, 0, -1):  # continuation counts: distinct characters to the left
        suffix = F.col("k").bitwiseAND(F.lit((1 << (BITS * n)) - 1))
        levels[n] = materialise(levels[n + 1].groupBy(suffix.alias("k")).agg(F.count("*").alias("c")), "grams")

    probability: dict[int, list[Shard]] = {}
    backoff: dict[int, list[Shard]] = {}
    lower = None
    for n in range(1, order + 1):
        of = {r["c"]: r["n"] for r in levels[n].filter("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [max(0.05, min(i + 0.95, i + 1 - (i + 2) * y * b / a)) if a and b else 0.5 * (i + 1) for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)))]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("k", BITS)
        sums = levels[n].groupBy(context.alias("x")).agg(F.sum("c").alias("total"), (F.sum(off) / F.sum("c")).alias("g"))
        p = levels[n].withColumn("x", context).join(sums, "x").withColumn("suffix", F.col("k").bitwiseAND(F.lit((1 << (BITS * (n - 1))) - 1)))
        if lower is None:
            rest = F.lit(1.0 / (len(alphabet) + FIRST))
        else:
            p = p.join(lower.select(F.col("k").alias("suffix"), F.col("p").alias("rest")), "suffix")
            rest = F.col("rest")
        lower = materialise(p.select("k", ((F.col("c") - off) / F.col("total") + F.col("g") * rest).alias("p")), "probability")
        probability[n] = _shards(lower.select("k", F.col("p").alias("v")), shards)
        backoff[n] = _shards(sums.select(F.col("x").alias("k"), F.col("g").alias("v")), shards)
    return KneserNey(alphabet, order, probability, backoff)


def _shards(table: DataFrame, shards: int) -> list[Shard]:
    rows = table.toArrow()
    k, v = np.asarray(rows.column("k").combine_chunks()), np.asarray(rows.column("v").combine_chunks())
    order = np.argsort(k)
    return [Shard(k[part], v[part]) for part in np.array_split(order, shards) if len(part)]


def worst_windows(total: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """The least mean of ``window`` values in a row within each text, of shorter ones the mean; ``total``: running sums from 0."""
    starts = np.cumsum(lengths) - lengths
    width = np.minimum(np.maximum(lengths, 1), window)
    at = np.repeat(starts, np.maximum(lengths - window, 0) + 1)
    first = np.cumsum(np.maximum(lengths - window, 0) + 1) - (np.maximum(lengths - window, 0) + 1)
    at = at + np.arange(len(at)) - np.repeat(first, np.maximum(lengths - window, 0) + 1)
    wide = np.repeat(np.where(lengths > 0, width, 0), np.maximum(lengths - window, 0) + 1)
    means = (total[at + wide] - total[at]) / np.maximum(wide, 1)
    return np.minimum.reduceat(means, first) if len(first) else means


def perplexities(docs: DataFrame, model: KneserNey, text: str = "text", window: int = 8) -> DataFrame:
    """``docs`` (without the text) with ``perplexity`` per character, ``worst``, that of the worst ``window`` characters, and
    ``n_chars_scored``; null perplexities for null or empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [f for f in docs.schema.fields if f.name != text]

    def score(batches):
        m = shared.value
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                part = batch.slice(i, SLICE)
                key, lengths = packed(part.column(text).to_pylist(), m.alphabet, m.order)
                distinct, inverse = np.unique(key, return_inverse=True)
                total = np.r_[0.0, np.cumsum(m.log_probability(distinct)[inverse])]
                ends = np.cumsum(lengths)
                mean = (total[ends] - total[ends - lengths]) / np.maximum(lengths, 1)
                out = [pa.array(np.exp(-x), mask=lengths == 0) for x in (mean, worst_windows(total, lengths, window))]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), *out, pa.array(lengths)], names=[*(f.name for f in others), "perplexity", "worst", "n_chars_scored"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return docs.mapInArrow(score, f"{kinds}, perplexity double, worst double, n_chars_scored long")


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quantile: float = 0.99,
    **parameters,
) -> DataFrame:
    """One row (key, lang, perplexity, threshold, worst, worst_threshold, keep) per row of ``docs``. ``trusted``: keys of trusted rows, in
    a column of that name.

    The model is fitted on the whole texts of the trusted rows whose crc32(key as text) is even. Thresholds are quantiles of all other trusted
    rows, as the model knows its own too well; if a half is empty, all trusted rows are in both. Scores cover all rows. Null languages are
    a language of their own; a language without trusted rows takes the quantiles of all; without any, everything is kept. Null and empty
    texts have no perplexity and aren't kept.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    good = trusted.select(F.col(key).alias("key")).filter("key is not null").distinct()
    learnt = in_fold(F.col("key"), 2, 0)
    halves = good.filter(learnt), good.filter(~learnt)
    fitted, other = (good, good) if any(half.isEmpty() for half in halves) else halves
    sample = materialise(rows.join(side(fitted), "key", "left_semi").filter("text is not null").select("text"), "trusted")
    model = train(sample, **parameters)
    scored = materialise(perplexities(rows, model), "scored")
    known = scored.join(other.withColumnRenamed("key", "good"), F.col("key") == F.col("good")).filter("perplexity is not null")
    columns = {"perplexity": "threshold", "worst": "worst_threshold"}
    cut = lambda c: F.percentile_approx(c, quantile, 100_000)
    limits = materialise(known.groupBy(F.col("lang").alias("l")).agg(*(cut(c).alias(f"_{t}") for c, t in columns.items())), "limits")  # one row a language
    overall = known.agg(*map(cut, columns)).first()
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left")
    out = out.withColumns({t: F.coalesce(f"_{t}", F.lit(x).cast("double")) for t, x in zip(columns.values(), overall, strict=True)})
    within = (F.col("perplexity") <= F.col("threshold")) & (F.col("worst") <= F.col("worst_threshold"))
    keep = F.coalesce(within, F.col("perplexity").isNotNull())
    return out.select(F.col("key").alias(key), F.col("lang").alias(lang), "perplexity", "threshold", "worst", "worst_threshold", keep.alias("keep"))
