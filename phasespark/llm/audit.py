"""Filter interaction audit: what each of five filters removes in each of the 120 orders, from 80 edges of the lattice of filter sets."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasespark.llm.common import UPPER, let, materialise

#: The filters in the order of their bits.
FILTERS = "ABCDE"
BLANK = r"[\x20\x09-\x0D]+"
#: The sums of an edge.
SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def edges() -> list[tuple[int, int]]:
    """(set of filters applied, next filter) as bits: 80."""
    return [(s, f) for f in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> f & 1]


def steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, set applied before, filter) of all orders: 600, the paths through the lattice."""
    return [(o, k + 1, sum(1 << FILTERS.index(c) for c in o[:k]), FILTERS.index(o[k])) for o in map("".join, permutations(FILTERS)) for k in range(len(o))]


def own_failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""

    def of(words: Column) -> Column:
        n, bit = F.size(words), lambda c, k: F.when(c, 1 << k).otherwise(0)
        capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
        return bit(n < 200, 0) + bit(100 * F.size(F.array_distinct(words)) < 50 * n, 1) + bit(100 * capitals > 2 * F.length(text), 2) + bit(text.rlike(r"[#$%&*|]"), 3)

    return let(F.filter(F.split(text, BLANK), lambda w: w != ""), of)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents by source and the set of filters that they fail, with those labelled so.

    Only digests of texts are shuffled. Copies are counted by text, source, label and failures before the least id of a text is looked
    for, so that a text that stands in a third of all rows is a few rows by then.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), own_failures(text).alias("own"))
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    ids = rows.groupBy("digest", "part", "own", "good", "toxic", "doc_id").agg(F.count("*").alias("n"))
    alike = ids.groupBy("digest", "part", "own", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    alike = materialise(alike, "alike")
    alike = alike.join(alike.groupBy("digest").agg(F.min("first").alias("least")), "digest")
    spared = F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0) + F.col("n_null")
    both = F.array(F.struct(F.col("own").alias("fails"), spared.alias("n")), F.struct((F.col("own") + (1 << 4)).alias("fails"), (F.col("n") - spared).alias("n")))
    flat = alike.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    return flat.groupBy("part", "fails").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def lattice(counts: DataFrame) -> DataFrame:
    """(part, applied, filter, SUMS) for the 80 edges of each part, zeros included, from ``cells``."""
    pairs = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for s, f in edges()))
    rows = counts.select("*", F.inline(pairs))
    own = F.expr("fails & shiftleft(1, filter)") != 0
    before = F.expr("fails & applied") != 0
    total = lambda c, n="n": F.sum(F.when(c, F.col(n)).otherwise(0))
    values = (total(~own & ~before), total(own & ~before), total(own & before), total(F.expr("fails = shiftleft(1, filter)")), total(own & ~before, "good"), total(own & ~before, "toxic"))
    return rows.groupBy("part", "applied", "filter").agg(*(v.alias(n) for v, n in zip(values, SUMS, strict=True)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, SUMS, shapley): what each step of each order of the filters does to the documents of each source.

    ``kept`` pass this and all earlier filters, ``removed`` go here, ``redundant`` fail here but went earlier, ``unique_fails`` fail
    nothing else; ``good_lost`` and ``toxic_lost`` are those removed here that a label calls so; ``shapley`` sums what the step's filter
    removes over all orders, each edge weighted by the orders that pass through it.

    Null text is empty, null source the part ''. A document of several labels is good or toxic if one of them says so. A document fails
    E if one of smaller id has the same text; rows of one id spare each other, rows without id are never removed by E and remove none. No
    documents give no rows. Texts are told apart by SHA-256.
    """
    spark = docs.sparkSession
    table = lattice(cells(docs, labels))
    n = len(FILTERS)
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("applied") + 1)
    worth = table.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    path = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, applied int, filter int"))  # 600 rows at any size
    rows = table.join(worth, ["part", "filter"]).join(path, ["applied", "filter"])
    return rows.select("part", "filter_order", "step", *SUMS, "shapley")
