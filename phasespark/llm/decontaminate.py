"""Benchmark decontamination: which documents contain which test items, however long the documents are.

Items are partitioned by their number of shingles. An item's sketch is its k smallest shingle hashes, k being one more than the number
of shingles that an item of its partition may miss. So an item contained at the asked degree always shows at least k minus that number
of its sketch in the document, and no pair is lost. Candidates are then verified by exact containment of the shingles themselves.
Everything is DataFrame operations.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasespark.llm.common import let, materialise, side

SPACES = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Lower-case words split at ASCII white space; null or blank text has none."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[ \t-\r]+")))


def _starts(tokens: Column, n: Column) -> Column:
    return F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))


def _hashes(text: Column, n: int) -> Column:
    """Distinct hashes of all runs of n words."""
    h = F.transform(words(text), lambda w: F.xxhash64(w))
    runs = let(h, lambda h: F.transform(_starts(h, F.lit(n)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])))
    return F.array_distinct(runs)


def _shingles(text: Column, n: Column) -> Column:
    """Distinct runs of n words, each between spaces."""
    run = lambda w, i: F.concat(F.lit(" "), F.array_join(F.slice(w, i + 1, n), " "), F.lit(" "))
    return F.array_distinct(let(words(text), lambda w: F.transform(_starts(w, n), lambda i: run(w, i))))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shingle_words: int = 5,
    min_containment: float = 0.8,
) -> DataFrame:
    """Rows (doc_id, item_id, n_shingles, n_found, containment) for each pair at or over ``min_containment``.

    An item of fewer than ``shingle_words`` words is one shingle of all its words; items without words and null texts match nothing.
    Repeated rows of a key give one row, that with the most shingles found; null keys are a key like any other. Empty tables give none.
    """
    share = Fraction(str(min_containment))
    own = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("t"), F.size(words(F.col(item_text))).alias("n")).filter("n > 0")
    own = own.withColumn("n", F.least(F.col("n"), F.lit(shingle_words)))
    lengths = [r["n"] for r in own.select("n").distinct().collect()]  # shingle_words values at most
    if not lengths:
        kinds = {doc_id: docs.schema[doc_id].dataType, item_id: items.schema[item_id].dataType}
        kinds |= {"n_shingles": T.IntegerType(), "n_found": T.IntegerType(), "containment": T.DoubleType()}
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField(k, v) for k, v in kinds.items()]))
    missable = lambda q: F.floor(q * F.lit(share.denominator - share.numerator) / F.lit(share.denominator)).cast("int")
    rows = []
    for n in lengths:
        q = own.filter(F.col("n") == n).select("item", "n", _hashes(F.col("t"), n).alias("h"))
        upper = F.pow(F.lit(2), F.floor(F.log2(F.size("h"))) + 1).cast("int") - 1  # the largest size of the item's partition
        q = q.withColumn("k", F.least(F.size("h"), missable(upper) + 1)).withColumn("need", F.col("k") - missable(F.size("h")))
        sketch = F.slice(F.array_sort("h"), F.lit(1), F.col("k"))
        rows.append(q.select("item", "n", "need", F.explode(sketch).alias("h")))
    index = materialise(reduce(DataFrame.unionByName, rows), "index")
    index = side(index)

    read = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t"))
    hits = [
        read.select("doc", F.explode(_hashes(F.col("t"), n)).alias("h")).join(index.filter(F.col("n") == n), "h").select("doc", "item", "need")
        for n in lengths
    ]
    found = reduce(DataFrame.unionByName, hits).groupBy("doc", "item", "need").count().filter(F.col("count") >= F.col("need"))
    found = materialise(found.select(F.col("doc").alias("d"), F.col("item").alias("i")), "candidates")

    # The candidates go to the texts, not the texts to the candidates: those without one never leave their scan.
    tests = materialise(own.select("item", _shingles(F.col("t"), F.col("n")).alias("s")), "tests")
    pairs = read.join(side(found), F.col("doc").eqNullSafe(F.col("d"))).join(side(tests), F.col("i").eqNullSafe(F.col("item")))
    joined = F.concat(F.lit(" "), F.array_join(words(F.col("t")), " "), F.lit(" "))
    n_found = let(joined, lambda t: F.size(F.filter("s", lambda s: F.contains(t, s))))
    out = pairs.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.size("s").alias("n_shingles"), n_found.alias("n_found"))
    out = out.filter(F.col("n_found") * share.denominator >= F.col("n_shingles") * share.numerator)
    out = out.groupBy(doc_id, item_id, "n_shingles").agg(F.max("n_found").alias("n_found"))
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
