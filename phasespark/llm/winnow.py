"""Document fingerprints by winnowing, in DataFrame operations.

Every run of k characters (code points) is hashed; of every window of w consecutive hashes the smallest is kept, the rightmost among
equal ones, with its position. Two texts that share a run of k + w - 1 characters therefore share a hash, wherever the run stands.

SQL functions keep no state along an array, so hashes aren't rolled from one place to the next but taken of k characters of the text in
UTF-32, where places are found at once; the window minima are rolled by doubling, over 2, 4, 8.. places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasespark.llm.common import let

#: Windows of a text taken at a time; bounds the memory of a very long text and changes no result.
BLOCK = 1 << 16
ENTRY = "array<struct<h:bigint,at:bigint>>"


#: Low bits of a key that hold the place, counted down so that the rightmost of equal hashes is the smallest key. A block has fewer places.
PLACE_BITS = 17
LAST = (1 << PLACE_BITS) - 1


def _hash(block: Column, k: int, i: Column) -> Column:
    return F.xxhash64(F.substring(block, i * 4 + 1, F.lit(4 * k)))


def _keys(block: Column, k: int) -> Column:
    """For each run of k characters of a block in UTF-32, or the only shorter one, the leading bits of its hash and its place in one long."""
    last = F.greatest(F.octet_length(block) / 4 - k, F.lit(0)).cast("int")
    key = lambda i: F.shiftleft(F.shiftright(_hash(block, k, i), PLACE_BITS), PLACE_BITS).bitwiseOR((F.lit(LAST) - i).cast("long"))
    return F.transform(F.sequence(F.lit(0), last), key)


def _minima(keys: Column, w: int) -> Column:
    """The smallest key of each window, or of the only window if there are fewer than w keys."""

    def wider(keys: Column, step: int) -> Column:
        return let(keys, lambda p: F.zip_with(F.slice(p, 1, F.size(p) - step), F.slice(p, 1 + step, F.size(p) - step), lambda a, b: F.least(a, b)))

    found, span = keys, 1
    while span < w:
        found, span = wider(found, min(span, w - span)), min(2 * span, w)
    return F.when(F.size(keys) < w, F.array(F.array_min(keys))).otherwise(F.array_distinct(found))


def entries(text: Column, k: int = 8, w: int = 16) -> Column:
    """The window minima of a text as structs (h: 64-bit hash, at: position in code points), by position.

    Hashes are ordered by their leading 47 bits, as signed numbers. Fewer than k characters: one hash of all of them; fewer than w hashes:
    one window. Null and empty texts have no entries. Texts are taken in blocks of windows, so that memory is bounded whatever their length.
    """

    def of(points: Column) -> Column:
        windows = F.greatest(F.octet_length(points) / 4 - (k + w - 2), F.lit(1)).cast("long")

        def block(start: Column) -> Column:
            part = F.substring(points, (start * 4 + 1).cast("int"), (F.least(windows - start, F.lit(BLOCK)) * 4 + 4 * (k + w - 2)).cast("int"))

            def named(b: Column) -> Column:
                place = lambda key: (F.lit(LAST) - key.bitwiseAND(F.lit(LAST))).cast("int")
                entry = lambda key: F.struct(_hash(b, k, place(key)).alias("h"), (start + place(key)).alias("at"))
                return F.transform(let(_keys(b, k), lambda keys: _minima(keys, w)), entry)

            return let(part, named)

        blocks = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), windows - 1, F.lit(BLOCK).cast("long")), block))
        # windows on both sides of a border may have chosen the same place
        once = let(blocks, lambda e: F.filter(e, lambda x, i: (i == 0) | (x["at"] != F.get(e, i - 1)["at"])))
        return F.when(F.octet_length(points) == 0, F.array().cast(ENTRY)).otherwise(once)

    return let(F.encode(F.coalesce(text, F.lit("")), "UTF-32"), of)


def hashes(found: Column) -> Column:
    """The set of an entry array's hashes."""
    return F.array_distinct(found["h"])


def shown(found: Column) -> Column:
    """Entries as text: all hashes and then all positions, joined by spaces, a semicolon between; nothing for none."""
    joined = lambda e, c: F.array_join(e[c].cast("array<string>"), " ")
    return let(found, lambda e: F.when(F.size(e) == 0, "").otherwise(F.concat(joined(e, "h"), F.lit(";"), joined(e, "at"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; 1 for two empty ones."""

    def ratio(both: Column) -> Column:
        return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))

    return let(F.size(F.array_intersect(a, b)), ratio)


def _replaced(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter (rounded down, code points) replaced by as much of the beginning of ``following``, or all of it."""
    m = _replaced(text)
    return F.concat(F.substring(text, F.lit(1), F.length(text) - m), F.substring(following, F.lit(1), m))


def edited_entries(text: Column, found: Column, new: Column, k: int = 8, w: int = 16) -> Column:
    """The entries of the edited text ``new`` from those of ``text``: only windows that reach the edit are taken anew.

    Chosen places never go back from one window to the next. So those before the first choice of the new windows were chosen by older
    windows, which both texts have.
    """
    reach = k + w - 1

    def late(start: Column) -> Column:
        new_ones = entries(F.substring(new, start + 1, F.length(new)), k, w)
        return let(new_ones, lambda e: F.transform(e, lambda x: F.struct(x["h"].alias("h"), (x["at"] + start).alias("at"))))

    def join(late: Column) -> Column:
        return let(late[0]["at"], lambda first: F.concat(F.filter(found, lambda e: e["at"] < first), late))

    start = F.length(text) - _replaced(text) - reach
    return let(start, lambda start: F.when(start < 0, late(F.lit(0))).otherwise(let(late(start), join)))


def _bucket(rank: Column, bounds: list[int]) -> Column:
    """The number of the last of the sorted ``bounds`` that is not over ``rank``, by binary search."""
    steps = max(1, (len(bounds) - 1).bit_length())
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        over = (middle > acc["lo"]) & (F.get(edges, middle) > rank)
        return F.struct(F.when(over, acc["lo"]).otherwise(middle).alias("lo"), F.when(over, middle).otherwise(acc["hi"]).alias("hi"))

    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: acc["lo"])


def with_next(docs: DataFrame, key: str, columns: dict[str, Column], rows_per_bucket: int = 4096, max_buckets: int = 20_000) -> DataFrame:
    """(key, text) rows with ``columns``, and ``next_text`` and ``next_<column>`` of the next row by (key, text), the first row's after the last.

    The order is dealt into buckets by quantiles of the key, so that no task holds it all; a bucket's first row is also sent to the
    bucket before. ``columns`` are computed after that, so that only texts are moved. Null keys come first. One row is its own next;
    rows with one and the same key share a bucket, which is sorted on disk if need be.
    """
    rank = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    n = docs.count()
    buckets = max(1, min(max_buckets, n // rows_per_bucket))
    shares = [i / buckets for i in range(1, buckets)]
    ends = docs.select(rank.alias("r")).agg(F.min("r"), *([F.percentile_approx("r", shares, 10 * buckets + 10_000)] if shares else [])).first()
    bounds = [0] if ends[0] is None else sorted({ends[0], *(ends[1] if shares else [])})  # keys, each the least of its bucket
    own = _bucket(rank, bounds)
    placed = docs.withColumn("_b", own).withColumn("_first", F.get(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("_b")) == rank)
    place = lambda b, late: F.struct(b.cast("int").alias("b"), F.lit(late).alias("late"))
    before = F.pmod(F.col("_b") - 1, F.lit(len(bounds)))
    to = F.when(F.col("_first"), F.array(place(F.col("_b"), 0), place(before, 1))).otherwise(F.array(place(F.col("_b"), 0)))
    dealt = placed.select("*", F.explode(to).alias("_to")).select(key, "text", F.col("_to.b").alias("_b"), F.col("_to.late").alias("_late"))
    order = ["_late", F.col(key).asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = dealt.repartition("_b").sortWithinPartitions("_b", *order).withColumns(columns)
    by = Window.partitionBy("_b").orderBy(*order)
    led = dealt.withColumns({f"next_{c}": F.lead(c).over(by) for c in ("text", *columns)})
    return led.filter("_late = 0").drop("_b", "_late")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 8, w: int = 16) -> DataFrame:
    """One row per row of ``docs``: key, n_chars, edited text, entries of the text and of the edited text, and their likenesses.

    The edited text ends with the beginning of the next document by ascending key, which must be of an integer type. A null text is an
    empty one; a repeated row is the next of its copy. Extra columns are dropped; an empty table gives no rows.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be of an integer type")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows, "key", {"entries": entries(F.col("text"), k, w)})
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_entries", edited_entries(F.col("text"), F.col("entries"), F.col("edited"), k, w)).withColumn("own", hashes(F.col("entries")))
    near = lambda other: let(F.col("own"), lambda own: let(hashes(F.col(other)), lambda o: likeness(own, o)))
    return rows.select(
        F.col("key").alias(key),
        F.length("text").cast("long").alias("n_chars"),
        "edited",
        "entries",
        "edited_entries",
        near("edited_entries").alias("near_edited"),
        near("next_entries").alias("near_next"),
    )
