"""SimHash near-duplicate groups with vantage-point trees.

Fingerprints are compared by Hamming distance. A small tree of vantage points, grown on a bounded sample, deals the distinct
fingerprints out: each has a home shard, and also visits the shards that the triangle inequality says may hold a neighbour across a
boundary. Over whole fingerprints most would lie near a boundary at every level of the tree, so the bits are cut into blocks with a tree
each: of b blocks one differs in no more than radius // b bits, and with more blocks than the radius there is one without any
difference. Then no boundary is in reach, and every fingerprint goes to one shard a block, however many there are. Inside a shard, those
that agree on the block are compared, by the same kind of tree down to runs that are compared whole. Of the links found, a shard
returns a spanning forest, never all pairs; the forests are joined by distributed connected components.

With ``min_jaccard`` the likeness asked is so low that some fingerprints lie at distances where no tree prunes. There the trees give the
candidates within the radius; the others meet by the shingles of their prefixes, rare ones first, and fingerprints filter them. Of both, a
pair links if the exact similarity of its sets allows it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasespark.llm.common import materialise, side
from phasespark.llm.components import components

CODE = T.StructType([T.StructField("words", T.ArrayType(T.LongType())), T.StructField("n_shingles", T.LongType())])
SET_CODE = T.StructType([*CODE.fields, T.StructField("digest", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
#: Pairs whose smaller set has so many shingles at most are candidates whatever their fingerprints.
SHORT = 12


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64-bit hash of a hash (the finaliser of splitmix64 over an odd step)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(text: str | None, shingle_words: int = 4, words: int = 1, repeats: bool = True, seed: int = 42) -> tuple[list[int], int]:
    """(64-bit words of the fingerprint, number of shingles). Words are split at ASCII white space, A-Z lower-cased.

    A bit is 1 if it is set in over half of the shingle hashes, with or without ``repeats`` of a shingle. Fewer words than a shingle's: the whole sequence is
    the only shingle. No words, or null: all bits 0 and no shingle. Further 64-bit words vote with further hashes of each shingle.
    """
    h = shingles(text, shingle_words, seed)
    if not repeats:
        h = np.unique(h)
    return voted(h, words), len(h)


def shingles(text: str | None, shingle_words: int, seed: int = 42) -> np.ndarray:
    """The hashes of all shingles of a text, in order."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))) + np.arange(len(tokens))
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(tokens) - shingle_words + 1)
    of, digest = memoryview(joined), xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(shingle_words, len(tokens)) - 1 :].tolist(), strict=True)
    return np.array([digest(of[a:b], seed) for a, b in spans], dtype=np.uint64)


def voted(h: np.ndarray, words: int) -> list[int]:
    """The 64-bit words of the fingerprint of shingle hashes."""
    n = len(h)
    out = []
    for k in range(words):
        votes = np.zeros(64, dtype=np.int64)
        for i in range(0, n, 65536):
            part = _mixed(h[i : i + 65536], k) if k else h[i : i + 65536]
            votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0]))
    return out


def coded(text: Column, shingle_words: int = 4, words: int = 1, repeats: bool = True) -> Column:
    """A struct (words, n_shingles) for a text column."""

    @F.arrow_udf(CODE)
    def code(texts: pa.Array) -> pa.Array:
        out = [simhash(t.as_py(), shingle_words, words, repeats) for t in texts]
        return pa.array([{"words": w, "n_shingles": n} for w, n in out], pa.struct([("words", pa.list_(pa.int64())), ("n_shingles", pa.int64())]))

    return code(text)


def coded_sets(text: Column, shingle_words: int, words: int, min_jaccard: float, common: Broadcast) -> Column:
    """As ``coded`` without repeats, with a digest of the set of shingles and the set's prefix, rare shingles first.

    Of n shingles the prefix has n - ceil(min_jaccard n) + 1: sets that are similar enough share a shingle of both prefixes, in whatever
    order, if it is the same for all sets. ``common`` holds the (sorted hashes, counts) of ``common_shingles``.
    """
    share = Fraction(str(min_jaccard))

    @F.arrow_udf(SET_CODE)
    def code(texts: pa.Array) -> pa.Array:
        votes, sizes, digests, prefixes = [], [], [], [np.zeros(0, np.uint64)]
        for t in texts:
            h = np.unique(shingles(t.as_py(), shingle_words))
            votes.extend(voted(h, words))
            sizes.append(len(h))
            digests.append(digest_of(h))
            prefixes.append(rare_first(h, *common.value)[: len(h) + 1 - math.ceil(share * len(h))] if len(h) else h)
        ends = np.cumsum([len(x) for x in prefixes], dtype=np.int32)
        columns = [
            pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * words, pa.array(votes, pa.int64())),
            pa.array(sizes, pa.int64()),
            pa.array(digests, pa.int64()),
            pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prefixes).view(np.int64))),
        ]
        return pa.StructArray.from_arrays(columns, names=SET_CODE.names)

    return code(text)


def rare_first(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sorted hashes with the common ones at the end, by their counts."""
    if not len(common):
        return h
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    found = common[at] == h
    return np.r_[h[~found], h[found][np.argsort(counts[at[found]], kind="stable")]]


def digest_of(h: np.ndarray) -> int:
    """A 64-bit sum that tells sets of shingle hashes apart."""
    return int(_mixed(h, 99).sum(dtype=np.uint64).astype(np.int64)) if len(h) else 0


@dataclass
class VantageTree:
    """Arrays of a tree over 64-bit codes: inner nodes hold a vantage code and a median distance, leaves are shards."""

    vantage: np.ndarray
    median: np.ndarray
    inside: np.ndarray  #: child with distance <= median; a leaf's number is stored as -1 - number
    outside: np.ndarray
    leaves: int

    @classmethod
    def grow(cls, sample: np.ndarray, leaves: int) -> VantageTree:
        """A tree with about ``leaves`` leaves, split at the median distance; a node that can't be split is a leaf."""
        nodes, count = [], 0

        def split(codes: np.ndarray, wanted: int) -> int:
            nonlocal count
            if wanted > 1 and len(codes) > 2:
                d = np.bitwise_count(codes ^ codes[0])
                middle = int(np.median(d))
                near = d <= middle
                if near.all():
                    middle -= 1
                    near = d <= middle
                if 0 < near.sum() < len(codes):
                    nodes.append(None)
                    at = len(nodes) - 1
                    nodes[at] = (codes[0], middle, split(codes[near], wanted // 2), split(codes[~near], wanted - wanted // 2))
                    return at
            count += 1
            return -count

        if split(sample, leaves) < 0:
            return cls(*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64)), 1)
        columns = zip(*nodes, strict=True)
        return cls(*(np.array(c, dtype=t) for c, t in zip(columns, (np.uint64, np.int64, np.int64, np.int64), strict=True)), count)

    def deal(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of a code, shard, whether it is the home) such that codes within ``radius`` meet in a home of one of them.

        At a node, codes inside go outside as visitors too when the boundary is within the radius; the other way round isn't needed,
        as each pair has to meet once. Visitors go wherever the bounds let them.
        """
        out, todo = [], [(0 if len(self.vantage) else -1, np.arange(len(codes)), np.ones(len(codes), bool))]
        while todo:
            node, at, home = todo.pop()
            if node < 0:
                out.append((at, np.full(len(at), -1 - node), home))
                continue
            d = np.bitwise_count(codes[at] ^ self.vantage[node]).astype(np.int64)
            middle = self.median[node]
            near = d <= middle
            left = np.where(home, near, d <= middle + radius)
            right = np.where(home, ~near | (d > middle - radius), d > middle - radius)
            todo.append((self.inside[node], at[left], home[left]))
            todo.append((self.outside[node], at[right], home[right] & ~near[right]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    def deal_guests(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of a code, shard) as ``deal``, with all codes as visitors only."""
        out, todo = [], [(0 if len(self.vantage) else -1, np.arange(len(codes)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out.append((at, np.full(len(at), -1 - node)))
                continue
            d = np.bitwise_count(codes[at] ^ self.vantage[node]).astype(np.int64)
            todo.append((self.inside[node], at[d <= self.median[node] + radius]))
            todo.append((self.outside[node], at[d > self.median[node] - radius]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(2))


class Linker:
    """Links within a shard: a union-find that takes whole blocks of pairs."""

    BLOCK = 1 << 20

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, radius: int, wide_limit: int, min_ratio: float):
        self.first, self.codes, self.sizes = codes[:, 0].copy(), codes, sizes
        self.radius, self.wide_limit, self.min_ratio = radius, wide_limit, min_ratio
        self.group = np.arange(len(codes))

    def _accept(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of candidate pairs, those that hold on the further words and sizes."""
        if self.codes.shape[1] > 1 and len(i):
            lo, hi = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
            keep = lo >= self.min_ratio * hi
            i, j = i[keep], j[keep]
            d = sum(np.bitwise_count(self.codes[i, k] ^ self.codes[j, k]).astype(np.int64) for k in range(self.codes.shape[1]))
            keep = d <= self.wide_limit
            i, j = i[keep], j[keep]
        return i, j

    def _union(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.group[i], self.group[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.group, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.group[self.group]
                if (up == self.group).all():
                    break
                self.group = up

    def _brute(self, home: np.ndarray, guests: np.ndarray) -> None:
        rows = max(1, self.BLOCK // max(1, len(guests)))
        for k in range(0, len(home), rows):
            part = home[k : k + rows]
            i, j = np.nonzero(np.bitwise_count(self.first[part][:, None] ^ self.first[guests][None, :]) <= self.radius)
            i, j = part[i], guests[j]
            apart = self.group[i] != self.group[j]
            self._union(*self._accept(i[apart], j[apart]))

    def link(self, home: np.ndarray, guests: np.ndarray) -> None:
        """Join every home code with every guest within the radius. guests may contain home codes."""
        todo = [(home, guests)]
        while todo:
            home, guests = todo.pop()
            if not len(home) or not len(guests):
                continue
            if len(home) <= 256 or len(home) * len(guests) <= self.BLOCK:
                self._brute(home, guests)
                continue
            v = home[0]
            dh = np.bitwise_count(self.first[home] ^ self.first[v]).astype(np.int64)
            dg = np.bitwise_count(self.first[guests] ^ self.first[v]).astype(np.int64)
            if self.codes.shape[1] == 1:
                ball, guest_ball = dh <= self.radius, dg <= self.radius
                self._union(home[ball], np.full(ball.sum(), v))
                self._union(guests[guest_ball], np.full(guest_ball.sum(), v))
                if 4 * ball.sum() >= len(home):  # a dense ball is one group already: its codes aren't compared with each other
                    todo += [(home[ball], guests[~guest_ball]), (home[~ball], guests)]
                    continue
            middle = int(np.median(dh))
            near = dh <= middle
            if near.all():
                near = dh <= (middle := middle - 1)
            if not near.any() or (dg <= middle + self.radius).all() and (dg > middle - self.radius).all():
                self._brute(home, guests)
                continue
            todo.append((home[near], guests[dg <= middle + self.radius]))
            todo.append((home[~near], guests[dg > middle - self.radius]))


def block_masks(blocks: int) -> list[np.uint64]:
    """The 64 bits in ``blocks`` runs of nearly one length."""
    ends = [64 * j // blocks for j in range(blocks + 1)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(ends, ends[1:], strict=False)]


def near_links(
    codes: DataFrame,
    radius: int,
    *,
    wide_limit: int = 0,
    min_ratio: float = 0.0,
    blocks: int | None = None,
    shard_codes: int = 16384,
    most_codes: int = 131_072,
    max_sample: int = 50_000,
) -> DataFrame:
    """A forest (a, b) that joins all codes linked directly or through others. ``codes``: distinct (id, words, n_shingles).

    ``blocks`` of the first word have a tree each, by default one more than the radius. With ``min_ratio`` codes are also dealt into bands
    of size, and meet codes of the same and of the next band: sizes outside the ratio never meet. A shard of over ``most_codes`` is cut
    into pieces, and a task takes a pair of pieces. The sample that shapes the trees is the ``max_sample`` smallest hashes at most and
    changes the speed only.
    """
    spark = codes.sparkSession
    blocks = radius + 1 if blocks is None else blocks
    reach, masks = radius // blocks, block_masks(blocks)
    n = codes.count()
    leaves = max(1, -(-n // shard_codes))
    wanted = min(max_sample, 64 * leaves)
    first = F.col("words")[0]
    share = min(1.0, 2 * wanted / max(1, n))
    drawn = codes.filter(F.pmod(F.xxhash64(first), F.lit(1 << 30)) <= int(share * (1 << 30))).select(first.alias("w")).orderBy(F.xxhash64("w")).limit(wanted)
    sample = np.array([r["w"] for r in drawn.collect()], dtype=np.int64).view(np.uint64)
    trees = spark.sparkContext.broadcast([VantageTree.grow(sample & mask, leaves) for mask in masks])
    width = np.log(1 / min_ratio) if min_ratio else 0.0

    def deal(batches):
        for batch in batches:
            if not len(batch):
                continue
            words = batch.column("words")
            flat = np.asarray(words.flatten()).reshape(len(batch), -1)[:, 0].copy().view(np.uint64)
            sizes = np.asarray(batch.column("n_shingles"))
            band = np.floor(np.log(np.maximum(sizes, 1)) / width).astype(np.int64) if width else np.zeros(len(batch), np.int64)
            for j, (tree, mask) in enumerate(zip(trees.value, masks, strict=True)):
                at, leaf, home = tree.deal(flat & mask, reach)
                leaf = band[at] * tree.leaves + leaf
                if width:  # all of them visit the next band as well
                    at2, leaf2 = tree.deal_guests(flat & mask, reach)
                    leaf = np.r_[leaf, (band[at2] + 1) * tree.leaves + leaf2]
                    at, home = np.r_[at, at2], np.r_[home, np.zeros(len(at2), bool)]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), pa.array(np.full(len(at), j, np.int32)), pa.array(home), batch.column("id").take(take), words.take(take), pa.array(sizes[at])],
                    names=["shard", "part", "home", "id", "words", "n_shingles"],
                )

    def join(shard: pa.Table) -> pa.Table:
        home = np.asarray(shard.column("home").combine_chunks().cast(pa.int8())).astype(bool)
        ids = np.asarray(shard.column("id").combine_chunks())
        lists = shard.column("words").combine_chunks()
        flat = np.asarray(lists.flatten()).view(np.uint64).reshape(len(ids), -1)
        linker = Linker(flat, np.asarray(shard.column("n_shingles").combine_chunks()), radius, wide_limit, min_ratio)
        if reach:
            linker.link(np.flatnonzero(home), np.arange(len(ids)))
        else:  # a pair within the radius agrees on a block: only those that agree on this one meet here
            value = flat[:, 0] & masks[shard.column("part")[0].as_py()]
            order = np.argsort(value, kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
                if len(same) > 1:
                    linker.link(same[home[same]], same)
        smallest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(smallest, linker.group, ids)
        root = smallest[linker.group]
        apart = root != ids
        return pa.table({"a": ids[apart], "b": root[apart]})

    dealt = codes.select("id", "words", "n_shingles").mapInArrow(deal, "shard long, part int, home boolean, id long, words array<long>, n_shingles long")
    dealt = materialise(dealt, "dealt")
    large = dealt.groupBy("part", "shard").agg(F.count("*").alias("n")).filter(F.col("n") > most_codes)
    pieces = side(materialise(large.select("part", "shard", F.ceil(F.col("n") * 2 / most_codes).cast("int").alias("pieces")), "large"))
    held = dealt.join(pieces, ["part", "shard"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    held = held.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    held = held.withColumn("lo", F.least("piece", "other")).withColumn("hi", F.greatest("piece", "other"))
    return held.groupBy("part", "shard", "lo", "hi").applyInArrow(join, "a long, b long")


def common_shingles(docs: DataFrame, shingle_words: int, *, rate: int = 64, least: int = 32, most: int = 2_000_000) -> DataFrame:
    """(h, n): shingles of at least ``least`` texts among one in ``rate`` rows (key, text), and in how many.

    The rows are those whose key has a hash divisible by ``rate``, so that the work grows with the table and a shingle of some
    rate x least rows is found wherever it stands. The list only orders prefixes and cuts large groups: links don't depend on it, nor on
    the ``most`` frequent ones being all that is kept.
    """

    def sets(batches):
        for batch in batches:
            h = [np.unique(shingles(t.as_py(), shingle_words)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *h]).view(np.int64))], names=["h"])

    drawn = docs.filter("key is not null").filter(F.pmod(F.xxhash64(F.lit("drawn"), "key"), F.lit(rate)) == 0).select("text")
    counted = drawn.mapInArrow(sets, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return materialise(counted.orderBy(F.desc("n"), "h").limit(most), "common")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges a - b but the smallest of its component, and that smallest."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        root = root[root]
    while (root != root[root]).any():
        root = root[root]
    apart = root != np.arange(len(nodes))
    return nodes[apart], nodes[root[apart]]


def candidate_pairs(h: np.ndarray, ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, guest: np.ndarray, cross: bool, limit: int, min_jaccard: float, short_run: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the candidates among rows that share a hash: sizes and fingerprints allow the similarity.

    Runs of up to ``short_run`` rows are compared at all distances at once, longer ones by ``linked``, which leaves out pairs already joined.
    """
    share = Fraction(str(min_jaccard))
    order = np.lexsort((sizes, h))
    h, ids, sizes, codes, guest = h[order], ids[order], sizes[order], codes[order], guest[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    runs = np.diff(np.r_[starts, len(h)])
    large = (runs > 1) if cross else (runs > short_run)
    small = np.repeat(~large, runs)
    a, b = [ids[:0]], [ids[:0]]
    for d in range(1, 1 if cross else short_run):
        i = np.flatnonzero((h[d:] == h[:-d]) & small[:-d])
        if not len(i):
            break
        i = i[sizes[i] * share.denominator >= sizes[i + d] * share.numerator]
        i = i[(np.bitwise_count(codes[i] ^ codes[i + d]).sum(axis=1, dtype=np.int64) <= limit) | (sizes[i] <= SHORT)]
        a.append(ids[i])
        b.append(ids[i + d])
    for start, n in zip(starts[large].tolist(), runs[large].tolist(), strict=True):
        at = slice(start, start + n)
        group = linked(sizes[at], codes[at], None, guest[at], cross, limit, min_jaccard)
        smallest = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, ids[at])
        a.append(ids[at])
        b.append(smallest[group])
    return forest(np.concatenate(a), np.concatenate(b))


def prefix_links(codes: DataFrame, common: DataFrame, limit: int, min_jaccard: float, *, rate: int = 64, slice_rows: int = 200_000, most_rows: int = 131_072) -> DataFrame:
    """A forest (a, b) of candidates: codes (id, words, n_shingles, prefix) that share a shingle of their prefixes.

    Rows meet by shingle, many shingles to a slice. A shingle of over ``most_rows`` rows, by its count in ``common``, has slices of its
    own: its rows are cut into pieces, and a task takes a pair of pieces. Two words of the fingerprints, if there are as many, filter.
    """
    n = codes.agg(F.sum(F.size("prefix").cast("long"))).first()[0] or 0
    slices = max(64, -(-n // slice_rows))
    heavy = common.select("h", F.ceil(F.col("n") * (2 * rate) / most_rows).cast("int").alias("pieces")).filter("pieces > 2")
    held = codes.select("id", "n_shingles", F.slice("words", 1, 2).alias("words"), F.explode("prefix").alias("h"))
    held = held.join(side(heavy), "h", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    held = held.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    held = held.withColumn("lo", F.least("piece", "other")).withColumn("hi", F.greatest("piece", "other"))
    own = F.when(F.col("pieces") == 1, F.pmod(F.xxhash64("h"), F.lit(slices))).otherwise(F.col("h"))
    held = held.select(own.alias("slice"), (F.col("pieces") > 1).alias("large"), "lo", "hi", (F.col("piece") > F.col("lo")).alias("guest"), "h", "id", "words", "n_shingles")

    def meet(part: pa.Table) -> pa.Table:
        h, ids, sizes = (np.asarray(part.column(c).combine_chunks()) for c in ("h", "id", "n_shingles"))
        words = np.asarray(part.column("words").combine_chunks().flatten()).view(np.uint64).reshape(len(ids), -1)
        guest = np.asarray(part.column("guest").combine_chunks().cast(pa.int8())).astype(bool)
        a, b = candidate_pairs(h, ids, sizes, words, guest, part.column("lo")[0] != part.column("hi")[0], limit, min_jaccard)
        return pa.table({"a": a, "b": b})

    return held.groupBy("slice", "large", "lo", "hi").applyInArrow(meet, "a long, b long")


def linked(size: np.ndarray, codes: np.ndarray, sets: list[np.ndarray] | None, guest: np.ndarray, cross: bool, limit: int, min_jaccard: float) -> np.ndarray:
    """The group of each position by all pairs that hold; of ``cross``, only those of a guest and another.

    A group grows from a first member by comparing each of its members with all that are in no group yet, so that copies of copies cost
    little. A pair holds if sizes and fingerprints (or shortness) allow it and, with ``sets``, their exact similarity.
    """
    share = Fraction(str(min_jaccard))
    p, q = share.numerator, share.denominator
    order = np.argsort(size, kind="stable")
    size, codes, guest = size[order], codes[order], guest[order]
    left = [np.flatnonzero(~guest), np.flatnonzero(guest)] if cross else [np.arange(len(size))]
    group = np.arange(len(size))
    while len(left[0]) and len(left[-1]):
        first, left[0] = int(left[0][0]), left[0][1:]
        todo = [(first, 0)]
        while todo:
            i, own = todo.pop()
            other = 1 - own if cross else 0
            ends = np.searchsorted(size, -(-size[i] * p // q), "left"), np.searchsorted(size, size[i] * q // p, "right")
            lo, hi = np.searchsorted(left[other], ends)
            j = left[other][lo:hi]
            if not len(j) or not size[i]:
                continue
            hold = (np.bitwise_count(codes[j] ^ codes[i]).sum(axis=1, dtype=np.int64) <= limit) | (np.minimum(size[j], size[i]) <= SHORT)
            if sets is not None and hold.any():
                near = np.flatnonzero(hold)
                mine, flat, n = sets[order[i]], np.concatenate([sets[order[x]] for x in j[near]]), size[j[near]]
                at = np.minimum(np.searchsorted(mine, flat), size[i] - 1)
                shared = np.add.reduceat(mine[at] == flat, np.r_[0, np.cumsum(n)[:-1]], dtype=np.int64)
                hold[near] = shared * (p + q) >= p * (size[i] + n)
            if hold.any():
                found = j[hold]
                group[found] = first
                todo.extend((x, other) for x in found.tolist())
                left[other] = np.r_[left[other][:lo], j[~hold], left[other][hi:]]
    out = np.empty_like(group)
    out[order] = group
    return out


def verified_links(docs: DataFrame, candidates: DataFrame, shingle_words: int, wide_limit: int, min_jaccard: float, tile_shingles: int) -> DataFrame:
    """A forest (a, b) of the pairs of ``candidates`` (id, root, words, n_shingles, digest) whose shingle sets are similar enough.

    ``docs``: (key, text). Pairs are sought within a root. Small groups share a tile; a group over ``tile_shingles`` is cut into blocks,
    and a tile is a pair of blocks, so that no task holds more than two blocks.
    """
    weight = F.col("n_shingles") + 8
    groups = materialise(candidates.groupBy("root").agg(F.sum(weight).alias("weight")), "groups")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    tiles = max(64, -(-total // tile_shingles))
    groups = groups.select("root", F.ceil(F.col("weight") / tile_shingles).cast("int").alias("blocks"))
    members = candidates.join(groups, "root").withColumn("block", F.pmod(F.xxhash64("id", "digest"), F.col("blocks")).cast("int"))
    members = members.select("id", "root", "words", "digest", "blocks", "block")
    texts = docs.filter("key is not null").join(members.select(F.col("id").alias("key")).distinct(), "key").select("key", "text")

    def sets(batches):
        for batch in batches:
            h = [np.unique(shingles(t.as_py(), shingle_words)) for t in batch.column("text")]
            found = [pa.array([digest_of(x) for x in h], pa.int64()), pa.array([x.view(np.int64) for x in h], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *found], names=["id", "digest", "shingles"])

    held = texts.mapInArrow(sets, "id long, digest long, shingles array<long>").dropDuplicates(["id", "digest"]).join(members, ["id", "digest"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    held = held.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    tile = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(tiles))).otherwise(F.col("root"))
    held = held.select(tile.alias("tile"), (F.col("blocks") > 1).alias("large"), "lo", "hi", (F.col("block") > F.col("lo")).alias("guest"), "id", "root", "words", "shingles")

    def verify(tile: pa.Table) -> pa.Table:
        ids, roots = np.asarray(tile.column("id").combine_chunks()), np.asarray(tile.column("root").combine_chunks())
        guest = np.asarray(tile.column("guest").combine_chunks().cast(pa.int8())).astype(bool)
        codes = np.asarray(tile.column("words").combine_chunks().flatten()).view(np.uint64).reshape(len(ids), -1)
        lists = tile.column("shingles").combine_chunks()
        flat, ends = np.asarray(lists.flatten()).view(np.uint64), np.cumsum(np.asarray(lists.value_lengths()))
        cross = tile.column("lo")[0] != tile.column("hi")[0]
        order = np.argsort(roots, kind="stable")
        a, b = [ids[:0]], [ids[:0]]
        for at in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            sets = [flat[ends[k - 1] if k else 0 : ends[k]] for k in at]
            group = linked(np.array([len(x) for x in sets], dtype=np.int64), codes[at], sets, guest[at], cross, wide_limit, min_jaccard)
            smallest = np.full(len(at), np.iinfo(np.int64).max)
            np.minimum.at(smallest, group, ids[at])
            root = smallest[group]
            apart = root != ids[at]
            a.append(ids[at][apart])
            b.append(root[apart])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return held.groupBy("tile", "large", "lo", "hi").applyInArrow(verify, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = 4,
    radius: int = 4,
    words: int = 1,
    repeats: bool = True,
    wide_limit: int = 0,
    min_ratio: float = 0.0,
    blocks: int | None = None,
    shard_codes: int = 16384,
    min_jaccard: float = 0.0,
    near_limit: int = 128,
    tile_shingles: int = 2_000_000,
) -> DataFrame:
    """One row (key, words, n_shingles, component_id) per row of ``docs``.

    Rows link when the first 64-bit words of their fingerprints differ in at most ``radius`` bits and, with more words, all words in at
    most ``wide_limit`` bits and the numbers of shingles by no more than ``min_ratio``. component_id is the smallest key reachable,
    the row's own included. Null and empty texts share the zero fingerprint. Rows with a null key keep their fingerprint and take the
    component of the other rows that have it, if any; repeated rows stay. Keys are integers. An empty table gives no rows.

    With ``min_jaccard`` (sets of shingles, so without ``repeats``) texts within ``radius`` are candidates, and beyond it those that share a
    shingle of their prefixes if the first two words of their fingerprints differ in ``near_limit`` bits at most and all in
    ``wide_limit``, or if they are short. A pair links if the exact Jaccard similarity of its sets is ``min_jaccard`` or more.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be of an integer type")
    shape = {"wide_limit": wide_limit, "min_ratio": min_ratio, "blocks": blocks, "shard_codes": shard_codes}
    if min_jaccard:
        return _verified_duplicates(docs, key, text, shingle_words, words, radius, shape, near_limit, min_jaccard, tile_shingles)
    rows = docs.select(F.col(key).alias("key"), coded(F.col(text), shingle_words, words, repeats).alias("code"))
    rows = materialise(rows.select("key", "code.words", "code.n_shingles"), "codes")
    same = ["words"] if not min_ratio else ["words", "n_shingles"]
    size = F.lit(0).cast("long") if not min_ratio else F.col("n_shingles")
    by_code = rows.select("key", "words", size.alias("n_shingles"))
    codes = by_code.filter("key is not null").groupBy("words", "n_shingles").agg(F.min("key").alias("id"))
    codes = materialise(codes, "distinct")
    found = components(near_links(codes, radius, **shape))
    classes = codes.join(found, codes["id"] == found["node"], "left").select("words", "n_shingles", F.coalesce("root", "id").alias("component_id"))
    if not min_ratio:
        classes = classes.drop("n_shingles")
    return rows.join(classes, same, "left").select(F.col("key").alias(key), "words", "n_shingles", "component_id")


def _verified_duplicates(docs: DataFrame, key: str, text: str, shingle_words: int, words: int, radius: int, shape: dict, near_limit: int, min_jaccard: float, tile_shingles: int) -> DataFrame:
    """``near_duplicates`` with ``min_jaccard``: rows are alike as they have the same set of shingles, not the same fingerprint."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    common = common_shingles(docs, shingle_words)
    listed = common.toArrow()  # ``most`` rows of two longs at most
    h, n = (np.asarray(listed.column(c).combine_chunks()) for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast((h.view(np.uint64)[order], n[order]))
    rows = docs.select("key", coded_sets(F.col("text"), shingle_words, words, min_jaccard, shared).alias("code"))
    rows = materialise(rows.select("key", "code.*"), "codes")
    same = ["words", "n_shingles", "digest"]
    codes = materialise(rows.filter("key is not null").groupBy(*same).agg(F.min("key").alias("id"), F.first("prefix").alias("prefix")), "distinct")
    two_words = codes.select("id", F.slice("words", 1, 2).alias("words"), "n_shingles")
    by_trees = near_links(two_words, radius, **(shape | {"wide_limit": near_limit, "min_ratio": 0.0}))
    by_prefixes = prefix_links(codes, common, near_limit, min_jaccard)
    near = materialise(components(by_trees.unionByName(by_prefixes)), "candidates")
    candidates = materialise(codes.join(near, codes["id"] == near["node"]).select("id", "root", *same), "candidates")
    found = components(verified_links(docs, candidates, shingle_words, shape["wide_limit"], min_jaccard, tile_shingles))
    classes = codes.join(found, codes["id"] == found["node"], "left").select(*same, F.coalesce("root", "id").alias("component_id"))
    return rows.join(classes, same, "left").select(F.col("key").alias(key), "words", "n_shingles", "component_id")


#: Exact similarity of five-word shingles of 0.8 or more. Sets of likeness J differ in a share p of the bits with
#: cos(pi p) = 2 J / (1 + J): 0.152 at 0.8, with a deviation of 8 in 512 bits and 4.1 in 128; the limits for candidates stand seven and
#: six deviations above. Sets of up to SHORT shingles, where p is up to 0.19, don't depend on them.
SIMILAR = {"shingle_words": 5, "words": 8, "repeats": False, "wide_limit": 140, "near_limit": 44, "min_jaccard": 0.8}


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """``docs`` without the rows that are linked to a row with a smaller key: one document of each group stays.

    Without parameters, links are those of SIMILAR. Rows with a null key stay; of repeated rows of a key one stays.
    """
    rows = near_duplicates(docs, key=key, text=text, **(parameters or SIMILAR))
    rows = materialise(rows.select(F.col(key).alias("_k"), "component_id"), "classes")
    n, distinct = rows.filter("_k is not null").agg(F.count("*"), F.countDistinct("_k")).first()
    out = docs.join(side(rows.filter("component_id <> _k").select("_k").distinct()), F.col(key) == F.col("_k"), "left_anti")
    if n != distinct:
        out = out.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(docs.filter(F.col(key).isNull()))
    return out
