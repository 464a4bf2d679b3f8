"""Bloom filter cascades: exact membership of a list among all keys of a corpus, from filters that only approximate it.

The first filter holds the listed keys. Some other keys of the corpus pass it too; the second filter holds those. Some listed keys pass the
second by chance; the third holds them, and so on until a filter lets nothing through by mistake. A key is a member if the first filter
that it doesn't pass is the second, the fourth, and so on. That is right for every key of the corpus, since all of them were tried.

Keys are dealt to shards by their hash. A shard's cascade is built in one task, over some ``SHARD_KEYS`` keys at any size of the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasespark.llm.common import BROADCAST_BYTES, materialise

#: Keys of a shard, about; and the least number of shards, so that a small corpus is spread too.
SHARD_KEYS, LEAST_SHARDS = 1 << 16, 64
#: Filters of a shard; a cascade halves at each, so that more means that a listed key is also unlisted.
MOST_LEVELS = 200
_ODD = 0x9E3779B97F4A7C15


def hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes of a string. Keys are told apart by these 128 bits."""
    return [F.xxhash64(key), F.xxhash64(F.lit("second"), key)]


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """The hashes stirred anew for a level, so that the mistakes of two filters are independent."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64) + np.uint64((_ODD * (level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, probe: int, bits) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mixed(h1, level) + np.uint64(probe) * (_mixed(h2, level) | np.uint64(1))) % bits


def levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """The filters of one shard as (bits, probes, bytes)."""
    inside, outside, out = np.flatnonzero(listed), np.flatnonzero(~listed), []
    while len(inside):
        if len(out) == MOST_LEVELS:
            raise ValueError("two keys agree in 128 bits of hash, and only one is listed")
        share = min(0.5, len(inside) * math.sqrt(0.5) / max(1, len(outside))) if not out else 0.5
        probes = max(1, round(-math.log2(share)))
        bits = max(8, math.ceil(len(inside) * probes / math.log(2)))
        flags = np.zeros(bits, dtype=np.uint8)
        passed = np.ones(len(outside), dtype=bool)
        for j in range(probes):
            flags[_places(h1[inside], h2[inside], len(out), j, np.uint64(bits))] = 1
        for j in range(probes):
            passed &= flags[_places(h1[outside], h2[outside], len(out), j, np.uint64(bits))] == 1
        out.append((bits, probes, np.packbits(flags, bitorder="little")))
        inside, outside = outside[passed], inside
    return out


def build(keys: DataFrame) -> tuple[DataFrame, int]:
    """(shard, level, bits, probes, filter) for rows (h1, h2, listed, known) of keys in any number, and the number of shards.

    A key is listed if any of its rows is; those that no row knows of (that aren't in the corpus) are left out. Repeated rows are taken
    together before they are shuffled. No rows give no filters: then nothing is a member.
    """
    own = keys.groupBy("h1", "h2").agg(F.max("listed").alias("listed"), F.max("known").alias("known"))
    own = materialise(own.filter("known").select("h1", "h2", "listed"), "keys")
    shards = max(LEAST_SHARDS, math.ceil(own.count() / SHARD_KEYS))

    def one(part: pa.Table) -> pa.Table:
        h1, h2, listed = (np.asarray(part.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in ("h1", "h2", "listed"))
        found = levels(h1.astype(np.int64), h2.astype(np.int64), listed.astype(bool))
        shard = part.column("shard")[0].as_py()
        return pa.table(
            {
                "shard": pa.array([shard] * len(found), pa.int64()),
                "level": pa.array(range(len(found)), pa.int32()),
                "bits": pa.array([f[0] for f in found], pa.int64()),
                "probes": pa.array([f[1] for f in found], pa.int32()),
                "filter": pa.array([f[2].tobytes() for f in found], pa.binary()),
            }
        )

    dealt = own.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return materialise(dealt.groupBy("shard").applyInArrow(one, "shard long, level int, bits long, probes int, filter binary"), "cascade"), shards


@dataclass
class Cascade:
    """Filters of many shards, each level's bytes end to end."""

    shards: int
    bits: list[np.ndarray]
    probes: list[np.ndarray]
    starts: list[np.ndarray]
    filters: list[np.ndarray]

    @classmethod
    def of(cls, rows, shards: int) -> Cascade:
        """From rows (shard, level, bits, probes, filter)."""
        out, size = cls(shards, [], [], [], []), 0
        for r in sorted(rows, key=lambda r: (r["level"], r["shard"])):
            if r["level"] == len(out.bits):
                for x in (out.bits, out.probes, out.starts):
                    x.append(np.zeros(shards, dtype=np.int64))
                out.filters.append([])
                size = 0
            out.bits[-1][r["shard"]], out.probes[-1][r["shard"]], out.starts[-1][r["shard"]] = r["bits"], r["probes"], size * 8
            out.filters[-1].append(np.frombuffer(r["filter"], dtype=np.uint8))
            size += len(r["filter"])
        out.filters = [np.concatenate(f) for f in out.filters]
        return out

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which keys are members. Right for keys of the corpus; others get an answer of a Bloom filter."""
        shard = h1 % np.int64(self.shards)
        member, at = np.zeros(len(h1), dtype=bool), np.arange(len(h1))
        for level, (bits, probes, starts, filters) in enumerate(zip(self.bits, self.probes, self.starts, self.filters, strict=True)):
            at = at[bits[shard[at]] > 0]
            for j in range(int(probes.max(initial=0))):
                s = shard[at]
                place = starts[s] + _places(h1[at], h2[at], level, j, bits[s].astype(np.uint64)).astype(np.int64)
                passed = (filters[place >> 3] >> (place & 7).astype(np.uint8)) & 1
                at = at[(passed == 1) | (probes[s] <= j)]
            member[at] = level % 2 == 0  # passed this one: decided otherwise only by passing the next
        return member


def parts(table: DataFrame, most: int = BROADCAST_BYTES) -> list[tuple[int, int]]:
    """Ranges of shards whose filters take ``most`` bytes at most (a shard at least): one range for nearly all lists.

    Sizes are counted before any filter is fetched.
    """
    sizes = {r["shard"]: r["size"] for r in table.groupBy("shard").agg(F.sum(F.octet_length("filter") + 64).alias("size")).collect()}
    out: list[tuple[int, int]] = []
    room = 0
    for shard in sorted(sizes):
        if not out or sizes[shard] > room:
            out.append((shard, shard))
            room = most
        out[-1] = (out[-1][0], shard)
        room -= sizes[shard]
    return out


def fetch(table: DataFrame, shards: int, part: tuple[int, int]) -> Cascade:
    """The cascades of a range of shards; nothing is a member in the others."""
    return Cascade.of(table.filter(F.col("shard").between(*part)).collect(), shards)
