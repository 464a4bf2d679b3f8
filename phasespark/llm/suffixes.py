"""Removal of byte strings that an earlier document has, with suffix arrays over what can repeat.

Every window of ``width`` bytes is anchored at its smallest k-byte hash, so equal windows have equal anchors wherever they stand. The
windows of one anchor occurrence form a unit. Units are gathered by anchor, over shards of the hash space, a batch of documents sending
each distinct unit once. A unit whose whole text occurs in an earlier document is settled by that. Where units of one anchor differ,
their texts are gathered in a shard and sorted: suffixes smaller than their successors directly, all others induced from them by bucket
scans; adjacent common prefixes of at least ``width`` bytes give the repeated windows and the smallest document that has each.

An anchor of very many different units (a short phrase that many texts share) would fill one task. A batch that has more than
``hot_units`` of them offers a mark in their place, and the windows of such an anchor, as of one with more than ``hot_anchor`` units in
all, are dealt one by one by their own hash and sorted there: equal windows meet, whatever stands around them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasespark.llm.blobs import packed, unpacked
from phasespark.llm.common import materialise

NO_ID = np.iinfo(np.int64).max  #: stands for a null key: earlier than nothing
BITS = 48
U = np.uint64


# --- suffix sorting -------------------------------------------------------------------------------------------------------------


def _words(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as big-endian numbers; x has at least 8 bytes after each."""
    out = np.zeros(len(at), dtype=U)
    for j in range(8):
        out = (out << U(8)) | x[at + j].astype(U)
    return out


def _sorted_to(x: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the suffixes' first ``depth`` bytes: 8 at a time, only those still tied."""
    at = at[np.argsort(_words(x, at), kind="stable")]
    key = _words(x, at)
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    for done in range(8, depth, 8):
        tied = np.flatnonzero(np.r_[group[1:] == group[:-1], False] | np.r_[False, group[1:] == group[:-1]])
        if not len(tied):
            break
        key = _words(x, at[tied] + done)
        order = np.lexsort((key, group[tied]))
        at[tied], key, own = at[tied][order], key[order], group[tied]
        new = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
        split = np.zeros(len(at), bool)
        split[tied] = new
        edge = np.r_[True, group[1:] != group[:-1]] | split
        group = np.cumsum(edge)
    return at


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """All positions of a uint8 array in the order of their suffixes, to the first ``depth`` bytes at least (ties in any order)."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    x = np.r_[text, np.zeros(depth + 16, np.uint8)]
    step = np.sign(x[1 : n + 1].astype(np.int16) - x[:n].astype(np.int16))
    step[n - 1] = -1 if text[n - 1] else 1  # the end is smaller than any byte but the lowest
    change = np.where(step != 0, np.arange(n), n - 1)
    smaller = step[np.minimum.accumulate(change[::-1])[::-1]] > 0  # than the successor
    direct = _sorted_to(x, np.flatnonzero(smaller), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not smaller[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))

    def induce(at: np.ndarray) -> None:
        if not len(at):
            return
        first = text[at]
        order = np.argsort(first, kind="stable")
        at, first = at[order], first[order]
        cut = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        for c, part in zip(first[cut].tolist(), np.split(at, cut[1:]), strict=True):
            waiting[c].append(part)

    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(wave):  # runs of one byte: one wave for each length
            out.append(wave)
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            same = text[before] == c
            induce(before[~same])
            wave = before[same]
        mine = direct[bounds[c] : bounds[c + 1]]
        out.append(mine)
        before = mine[mine > 0] - 1
        induce(before[~smaller[before]])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each position in ``order`` but the first: bytes shared with the one before, at most ``limit`` (rounded up to 8)."""
    x = np.r_[text, np.zeros(limit + 16, np.uint8)]
    a, b = order[:-1], order[1:]
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for done in range(0, limit, 8):
        if not len(live):
            break
        differ = _words(x, a[live] + done) ^ _words(x, b[live] + done)
        lead = np.where(differ == 0, 8, 0)
        some = np.flatnonzero(differ)
        for j in range(1, 8):
            lead[some] += (differ[some] >> U(64 - 8 * j)) == 0
        out[live] += lead
        live = live[differ == 0]
    return out


def repeated_windows(texts: list[bytes], owners: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text, a mask over its windows: whether a text of a smaller owner has the same ``width`` bytes."""
    lengths = np.array([len(t) for t in texts])
    x = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(lengths)
    which = np.repeat(np.arange(len(texts)), lengths)
    valid = np.arange(len(x)) + width <= ends[which]
    order = suffix_order(x, width)
    order = order[valid[order]]
    flags = np.zeros(len(x), bool)
    if len(order):
        new = np.r_[True, common_prefixes(x, order, width) < width]
        starts = np.flatnonzero(new)
        own = owners[which[order]]
        least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.r_[starts, len(order)]))
        flags[order] = least < own
    return [flags[e - n : max(e - n, e - width + 1)] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


# --- anchors --------------------------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


STEP = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(STEP, -1, 1 << 64)
LETTER = _mix(np.arange(1, 257, dtype=U) * U(STEP))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        out = np.full(n + n // 4 + 1, base, dtype=U)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


@dataclass
class Units:
    """The units of a batch in text order, and its distinct (anchor, content) pairs in sorted order."""

    start: np.ndarray  #: first window
    count: np.ndarray  #: windows
    doc: np.ndarray  #: position of the document in the batch
    pair: np.ndarray  #: position among the distinct pairs
    anchor: np.ndarray  #: of the distinct pairs
    content: np.ndarray
    least: np.ndarray  #: smallest key among the batch's documents with the pair
    first: np.ndarray  #: a unit of that document


def units(x: np.ndarray, lengths: np.ndarray, keys: np.ndarray, width: int, k: int) -> Units:
    """x: the documents' bytes in a row."""
    none = np.zeros(0, np.int64)
    w = width - k + 1
    if len(x) < width:
        return Units(*(none for _ in range(8)))
    n = len(x)
    prefix = np.zeros(n + 1, dtype=U)
    np.cumsum(LETTER[x] * _power(STEP, n), out=prefix[1:])
    back = _power(INVERSE, n)
    gram = _mix((prefix[k:] - prefix[:-k]) * back[: n - k + 1])
    low = U(0xFFFFFF)
    least = (gram & ~low) | (np.arange(len(gram), dtype=U) & low)
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    begin = np.flatnonzero(np.arange(len(least)) + width <= ends[doc])
    least, doc = least[begin], doc[begin]
    if not len(begin):
        return Units(*(none for _ in range(8)))
    cut = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    start, count, doc = begin[cut], np.diff(np.r_[cut, len(begin)]), doc[cut]
    at = start + ((least[cut] & low).astype(np.int64) - start) % (1 << 24)
    top = U(64 - BITS)
    anchor = _mix(gram[at] + U(STEP)) >> top  # hashed anew: being minima, the hashes themselves crowd at the low end
    stop = start + count + width - 1
    content = _mix((prefix[stop] - prefix[start]) * back[start] + count.astype(U)) >> top
    owner = keys[doc]
    order = np.lexsort((owner, content, anchor))
    a, c = anchor[order], content[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    first = order[new]
    return Units(start, count, doc, pair, anchor[first], content[first], owner[first], first)


@dataclass
class Batch:
    """Documents packed in one row: their keys and bytes."""

    keys: np.ndarray
    lengths: np.ndarray
    x: np.ndarray

    @staticmethod
    def pack(keys: list[int | None], texts: list[bytes]) -> tuple[bytes, bytes]:
        own = np.array([NO_ID if k is None else k for k in keys], dtype=np.int64)
        return packed(own, np.array([len(t) for t in texts])), zstandard.ZstdCompressor(level=3).compress(b"".join(texts))

    @classmethod
    def unpack(cls, head: bytes, body: bytes) -> Batch:
        keys, lengths = unpacked(head, 2)
        return cls(keys, lengths, np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=np.uint8))


def _rows(batch: pa.RecordBatch, *names: str):
    columns = [batch.column(n) for n in names]
    for i in range(len(batch)):
        yield tuple(c[i].as_py() for c in columns)


# --- the distributed steps ------------------------------------------------------------------------------------------------------


HOT = -1  #: in place of a content: the batch has more units of the anchor than it offers


@dataclass
class Windows:
    """The distinct windows of a batch's hot anchors, by shard of their hash."""

    start: np.ndarray  #: of each occurrence
    doc: np.ndarray
    which: np.ndarray  #: position of an occurrence's window among the distinct ones
    text: np.ndarray  #: the distinct windows, a row each
    least: np.ndarray  #: smallest key among their documents
    cut: np.ndarray  #: first distinct window of each shard


def hot_windows(b: Batch, u: Units, anchors: np.ndarray, width: int, shards: int) -> Windows:
    at = np.flatnonzero(np.isin(u.anchor[u.pair], anchors))
    start = np.repeat(u.start[at], u.count[at]) + np.arange(u.count[at].sum()) - np.repeat(np.cumsum(u.count[at]) - u.count[at], u.count[at])
    doc = np.repeat(u.doc[at], u.count[at])
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b.x, width)[start]) if len(start) else np.zeros((0, width), np.uint8)
    _, first, which = np.unique(rows.view(f"V{width}").ravel(), return_index=True, return_inverse=True)
    text, h = rows[first], np.full(len(first), STEP, dtype=U)
    for j in range(width):
        h = _mix((h + LETTER[text[:, j]]) * U(STEP))
    least = np.full(len(first), NO_ID)
    np.minimum.at(least, which, b.keys[doc])
    shard = ((h >> U(32)).astype(np.int64) * shards) >> 32
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Windows(start, doc, place[which], text[order], least[order], np.searchsorted(shard[order], np.arange(shards + 1)))


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    width: int = 50,
    k: int = 20,
    batch_bytes: int = 2 << 20,
    shard_bytes: int = 16 << 20,
    hot_units: int = 16,
    hot_anchor: int = 4096,
) -> DataFrame:
    """One row (key, n_bytes, n_removed, n_spans, kept binary) per row of ``docs``.

    A byte goes if some ``width``-byte string over it also starts in a row with a smaller key; strings are judged on the input. Null and
    empty texts keep nothing and lose nothing. Rows of one and the same key don't take from each other; a null key is larger than all
    others. Keys are integers. Extra columns are dropped; an empty table gives no rows.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be of an integer type")

    def pack(batches):
        from pyspark import TaskContext

        number, keys, texts, size = TaskContext.get().partitionId() << 24, [], [], 0

        def row():
            head, body = Batch.pack(keys, texts)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([head], pa.binary()), pa.array([body], pa.binary())], names=["batch", "size", "head", "body"])

        for batch in batches:
            for i, t in _rows(batch, "key", "text"):
                raw = (t or "").encode("utf-8", "replace")
                if texts and (size + len(raw) > batch_bytes or len(texts) >= 65536):
                    yield row()
                    number, keys, texts, size = number + 1, [], [], 0
                keys.append(i)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield row()

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    batches_ = materialise(source.mapInArrow(pack, "batch long, size long, head binary, body binary"), "batches")
    total = batches_.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, min(1 << 20, total // shard_bytes))

    def found(head: bytes, body: bytes) -> tuple[Batch, Units, np.ndarray]:
        b = Batch.unpack(head, body)
        u = units(b.x, b.lengths, b.keys, width, k)
        # shards are ranges of anchors, so those of the sorted pairs follow each other
        shard = (u.anchor.astype(U) >> U(BITS - 32)).astype(np.int64) * shards >> 32
        return b, u, np.searchsorted(shard, np.arange(shards + 1))

    def offer(batches):
        for batch in batches:
            for number, head, body in _rows(batch, "batch", "head", "body"):
                _, u, cut = found(head, body)
                some = np.flatnonzero(np.diff(cut))
                new = np.flatnonzero(np.r_[True, u.anchor[1:] != u.anchor[:-1]]) if len(u.anchor) else np.zeros(0, np.int64)
                size = np.diff(np.r_[new, len(u.anchor)])
                many = np.repeat(size > hot_units, size)
                content = np.where(many, HOT, u.content.astype(np.int64))
                offered = ~many
                offered[new] = True
                blobs = []
                for s in some.tolist():
                    index = np.flatnonzero(offered[cut[s] : cut[s + 1]])
                    at = cut[s] + index
                    blobs.append(packed(index, u.anchor[at], content[at], u.least[at]))
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), number)), pa.array(blobs, pa.binary())], names=["shard", "batch", "blob"])

    def settle(shard: pa.Table) -> pa.Table:
        numbers, parts = np.asarray(shard.column("batch").combine_chunks()), [unpacked(b, 4) for b in shard.column("blob").to_pylist()]
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        index, anchor, content, least = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((least, content, anchor))
        a, c, m = anchor[order], content[order], least[order]
        new_a = np.r_[True, a[1:] != a[:-1]]
        new_pair = new_a | np.r_[True, c[1:] != c[:-1]]
        first = np.flatnonzero(new_pair)
        smallest = np.repeat(m[first], np.diff(np.r_[first, len(m)]))
        group = np.cumsum(new_a) - 1
        contents = np.bincount(group[first])
        hot = ((contents > hot_anchor) | (np.bincount(group, c == HOT) > 0))[group]
        settled = (m > smallest) & ~hot
        asked = (m == smallest) & ~hot & (contents > 1)[group]  # anchors with several contents
        out = []
        for kind, chosen in ((0, settled), (1, asked), (3, hot)):
            at = order[chosen]
            values = smallest[chosen]
            by = np.lexsort((index[at], source[at]))
            at, values = at[by], values[by]
            cut = np.searchsorted(source[at], np.arange(len(parts) + 1))
            for s in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[s], cut[s + 1])
                out.append((kind, int(numbers[s]), shard.column("shard")[0].as_py(), packed(index[at[part]], values[part])))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["kind", "batch", "shard", "blob"])

    offered = batches_.select("batch", "head", "body").mapInArrow(offer, "shard long, batch long, blob binary")
    replies = materialise(offered.groupBy("shard").applyInArrow(settle, "kind int, batch long, shard long, blob binary"), "replies")

    def gathered(kind: int, of: DataFrame) -> DataFrame:
        """One row per batch: what the shards (at most one entry each) say to it."""
        return of.filter(F.col("kind") == kind).groupBy("batch").agg(F.collect_list(F.struct("shard", "blob")).alias(f"told{kind}"))

    def show(batches):
        for batch in batches:
            for number, head, body, told in _rows(batch, "batch", "head", "body", "told1"):
                b, u, cut = found(head, body)
                for entry in told:
                    index, _ = unpacked(entry["blob"], 2)
                    at = u.first[cut[entry["shard"]] + index]
                    texts = [b.x[s:e].tobytes() for s, e in zip(u.start[at].tolist(), (u.start[at] + u.count[at] + width - 1).tolist(), strict=True)]
                    blob = packed(index, b.keys[u.doc[at]], np.array([len(t) for t in texts]))
                    body_blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
                    yield pa.RecordBatch.from_arrays([pa.array([entry["shard"]]), pa.array([number]), pa.array([blob], pa.binary()), pa.array([body_blob], pa.binary())], names=["shard", "batch", "blob", "texts"])

    def compare(shard: pa.Table) -> pa.Table:
        numbers, heads, owners, texts = shard.column("batch").to_pylist(), [], [], []
        for blob, raw in zip(shard.column("blob").to_pylist(), shard.column("texts").to_pylist(), strict=True):
            index, own, lengths = unpacked(blob, 3)
            raw, ends = zstandard.ZstdDecompressor().decompress(raw), np.cumsum(lengths)
            heads.append(index)
            owners.append(own)
            texts += [raw[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        masks = repeated_windows(texts, np.concatenate(owners), width)
        bits = np.array([int((m.astype(np.int64) << np.arange(len(m))).sum()) for m in masks], dtype=np.int64)
        out, at = [], 0
        for number, index in zip(numbers, heads, strict=True):
            own = bits[at : at + len(index)]
            at += len(index)
            some = own != 0
            if some.any():
                out.append((2, number, shard.column("shard")[0].as_py(), packed(index[some], own[some])))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["kind", "batch", "shard", "blob"])

    asks = batches_.select("batch", "head", "body").join(gathered(1, replies), "batch")
    shown = asks.mapInArrow(show, "shard long, batch long, blob binary, texts binary")
    partial = materialise(shown.groupBy("shard").applyInArrow(compare, "kind int, batch long, shard long, blob binary"), "partial")

    def hot_anchors(u: Units, cut: np.ndarray, told) -> np.ndarray:
        own = [u.anchor[cut[entry["shard"]] + unpacked(entry["blob"], 2)[0]] for entry in told or []]
        return np.unique(np.concatenate(own)) if own else u.anchor[:0]

    def show_windows(batches):
        for batch in batches:
            for number, head, body, told in _rows(batch, "batch", "head", "body", "told3"):
                b, u, cut = found(head, body)
                w = hot_windows(b, u, hot_anchors(u, cut, told), width, shards)
                for s in np.flatnonzero(np.diff(w.cut)).tolist():
                    part = slice(w.cut[s], w.cut[s + 1])
                    blob = packed(w.least[part])
                    text = zstandard.ZstdCompressor(level=1).compress(w.text[part].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([number]), pa.array([blob], pa.binary()), pa.array([text], pa.binary())], names=["shard", "batch", "blob", "texts"])

    def compare_windows(shard: pa.Table) -> pa.Table:
        numbers, least = shard.column("batch").to_pylist(), [unpacked(b, 1)[0] for b in shard.column("blob").to_pylist()]
        raw = b"".join(zstandard.ZstdDecompressor().decompress(t) for t in shard.column("texts").to_pylist())
        _, which = np.unique(np.frombuffer(raw, dtype=f"V{width}"), return_inverse=True)
        own = np.concatenate(least)
        smallest = np.full(which.max() + 1, NO_ID)
        np.minimum.at(smallest, which, own)
        out, at = [], 0
        for number, mine in zip(numbers, least, strict=True):
            before = smallest[which[at : at + len(mine)]]
            index = np.flatnonzero(before < mine)
            at += len(mine)
            if len(index):
                out.append((4, number, shard.column("shard")[0].as_py(), packed(index, before[index])))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["kind", "batch", "shard", "blob"])

    hot = batches_.select("batch", "head", "body").join(gathered(3, replies), "batch")
    split = hot.mapInArrow(show_windows, "shard long, batch long, blob binary, texts binary")
    single = materialise(split.groupBy("shard").applyInArrow(compare_windows, "kind int, batch long, shard long, blob binary"), "windows")

    def cut_out(batches):
        for batch in batches:
            for head, body, told0, told2, told3, told4 in _rows(batch, "head", "body", "told0", "told2", "told3", "told4"):
                b, u, cut = found(head, body)
                w = hot_windows(b, u, hot_anchors(u, cut, told3), width, shards) if told3 else None
                least, bits = u.least.copy(), np.zeros(len(u.anchor), np.int64)
                for told, into in ((told0, least), (told2, bits)):
                    for entry in told or []:
                        index, values = unpacked(entry["blob"], 2)
                        into[cut[entry["shard"]] + index] = values
                mark = np.zeros(len(b.x) + 1, np.int64)
                if w is not None:
                    smallest = w.least.copy()
                    for entry in told4 or []:
                        index, values = unpacked(entry["blob"], 2)
                        smallest[w.cut[entry["shard"]] + index] = values
                    s = w.start[smallest[w.which] < b.keys[w.doc]]
                    np.add.at(mark, s, 1)
                    np.add.at(mark, s + width, -1)
                    least[np.isin(u.anchor, hot_anchors(u, cut, told3))] = NO_ID
                whole = least[u.pair] < b.keys[u.doc]
                for s, n in ((u.start[whole], u.count[whole]),):
                    np.add.at(mark, s, 1)
                    np.add.at(mark, s + n + width - 1, -1)
                part = np.flatnonzero(~whole & (bits[u.pair] != 0))
                for j in range(width):
                    s = u.start[part][(bits[u.pair[part]] >> j) & 1 == 1] + j
                    np.add.at(mark, s, 1)
                    np.add.at(mark, s + width, -1)
                gone = np.cumsum(mark)[:-1] > 0
                out, at = [], 0
                for i, n in zip(b.keys.tolist(), b.lengths.tolist(), strict=True):
                    g, x = gone[at : at + n], b.x[at : at + n]
                    at += n
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    out.append((None if i == NO_ID else i, n, int(g.sum()), spans, x[~g].tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    told = batches_.select("batch", "head", "body").join(gathered(0, replies), "batch", "left").join(gathered(2, partial), "batch", "left")
    told = told.join(gathered(3, replies), "batch", "left").join(gathered(4, single), "batch", "left")
    return told.mapInArrow(cut_out, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept binary")

