"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words of at least ``min_count`` training tokens, the text's end among them, and one class per hashed ending for all others.
Contexts are runs of up to ``depth`` such words with at least ``min_count`` training tokens after them, in a corpus of any size; so symbols
and contexts grow with it. A context stays in the tree if its next-symbol distribution diverges from that of its longest suffix in the tree; distributions are smoothed
by that suffix's. A token is scored at the longest context that stayed, and a word of a class by its share of the class.

The tree is never in one place. Texts are packed into batches of token numbers once. For the words, and then for the contexts of each
length, every batch sends its distinct entries with their training counts to shards of the hash space, packed; a shard adds them up, tests
the contexts and answers each batch. A context of many tokens is dealt over several shards by the next symbol; their parts of its divergence
are added up before it is tested.

What is sent are numbers, so that it compresses: a frequent word's is the smaller the more tokens it has and tells their number closely
enough for a test, and a shard numbers those of its pairs that are contexts of the next length. A context is sent once for all that follows it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasespark.llm.blobs import packed, packed_groups, unpacked, unpacked_groups
from phasespark.llm.common import bucketed, in_fold, materialise

END = b"\n"  #: hashed as the end token; no word has a line feed
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, split at ASCII white space, then the end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _steps() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 48:
        out.append(out[-1] + max(1, out[-1] // 1477))
    return np.array(out, dtype=np.int64)


#: Counts from one of these up to the next lie within 1/1024 of a binary logarithm; those below 2954 are told apart.
STEPS = _steps()


def step_of(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(STEPS, count, "right") - 1


def ending_class(word: bytes, classes: int) -> int:
    return xxhash.xxh32_intdigest(word[-2:]) % classes


def hashed(word: bytes, classes: int) -> int:
    """A word's hash, its class in the lowest bits."""
    bits = (classes - 1).bit_length()
    return xxhash.xxh64_intdigest(word) >> bits << bits | ending_class(word, classes)


def kinds_of(h: np.ndarray, classes: int) -> np.ndarray:
    return (h.view(np.int64) & ((1 << (classes - 1).bit_length()) - 1)).astype(np.int64)


def coded(p: np.ndarray) -> np.ndarray:
    """A probability in 1/1024 of its binary logarithm: close enough to test a context, and of two bytes."""
    return np.round(-1024 * np.log2(p)).astype(np.int64)


def sharded(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U(32)).astype(np.int64) * shards) >> 32


@dataclass
class Batch:
    """Texts as numbers of their words. Words are in the order of their hashes, which also is that of their shards."""

    keys: np.ndarray
    known_key: np.ndarray
    trained: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    kinds: np.ndarray
    tokens: np.ndarray

    @staticmethod
    def pack(keys: list, trained: list[bool], texts: list[str | None], classes: int) -> tuple[bytes, bytes, bytes]:
        index: dict[bytes, int] = {}
        lengths, flat = [], []
        for text in texts:
            own = tokens(text)
            lengths.append(len(own))
            flat += [index.setdefault(w, len(index)) for w in own]
        h = np.array([hashed(w, classes) for w in index], dtype=U)
        order = np.argsort(h, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        head = packed(np.array([0 if k is None else k for k in keys]), np.array([k is not None for k in keys]), np.array(trained), np.array(lengths))
        body = zstandard.ZstdCompressor(level=3).compress(place[np.array(flat, dtype=np.int32)].tobytes())
        return head, packed(h[order]), body

    @classmethod
    def unpack(cls, head: bytes, words: bytes, body: bytes, classes: int) -> Batch:
        keys, known_key, trained, lengths = unpacked(head, 4)
        h = unpacked(words, 1)[0].view(U)
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=np.int32)
        return cls(keys, known_key.astype(bool), trained.astype(bool), lengths, h, kinds_of(h, classes), flat)

    def inside(self) -> np.ndarray:
        """Each token's place in its text."""
        return np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def in_training(self) -> np.ndarray:
        return np.repeat(self.trained, self.lengths)


@dataclass
class Root:
    """What all batches know: sizes of the training corpus and of the classes of its rare words, and how frequent words are numbered: those
    of a step of ``STEPS`` from its start on, the highest step first."""

    n_tokens: int
    n_distinct: int
    class_count: np.ndarray
    class_words: np.ndarray
    steps: np.ndarray  #: descending
    starts: np.ndarray

    @property
    def class_mass(self) -> np.ndarray:
        """Of a class, with half a token for each of its words and for an unseen one."""
        return self.class_count + 0.5 * (self.class_words + 1)

    @property
    def mass(self) -> float:
        """Of everything: with it, the root is a distribution."""
        return self.n_tokens + 0.5 * (self.n_distinct + len(self.class_count))

    def symbols(self, count: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of frequent words, after those of the classes."""
        if not len(self.steps):
            return np.zeros(len(count), np.int64)
        return len(self.class_count) + self.starts[np.searchsorted(-self.steps, -step_of(count)).clip(max=len(self.steps) - 1)] + place

    def probability(self, symbol: np.ndarray) -> np.ndarray:
        """Close enough to test a context."""
        n = len(self.class_count)
        if not len(self.steps):
            return self.class_mass[symbol] / self.mass
        step = self.steps[(np.searchsorted(self.starts, symbol - n, "right") - 1).clip(min=0)]
        count = (STEPS[step] + STEPS[step + 1] - 1) / 2
        return np.where(symbol < n, self.class_mass[np.minimum(symbol, n - 1)], count + 0.5) / self.mass


@dataclass
class Parameters:
    depth: int
    min_count: int
    min_divergence: float
    smoothing: float
    hot_context: int


@dataclass
class Level:
    """The distinct (context, next) pairs of one depth in a batch, in the order of their shards."""

    at: np.ndarray  #: positions that have a context
    which: np.ndarray  #: their pair
    context: np.ndarray
    following: np.ndarray
    count: np.ndarray  #: training occurrences in the batch
    total: np.ndarray  #: training tokens after the context, in all
    suffix: np.ndarray  #: probability at the suffix
    cut: np.ndarray  #: first pair of each shard


class Stream:
    """A batch's symbols, and what each further answer tells about them."""

    def __init__(self, b: Batch, counts: np.ndarray, places: np.ndarray, root: Root, parameters: Parameters):
        """counts, places: of each of the batch's words, the latter among those of its step and for frequent words only."""
        self.b, self.root, self.parameters = b, root, parameters
        self.word_count = counts
        frequent = counts >= parameters.min_count
        symbol = np.where(frequent, root.symbols(counts, places), b.kinds).astype(U)
        mass = np.where(frequent, counts + 0.5, root.class_mass[b.kinds])
        self.frequent = frequent[b.tokens]
        self.symbol = symbol[b.tokens]
        self.count = np.where(frequent, counts, root.class_count[b.kinds])[b.tokens]
        self.p = (mass / root.mass)[b.tokens]
        self.place, self.training = b.inside(), b.in_training()
        end = np.repeat(np.cumsum(b.lengths) - 1, b.lengths)  # a text begins after an end
        self.context = np.where(self.place > 0, self.symbol[np.maximum(np.arange(len(self.symbol)) - 1, 0)], self.symbol[end])
        follow = np.where(self.frequent, self.count, 0)  # a class is no context
        self.total = np.where(self.place > 0, follow[np.maximum(np.arange(len(self.symbol)) - 1, 0)], follow[end])
        self.d = 1

    def level(self, shards: int) -> Level:
        """The pairs of the present depth: of contexts with enough tokens after them."""
        at = np.flatnonzero((self.place >= self.d - 1) & (self.total >= self.parameters.min_count))
        context, following = self.context[at], self.symbol[at]
        pair = mixed(mixed(context + STEP) + following * STEP)
        _, first, which = np.unique(pair, return_index=True, return_inverse=True)
        count = np.bincount(which, weights=self.training[at], minlength=len(first)).astype(np.int64)
        first = at[first]
        context, following, total = self.context[first], self.symbol[first], self.total[first]
        pieces = (total // self.parameters.hot_context + 1).astype(U)
        shard = sharded(mixed(mixed(context + STEP) + (mixed(following) % pieces) * STEP), shards)
        order = np.lexsort((following, context, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        return Level(at, place[which], context[order], following[order], count[order], total[order], self.p[first][order], cut)

    def take(self, level: Level, n: np.ndarray, stays: np.ndarray, number: np.ndarray, gone: np.ndarray) -> None:
        """Go one symbol deeper with the answers to a level: the count of a pair, whether its context stays, and the pair's number as a
        context. ``gone``: contexts of several shards that don't stay."""
        stays, m = stays.astype(bool) & ~np.isin(level.context, gone), self.parameters.smoothing
        p = np.where(stays, (n + m * level.suffix) / (level.total + m), level.suffix)
        self.p[level.at] = p[level.which]
        seen, as_context = np.zeros(len(self.symbol), np.int64), np.zeros(len(self.symbol), U)  # of a pair: the tokens after the context that it makes
        seen[level.at] = np.where(self.frequent[level.at], n[level.which], 0)
        as_context[level.at] = number.astype(U)[level.which]
        last = np.maximum(np.arange(len(self.symbol)) - 1, 0)
        self.d += 1
        self.total = np.where(self.place > 0, seen[last], 0)
        self.context = as_context[last]


def offered_pairs(level: Level, part: slice, with_suffix: bool) -> bytes:
    """Each context once, with its tokens and how many symbols follow; of these the steps from one to the next."""
    context, following, total = level.context[part].astype(np.int64), level.following[part].astype(np.int64), level.total[part]
    first = np.flatnonzero(np.diff(context, prepend=-1))
    step = np.diff(following, prepend=0)
    step[first] = following[first]
    contexts = np.diff(context[first], prepend=0), np.diff(first, append=len(context)), total[first]
    return packed_groups(contexts, (step, level.count[part], *([coded(level.suffix[part])] if with_suffix else [])))


def taken_pairs(blob: bytes, with_suffix: bool) -> tuple[np.ndarray, ...]:
    """context, following, count, total and perhaps the coded suffix of what ``offered_pairs`` packed."""
    (context, runs, total), (step, count, *suffix) = unpacked_groups(blob, 3, 2 + with_suffix)
    first = np.cumsum(runs) - runs
    sums = np.cumsum(step)
    following = sums - np.repeat(sums[first] - step[first], runs)
    return np.repeat(np.cumsum(context), runs), following, count, np.repeat(total, runs), *suffix


def judged(context: np.ndarray, following: np.ndarray, count: np.ndarray, total: np.ndarray, suffix: np.ndarray, parameters: Parameters, classes: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The answers to all offers of a shard: the sum of a pair's counts, 1 if its context stays, and the number of pairs up to this one that
    are contexts of the next length; and the parts of contexts that lie in several shards: the context, this shard's terms of the
    divergence, the suffix's share of what was seen here, the tokens.

    A context stays if its smoothed distribution diverges by ``min_divergence`` nats (Kullback-Leibler) from the suffix's. What was never
    seen keeps the suffix's proportions. A context of ``hot_context`` tokens, which lies in several shards, is tested when its parts are together (``fails``).
    """
    order = np.lexsort((following, context))
    c, f = context[order], following[order]
    new_context = np.r_[True, c[1:] != c[:-1]]
    new = new_context | np.r_[True, f[1:] != f[:-1]]
    first = np.flatnonzero(new)
    n = np.add.reduceat(count[order], first)
    q, t = suffix[order][first], total[order][first]
    m = parameters.smoothing
    p = (n + m * q) / (t + m)
    seen = n > 0
    own = np.cumsum(new_context[first]) - 1
    term = np.bincount(own, weights=np.where(seen, p * np.log(p / q), 0.0))
    share = np.bincount(own, weights=np.where(seen, q, 0.0))
    at = np.flatnonzero(new_context[first])
    hot = t[at] >= parameters.hot_context
    stays = hot | ~fails(term, share, t[at], parameters)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    contexts = np.cumsum((n >= parameters.min_count) & (f[first] >= classes))  # a class is no context
    return [n[place], stays[own][place], contexts[place]], [c[first][at][hot], term[hot], share[hot], t[at][hot]]


def fails(term: np.ndarray, share: np.ndarray, total: np.ndarray, parameters: Parameters) -> np.ndarray:
    """Whether contexts diverge too little, from the terms of the symbols seen after them and the suffix's share of these."""
    rest = parameters.smoothing / (total + parameters.smoothing)
    return term + rest * np.maximum(1.0 - share, 0.0) * np.log(rest) < parameters.min_divergence


def _rows(batch: pa.RecordBatch, *names: str):
    columns = [batch.column(n) for n in names]
    for i in range(len(batch)):
        yield tuple(c[i].as_py() for c in columns)


def _frame(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


OFFER = [("shard", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())]
OFFER_SQL = "shard long, batch long, blob binary"
SUMS = pa.list_(pa.struct([("i", pa.int64()), ("v", pa.int64())]))
HOT = pa.list_(pa.struct([("context", pa.int64()), ("term", pa.float64()), ("share", pa.float64()), ("total", pa.int64())]))
HOT_SQL = "array<struct<context: long, term: double, share: double, total: long>>"
BATCH = ["batch", "head", "words", "body"]
FINAL = ["key", "n_tokens", "n_known", "base_score", "score"]


def _gathered(answers: DataFrame, name: str) -> DataFrame:
    """One row a batch: what the shards, one entry each at most, answer."""
    return bucketed(answers.filter("batch >= 0").groupBy("batch").agg(F.collect_list(F.struct("shard", "blob")).alias(name)), "batch", name)


def _placed(told, cut: np.ndarray, columns: int) -> np.ndarray:
    """The answers in the order of what was offered. The last column counts within a shard and becomes a number among those of all shards."""
    out, shards = np.zeros((columns, cut[-1]), np.int64), len(cut) - 1
    for entry in told or []:
        own = out[:, cut[entry["shard"]] : cut[entry["shard"] + 1]]
        own[:] = unpacked_groups(entry["blob"], columns)[0]
        if columns == 3:  # of pairs: sent by differences
            own[-1] = np.cumsum(own[-1])
        own[-1] = own[-1] * shards + entry["shard"]
    return out


def score(
    docs: DataFrame,
    train: Column,
    key: str = "doc_id",
    text: str = "text",
    *,
    depth: int = 3,
    min_count: int = 64,
    min_divergence: float = 0.02,
    smoothing: float = 20.0,
    classes: int = 64,
    hot_context: int = 1 << 20,
    batch_bytes: int = 4 << 20,
    shard_bytes: int = 16 << 20,
) -> DataFrame:
    """One row (key, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``, learning from the rows where ``train`` holds.

    Null text is empty: its end is its only token. Repeated rows each count and are scored. Keys are integers or null. Without training
    rows, all words are equally unseen. Extra columns are dropped; an empty table gives no rows.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be of an integer type")
    packed_kinds = [("batch", pa.int64()), ("size", pa.int64()), ("head", pa.binary()), ("words", pa.binary()), ("body", pa.binary())]

    def pack(batches):
        from pyspark import TaskContext

        number, keys, trained, texts, size = TaskContext.get().partitionId() << 24, [], [], [], 0

        def row():
            return _frame([(number, size, *Batch.pack(keys, trained, texts, classes))], packed_kinds)

        for batch in batches:
            for k, t, x in _rows(batch, "key", "train", "text"):
                raw = len(x or "")
                if texts and (size + raw > batch_bytes or len(texts) >= 65536):
                    yield row()
                    number, keys, trained, texts, size = number + 1, [], [], [], 0
                keys.append(k)
                trained.append(bool(t))
                texts.append(x)
                size += raw
        if texts:
            yield row()

    source = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    batches_ = bucketed(source.mapInArrow(pack, "batch long, size long, head binary, words binary, body binary"), "batch", "batches")
    total = batches_.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, total // shard_bytes)
    parameters = Parameters(depth, min_count, min_divergence, smoothing, hot_context)

    def offer_words(batches):
        for batch in batches:
            for number, head, words, body in _rows(batch, *BATCH):
                b = Batch.unpack(head, words, body, classes)
                count = np.bincount(b.tokens, weights=b.in_training(), minlength=len(b.words)).astype(np.int64)
                cut = np.searchsorted(sharded(b.words, shards), np.arange(shards + 1))
                rows = [(s, number, packed(b.words[cut[s] : cut[s + 1]], count[cut[s] : cut[s + 1]])) for s in np.flatnonzero(np.diff(cut)).tolist()]
                yield _frame(rows, OFFER)

    def add_words(shard: pa.Table) -> pa.Table:
        numbers, parts = shard.column("batch").to_pylist(), [unpacked(x, 2) for x in shard.column("blob").to_pylist()]
        h, count = (np.concatenate([p[i] for p in parts]) for i in range(2))
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(which, weights=count).astype(np.int64)
        rare, kind = (n > 0) & (n < min_count), kinds_of(h[first], classes)
        own, frequent, place = shard.column("shard")[0].as_py(), np.flatnonzero(n >= min_count), np.zeros(len(n), np.int64)
        frequent = frequent[np.argsort(step_of(n[frequent]), kind="stable")]
        steps, start, size = np.unique(step_of(n[frequent]), return_index=True, return_counts=True)
        place[frequent] = np.arange(len(frequent)) - np.repeat(start, size)
        sums = [int(n.sum()), int((n > 0).sum())]
        sums += np.bincount(kind[rare], weights=n[rare], minlength=classes).astype(np.int64).tolist() + np.bincount(kind[rare], minlength=classes).tolist()
        sums = [*enumerate(sums), *zip((steps + len(sums)).tolist(), size.tolist(), strict=True)]
        ends = np.cumsum([len(p[0]) for p in parts])
        mine = [which[e - len(p[0]) : e] for e, p in zip(ends.tolist(), parts, strict=True)]
        blobs = [packed_groups((n[at], place[at])) for at in mine]
        rows = [(own, number, blob, None) for number, blob in zip(numbers, blobs, strict=True)] + [(own, -1, None, [{"i": i, "v": v} for i, v in sums])]
        return pa.Table.from_batches([_frame(rows, [*OFFER, ("sums", SUMS)])])

    offered = batches_.select(*BATCH).mapInArrow(offer_words, OFFER_SQL)
    answers = materialise(offered.groupBy("shard").applyInArrow(add_words, OFFER_SQL + ", sums array<struct<i: long, v: long>>"), "words")
    sums = answers.filter("batch < 0").select(F.inline("sums")).groupBy("i").agg(F.sum("v").alias("v"), F.max("v").alias("most")).collect()
    one = dict((r["i"], r["v"]) for r in sums)  # two, two a class, then one for each of STEPS that has words, however many these are
    of = np.array([one.get(i, 0) for i in range(2 + 2 * classes)], dtype=np.int64)
    most = dict((r["i"] - len(of), r["most"] * shards) for r in sums if r["i"] >= len(of))
    steps = np.array(sorted(most, reverse=True), dtype=np.int64)
    starts = np.cumsum([0, *(most[i] for i in steps.tolist())])[:-1].astype(np.int64)
    root = Root(int(of[0]), int(of[1]), of[2 : 2 + classes], of[2 + classes :], steps, starts)
    told = batches_.select(*BATCH).join(_gathered(answers, "told0"), "batch")

    gone: list[np.ndarray] = []  # of each depth: contexts of several shards that don't stay

    def stream(row: tuple) -> Stream:
        """A batch after all answers so far."""
        _, head, words, body, *answered = row
        b = Batch.unpack(head, words, body, classes)
        cut = np.searchsorted(sharded(b.words, shards), np.arange(shards + 1))
        s = Stream(b, *_placed(answered[0], cut, 2), root, parameters)
        for answer, out in zip(answered[1:], gone, strict=True):
            level = s.level(shards)
            s.take(level, *_placed(answer, level.cut, 3), out)
        return s

    def offer_pairs(names: list[str]):
        def offer(batches):
            for batch in batches:
                for row in _rows(batch, *BATCH, *names):
                    level = stream(row).level(shards)
                    rows = []
                    for s in np.flatnonzero(np.diff(level.cut)).tolist():
                        part = slice(level.cut[s], level.cut[s + 1])
                        rows.append((s, row[0], offered_pairs(level, part, len(names) > 1)))
                    if rows:
                        yield _frame(rows, OFFER)

        return offer

    def judge(with_suffix: bool):
        """``with_suffix``: whether the suffix's probabilities were sent; those of the root are known."""

        def judged_shard(shard: pa.Table) -> pa.Table:
            numbers, parts = shard.column("batch").to_pylist(), [taken_pairs(x, with_suffix) for x in shard.column("blob").to_pylist()]
            context, following, count, total, *suffix = (np.concatenate(c) for c in zip(*parts, strict=True))
            suffix = np.exp2(suffix[0] / -1024) if with_suffix else root.probability(following)
            answer, hot = judged(context, following, count, total, suffix, parameters, classes)
            own, ends = shard.column("shard")[0].as_py(), np.cumsum([len(p[0]) for p in parts])
            mine = [[c[e - len(p[0]) : e] for c in answer] for e, p in zip(ends.tolist(), parts, strict=True)]
            rows = [(own, number, packed_groups((n, stays, np.diff(place, prepend=0))), None) for number, (n, stays, place) in zip(numbers, mine, strict=True)]
            if len(hot[0]):
                rows.append((own, -1, None, [dict(zip(("context", "term", "share", "total"), r, strict=True)) for r in zip(*(x.tolist() for x in (hot[0].astype(np.int64), *hot[1:])), strict=True)]))
            return pa.Table.from_batches([_frame(rows, [*OFFER, ("hot", HOT)])])

        return judged_shard

    def untied(answers: DataFrame) -> np.ndarray:
        """The contexts of several shards that fail the test: a context has ``hot_context`` tokens, so they are few."""
        parts = answers.filter("batch < 0").select("shard", F.inline("hot"))
        parts = parts.groupBy("context", "total").agg(F.sort_array(F.collect_list(F.struct("shard", "term", "share"))).alias("p"))
        whole = lambda c: F.aggregate(f"p.{c}", F.lit(0.0), lambda a, x: a + x).alias(c)
        found = parts.select("context", whole("term"), whole("share"), "total").toArrow()
        context, term, share, total = (np.asarray(found.column(c).combine_chunks()) for c in ("context", "term", "share", "total"))
        return context[fails(term, share, total, parameters)].view(U)

    names = ["told0"]
    for d in range(1, depth + 1):
        offered = told.mapInArrow(offer_pairs(list(names)), OFFER_SQL)
        answers = materialise(offered.groupBy("shard").applyInArrow(judge(d > 1), OFFER_SQL + ", hot " + HOT_SQL), f"contexts{d}")
        gone.append(untied(answers))
        told = told.join(_gathered(answers, f"told{d}"), "batch", "left")
        names.append(f"told{d}")

    def finish(batches):
        for batch in batches:
            for row in _rows(batch, *BATCH, *names):
                s = stream(row)
                b, count = s.b, s.word_count[s.b.tokens]
                base = np.log10((count + 0.5) / (root.n_tokens + 0.5 * (root.n_distinct + 1)))
                share = np.where(s.frequent, 0.0, np.log10((count + 0.5) / root.class_mass[b.kinds[b.tokens]]))
                whole = lambda x, at=np.cumsum(b.lengths) - b.lengths: np.add.reduceat(x, at)  # noqa: E731  every text has its end at least
                columns = [b.lengths, whole((count > 0).astype(np.int64)), whole(base), whole(np.log10(s.p) + share)]
                yield pa.RecordBatch.from_arrays([pa.array(b.keys, mask=~b.known_key), *map(pa.array, columns)], names=FINAL)

    out = told.mapInArrow(finish, "key long, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(root.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame, modulus: int = 5, held_out: int = 1, **parameters) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text) outside the held-out fold and score all rows."""
    return score(docs, ~in_fold(F.col("doc_id"), modulus, held_out), **parameters).withColumn("held_out", in_fold(F.col("doc_id"), modulus, held_out))
