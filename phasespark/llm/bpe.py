"""Byte-pair encoding and decoding for vocabularies with word-end marks, in batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up all neighbouring pairs by binary search over the sorted pair
keys, takes the lowest rank of every word and merges it, until no word has a known pair. A word is encoded once per worker; texts are
then put together from the words' ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
#: White space of the vocabulary's pattern language: the Unicode property, without the four information separators.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The same pattern where all characters are below U+0100: a quicker matcher can take it.
LETTERS, NUMBERS = "a-zªµºà-öø-ÿÀ-ÖØ-Þß", "0-9²³¹¼-¾"
LATIN_PIECES = re.compile(rf"{ENDINGS}|[{LETTERS}]+|[{NUMBERS}]|[^\t-\r\x20\x85\xa0{LETTERS}{NUMBERS}]+")
NOT_LATIN = re.compile("[^\x00-\xff]")

# Fixed values. The library's classes are those of Unicode 16, its lower case that of Unicode 17 and its composition older than both;
# Python 3.13 has Unicode 15.1. First and last code points of what differs: letters and numbers of Unicode 16,
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# capitals (first, last, step from a capital to the next, distance to its small letter),
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 1, 1), (0xA7CB, 0xA7CB, 1, 0x264 - 0xA7CB), (0xA7CC, 0xA7CE, 2, 1), (0xA7D2, 0xA7D4, 2, 1), (0xA7DA, 0xA7DA, 1, 1),
    (0xA7DC, 0xA7DC, 1, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 1, 0x20), (0x16EA0, 0x16EB8, 1, 0x1B),
)
# and marks that composition takes as signs of their own, as they came after its version.
PLAIN_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x11938, 0x11938),
    (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42),
    (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE),
    (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


@dataclass
class Vocabulary:
    """Arrays of a word-end BPE vocabulary; small (some 50,000 merges) whatever the corpus."""

    tokens: list[str]
    special: dict[str, int]
    first: np.ndarray  #: byte -> symbol inside a word
    last: np.ndarray  #: byte -> symbol at a word's end
    keys: np.ndarray  #: sorted left * size + right
    rank: np.ndarray
    merged: np.ndarray
    in_turn: np.ndarray  #: by rank: whether all its occurrences in a word may be merged at once

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        raw = json.loads(open(path, encoding="utf-8").read())
        vocab, end = raw["model"]["vocab"], raw["model"]["end_of_word_suffix"] or ""
        added = {x["content"]: x["id"] for x in raw["added_tokens"]}
        tokens = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in [*vocab.items(), *added.items()]:
            tokens[i] = token
        letters, size = byte_letters(), len(tokens)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in raw["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        used = np.full(size, NONE)  # the lowest rank that takes a token as a part
        for side in (left, right):
            np.minimum.at(used, side, np.arange(len(pairs)))
        key = left * size + right
        order = np.argsort(key, kind="stable")
        return cls(
            tokens,
            added,
            np.array([vocab[c] for c in letters], dtype=np.int64),
            np.array([vocab[c + end] for c in letters], dtype=np.int64),
            key[order],
            order.astype(np.int64),
            made[order],
            used[made] > np.arange(len(pairs)),
        )

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, offsets) for non-empty words."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.first[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        size, done = len(self.tokens), []
        while len(symbols):
            rank, at = np.full(len(symbols), NONE), np.zeros(len(symbols), dtype=np.int64)
            inner = np.flatnonzero(owner[:-1] == owner[1:])
            pair = symbols[inner] * size + symbols[inner + 1]
            found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = self.keys[found] == pair
            at[inner[known]] = found[known]
            rank[inner[known]] = self.rank[found[known]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            lowest = np.repeat(lowest, np.diff(np.r_[starts, len(symbols)]))
            ready = lowest == NONE
            done.append((owner[ready], symbols[ready]))
            chosen = np.flatnonzero((rank == lowest) & ~ready)
            if len(chosen):
                fresh = np.r_[True, owner[chosen[1:]] != owner[chosen[:-1]]]
                chosen = chosen[fresh | self.in_turn[rank[chosen]]]
                run = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1] + 1])
                offset = np.arange(len(chosen)) - np.repeat(run, np.diff(np.r_[run, len(chosen)]))
                chosen = chosen[offset % 2 == 0]  # of overlapping pairs, those from the left
                symbols[chosen] = self.merged[at[chosen]]
            keep = ~ready
            keep[chosen + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        owner, ids = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(words) + 1))

    def decode(self, ids) -> str:
        """Token strings joined by single spaces, special ones kept: what a vocabulary without a decoder gives."""
        return " ".join([self.tokens[i] for i in ids])


def _class(ranges) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


def _of_category(initial: str) -> list[tuple[int, int]]:
    """The code points of the categories with an initial, as ranges."""
    mine = np.array([unicodedata.category(chr(c))[0] == initial for c in range(0x110000)])
    edges = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


@cache
def _pieces() -> re.Pattern:
    letters, numbers = _class([*_of_category("L"), *NEW_LETTERS]), _class([*_of_category("N"), *NEW_NUMBERS])
    return re.compile(rf"{ENDINGS}|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


MARKS = re.compile(f"([{_class(PLAIN_MARKS)}])")
#: Small letters of capitals; sigma letter by letter, so that none becomes a final one.
SMALL = {ord("Σ"): "σ"} | {c: chr(c + to) for a, b, step, to in NEW_CAPITALS for c in range(a, b + 1, step)}


def split(text: str) -> list[str]:
    """The pieces of a text without special tokens: composed, lower case, white space dropped."""
    if not unicodedata.is_normalized("NFC", text) or MARKS.search(text):
        text = "".join([part if i % 2 else unicodedata.normalize("NFC", part) for i, part in enumerate(MARKS.split(text))])
    if text.isascii() or NOT_LATIN.search(text) is None:
        return LATIN_PIECES.findall(text.lower())
    return _pieces().findall(text.translate(SMALL).lower())


@dataclass
class Encoder:
    """A vocabulary with the words met so far; ``max_words`` bounds a worker's memory, not what is encoded."""

    vocabulary: Vocabulary
    max_words: int = 200_000
    batch_bytes: int = 2_000_000
    _index: dict[str, int] = field(default_factory=dict, repr=False)
    _ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32), repr=False)
    _offsets: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64), repr=False)
    _decoded: list[str] = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "max_words": self.max_words, "batch_bytes": self.batch_bytes}

    def __setstate__(self, state):
        self.__init__(**state)

    def _learn(self, words: list[str]) -> None:
        special, parts = self.vocabulary.special, []
        plain = [w.encode("utf-8", "replace") for w in words if w not in special]
        ids, offsets = self.vocabulary.encode_words(plain) if plain else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        k = 0
        for w in words:
            if w in special:
                parts.append(np.array([special[w]], np.int32))
            else:
                parts.append(ids[offsets[k] : offsets[k + 1]])
                k += 1
        self._decoded += [self.vocabulary.decode(p) for p in parts]
        self._ids = np.concatenate([self._ids, *parts])
        self._offsets = np.r_[self._offsets, self._offsets[-1] + np.cumsum([len(p) for p in parts])]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids of all texts in a row, offsets, decoded texts); a null text is an empty one."""
        if len(self._index) > self.max_words:
            self.__init__(self.vocabulary, self.max_words, self.batch_bytes)
        index, new, new_bytes, docs = self._index, [], 0, []
        marks = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")") if self.vocabulary.special else None
        for text in texts:
            text = text or ""
            if marks and any(m in text for m in self.vocabulary.special):
                pieces = [p for i, x in enumerate(marks.split(text)) for p in ([x] if i % 2 else split(x))]
            else:
                pieces = split(text)
            found = list(map(index.get, pieces))
            if None in found:
                for p in pieces:
                    if index.setdefault(p, len(index)) == len(self._decoded) + len(new):
                        new.append(p)
                        new_bytes += len(p)
                found = list(map(index.get, pieces))
            docs.append(np.array(found, dtype=np.int32))
            if new_bytes > self.batch_bytes:
                self._learn(new)
                new, new_bytes = [], 0
        if new:
            self._learn(new)
        words = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        lengths = np.diff(self._offsets)[words]
        before = np.r_[0, np.cumsum(lengths)]
        flat = self._ids[np.arange(before[-1]) + np.repeat(self._offsets[:-1][words] - before[:-1], lengths)]
        bounds = np.cumsum([0, *(len(d) for d in docs)])
        decoded = self._decoded
        return flat, before[bounds], [" ".join([decoded[i] for i in d]) for d in docs]


def encode(docs: DataFrame, path: str, text: str = "text", rows: int = 500) -> DataFrame:
    """``docs`` with a struct column ``bpe`` (ids, decoded), by the vocabulary file at ``path`` (read by the driver).

    Every row and column stays (one named ``bpe`` is replaced); null and empty texts give no ids. ``rows`` texts are in hand at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(Vocabulary.load(path)))
    own = [f for f in docs.schema.fields if f.name != "bpe"]

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), rows):
                part = batch.slice(i, rows)
                flat, offsets, decoded = shared.value.encode(part.column(text).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                found = pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string())], ["ids", "decoded"])
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in own), found], names=[*(f.name for f in own), "bpe"])

    return docs.mapInArrow(run, T.StructType([*own, T.StructField("bpe", ENCODED)]))
