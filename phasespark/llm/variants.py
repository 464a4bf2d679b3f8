"""Spelling variants: words one error apart, found by automata that read words from the front and from the back."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasespark.llm.common import LOWER, UPPER, materialise, side

#: Characters of a word.
LETTERS = r"A-Za-zÀ-ÿ"
#: Rows of a shard, about; the least number of shards; and words beyond which the words of one half are dealt to several shards.
SHARD_ROWS, LEAST_SHARDS, MOST_WORDS = 1 << 15, 64, 1 << 16


class Automaton:
    """The minimal acyclic automaton of some words, and its perfect hash: a word's number is its place among the words in order."""

    def __init__(self, words):
        """``words`` in ascending order, each once."""
        self.after: list[dict] = [{}]  # per state: character -> [next state, words that come before its own]
        self.final, self.size = [False], [0]
        known: dict[tuple, int] = {}
        path, last = [0], ""  # states along the last word that aren't settled yet
        for word in (*words, ""):
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            for k in range(len(last), same, -1):  # what lies beyond the common prefix doesn't change any more
                state = path.pop()
                n = int(self.final[state])
                for edge in self.after[state].values():
                    edge[1] = n
                    n += self.size[edge[0]]
                self.size[state] = n
                key = (self.final[state], *((c, e[0]) for c, e in self.after[state].items()))
                self.after[path[-1]][last[k - 1]][0] = known.setdefault(key, state)
            for c in word[same:]:
                self.after.append({})
                self.final.append(False)
                self.size.append(0)
                self.after[path[-1]][c] = [len(self.after) - 1, 0]
                path.append(len(self.after) - 1)
            if word:
                self.final[path[-1]] = True
            last = word
        n = int(self.final[0])
        for edge in self.after[0].values():
            edge[1] = n
            n += self.size[edge[0]]
        self.size[0] = n

    def walk(self, text: str, state: int = 0, number: int = 0) -> tuple[int, int] | None:
        """The state after ``text``, and how many words come before all that go on from there."""
        after = self.after
        for c in text:
            edge = after[state].get(c)
            if edge is None:
                return None
            state, number = edge[0], number + edge[1]
        return state, number

    def one_error(self, exact: str, rest: str) -> set[int]:
        """The numbers of the words that begin with ``exact`` and go on as ``rest`` with just one character more, less or replaced."""
        found: set[int] = set()
        at = self.walk(exact)
        for i in range(len(rest) + 1):
            if at is None:
                break
            state, number = at
            tails = [(edge, rest[i:]) for edge in self.after[state].values()]
            if i < len(rest):
                tails += [(edge, rest[i + 1 :]) for c, edge in self.after[state].items() if c != rest[i]]
                tails.append(((state, 0), rest[i + 1 :]))
            for (target, skipped), tail in tails:
                if (end := self.walk(tail, target, number + skipped)) is not None and self.final[end[0]]:
                    found.add(end[1])
            if i < len(rest):
                at = self.walk(rest[i], state, number)
        return found


def near_in(words: list[str], asked: list[str], backward: bool) -> list[tuple[int, int]]:
    """(place in ``asked``, place in ``words``) of words one error apart, of which the first half (``backward``: the second) has none.

    The first half is the shorter one. What the forward search finds isn't given again by the backward search.
    """
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    order = sorted(range(len(words)), key=lambda i: turn(words[i]))
    automaton = Automaton([turn(words[i]) for i in order])
    out = []
    for q, w in enumerate(asked):
        half = len(w) // 2
        if backward:
            found = automaton.one_error(w[half:][::-1], w[:half][::-1])
            out += [(q, order[k]) for k in found if not words[order[k]].startswith(w[:half])]
        else:
            out += [(q, order[k]) for k in automaton.one_error(w[:half], w[half:])]
    return out


def words(docs: DataFrame, least_length: int = 5, least_count: int = 3, modulus: int = 97) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) and how often they stand there.

    Words are maximal runs of letters with A-Z lower-cased. Where ``modulus`` divides the CRC-32 of ``<doc_id>:<run>``, the run loses the
    character at that number modulo its length (misspellings planted in the same places on every run). Null texts have no words; a null
    id counts as an empty one. Occurrences are counted before they are shuffled, so that a frequent word is a row a task.
    """
    runs = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least_length},}})"), 1)  # shorter runs can't make a word
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    rows = rows.select("run", h.alias("h")).select(F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run")).alias("word"))
    return rows.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def near_pairs(counted: DataFrame) -> DataFrame:
    """(word, near, near_n): each pair of words of ``counted`` (word, n) that differ by one character more, less or replaced, both ways.

    Of two such words, the one either begins with the other's first half or ends with its second. So each word is asked once under its
    first and once under its second half, and lies under those of its beginnings and ends that are a half of words one character shorter
    to one longer (two of each). Halves are dealt to shards; the words of a half that many share are dealt to several, and each of them is
    asked. A shard builds one automaton forwards or backwards and answers by it. Words are told apart: each once, none null or empty.
    """
    counted = materialise(counted.select("word", "n"), "words")
    n, size = counted.count(), F.length("word")
    heads = F.array_distinct(F.array(*(F.expr(f"substr(word, 1, int((length(word) + {d}) / 2))") for d in (-1, 0, 1))))
    tails = F.array_distinct(F.array(*(F.expr(f"substr(word, 1 + length(word) - least(length(word), length(word) + {d} - int((length(word) + {d}) / 2)))") for d in (-1, 0, 1))))
    both = lambda kind, c: F.transform(c, lambda h: F.struct(F.lit(kind).alias("backward"), h.alias("half")))
    lie = counted.select("word", "n", F.inline(F.concat(both(False, heads), both(True, tails))))
    half = F.floor(size / 2).cast("int")
    ask = F.array(F.struct(F.lit(False).alias("backward"), F.substring("word", F.lit(1), half).alias("half")), F.struct(F.lit(True).alias("backward"), F.substring("word", half + 1, size).alias("half")))
    ask = counted.select("word", F.inline(ask))
    hot = lie.groupBy("backward", "half").agg(F.count("*").alias("c")).filter(F.col("c") > MOST_WORDS)
    hot = side(materialise(hot.select("backward", "half", F.ceil(F.col("c") / MOST_WORDS).cast("int").alias("pieces")), "hot"))
    pieces = F.coalesce("pieces", F.lit(1))
    lie = lie.join(hot, ["backward", "half"], "left").withColumn("piece", F.pmod(F.xxhash64("word"), pieces).cast("int"))
    ask = ask.join(hot, ["backward", "half"], "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    shards = max(LEAST_SHARDS, math.ceil(6 * n / SHARD_ROWS))
    shard = F.pmod(F.xxhash64("backward", "half", "piece"), F.lit(shards)).alias("shard")
    kept = ("backward", shard, "word", F.length("half").alias("half"))
    rows = lie.select(*kept, "n").unionByName(ask.select(*kept, F.lit(None).cast("long").alias("n")))

    def answer(part: pa.Table) -> pa.Table:
        backward = part.column("backward")[0].as_py()
        own, under, asked = {}, set(), {}
        for word, half, k in zip(*(part.column(c).to_pylist() for c in ("word", "half", "n")), strict=True):
            if k is None:
                asked[word] = half
            else:
                own[word] = k
                under.add((word, half))
        there, asks = list(own), list(asked)
        # a word may lie here under another half than that which is asked for: it is answered where it lies under that one
        found = [(q, k) for q, k in near_in(there, asks, backward) if (there[k], asked[asks[q]]) in under]
        return pa.table({"word": pa.array([asks[q] for q, _ in found], pa.string()), "near": pa.array([there[k] for _, k in found], pa.string()), "near_n": pa.array([own[there[k]] for _, k in found], pa.int64())})

    return rows.groupBy("backward", "shard").applyInArrow(answer, "word string, near string, near_n long")


def group(counted: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``counted`` (word, n), each word once.

    The form of a word is its most frequent near word (of equal ones the first in the order of code points) if it is at least twice as
    frequent as the word; the root is where the forms lead in the end, the word itself without a form. Forms at least double the count
    at each step, so that they end; each round of joins doubles the way that is followed.
    """
    counted = materialise(counted.select("word", "n"), "counted")
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w")))
    near = near_pairs(counted).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = counted.join(near, "word", "left")
    good = -F.col("best.k") >= 2 * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.w")).alias("form"), F.when(good, -F.col("best.k")).alias("form_n"))
    rows = materialise(rows, "forms").withColumn("root", F.coalesce("form", "word"))
    while True:
        step = rows.select(F.col("word").alias("root"), F.col("root").alias("further"))
        rows = materialise(rows.join(step, "root").withColumn("moved", F.col("further") != F.col("root")).withColumn("root", F.col("further")).drop("further"), "roots")
        if not rows.agg(F.max("moved")).first()[0]:
            return rows.select("word", "form", "root", "n", "n_near", "form_n")
        rows = rows.drop("moved")
