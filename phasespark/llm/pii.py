"""Personal data: fixed formats, and identifiers found by bootstrapped contexts.

Emails, IP addresses, cards and phone numbers are matched by fixed patterns. They seed a bipartite graph of lexical patterns (the words
around) and instances (whatever stands between them). A pattern's confidence is the share of its distinct instances that are known, an
instance's the share of its occurrences in confident patterns; confident patterns discover instances, these induce further patterns, and
so on for some rounds. What they find is added under the kind ``id``. DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasespark.llm.common import let, materialise, side

# Fixed patterns, each with the same leftmost, greedy, non-overlapping matches as the plain form; possessive, so that they take linear
# time and no stack on long runs.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Signs that aren't part of a word at its ends.
PUNCTUATION = ".,;:!?()[]{}<>\"'`|*#$%&~^=/\\"
#: ASCII and as many private characters: a base span is written in the latter, so that it is one token and known for a seed.
PLAIN, PRIVATE = ("".join(chr(c + to) for c in range(0x20, 0x7F)) for to in (0, 0xE100))
SEED = f"[{PRIVATE[0]}-{PRIVATE[-1]}]"
KINDS = ("email", "ip", "card", "phone")
NO_SPANS = "array<struct<s:int,e:int,m:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches as an array of (s, e, m): code point offsets, end exclusive, and the matched string."""

    def placed(t: Column) -> Column:
        def place(found: Column) -> Column:
            step = lambda acc, m: F.struct(
                (acc["i"] + 1).alias("i"),
                (acc["at"] + F.length(acc["gaps"][acc["i"]]) + F.length(m)).alias("at"),
                acc["gaps"].alias("gaps"),
                F.array_append(
                    acc["out"],
                    F.struct(
                        (acc["at"] + F.length(acc["gaps"][acc["i"]])).alias("s"),
                        (acc["at"] + F.length(acc["gaps"][acc["i"]]) + F.length(m)).alias("e"),
                        m.alias("m"),
                    ),
                ).alias("out"),
            )
            start = F.struct(
                F.lit(0).alias("i"), F.lit(0).alias("at"), F.split(t, pattern, -1).alias("gaps"), F.array().cast(NO_SPANS).alias("out")
            )
            return F.when(F.size(found) > 0, F.aggregate(found, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(NO_SPANS))

        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), place)

    return let(F.coalesce(text, F.lit("")), placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, -i, F.lit(1)).cast("int") * (2 - i % 2)
            return acc + x - F.when(x > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)

    return let(digits, total) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array of spans. Matches that fail their kind's test are dropped, and not tried again in part."""
    size = lambda m: F.length(_digits(m))
    return {
        "email": matches(text, EMAIL),
        "ip": F.filter(matches(text, IP), lambda x: x["m"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": F.filter(matches(text, CARD), lambda x: size(x["m"]).between(16, 19) & _luhn(_digits(x["m"]))),
        "phone": F.filter(matches(text, PHONE), lambda x: size(x["m"]).between(8, 15)),
    }


def _masked(text: Column, spans: Column) -> Column:
    """A text with its spans in private characters, of the same length."""
    part = lambda t, x: F.substring(t, x["s"] + 1, x["e"] - x["s"])
    write = lambda t, x: F.overlay(t, F.translate(part(t, x), PLAIN, PRIVATE), x["s"] + 1, x["e"] - x["s"])
    return F.aggregate(spans, text, write)


def _scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, h, kinds.., masked): every row with its base spans, written once and scanned by all rounds; the masked text as far as a
    text has spans."""
    t = F.col("row")[text]
    rows = docs.select(F.struct("*").alias("row"))
    plain = lambda v: F.transform(v, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    found = rows.select("row", F.col("row")[key].alias("key"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("h"), *(plain(v).alias(k) for k, v in base_spans(t).items()))
    spans = F.concat(*KINDS)
    found = materialise(found.withColumn("masked", F.when(F.size(spans) > 0, _masked(t, spans))), "scanned")
    return found.withColumn("masked", F.coalesce("masked", t, F.lit("")))


def _occurrences(scanned: DataFrame) -> DataFrame:
    """(key, h, i, m, pl, pb, pr): each token m, the i-th piece between single white spaces, with its patterns: the word to the left, the two
    words to the left, the word to the right. Patterns of words that are missing or seeds themselves are null."""
    pieces = F.transform(F.split("masked", r"\s"), lambda w, i: F.struct(F.btrim(w, F.lit(PUNCTUATION)).alias("w"), i.alias("i")))
    named = F.transform(F.filter(pieces, lambda x: x["w"] != ""), lambda x: F.struct(x["w"].alias("w"), F.lower(x["w"]).alias("c"), x["i"].alias("i")))
    tokens = scanned.select("key", "h", (F.size(F.concat(*KINDS)) > 0).alias("seeded"), named.alias("t"))
    rows = tokens.select("key", "h", "seeded", "t", F.posexplode("t").alias("k", "x"))
    word = lambda at: F.get("t", F.col("k") + at)["c"]
    rows = rows.select("key", "h", "seeded", F.col("x.i").alias("i"), F.col("x.w").alias("m"), word(-1).alias("l1"), word(-2).alias("l2"), word(1).alias("r1"))
    usable = lambda *c: ~F.col("seeded") | reduce(lambda a, b: a & b, (~F.col(x).rlike(SEED) for x in c))
    return rows.select(
        "key",
        "h",
        "i",
        "m",
        F.when(usable("l1"), F.concat(F.lit("L "), "l1")).alias("pl"),
        F.when(usable("l1", "l2"), F.concat(F.lit("B "), "l2", F.lit(" "), "l1")).alias("pb"),
        F.when(usable("r1"), F.concat(F.lit("R "), "r1")).alias("pr"),
    )


SLOTS = ("pl", "pb", "pr")


def _in_patterns(occurrences: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, h, i, m, p) for each occurrence in each of its ``patterns`` (p)."""
    chosen = side(patterns.select("p"))
    rows = occurrences
    for c in SLOTS:
        rows = rows.join(chosen.withColumnRenamed("p", f"_{c}"), F.col(c) == F.col(f"_{c}"), "left")
    hits = [F.col(f"_{c}") for c in SLOTS]
    return rows.filter(F.coalesce(*hits).isNotNull()).select("key", "h", "i", "m", F.explode(F.array_compact(F.array(*hits))).alias("p"))


def _around(occurrences: DataFrame) -> DataFrame:
    """(p, m): the distinct instances of all patterns."""
    return occurrences.select("m", F.explode(F.array_compact(F.array(*SLOTS))).alias("p")).distinct()


def _discovered(scanned: DataFrame, rounds: int, min_confidence: float, min_support: int, min_share: float) -> DataFrame | None:
    """(key, h, i) of the tokens in confident patterns that stand in such in a share ``min_share`` of their places; None if there are none.

    All seeds stand in texts with spans, so these give a pattern's seeds exactly and its instances from below: patterns that can't become
    confident, such as those of common words, are told by these texts alone. Only what is left is looked for in all texts.
    """
    everywhere = _occurrences(scanned)
    is_seed = F.col("m").rlike(SEED)
    seeded = _occurrences(scanned.filter(F.size(F.concat(*KINDS)) > 0))
    seeds = _around(seeded.filter(is_seed)).groupBy("p").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= min_support)
    seeds = materialise(seeds, "seeds")
    least = _in_patterns(seeded, seeds).select("p", "m").distinct().groupBy("p").agg(F.count("*").alias("least"))
    near = materialise(seeds.join(least, "p"), "patterns")
    accepted, found, n_accepted = None, None, 0
    for _ in range(rounds):
        possible = (F.col("seeds") + n_accepted) / (F.col("least") + 1) >= min_confidence
        patterns = near.filter(possible).select("p")
        if accepted is not None:
            more = _around(everywhere.join(side(accepted), "m")).groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support)
            patterns = patterns.unionByName(more.select("p")).distinct()
        patterns = materialise(patterns, "patterns")
        if patterns.isEmpty():
            return None
        edges = materialise(_in_patterns(everywhere, patterns).select("p", "m").distinct(), "edges")
        flagged = edges.withColumn("known", is_seed)
        if accepted is not None:
            flagged = edges.join(side(accepted.withColumn("yes", F.lit(True))), "m", "left").withColumn("known", is_seed | F.coalesce("yes", F.lit(False)))
        score = flagged.groupBy("p").agg(F.sum(F.col("known").cast("int")).alias("support"), F.count("*").alias("n"))
        sure = score.filter((F.col("support") >= min_support) & (F.col("support") / (F.col("n") + 1) >= min_confidence)).select("p")
        sure = materialise(sure, "sure")
        reached = materialise(edges.join(side(sure), "p").filter(~is_seed).select("m").distinct(), "reached")
        if reached.isEmpty():
            return None
        slots = everywhere.join(side(reached), "m")
        for c in SLOTS:  # an occurrence may stand in several patterns, and counts once
            slots = slots.join(side(sure).select(F.col("p").alias(f"_{c}")), F.col(c) == F.col(f"_{c}"), "left")
        slots = slots.withColumn("inside", F.coalesce(*(F.col(f"_{c}") for c in SLOTS)).isNotNull())
        shares = slots.groupBy("m").agg(F.avg(F.col("inside").cast("double")).alias("share")).filter(F.col("share") >= min_share).select("m")
        accepted, before = materialise(shares, "accepted"), n_accepted
        found, n_accepted = sure, accepted.count()
        if n_accepted == before:
            break
    return _in_patterns(everywhere.join(side(accepted), "m"), found).select("key", "h", "i").distinct()


def _located(scanned: DataFrame, tokens: DataFrame) -> DataFrame:
    """(key, h, id): the spans of tokens (key, h, i) of each text, without the punctuation around them."""
    wanted = tokens.groupBy("key", "h").agg(F.array_sort(F.collect_list("i")).alias("at")).select(F.col("key").alias("k"), F.col("h").alias("kh"), "at")
    texts = scanned.select("key", "h", "masked").join(side(wanted), F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("kh"))).dropDuplicates(["key", "h"])

    def spans(words: Column) -> Column:
        def span(i: Column) -> Column:
            start = F.aggregate(F.slice(words, F.lit(1), i), F.lit(0), lambda acc, w: acc + F.length(w) + 1)
            w = F.get(words, i)
            lead = F.length(w) - F.length(F.ltrim(w, F.lit(PUNCTUATION)))
            core = F.length(F.btrim(w, F.lit(PUNCTUATION)))
            return F.struct((start + lead).cast("int").alias("s"), (start + lead + core).cast("int").alias("e"))

        return F.transform("at", span)

    return texts.select("k", "kh", let(F.split("masked", r"\s"), spans).alias("id"))


def _with_spans(scanned: DataFrame, **parameters) -> DataFrame:
    """``scanned`` with a column ``id``."""
    none = F.array().cast("array<struct<s:int,e:int>>")
    tokens = _discovered(scanned, **parameters)
    if tokens is None:
        return scanned.withColumn("id", none)
    ids = side(materialise(_located(scanned, materialise(tokens, "tokens")), "spans"))
    rows = scanned.join(ids, F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("kh")), "left")
    return rows.withColumn("id", F.coalesce("id", none)).drop("k", "kh")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", *, rounds: int = 2, min_confidence: float = 0.7, min_support: int = 3, min_share: float = 0.3) -> DataFrame:
    """One row (key, email, ip, card, phone, id) per row of ``docs``: arrays of (s, e), code points, end exclusive, by start.

    Null text is empty. Repeated rows each get their spans; rows of one key with different texts get those of their own text. ``id``
    spans are single tokens and never overlap the others. An empty table gives no rows. Private characters U+E120 to U+E17E in a text
    count as parts of a seed.
    """
    scanned = _scanned(docs.select(key, text), key, text)
    rows = _with_spans(scanned, rounds=rounds, min_confidence=min_confidence, min_support=min_support, min_share=min_share)
    return rows.select(F.col("key").alias(key), "h", *KINDS, "id")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", *, rounds: int = 2, min_confidence: float = 0.7, min_support: int = 3, min_share: float = 0.3) -> DataFrame:
    """``docs`` with all spans in ``text`` replaced by ``[kind]``; rows without spans stay as they are, null texts stay null."""
    rows = _with_spans(_scanned(docs, key, text), rounds=rounds, min_confidence=min_confidence, min_support=min_support, min_share=min_share)
    label = lambda k: F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{k}]").alias("k")))
    spans = F.array_sort(F.concat(*(label(k) for k in (*KINDS, "id"))))
    t = F.col("row")[text]

    def cut(t: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            before = F.substring(t, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
            fresh = x["s"] >= acc["at"]  # overlapping spans of several kinds: one mark, and the longest reach
            return F.struct(
                F.greatest(acc["at"], x["e"]).alias("at"),
                F.when(fresh, F.concat(acc["out"], before, x["k"])).otherwise(acc["out"]).alias("out"),
            )

        return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))

    new = let(spans, lambda s: F.when(F.size(s) == 0, t).otherwise(let(t, lambda t: cut(t, s))))
    return rows.select(*((new if c == text else F.col("row")[c]).alias(c) for c in docs.columns))
