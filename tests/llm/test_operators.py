"""The text operators against brute force, library results and edge cases: nulls, empty texts, ties, repeated rows, clashing columns."""

import base64
import hashlib
import io
import math
import random
import re
import struct
import unicodedata
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phasespark.llm import bpe, decontaminate, langid, pii, quality, queries, simhash, suffixes, suffixtree, warc, winnow
from phasespark.llm.blobs import packed
from phasespark.llm.components import components

SF = "/root/testdata/sf0.001"
EDGES = [None, "", " \n\t ", "word", "Ünï cödé 😀", "a b c d e f g", "a b c d e f g", "x" * 5000, "lorem ipsum " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def frame(spark, rows):
    """doc_id and text, beside columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", 0, 0, "w") for i, t in rows], "doc_id long, text string, lang string, key string, h int, t int, words string")


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, [*enumerate(EDGES), (8, EDGES[8]), (None, "a b c d e f g")])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [(0, "x")]).limit(0)


# --- op1 ------------------------------------------------------------------------------------------------------------------------------


def test_language_accuracy_on_the_held_out_fold(spark, docs):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, edge, empty, docs):
    model = langid.learn(docs.select("doc_id", "text", "lang"))
    got = {(r["doc_id"], r["text"]): r["language"] for r in langid.identify(edge, model).collect()}
    for k in (0, 1, 2):
        assert got[k, EDGES[k]]["lang_pred"] == "und" and got[k, EDGES[k]]["rejected"]
    assert langid.identify(edge, model).count() == edge.count() and "words" in langid.identify(edge, model).columns
    assert langid.identify(empty, model).count() == 0
    nothing = langid.learn(empty)
    assert nothing.classify("some text") == ("und", 0.0, 0.0, True)


# --- op2 ------------------------------------------------------------------------------------------------------------------------------


def winnowed(text):
    """Runs of 8 characters, windows of 16 hashes, written out; signed 64-bit hashes of the run in UTF-32."""
    text = text or ""
    if not text:
        return []
    runs = [text[i : i + 8] for i in range(max(1, len(text) - 8 + 1))]
    grams = [struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(r.encode("utf-32-be"), 42)))[0] for r in runs]
    out = []
    for i in range(max(1, len(grams) - 16 + 1)):
        at = -min((g >> 17, -p) for p, g in enumerate(grams[i : i + 16], i))[1]
        if not out or out[-1] != (grams[at], at):
            out.append((grams[at], at))
    return out


def jaccard(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def check_winnow(row, own, following):
    m = len(own) // 4
    changed = own[: len(own) - m] + following[:m]
    fp = winnowed(own)
    assert row["n_chars"] == len(own) and row["edited"] == changed
    assert [(e["h"], e["at"]) for e in row["entries"]] == fp
    assert [(e["h"], e["at"]) for e in row["edited_entries"]] == winnowed(changed)
    assert math.isclose(row["near_edited"], jaccard(fp, winnowed(changed))) and math.isclose(row["near_next"], jaccard(fp, winnowed(following)))


def test_winnowing(docs, texts):
    got = {r["doc_id"]: r for r in winnow.fingerprints(docs).collect()}
    assert len(got) == len(texts)
    order = sorted(got)
    for k, i in enumerate(order):
        check_winnow(got[i], texts[i], texts[order[(k + 1) % len(order)]])


def test_winnowing_of_odd_texts_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BLOCK", 7)
    letters = random.Random(5)
    odd = ["a" * n for n in (1, 7, 8, 22, 23, 24, 30, 31, 200)] + ["ab" * 40, "", "漢字かな交じり文😀" * 9, "Zaß!"]
    odd += ["".join(letters.choice("ab ") for _ in range(n)) for n in (5, 20, 29, 30, 31, 32, 33, 60, 400)]
    got = {r["doc_id"]: r for r in winnow.fingerprints(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()}
    for i, text in enumerate(odd):
        check_winnow(got[i], text, odd[(i + 1) % len(odd)])


def test_winnowing_of_a_shifted_unspaced_text(spark):
    letters = random.Random(6)
    text = "".join(letters.choice("abcdefghij") for _ in range(4000))
    row = winnow.fingerprints(spark.createDataFrame([(1, text), (2, "x" + text)], "doc_id long, text string")).filter("doc_id = 1").first()
    assert row["near_next"] > 0.98


def test_winnowing_takes_integer_keys(spark):
    with pytest.raises(TypeError):
        winnow.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_next_document_across_buckets(spark):
    rows = [(i * i % 101, f"text {i}") for i in range(50)]
    df = spark.createDataFrame(sorted(set(rows)), "k long, text string")
    got = {(r["k"], r["text"]): r["next_text"] for r in winnow.with_next(df, "k", {}, rows_per_bucket=3).collect()}
    order = sorted(set(rows))
    assert got == {a: order[(i + 1) % len(order)][1] for i, a in enumerate(order)}


def test_winnowing_edges(edge, empty):
    got = winnow.fingerprints(edge).collect()
    assert len(got) == len(EDGES) + 2
    assert {len(r["entries"]) for r in got if r["doc_id"] in (0, 1)} == {0}
    assert winnow.fingerprints(empty).count() == 0


# --- op3 ------------------------------------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same_tokens(encoder, tokenizer, texts):
    flat, offsets, decoded = encoder.encode(texts)
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert flat[offsets[i] : offsets[i + 1]].tolist() == want
        assert decoded[i] == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_matches_the_library(tokenizer, texts):
    encoder = bpe.Encoder(bpe.Vocabulary.load(PATH))
    same_tokens(encoder, tokenizer, list(texts.values()))
    same_tokens(encoder, tokenizer, [*EDGES[1:], "<|endoftext|> it's <|startoftext|>ΟΔΟΣ don't İ", "aaaaaaaaaaaaaaaaaaaaa", "ﬁ ½ ² é \x1c"])


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_bpe_on_any_latin_text(text):
    if not hasattr(test_bpe_on_any_latin_text, "kept"):
        test_bpe_on_any_latin_text.kept = bpe.Encoder(bpe.Vocabulary.load(PATH)), Tokenizer.from_file(PATH)
    same_tokens(*test_bpe_on_any_latin_text.kept, [text])


def test_bpe_frames(edge, empty):
    rows = bpe.encode(edge, PATH).collect()
    assert len(rows) == len(EDGES) + 2 and all(r["bpe"]["ids"] == [] for r in rows if not (r["text"] or "").strip())
    assert bpe.encode(empty, PATH).count() == 0


def test_bpe_on_every_code_point():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    encoder = bpe.Encoder(bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json")))
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}a 1{c}1 {c}{c} A\u0301{c}\u0316\u0301 {c}\u0301" for c in signs]
    for i in range(0, len(texts), 100_000):
        part = texts[i : i + 100_000]
        ids, offsets, _ = encoder.encode(part)
        for k, want in enumerate(library.encode_batch(part, add_special_tokens=False)):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == want.ids, hex(ord(signs[i + k]))


def test_bpe_on_signs_that_compose():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder = bpe.Encoder(bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json")))
    rng = random.Random(11)
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c)))]
    texts = ["".join(rng.choices(signs, k=6)) + "".join(rng.choices("aeoΣσİ\U00011935\U00011930\U00011938", k=6)) for _ in range(30_000)]
    ids, offsets, _ = encoder.encode(texts)
    for k, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want.ids, ascii(texts[k])


# --- op4 ------------------------------------------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one(spark, docs):
    model = quality.train(docs.limit(30).select("text"), order=3)
    symbols = np.arange(len(model.alphabet) + quality.FIRST)
    for context in (0, (5 << quality.BITS) | 9, (200 << quality.BITS) | 3):
        keys = np.sort((context << quality.BITS) | symbols)
        assert abs(np.exp(model.log_probability(keys)).sum() - 1) < 1e-9


def test_quality_separates_junk(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r["keep"] for r in got if r["quality"] == 1], [r["keep"] for r in got if r["quality"] == 0]
    toxic = [r["keep"] for r in got if r["toxic"] == 1]
    assert sum(good) > 0.9 * len(good) and sum(bad) < 0.2 * len(bad) and sum(toxic) < 0.7 * len(toxic)


def plain_kneser_ney(texts, order):
    """Natural log probability of a character after a context, by the definition: counts in dictionaries, no packing."""
    alphabet = {c for t in texts for c in t}
    grams = {order: Counter(("\0" * order + t)[i : i + order] for t in texts for i in range(1, len(t) + 1))}
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    off, after = {}, {}
    for n, g in grams.items():
        of = Counter(c for c in g.values() if c <= 4)
        n1, n2, n3, n4 = (of[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        off[n] = [max(0.05, min(i + 0.95, i + 1 - (i + 2) * y * b / a)) if a and b else 0.5 * (i + 1) for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)))]
        for k, c in g.items():
            after.setdefault((n, k[:-1]), {})[k[-1]] = c

    def p(n, context, c):
        if n == 0:
            return 1 / (len(alphabet) + 2)
        held = after.get((n, context))
        lower = p(n - 1, context[1:], c)
        if not held:
            return lower
        total = sum(held.values())
        own = held.get(c, 0)
        d = lambda x: off[n][min(x, 3) - 1]
        return (own - d(own) if own else 0) / total + sum(map(d, held.values())) / total * lower

    return lambda text, i: math.log(p(order, ("\0" * (order - 1) + text)[i : i + order - 1], text[i]))


def test_perplexity_matches_a_plain_model(spark):
    rng = random.Random(10)
    made = lambda n: "".join(rng.choices("abcd é漢", weights=[9, 7, 5, 3, 6, 2, 1], k=n))
    learnt, asked = [made(rng.randint(1, 60)) for _ in range(25)], ["abba", "", None, "zz漢z", made(300), "a"]
    model = quality.train(spark.createDataFrame([(t,) for t in learnt], "text string"), order=4)
    log_p = plain_kneser_ney(learnt, 4)
    got = quality.perplexities(spark.createDataFrame(list(enumerate(asked)), "k int, text string"), model).collect()
    for row in got:
        text = asked[row["k"]]
        if not text:
            assert row["perplexity"] is None and row["worst"] is None
            continue
        known = ["\1" if c == "z" else c for c in text]
        each = [log_p("".join(known), i) for i in range(len(text))]
        windows = [each[i : i + 8] for i in range(max(1, len(each) - 7))]
        assert math.isclose(row["perplexity"], math.exp(-sum(each) / len(each)), rel_tol=1e-9)
        assert math.isclose(row["worst"], math.exp(-min(sum(w) / len(w) for w in windows)), rel_tol=1e-9)


def test_quality_learns_from_whole_texts_of_all_trusted_rows(spark):
    rng = random.Random(11)
    rows = [(k, "".join(rng.choices("abcdef gh", k=rng.randint(20, 9000) if k < 40 else 20)), "en") for k in range(2600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = docs.filter("crc32(cast(doc_id as string)) % 2 = 0").select("text")
    model = quality.train(learnt, order=3)
    want = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(docs.select("doc_id", "text"), model).collect()}
    got = quality.classify(docs, docs.select("doc_id"), order=3).collect()
    assert all(math.isclose(r["perplexity"], want[r["doc_id"]], rel_tol=1e-9) for r in got)
    others = sorted(want[r["doc_id"]] for r in docs.filter("crc32(cast(doc_id as string)) % 2 <> 0").select("doc_id").collect())
    assert {r["threshold"] for r in got} == {others[math.ceil(0.99 * len(others)) - 1]}


def test_quality_edges(spark, edge, empty):
    trusted = spark.createDataFrame([(5,), (8,), (8,), (None,)], "doc_id long")
    got = quality.classify(edge, trusted, order=3).collect()
    assert len(got) == len(EDGES) + 2 and not any(r["keep"] for r in got if r["doc_id"] in (0, 1))
    assert quality.classify(empty, trusted, order=3).count() == 0
    assert all(r["keep"] for r in quality.classify(edge, trusted.limit(0), order=3).collect() if r["perplexity"] is not None)


# --- op5 ------------------------------------------------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain_pii(text):
    found = {"email": re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text), "ip": re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)}
    found |= {"card": re.finditer(r"[0-9]([\x20-]?[0-9])+", text), "phone": re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)}
    test = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return {k: [m.span() for m in v if test[k](m.group())] for k, v in found.items()}


CASES = ["a@b.c_d@e.f x@y", "a@b.cc..d@e.ff", "1.2.3.4.5.6.7.8 1.2.3.256 0001.02.3.4", "1" * 40, "4111 1111 1111 1111 4111-1111-1111-1111", "4" * 4000 + "@", "+1 (482) 555-7163 +12", "é😀 x@y.zz 10.0.0.1", "@@@a@b.c", "+1 2 3-4 5 6 7 8 9 0 1 2 3 4 5 6 7"]


def test_base_spans(spark, docs, texts):
    rows = pii.find(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert {k: [tuple(s) for s in r[k]] for k in pii.KINDS} == plain_pii(texts[r["doc_id"]])
    rng = random.Random(7)
    made = ["".join(rng.choices("0123456789.@+- a()", k=rng.randint(0, 60))) for _ in range(150)]
    cases = [*CASES, *made]
    for r in pii.find(frame(spark, enumerate(cases))).collect():
        assert {k: [tuple(s) for s in r[k]] for k in pii.KINDS} == plain_pii(cases[r["doc_id"]]), cases[r["doc_id"]]


def test_contexts_discover_identifiers(spark):
    known = [(100 + i, f"reference no. contact 10.20.30.{40 + i} today") for i in range(12)]
    hidden = [(10 + i, f"we made contact AB-4455{i}667 today") for i in range(3)]
    got = {r["doc_id"]: r["id"] for r in pii.find(frame(spark, known + hidden)).collect()}
    assert all(len(got[10 + i]) == 1 for i in range(3))
    s, e = got[10][0]
    assert hidden[0][1][s:e] == "AB-44550667"


def plain_discovery(texts, rounds=2, confidence=0.7, support=3, share=0.3):
    """The rounds over words in plain loops: {row: spans}."""
    signs = pii.PUNCTUATION
    rows = []  # (row, start, end, instance, seed, patterns)
    for n, text in enumerate(texts):
        base = sorted({s for spans in plain_pii(text).values() for s in spans})
        inside = {i for s, e in base for i in range(s, e)}
        found = []
        for m in re.finditer(r"[^\s]+", "".join("x" if i in inside else c for i, c in enumerate(text)), re.ASCII):
            s, e = m.span()
            while s < e and s not in inside and text[s] in signs:
                s += 1
            while e > s and e - 1 not in inside and text[e - 1] in signs:
                e -= 1
            if s < e:
                found.append((s, e, text[s:e], any(i in inside for i in range(s, e))))
        for k, (s, e, m, seed) in enumerate(found):
            left = [found[k - j] if k >= j else None for j in (1, 2)]
            right = found[k + 1] if k + 1 < len(found) else None
            word = lambda x: x[2].lower() if x and not x[3] else None
            p = {("L", word(left[0])), ("R", word(right)), ("B", word(left[1]), word(left[0]))}
            rows.append((n, s, e, (m, seed), seed, {x for x in p if None not in x}))

    def induced(known):
        around = {}
        for *_, m, _, ps in rows:
            if m in known:
                for p in ps:
                    around.setdefault(p, set()).add(m)
        return {p for p, ms in around.items() if len(ms) >= support}

    known = {r[3] for r in rows if r[4]}
    seeds, patterns, accepted, sure = set(known), induced(known), set(), set()
    for _ in range(rounds):
        held = {}
        for *_, m, _, ps in rows:
            for p in ps & patterns:
                held.setdefault(p, set()).add(m)
        sure = {p for p, ms in held.items() if len(ms & (seeds | accepted)) >= support and len(ms & (seeds | accepted)) / (len(ms) + 1) >= confidence}
        reached = {m for p in sure for m in held[p]} - seeds
        if not reached:
            return {}
        before, accepted = accepted, set()
        for m in reached:
            own = [bool(r[5] & sure) for r in rows if r[3] == m]
            if sum(own) / len(own) >= share:
                accepted.add(m)
        if before and len(before) == len(accepted):
            break
        patterns = patterns | induced(accepted)
    out = {}
    for n, s, e, m, _, ps in rows:
        if m in accepted and ps & sure:
            out.setdefault(n, []).append((s, e))
    return out


def test_discovery_matches_plain_loops(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "the", "of"]
    noise = lambda n: " ".join(rng.choices(words, k=n))
    texts = []
    for i in range(60):
        seed = rng.choice([f"user{i}@mail.example.org", f"10.1.{i}.7", "4111 1111 1111 1111", f"+44 20 7946 0{i:03d}"])
        texts.append(f"{noise(3)} please contact {seed}, or\n{noise(2)}")
    texts += [f"{noise(2)} please contact EMP-{i:03d}. or {noise(1)}" for i in range(9)]
    texts += [f"badge EMP-{i:03d} expired  {noise(2)}" for i in range(9)] + [f"badge {x} expired" for x in ("AB12345", "Smith")]
    texts += [f"{noise(2)} please contact the or"] + [noise(30), "", "the the"]
    got = {r["doc_id"]: [tuple(s) for s in r["id"]] for r in pii.find(frame(spark, enumerate(texts))).collect()}
    want = plain_discovery(texts)
    assert {k: v for k, v in got.items() if v} == want
    found = {texts[k][s:e] for k, v in want.items() for s, e in v}
    assert {f"EMP-{i:03d}" for i in range(9)} | {"AB12345", "Smith"} <= found and "the" not in found


def test_redaction(spark, edge, empty):
    df = frame(spark, [(0, "mail x@y.zz now"), (1, None), (2, "no data"), (3, "10.0.0.1 and +1 (482) 555-7163"), (3, "10.0.0.1 and +1 (482) 555-7163")])
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"]) == [(0, "mail [email] now"), (2, "no data"), (3, "[ip] and [phone]"), (3, "[ip] and [phone]")]
    clash = df.withColumnRenamed("words", "spans").withColumnRenamed("t", "masked").withColumnRenamed("h", "id").withColumnRenamed("source", "row")
    assert pii.redact(clash).columns == clash.columns and pii.redact(clash).filter("text like '%[email]%'").count() == 1
    assert pii.redact(edge).count() == len(EDGES) + 2 and pii.redact(empty).count() == 0


# --- op6 ------------------------------------------------------------------------------------------------------------------------------


def plain_suffix_tree(texts, trained, *, depth, min_count, min_divergence, smoothing, classes):
    """Scores by the tree written out: contexts as tuples, oldest symbol last, distributions as dictionaries over all symbols."""
    words = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    count = Counter(w for ws, own in zip(words, trained, strict=True) if own for w in ws)
    kind = lambda w: xxhash.xxh32_intdigest(w[-2:]) % classes
    symbol = lambda w: w if count[w] >= min_count else kind(w)
    rare = [w for w in count if count[w] < min_count]
    in_class = [(sum(count[w] for w in rare if kind(w) == k), sum(kind(w) == k for w in rare)) for k in range(classes)]
    z = sum(count.values()) + 0.5 * (len(count) + classes)
    root = {w: (count[w] + 0.5) / z for w in count if count[w] >= min_count} | {k: (c + 0.5 * (v + 1)) / z for k, (c, v) in enumerate(in_class)}
    assert math.isclose(sum(root.values()), 1)
    runs = [[symbol(w) for w in ws] for ws in words]
    after = {}
    for s, own in zip(runs, trained, strict=True):
        padded = [s[-1], *s]
        for i in range(1, len(padded) if own else 0):
            for d in range(1, min(depth, i) + 1):
                context = tuple(padded[i - 1 : i - d - 1 if i - d - 1 >= 0 else None : -1])
                if not any(isinstance(x, int) for x in context):  # a class is no context
                    after.setdefault(context, Counter())[padded[i]] += 1
    tree = {(): root}

    def longest(context):
        return next(tree[context[:d]] for d in range(len(context), -1, -1) if context[:d] in tree)

    for context in sorted(after, key=len):
        n = sum(after[context].values())
        if n < min_count:
            continue
        q = longest(context[:-1])
        p = {x: (after[context][x] + smoothing * q[x]) / (n + smoothing) for x in q}
        assert math.isclose(sum(p.values()), 1)
        if sum(p[x] * math.log(p[x] / q[x]) for x in q) >= min_divergence:
            tree[context] = p
    out = []
    for ws, s in zip(words, runs, strict=True):
        padded, total = [s[-1], *s], 0.0
        for i in range(1, len(padded)):
            context = tuple(padded[max(0, i - depth) : i][::-1])
            total += math.log10(longest(context)[padded[i]])
            if count[ws[i - 1]] < min_count:
                c, v = in_class[kind(ws[i - 1])]
                total += math.log10((count[ws[i - 1]] + 0.5) / (c + 0.5 * (v + 1)))
        out.append(total)
    return out, max(map(len, tree))


def test_suffix_tree_matches_a_plain_one(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)]
    def made(n):
        out = ["w0"]
        for _ in range(n):
            i = int(out[-1][1:])
            out.append(f"w{(i * 5 + len(out) % 3) % 12}" if rng.random() < 0.7 else rng.choice(vocabulary) if rng.random() < 0.8 else f"w{rng.randint(12, 90)}")
        return " ".join(out)
    texts = [made(rng.randint(0, 80)) for _ in range(120)] + ["", None, "  ", "never seen words", "w1"]
    trained = [i % 5 != 1 for i in range(len(texts))]
    how = {"depth": 3, "min_count": 12, "min_divergence": 0.05, "smoothing": 3.0, "classes": 4}
    want, deepest = plain_suffix_tree(texts, trained, **how)
    assert deepest == 3
    df = spark.createDataFrame([(i, t, own) for i, (t, own) in enumerate(zip(texts, trained, strict=True))], "doc_id long, text string, own boolean").repartition(3)
    for sizes in ({}, {"batch_bytes": 500, "shard_bytes": 900}):
        got = {r["doc_id"]: r["score"] for r in suffixtree.score(df, F.col("own"), **how, **sizes).collect()}
        assert all(math.isclose(got[i], x, rel_tol=1e-9) for i, x in enumerate(want))


def test_suffix_tree_does_not_depend_on_size_limits(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "a", "b", "c", "d"]) if rng.random() < 0.9 else "a b c" for _ in range(60)) for _ in range(80)]
    how = {"depth": 2, "min_count": 12, "min_divergence": 0.05, "smoothing": 3.0, "classes": 4}
    want, _ = plain_suffix_tree(texts, [True] * 80, **how)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    # contexts over 100 tokens lie in several shards; those that don't diverge must go all the same
    got = {r["doc_id"]: r["score"] for r in suffixtree.score(df, F.lit(True), **how, hot_context=100, batch_bytes=500, shard_bytes=900).collect()}
    assert all(math.isclose(got[i], x, rel_tol=1e-9) for i, x in enumerate(want))


def test_suffix_tree_base_and_score(spark, docs, texts):
    got = {r["doc_id"]: r for r in suffixtree.score_documents(docs.select("doc_id", "text")).collect()}
    words = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, z = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    for i, ws in words.items():
        r = got[i]
        assert r["held_out"] == held[i] and r["n_tokens"] == len(ws) and r["train_tokens"] == n and r["n_known"] == sum(w in c for w in ws)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / z) for w in ws), rel_tol=1e-9)
    outside = [i for i in texts if held[i]]
    assert sum(got[i]["score"] for i in outside) > sum(got[i]["base_score"] for i in outside)


def test_suffix_tree_sends_few_bytes():
    rng = np.random.default_rng(2)
    steps = np.arange(2000, 500, -1)
    root = suffixtree.Root(10**7, 10**5, np.full(4, 90), np.full(4, 9), steps, np.arange(len(steps)) * 30)
    symbol = lambda n: np.sort((rng.zipf(1.3, n) - 1) % 45000 + 4).astype(np.uint64)
    context, following = np.repeat(symbol(9000), 5), symbol(45000)
    order = np.lexsort((following[rng.permutation(45000)], context))
    pairs = np.unique(np.stack([context, following[order]]), axis=1)
    count = np.minimum(rng.zipf(2.5, pairs.shape[1]), 200)
    total = pairs[0].astype(np.int64) * 7 % 5000 + 64
    level = suffixtree.Level(None, None, pairs[0], pairs[1], count, total, root.probability(pairs[1].astype(np.int64)), np.array([0, pairs.shape[1]]))
    for known in (root, None):
        blob = suffixtree.offered_pairs(level, slice(None), known is None)
        got = suffixtree.taken_pairs(blob, known is None)
        assert all((a == b.astype(np.int64)).all() for a, b in zip(got, (*pairs, count, total), strict=False))
        if known:
            before = len(packed(*pairs.astype(np.int64), count, total, suffixtree.coded(level.suffix)))
            assert len(got) == 4 and len(blob) < 0.7 * before


def test_suffix_tree_edges(edge, empty):
    got = suffixtree.score_documents(edge).collect()
    assert len(got) == len(EDGES) + 2 and {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert suffixtree.score_documents(empty).count() == 0
    untaught = suffixtree.score_documents(edge.filter("doc_id is null")).first()
    assert untaught["train_tokens"] == 0 and untaught["base_score"] == 0.0


# --- op7 ------------------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(5, "u\r\nv%", "é"), (3, None, "é"), (3, "z", "é"), (None, "q", "é"), (7, "w", None), (8, "w", ""), (9, "k", "only")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    got = [r.asDict() for r in warc.round_trip(pages.drop("payload"), with_payload=True).collect()]
    assert len(got) == len(rows)
    by = {(r["page_id"], r["url"]): r for r in got}
    for i, url, html in rows:
        r, raw = by[i, url], (html or "").encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = {"é": 3, None: 7, "": 7, "only": 9}[html]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))
        assert r["payload"] == (raw if i == first else None)
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert warc.round_trip(pages, min_bytes=3).filter("record_type = 'revisit'").count() == 0


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at : at + n]


def test_zip_directories():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, kind in (("a", zipfile.ZIP_STORED), ("é", zipfile.ZIP_DEFLATED)):
            with z.open(zipfile.ZipInfo(name) if kind == zipfile.ZIP_STORED else name, "w", force_zip64=True) as f:
                f.write(b"hello " + name.encode())
        z.comment = b"PK\5\6 not the end"
    found = warc.members(Bytes(out.getvalue()))
    assert set(found) == {"a", "é"}
    at = warc.data_offset(Bytes(out.getvalue()), found["a"])
    assert out.getvalue()[at : at + found["a"].size] == b"hello a"
    with pytest.raises(ValueError):
        warc.members(Bytes(b"not an archive"))


def test_zip64_end_of_directory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", b"data")
    raw = out.getvalue()
    end = raw.rindex(b"PK\5\6")
    count, size, offset = struct.unpack_from("<HII", raw, end + 10)
    big = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, offset)
    where = b"PK\6\7" + struct.pack("<IQI", 0, end, 1)
    last = b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc.members(Bytes(raw[:end] + big + where + last))["x"].size == 4


# --- op8 ------------------------------------------------------------------------------------------------------------------------------


def plain_groups(links, n):
    group = list(range(n))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash_bits():
    words = b"to be or not to be".split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(3)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert simhash.simhash(" To be\tor not to be\n")[0][0] & 0xFFFFFFFFFFFFFFFF == want
    assert simhash.simhash(None) == ([0], 0) and simhash.simhash("one two")[1] == 1


@pytest.mark.parametrize(("shard", "blocks", "most"), [(7, None, 131_072), (40, None, 16), (1000, None, 20), (7, 1, 131_072), (40, 1, 50), (40, 2, 131_072), (30, 3, 25)])
def test_links_match_all_pairs(spark, shard, blocks, most):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    codes = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False)) for b in base for _ in range(4)]
    codes = list(dict.fromkeys(codes))
    links = [(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if bin(codes[i] ^ codes[j]).count("1") <= 4]
    df = spark.createDataFrame([(i, [c], 0) for i, c in enumerate(codes)], "id long, words array<long>, n_shingles long")
    found = {r["node"]: r["root"] for r in components(simhash.near_links(df, 4, blocks=blocks, shard_codes=shard, most_codes=most)).collect()}
    assert [found.get(i, i) for i in range(len(codes))] == plain_groups(links, len(codes))


def test_simhash_query(spark, docs, texts):
    got = {r["doc_id"]: r for r in queries.op8_simhash(spark, SF).collect()}
    order = sorted(texts)
    h = [simhash.simhash(texts[i])[0][0] & 0xFFFFFFFFFFFFFFFF for i in order]
    links = [(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if bin(h[i] ^ h[j]).count("1") <= 4]
    assert [got[i]["component_id"] for i in order] == [order[g] for g in plain_groups(links, len(h))]
    assert [got[i]["fingerprint"] for i in order] == [f"{x:016x}" for x in h]


def test_simhash_edges(edge, empty):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == len(EDGES) + 2
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert next(r["component_id"] for r in got if r["doc_id"] is None) == 5
    assert simhash.near_duplicates(empty).count() == 0
    kept = sorted((r["doc_id"] for r in simhash.deduplicate(edge).collect() if r["doc_id"] is not None))
    assert kept == [0, 3, 4, 5, 7, 8]


def test_deduplicate_catches_similar_documents(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    a, b = rng.choices(words, k=400), rng.choices(words, k=400)
    near = a[:200] + ["changed"] + a[201:]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(near)), (3, " ".join(b)), (4, " ".join(a[:200] + b[:200]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicate(df).collect()) == [1, 3, 4]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 40), (40, 30), (50, 50)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(21)} | {30: 30, 40: 30}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op9 ------------------------------------------------------------------------------------------------------------------------------


def plain_removal(rows, width=50):
    first = {}
    for i, t in sorted(rows):
        for k in range(len(t) - width + 1):
            first.setdefault(t[k : k + width], i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if first[t[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        out.append((i, len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1])), bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


@given(st.binary(max_size=80) | st.lists(st.sampled_from(b"ab"), max_size=80).map(bytes))
@settings(max_examples=200, deadline=None)
def test_suffix_order(text):
    x = np.frombuffer(text, np.uint8)
    order = suffixes.suffix_order(x, 100).tolist()
    padded = text + b"\0" * 100
    assert sorted(order) == list(range(len(text)))
    assert all(padded[a:] <= padded[b:] or padded[a : a + 100] == padded[b : b + 100] for a, b in zip(order, order[1:], strict=False))


@pytest.mark.parametrize("sizes", [(2 << 20, 16 << 20, 16, 4096), (3000, 4000, 16, 4096), (3000, 4000, 1, 4096), (3000, 4000, 2, 1)])
def test_removal_matches_brute_force(spark, sizes):
    rng = random.Random(11)
    pool = ["".join(rng.choices("abc ", k=rng.randint(45, 130))) for _ in range(8)]
    rows = [(i, "".join(rng.choice([rng.choice(pool), "".join(rng.choices("abcdefgh ", k=rng.randint(0, 60)))]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(60, "é" * 40), (61, "é" * 60), (62, "z" * 49), (63, "z" * 49), (64, "q" * 50), (65, "q" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in suffixes.remove_repeats(df, batch_bytes=sizes[0], shard_bytes=sizes[1], hot_units=sizes[2], hot_anchor=sizes[3]).collect())
    assert [(*r[:4], bytes(r[4])) for r in got] == plain_removal([(i, t.encode()) for i, t in rows])


def test_removal_with_one_short_phrase_in_all_texts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rows = [(i, " ".join([*(word() for _ in range(8)), "all rights are reserved by the publisher", *(word() for _ in range(8))])) for i in range(1500)]
    rows += [(1500 + i, rows[i * 7][1][20:]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in suffixes.remove_repeats(df, batch_bytes=20_000, shard_bytes=20_000).collect())
    assert [(*r[:4], bytes(r[4])) for r in got] == plain_removal([(i, t.encode()) for i, t in rows])


def test_removal_of_rows_with_one_key_in_several_batches(spark):
    text = "x" * 30 + "the same passage of more than fifty bytes stands in all of them" + "y" * 30
    rows = [(1, "q" * 20 + text[10:100]), (None, text), (None, text), (2, text), (2, text)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), batch_bytes=10).collect()
    for k in (None, 2):
        assert len({tuple(r) for r in got if r["doc_id"] == k}) == 1


def test_removal_edges(edge, empty):
    got = suffixes.remove_repeats(edge).collect()
    assert len(got) == len(EDGES) + 2 and all(r["n_removed"] == 0 for r in got)
    assert suffixes.remove_repeats(empty).count() == 0


# --- op10 -----------------------------------------------------------------------------------------------------------------------------


def test_contamination_matches_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 4, 5, 9, 20, 40])))) for i in range(25)] + [(90, None), (91, " ")]
    rows = []
    for i in range(60):
        t = rng.choices(words, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            x = (rng.choice(items[:25])[1]).split()
            if rng.random() < 0.5 and len(x) > 3:
                x[rng.randrange(len(x))] = "other"
            t[rng.randint(0, len(t)) : 0] = x
        rows.append((i, " ".join(t).upper() if i % 7 == 0 else "\n".join(t)))
    rows += [(3, rows[3][1]), (99, None)]

    def shingles(t, n):
        w = (t or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for i, t in rows:
        for k, x in items:
            n = min(5, len((x or "").split()))
            if n and 5 * len(shingles(x, n) & shingles(t, n)) >= 4 * len(shingles(x, n)):
                want.add((i, k))
    extra = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc int")
    got = decontaminate.contaminated(frame(spark, rows), extra).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["item_id"]) for r in got} == want


def test_contamination_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"]) for r in decontaminate.contaminated(edge, items).collect())
    assert got == [(False, 5), (False, 6), (True, None)]
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(edge, items.limit(0)).count() == 0
