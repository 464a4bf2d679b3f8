"""URL cascades, the audit of filters and spelling variants against plain versions, and their edges."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phasespark.llm import audit, cascade, queries, urls, variants

SF = "/root/testdata/sf0.001"
SQL = ["op11_url_filter", "op12_filter_audit", "op13_spelling_variants"]


@pytest.mark.parametrize("name", SQL)
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sql = c.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    columns = list(sql.columns)
    assert order == sorted(columns)
    mine = sorted(([r[k] for k in order] for r in df.collect()), key=repr)
    assert mine == sorted(([r[columns.index(k)] for k in order] for r in sql.fetchall()), key=repr)


# --- op11 -----------------------------------------------------------------------------------------------------------------------------


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_verdict(url, rules, listed):
    host, path = plain_split(url)
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h and under(h) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[3], max(fits)[4]
    return host, path, None, "block" if host and any(under(h) for h in listed) else "allow"


URLS = [
    None, "", "no scheme", "://", "x://", "http://a.b", "http://A.B/P", "http://a.b/p?q#f", "http://a.b?x/y", "http://c.a.b/p/q", "ftp://u:p@a.b:80/p", "http://..a.b/", "http://a.b//",
    "http://a.b/p\nq?r", "x http://a.b/p://c", "http://ä.b/ö", "http://" + "a." * 500 + "b/p/q", "http://a.b/" + "p" * 20000, "http://bad.net/x", "http://sub.bad.net", "http://notbad.net/",
]
RULES = [("a.b", "/p", "block"), ("a.b", "/p", "allow"), ("c.a.b", "", "allow"), ("b", "/p/q", "allow"), ("B", "/", "block"), ("ä.b", "/ö", "allow"), ("a.b", "p", "block"), ("zz", "/none", "block")]
LISTED = ["bad.net", "bad.net", "unused.org", None, ""]


def judged(spark, rows, rules, listed, **how):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(rows)], "page_id long, url string, host string, judged int")
    rules = spark.createDataFrame(rules, "host string, path string, action string")
    return urls.judge(pages, rules, spark.createDataFrame([(h,) for h in listed], "host string"), **how)


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_urls_against_plain_rules(spark, most, monkeypatch):
    monkeypatch.setattr(cascade, "LEAST_SHARDS", 3)
    rng = random.Random(5)
    hosts = ["".join(rng.choice("ab") + rng.choice(["", "."]) for _ in range(6)).strip(".") for _ in range(200)]
    rows = URLS + [f"http://{h}/{rng.choice(['p', 'q', ''])}/{rng.choice('xyz')}" for h in hosts] + ["http://hot.com/a"] * 300
    rules = RULES + [(rng.choice(hosts)[-k:].strip("."), rng.choice(["/", "/p", "/q/", ""]), rng.choice(["block", "allow"])) for k in range(1, 7)] + [(None, "/", "block"), ("b", None, "allow"), ("b", "/", None)]
    listed = LISTED + hosts[:5]
    df = judged(spark, rows, rules, listed, most=most)
    assert df.columns == ["page_id", "url", "host", "judged"]
    got = {r["page_id"]: tuple(r["judged"]) for r in df.collect()}
    ruled = [(h.lower() if h.isascii() else h, p, v) for h, p, v in rules if h and p is not None and v]
    want = {i: plain_verdict(u, ruled, [h for h in listed if h]) for i, u in enumerate(rows)}
    assert got == want
    assert {v[3] for v in want.values()} == {"block", "allow"} and any(v[2] for v in want.values())


def test_urls_without_rules_list_or_pages(spark):
    assert {r["judged"]["verdict"] for r in judged(spark, URLS, [], []).collect()} == {"allow"}
    assert judged(spark, [], RULES, LISTED).count() == 0
    only = {r["url"]: r["judged"]["verdict"] for r in judged(spark, URLS, [], LISTED).collect()}
    assert [u for u, v in only.items() if v == "block"] == ["http://bad.net/x", "http://sub.bad.net"]


def test_listed_hosts_are_cut_at_the_word(spark):
    pages = spark.createDataFrame([(u,) for u in ["http://www.spam-x.a.com/", "http://SPAM.b/", "http://notspam.c/", None]], "url string")
    assert {r[0] for r in urls.listed_hosts(pages, ["spam"]).collect()} == {"spam-x.a.com", "spam.b"}
    assert urls.listed_hosts(pages, []).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 400), st.integers(0, 3000), st.integers(0, 2**32))
def test_a_cascade_is_exact(listed, others, seed):
    rng = np.random.default_rng(seed)
    h1, h2 = (rng.integers(-(2**63), 2**63, listed + others) for _ in range(2))
    flags = np.arange(listed + others) < listed
    rows = [{"shard": 0, "level": i, "bits": b, "probes": p, "filter": f.tobytes()} for i, (b, p, f) in enumerate(cascade.levels(h1, h2, flags))]
    assert (cascade.Cascade.of(rows, 1).holds(h1, h2) == flags).all()
    if listed > 100:
        assert sum(len(r["filter"]) for r in rows) * 8 < listed * (8 + 2 * np.log2(max(1, others / listed) + 1))


def test_a_listed_key_that_is_also_unlisted_is_an_error():
    with pytest.raises(ValueError, match="128 bits"):
        cascade.levels(np.array([1, 1]), np.array([2, 2]), np.array([True, False]))


# --- op12 -----------------------------------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    found = []
    for doc, text, source in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs) else set()
        mark = [any(m[k] == 1 for m in labels if doc is not None and m[0] == doc) for k in (1, 2)]
        found.append((source or "", fails, *mark))
    out = {}
    for part in {f[0] for f in found}:
        own = [f for f in found if f[0] == part]
        worth = Counter()
        for o in map("".join, permutations("ABCDE")):
            for k, c in enumerate(o):
                gone = [f for f in own if c in f[1] and not f[1] & set(o[:k])]
                worth[c] += len(gone)
                out[part, o, k + 1] = [
                    sum(not f[1] & set(o[: k + 1]) for f in own), len(gone), sum(c in f[1] and bool(f[1] & set(o[:k])) for f in own), sum(f[1] == {c} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone),
                ]
        for (p, o, k), row in out.items():
            if p == part:
                row.append(worth[o[k - 1]])
    return out


def test_audit_against_every_order(spark):
    rng = random.Random(3)
    texts = [None, "", " \t", "one", "ONE TWO", "a " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"W{i}" for i in range(220)), "# " + " ".join(f"w{i}" for i in range(220)), "x" * 30000, "é\x0bü\x1cö " * 199]
    docs = [(i, rng.choice(texts), rng.choice(["s", "s", "t", None, ""])) for i in range(120)] + [(3, "one", "s"), (3, "one", "s"), (None, "one", "t"), (None, None, "u"), (-5, "ONE TWO", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, 7, 7) for d in docs], "doc_id long, text string, source string, n int, digest int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in audit.audit(frame, marks).collect()}
    assert got == plain_audit(docs, labels)
    assert audit.audit(frame.limit(0), marks).count() == 0
    bare = audit.audit(frame, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(bare) == (0, 0, 600 * len({s or "" for _, _, s in docs}))


def test_lattice_has_80_edges_and_600_steps():
    assert len(audit.edges()) == 80 and len(set(audit.edges())) == 80
    assert len(audit.steps()) == 600 and {(s, f) for _, _, s, f in audit.steps()} == set(audit.edges())


# --- op13 -----------------------------------------------------------------------------------------------------------------------------


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


WORDS = st.sets(st.text("abé", min_size=1, max_size=6), max_size=40)


@settings(max_examples=150, deadline=None)
@given(WORDS)
def test_automata_number_words_and_find_near_ones(words):
    words = sorted(words)
    automaton = variants.Automaton(words)
    for i, w in enumerate(words):
        state, number = automaton.walk(w)
        assert automaton.final[state] and number == i
    assert automaton.size[0] == len(words)
    found = variants.near_in(words, words, False) + variants.near_in(words, words, True)
    assert len(found) == len(set(found))
    assert {(words[a], words[b]) for a, b in found} == {(a, b) for a in words for b in words if one_apart(a, b)}


def test_an_automaton_is_minimal():
    automaton = variants.Automaton(sorted(a + b for a in "abcdefgh" for b in ("ing", "ings", "ed")))
    used, todo = set(), [0]
    while todo:
        if (s := todo.pop()) not in used:
            used.add(s)
            todo += [e[0] for e in automaton.after[s].values()]
    assert len(used) == 7


def plain_words(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_groups(counts):
    form, near = {}, {}
    for w, n in counts.items():
        near[w] = sorted((-m, v) for v, m in counts.items() if one_apart(w, v))
        form[w] = near[w][0][1] if near[w] and -near[w][0][0] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("most", [1 << 16, 2])
def test_variants_against_plain_loops(spark, most, monkeypatch):
    monkeypatch.setattr(variants, "MOST_WORDS", most)
    monkeypatch.setattr(variants, "LEAST_SHARDS", 5)
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 8))) for _ in range(40)]

    def slip(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w.upper(), w[:k] + w[k + 1 :], w[:k] + rng.choice("abÀ÷") + w[k:], w[:k] + "c" + w[k + 1 :]])

    docs = [(i, " ".join(slip(rng.choice(stems[: 1 + i % 40])) for _ in range(60)) + rng.choice([".", "!x", "-"])) for i in range(150)]
    docs += [(None, "Hello hello HELLO hellos"), (1, None), (2, ""), (3, "a1b2 ab"), (4, "y" * 20000), (4, "y" * 20000), (5, "Y" * 20000), (None, "hello")]
    frame = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int")
    counts = plain_words(docs)
    counted = variants.words(frame)
    assert {r["word"]: r["n"] for r in counted.collect()} == counts
    assert {r["word"]: tuple(r) for r in variants.group(counted).collect()} == plain_groups(counts)
    assert sum(v[1] is not None and v[2] != v[1] for v in plain_groups(counts).values()) > 0


def test_variants_of_nothing(spark):
    assert variants.group(variants.words(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    assert variants.group(variants.words(spark.createDataFrame([(1, "rare words only")], "doc_id long, text string"))).count() == 0
