"""The registered queries of the text operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasespark.llm import audit, bpe, decontaminate, langid, pii, quality, simhash, suffixes, suffixtree, urls, variants, warc, winnow
from phasespark.llm.common import in_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = langid.learn(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.margin", "language.rejected")


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    docs = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("bpe.ids").cast("array<string>"), " ")
    return docs.select(
        "doc_id",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded"), 256).alias("decoded_sha256"),
    )


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the smallest document that it is linked to."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digits = F.lower(F.lpad(F.hex(F.col("words")[0]), 16, "0"))
    return rows.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that contain at least 0.8 of the five-word shingles of a benchmark item, with the items."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs.select("doc_id", "text"), items.select("item_id", "text"))


#: All pairs by plain joins on the shingles themselves.
ORACLE_SQL["op10_decontaminate"] = r"""
WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') w FROM benchmark),
     iq AS (SELECT item_id, w, least(5, len(w)) n FROM i WHERE len(w) > 0),
     si AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) k FROM iq)),
     total AS (SELECT item_id, count(*) q FROM si GROUP BY item_id),
     d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') w FROM documents),
     sd AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') s
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) k FROM d, (SELECT DISTINCT n FROM iq) WHERE len(w) >= n))
SELECT sd.doc_id, si.item_id, any_value(q)::INT n_shingles, count(*)::INT n_found, count(*) / any_value(q) containment
FROM sd JOIN si USING (n, s) JOIN total USING (item_id)
GROUP BY sd.doc_id, si.item_id HAVING 5 * count(*) >= 4 * any_value(q)
"""


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written as a WARC record to ZIP-packaged archives and read back."""
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffix tree's and the unigram base's log10 probability of every document."""
    scored = suffixtree.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    rows = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    label = lambda k: F.transform(k, lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))
    base = F.concat(*map(label, pii.KINDS))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, label("id")), ",").alias("spans"),
    )


@query
def op2_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    rows = winnow.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnow.shown(F.col("entries")).alias("fingerprint"),
        winnow.shown(F.col("edited_entries")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps when 50-byte strings of earlier documents are removed."""
    rows = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document, its language's threshold, and whether the document is kept."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted)


#: The rules of the url query (host, path, action), and the words by which its list of hosts is drawn from the pages.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URL_WORDS = ["adult", "ads", "bets", "casino", "pills", "spam"]


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host and path, the rule that fits, and the verdict of the rule or else of the listed hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.judge(pages, rules, urls.listed_hosts(pages, URL_WORDS)).select("page_id", "judged.*")


ORACLE_SQL["op11_url_filter"] = r"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END r FROM pages),
     u AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM rest),
     rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
     fits AS (SELECT page_id, arg_max(h || p, length(h || p)) rule, arg_max(v, length(h || p)) v
              FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule,
       coalesce(v, CASE WHEN regexp_matches(host, '(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)') THEN 'block' ELSE 'allow' END) verdict
FROM u LEFT JOIN fits ON u.page_id = fits.page_id
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of each order of five filters removes, by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.audit(docs, table(spark, sf_dir, "labels"))


#: Each document along each order by itself: no lattice.
ORACLE_SQL["op12_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') x FROM documents),
     w AS (SELECT *, list_filter(regexp_split_to_array(x, '[ \t\n\x0b\f\r]+'), lambda v: v <> '') ws FROM t),
     f AS (SELECT w.doc_id, part,
                  (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
                  || (CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 2 * length(x) THEN 'C' ELSE '' END)
                  || (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END)
                  || (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END) fails
           FROM w),
     g AS (SELECT f.*, coalesce(max(quality = 1), false) good, coalesce(max(toxic = 1), false) toxic FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL),
     c(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
     o AS (SELECT a.k || b.k || d.k || e.k || h.k o FROM c a, c b, c d, c e, c h WHERE len(list_distinct([a.k, b.k, d.k, e.k, h.k])) = 5),
     s AS (SELECT o, step, substr(o, step, 1) k, substr(o, 1, step - 1) before FROM o, range(1, 6) r(step)),
     groups AS (SELECT part, fails, good, toxic, count(*) n FROM g GROUP BY ALL),
     m AS (SELECT part, o, step, k, n, good, toxic, contains(fails, k) own, fails = k alone,
                  len(list_filter(string_split(fails, ''), lambda v: v <> '' AND contains(before, v))) > 0 gone
           FROM groups, s),
     r AS (SELECT part, o, step, k, sum(n) FILTER (NOT own AND NOT gone) kept, sum(n) FILTER (own AND NOT gone) removed, sum(n) FILTER (own AND gone) redundant,
                  sum(n) FILTER (alone) unique_fails, sum(n) FILTER (own AND NOT gone AND good) good_lost, sum(n) FILTER (own AND NOT gone AND toxic) toxic_lost
           FROM m GROUP BY ALL)
SELECT part, o filter_order, step::INT step, coalesce(kept, 0)::BIGINT kept, coalesce(removed, 0)::BIGINT removed, coalesce(redundant, 0)::BIGINT redundant,
       coalesce(unique_fails, 0)::BIGINT unique_fails, coalesce(good_lost, 0)::BIGINT good_lost, coalesce(toxic_lost, 0)::BIGINT toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, k), 0)::BIGINT shapley
FROM r
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word, the more frequent word that it is a variant of, and the root of its group."""
    return variants.group(variants.words(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: CRC-32 bit by bit, near words by the strings that are left when one character goes.
ORACLE_SQL["op13_spelling_variants"] = r"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run FROM documents),
     own AS (SELECT doc_id, run, count(*) n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
     step8 AS (SELECT list(c ORDER BY b) t FROM (SELECT b, list_reduce([b] || range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) c FROM range(256) r(b))),
     hexed AS (SELECT run, n, hex(encode(doc_id::VARCHAR || ':' || run)) h FROM own),
     crc AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
                                            lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295) h FROM hexed, step8),
     cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, n FROM crc),
     words AS (SELECT word, sum(n)::BIGINT n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
     less AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) k FROM words)),
     near AS (SELECT a.word, b.word near, b.n near_n FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
              UNION SELECT less.word, words.word, words.n FROM less JOIN words ON rest = words.word
              UNION SELECT words.word, less.word, less.n FROM less JOIN words ON rest = words.word),
     best AS (SELECT word, count(*) n_near, first(near ORDER BY near_n DESC, near) near, max(near_n) near_n FROM near GROUP BY word),
     forms AS (SELECT word, n, coalesce(n_near, 0) n_near, CASE WHEN near_n >= 2 * n THEN near END form, CASE WHEN near_n >= 2 * n THEN near_n END form_n
               FROM words LEFT JOIN best USING (word)),
     way AS (SELECT word, word root FROM forms UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON forms.word = way.root WHERE forms.form IS NOT NULL),
     ends AS (SELECT way.word, way.root FROM way JOIN forms ON forms.word = way.root WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
