"""URL filters: rules by host and path, and a list of hosts, both asked of a Bloom filter cascade without a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasespark.llm import cascade
from phasespark.llm.common import BROADCAST_BYTES, LOWER, UPPER, materialise

#: Tags of keys: what a member of the cascade says of a url. Rules come before the list, blocking before allowing.
BLOCK, ALLOW, LISTED = "b", "a", "l"
#: No key of a url is a member.
NONE = 2**31 - 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://``, A-Z lower-cased, and the path up to ``?`` or ``#``; both empty for null or without ``://``."""
    parts = [F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2)]
    return F.translate(parts[0], UPPER, LOWER), parts[1]


def _ends(host: Column, labels: int) -> Column:
    """The host and its parent domains, of at most ``labels`` labels, longest first."""
    own = F.split(host, r"\.")
    n = F.size(own)
    ends = F.transform(F.sequence(F.greatest(n - labels + 1, F.lit(1)), n), lambda i: F.array_join(F.slice(own, i, n - i + 1), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(ends)


def _keys(labels: int, lengths: list[int]) -> Column:
    """The tagged keys of a url in the order in which they decide: rules from the longest, then the listed host and its parents."""
    host, path = F.col("_host"), F.col("_path")
    ends = _ends(host, labels)
    starts = F.filter(F.array(*(F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths)).cast("array<string>"), lambda p: p.isNotNull())
    ranked = lambda h, p: F.struct((-F.length(h) - F.length(p)).alias("all"), (-F.length(h)).alias("host"), F.concat(h, p).alias("rule"))
    both = F.array_sort(F.flatten(F.transform(ends, lambda h: F.transform(starts, lambda p: ranked(h, p)))))
    ruled = F.flatten(F.transform(both, lambda x: F.array(F.concat(F.lit(BLOCK), x["rule"]), F.concat(F.lit(ALLOW), x["rule"]))))
    return F.concat(ruled, F.transform(ends, lambda h: F.concat(F.lit(LISTED), h)))


def _first(held):
    """An Arrow function: the place of the first key of a row that is a member of a broadcast cascade."""

    @F.arrow_udf("int")
    def first(h1: pa.Array, h2: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.list_value_length(h1)).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hit = held.value.holds(np.asarray(h1.flatten()), np.asarray(h2.flatten()))
        out = np.full(len(sizes), NONE, dtype=np.int32)
        np.minimum.at(out, row[hit], place[hit].astype(np.int32))
        return pa.array(out)

    return first


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with a struct ``judged`` (host, path, rule, verdict) for its column ``url``.

    ``rules`` (host, path, action): a rule fits its host and all subdomains if the url's path starts with its path; the longest in all
    decides, of equally long ones that with the longer host, of both actions for one host and path ``block``. ``listed`` (host): without
    a rule, a url is blocked if its host or a parent domain is listed, and allowed otherwise.

    All keys that any url of the corpus asks for are gathered first, each once, and the cascade is made exact over them. Filters of over
    ``most`` bytes are asked in several passes over the rows, each with its part.

    Null urls and those without ``://`` have an empty host and path and no rule, and are allowed. Nulls in ``rules`` and ``listed`` are
    left out, repeated rows do no harm, and without rules and list all is allowed. Hosts may have any number of labels: they are read
    from the end, as far as the longest host of a rule or of the list goes. A column ``judged`` of ``pages`` is replaced.
    """
    low = F.translate(F.col("host"), UPPER, LOWER)
    rules = rules.filter("host is not null and path is not null and action in ('block', 'allow')")
    tag = F.when(F.col("action") == "block", BLOCK).otherwise(ALLOW)
    members = rules.select(F.concat(tag, low, "path").alias("key"), low.alias("host"))
    members = members.unionByName(listed.filter("host <> ''").select(F.concat(F.lit(LISTED), low).alias("key"), low.alias("host")))
    labels = members.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())

    host, path = host_and_path(F.col("url"))
    whole = F.struct(F.col("*")).alias("page")
    rows = pages.select(whole, host.alias("_host"), path.alias("_path"))
    asked = rows.select("_host", F.substring("_path", 1, max(lengths, default=0)).alias("_path")).distinct()
    asked = asked.select(F.explode(_keys(labels, lengths)).alias("key"))
    hashed = [f.select(*(h.alias(f"h{k}") for k, h in enumerate(cascade.hashes(F.col("key")), 1)), F.lit(own).alias("listed"), F.lit(not own).alias("known")) for f, own in ((asked, False), (members, True))]
    table, shards = cascade.build(hashed[0].unionByName(hashed[1]))

    rows = rows.withColumn("_keys", _keys(labels, lengths)).withColumn("_at", F.lit(NONE))
    ones, twos = F.transform("_keys", lambda k: cascade.hashes(k)[0]), F.transform("_keys", lambda k: cascade.hashes(k)[1])
    parts = cascade.parts(table, most)
    for i, part in enumerate(parts):
        held = pages.sparkSession.sparkContext.broadcast(cascade.fetch(table, shards, part))
        rows = rows.withColumn("_at", F.least("_at", _first(held)(ones, twos)))
        if i + 1 < len(parts):
            rows = materialise(rows, "judged")  # a worker holds one part at a time
    key = F.when(F.col("_at") < NONE, F.get("_keys", F.col("_at")))
    rows = rows.select("page", "_host", "_path", F.substring(key, 1, 1).alias("_tag"), F.expr("substr(_keys[_at], 2)").alias("_rule"))
    judged = F.struct(
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_tag").isin(BLOCK, ALLOW), F.col("_rule")).alias("rule"),
        F.when(F.col("_tag").isin(BLOCK, LISTED), "block").otherwise("allow").alias("verdict"),
    )
    return rows.select("page.*", judged.alias("judged")) if "judged" not in pages.columns else rows.select(*(F.col(f"page.`{c}`") for c in pages.columns if c != "judged"), judged.alias("judged"))


def listed_hosts(pages: DataFrame, words: list[str]) -> DataFrame:
    """(host) of the corpus with one of ``words`` as a part of a label between hyphens, without labels before the first such one."""
    host, _ = host_and_path(F.col("url"))
    parts = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    own = F.split("_host", r"\.")
    bad = F.transform(own, lambda label: F.arrays_overlap(F.split(label, "-"), parts))
    first = F.array_position(bad, True).cast("int")
    rows = pages.select(host.alias("_host")).distinct().filter(first > 0)
    return rows.select(F.array_join(F.slice(own, first, F.size(own)), ".").alias("host")).distinct()
