"""URL filters: dated list entries as validity intervals, and an as-of join for every capture.

An entry says that from a date on a host, with all hosts under it, is blocked or allowed, until the next
entry for the same host. The entries in force when a page was fetched are found for its host and every
domain above it; the longest one decides. Captures are first reduced to different (host, date), so a host
with a third of all pages is a few hundred rows in the join.

DataFrame functions only. A null URL, one without a host, or a null date has no entry in force and is not
blocked; a null page_id is kept; repeated rows give repeated rows; empty tables give what follows from it;
of entries for one host and date the least action counts (allow before block); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import read

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: str):
    found = F.regexp_extract(F.lower(F.trim(url)), HOST, 1)
    return F.when(found != "", found)


def intervals(entries: DataFrame) -> DataFrame:
    """domain, action, since, until (null: still in force) from domain, action, listed."""
    one = entries.where("domain is not null and listed is not null").groupBy("domain", "listed").agg(F.min("action").alias("action"))
    later = Window.partitionBy("domain").orderBy("listed")
    return one.select("domain", "action", F.col("listed").alias("since"), F.lead("listed").over(later).alias("until"))


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) with host, entry, since, blocked."""
    pages = captures.select("page_id", "url", "fetched").withColumn("host", host_of("url"))
    asked = pages.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    # The host and the domains above it, but for the top one; the number of labels is a host's own.
    above = F.expr("transform(sequence(1, greatest(1, size(split(host, '[.]')) - 1)), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    listed = intervals(entries)
    active = asked.withColumn("domain", F.explode(above)).join(listed, "domain").where("fetched >= since and (until is null or fetched < until)")
    longest = active.groupBy("host", "fetched").agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "since", "action")).alias("m"))
    verdict = longest.select("host", "fetched", F.col("m.domain").alias("entry"), F.col("m.since").alias("since"), (F.col("m.action") == "block").alias("blocked"))
    joined = pages.join(verdict, ["host", "fetched"], "left")
    return joined.select("page_id", "url", "host", "fetched", "entry", "since", F.coalesce("blocked", F.lit(False)).alias("blocked"))


# The tables hold neither fetch dates nor a list, so both follow from rules: a page is fetched page_id % 365
# days into 2024, and a host or domain has entries by the digits of its hash.


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', cast(page_id % 365 as int))").alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    hosts = pages.select(host_of("url").alias("host")).where("host is not null").distinct()
    above = hosts.where("size(split(host, '[.]')) > 2").select(F.expr("array_join(slice(split(host, '[.]'), 2, size(split(host, '[.]'))), '.')").alias("host"))
    hashed = hosts.union(above).distinct().withColumn("m", F.md5(F.col("host").cast("binary")))
    digit = lambda i: F.conv(F.substring("m", i, 1), 16, 10).cast("int")
    listing = F.array(
        F.struct(F.lit("block").alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), digit(2) * 8).alias("listed")),
        F.struct(F.lit("allow").alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), 128 + digit(3) * 8).alias("listed")),
        F.struct(F.lit("block").alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), 256 + digit(4) * 8).alias("listed")),
    )
    return hashed.where(digit(1) < 6).select(F.col("host").alias("domain"), F.explode(listing).alias("e")).select("domain", "e.action", "e.listed")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    found = judged(captures_of(pages), entries_of(pages))
    return found.withColumns({c: F.col(c).cast("string") for c in ("fetched", "since")})


SQL = r"""
WITH p AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS DATE) AS fetched,
                  nullif(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
a AS (SELECT host FROM h UNION SELECT array_to_string(string_split(host, '.')[2:], '.') FROM h WHERE len(string_split(host, '.')) > 2),
x AS (SELECT host, md5(host) AS m FROM a),
n AS (SELECT host, list_transform([1, 2, 3, 4], lambda i: strpos('0123456789abcdef', substr(m, i, 1)) - 1) AS d FROM x),
e AS (SELECT host AS domain, unnest(['block', 'allow', 'block']) AS action, unnest([d[2] * 8, 128 + d[3] * 8, 256 + d[4] * 8]) AS days FROM n WHERE d[1] < 6),
i AS (SELECT domain, action, CAST(DATE '2024-01-01' + CAST(days AS INTEGER) AS DATE) AS since,
             lead(CAST(DATE '2024-01-01' + CAST(days AS INTEGER) AS DATE)) OVER (PARTITION BY domain ORDER BY days) AS until FROM e),
k AS (SELECT DISTINCT host, fetched FROM p WHERE host IS NOT NULL AND fetched IS NOT NULL),
u AS (SELECT host, fetched, unnest(list_transform(range(1, greatest(1, len(string_split(host, '.')) - 1) + 1), lambda j: array_to_string(string_split(host, '.')[j:], '.'))) AS domain FROM k),
v AS (SELECT u.host, u.fetched, i.domain AS entry, i.since, i.action = 'block' AS blocked,
             row_number() OVER (PARTITION BY u.host, u.fetched ORDER BY length(i.domain) DESC, i.domain DESC) AS r
      FROM u JOIN i ON u.domain = i.domain AND u.fetched >= i.since AND (i.until IS NULL OR u.fetched < i.until))
SELECT p.page_id, p.url, p.host, CAST(p.fetched AS VARCHAR) AS fetched, v.entry, CAST(v.since AS VARCHAR) AS since, coalesce(v.blocked, false) AS blocked
FROM p LEFT JOIN v ON p.host = v.host AND p.fetched = v.fetched AND v.r = 1
"""
