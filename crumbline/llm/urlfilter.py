"""Operator 3: URL filters by a temporal list join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Intervals up to which the list goes to every task; a longer one meets the captures' keys by a shuffle.
SMALL = 200_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a dot at the end; null where the URL has none."""
    host = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*+@)?(\[[^\]/?#]*\]|[^/?#:]*+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path, from its first slash, without query and fragment; empty if there is none."""
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*+(/[^?#]*)", 1)


def keys_of(url: Column, depth: Column | int) -> Column:
    """What an entry can name a URL by: its host and every parent domain, and each of these with up to depth leading path segments."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    levels = F.sequence(F.lit(0), F.least(F.size(segments), F.lit(depth) if isinstance(depth, int) else depth))
    tails = F.transform(levels, lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))))
    every = F.flatten(F.transform(hosts, lambda h: F.transform(tails, lambda t: F.concat(h, t))))
    return F.when(host_of(url).isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, allows, since, until): when each entry is active; until is exclusive and null while it stays.

    entries: (list, key, allows, adds, at), dated changes. An entry is active from a change that adds it until the next change of
    the same list and key that doesn't; of changes at one time the one that adds wins. Changes that change nothing are merged. Rows with a null list, key or
    time are left out.
    """
    change = entries.where("list is not null and key is not null and at is not null").groupBy("list", F.lower("key").alias("key"), "at").agg(F.max(F.coalesce("adds", F.lit(False))).alias("adds"), F.max(F.coalesce("allows", F.lit(False))).alias("allows"))
    order = Window.partitionBy("list", "key").orderBy("at")
    turns = change.withColumn("was", F.lag("adds").over(order)).where(F.col("adds") != F.coalesce("was", F.lit(False)))
    turns = turns.withColumn("until", F.lead("at").over(order))
    return turns.where("adds").select("list", "key", "allows", F.col("at").alias("since"), "until")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures with a column verdict = struct(host, active, blocked, by, list): what the lists said when the page was fetched.

    captures has url and fetched_at. active counts the entries, over all lists, that name the URL and were active at fetched_at;
    the most specific one decides (the longest key; of equal ones one that allows, then the first list by name): by is its key.
    Each different (url, time) is judged once, whatever the number of captures. A null or hostless URL, or a null time, matches
    nothing and isn't blocked. Repeated rows stay.
    """
    spans = intervals(entries)
    depth = entries.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    asked = captures.select(F.col("url").alias("u"), F.col("fetched_at").alias("t")).where("u is not null and t is not null").distinct()
    keyed = asked.select("u", "t", F.explode(keys_of(F.col("u"), int(depth))).alias("k"))
    if spans.limit(SMALL + 1).count() <= SMALL:  # most keys, "com" for one, are no entry's: a list of checked size drops them where they are made
        spans = F.broadcast(spans)
    on = (F.col("k") == F.col("key")) & (F.col("since") <= F.col("t")) & (F.col("until").isNull() | (F.col("t") < F.col("until")))
    hits = keyed.join(spans, on)
    # The smallest of these stands for the longest key, then one that allows, then the first list.
    least = F.min(F.struct((-F.length("key")).alias("n"), (-F.col("allows").cast("int")).alias("a"), "list", "key", "allows"))
    said = hits.groupBy("u", "t").agg(F.count("*").alias("active"), least.alias("best"))
    out = captures.select(F.struct("*").alias("doc"), F.col("url").alias("cu"), F.col("fetched_at").alias("ct")).join(said, (F.col("cu") == F.col("u")) & (F.col("ct") == F.col("t")), "left")
    verdict = F.struct(
        host_of(F.col("cu")).alias("host"), F.coalesce("active", F.lit(0)).alias("active"), F.coalesce(~F.col("best.allows"), F.lit(False)).alias("blocked"),
        F.col("best.key").alias("by"), F.col("best.list").alias("list"),
    )
    return out.select("doc", verdict.alias("verdict"))


def passed(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures that aren't blocked, with their own columns."""
    return judged(captures, entries).where("not verdict.blocked").select("doc.*")


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def _day(n: Column) -> Column:
    return F.timestamp_seconds(F.lit(1_704_067_200) + n * 86_400)


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages have no fetch time: a day of the year 2024 is made from the page id."""
    return pages.select("page_id", "url", _day(F.pmod(F.col("page_id") * 37, F.lit(366))).alias("fetched_at"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """pages come without lists: three are made from the hosts' last three labels. By a hash, some domains are blocked (some of them removed
    again, some put back), some hosts are allowed for a season, and some domains' English pages are blocked from a day on."""
    domain = F.array_join(F.slice(F.split(host_of(F.col("url")), r"\."), -3, 3), ".")
    labels = F.size(F.split(host_of(F.col("url")), r"\."))
    domains = pages.where(host_of(F.col("url")).isNotNull() & (labels >= 3)).select(domain.alias("d")).distinct().withColumn("n", _number(F.col("d")))
    one = lambda when, name, key, allows, adds, at: F.when(when, F.struct(F.lit(name).alias("list"), key.alias("key"), F.lit(allows).alias("allows"), F.lit(adds).alias("adds"), _day(at).alias("at")))
    n, d = F.col("n"), F.col("d")
    rows = F.array(
        one(n % 4 == 0, "block", d, False, True, n % 200), one(n % 8 == 0, "block", d, False, False, n % 200 + 60), one(n % 16 == 0, "block", d, False, True, n % 200 + 120),
        one(n % 7 == 0, "allow", F.concat(F.lit("www."), d), True, True, n % 300), one(n % 7 == 0, "allow", F.concat(F.lit("www."), d), True, False, n % 300 + 90),
        one(n % 9 == 0, "paths", F.concat(d, F.lit("/en")), False, True, n % 250),
    )
    return domains.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("e")).select("e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = judged(dated_captures(pages), dated_entries(pages))
    return found.select("doc.page_id", "doc.fetched_at", "verdict.host", "verdict.active", "verdict.blocked", F.col("verdict.by").alias("blocked_or_allowed_by"), F.col("verdict.list").alias("list"))


ORACLE = r"""
WITH c AS (
  SELECT page_id, url, make_timestamp((1704067200 + ((page_id * 37 % 366 + 366) % 366) * 86400) * 1000000) AS fetched_at,
    nullif(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '\.+$', ''), '') AS host,
    regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), l AS (
  SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM c
), dom AS (
  SELECT DISTINCT array_to_string(labels[-3:], '.') AS d FROM l WHERE host IS NOT NULL AND len(labels) >= 3
), nd AS (SELECT d, ('0x' || substr(md5(d), 1, 7))::BIGINT AS n FROM dom
), iv AS (
  SELECT 'block' AS list, d AS key, false AS allows, n % 200 AS since, CASE WHEN n % 8 = 0 THEN n % 200 + 60 END AS until FROM nd WHERE n % 4 = 0
  UNION ALL SELECT 'block', d, false, n % 200 + 120, NULL FROM nd WHERE n % 16 = 0
  UNION ALL SELECT 'allow', 'www.' || d, true, n % 300, n % 300 + 90 FROM nd WHERE n % 7 = 0
  UNION ALL SELECT 'paths', d || '/en', false, n % 250, NULL FROM nd WHERE n % 9 = 0
), k AS (
  SELECT page_id, url, fetched_at, ((page_id * 37 % 366 + 366) % 366) AS day, unnest(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.'))) AS key FROM l WHERE host IS NOT NULL
  UNION ALL SELECT page_id, url, fetched_at, ((page_id * 37 % 366 + 366) % 366), unnest(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.') || '/' || segs[1])) FROM l WHERE host IS NOT NULL AND len(segs) > 0
), h AS (
  SELECT k.page_id, k.url, iv.*, row_number() OVER (PARTITION BY k.page_id, k.url ORDER BY length(iv.key) DESC, iv.allows DESC, iv.list) AS nth, count(*) OVER (PARTITION BY k.page_id, k.url) AS active
  FROM k JOIN iv ON k.key = iv.key AND iv.since <= k.day AND (iv.until IS NULL OR k.day < iv.until)
)
SELECT l.page_id, l.fetched_at, l.host, coalesce(h.active, 0)::BIGINT AS active, coalesce(NOT h.allows, false) AS blocked, h.key AS blocked_or_allowed_by, h.list AS list
FROM l LEFT JOIN h ON h.page_id = l.page_id AND h.url IS NOT DISTINCT FROM l.url AND h.nth = 1
"""
