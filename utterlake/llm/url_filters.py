"""URL filters: dated list entries become validity intervals, joined as of the time of each capture.

An entry says from which day on a host or a path is blocked, allowed or off the list. Consecutive entries
of one pattern make intervals; of entries of one day the strongest counts (allow, remove, block). A
capture meets the entries of its host, of the host's parent domains and of its path prefixes that are
active on the day it was fetched; the longest active pattern decides, and captures that meet none are kept.

The verdict depends on URL and day only, so captures are reduced to distinct pairs before anything is
shuffled by pattern; a host with a third of all rows costs its distinct URLs, and its part of the join is
an ordinary skewed join that adaptive execution splits. Lists of any length work: nothing is broadcast
by hint. Without SQL functions of its own, the operator is column expressions, joins and windows only.

A null or broken URL has no pattern and is kept with a null host; without a fetch day no entry is
active. Entries with a null pattern, day or action are ignored. Repeated captures each get the verdict.
Empty captures give an empty result, an empty list keeps all. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterlake.llm.tables import read

ACTIONS = {"block": 0, "remove": 1, "allow": 2}


def url_host(url: Column) -> Column:
    """Host in lower case without user, port and final dot; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def url_path(url: Column) -> Column:
    """Path segments, without query and fragment."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def url_patterns(host: Column, segments: Column) -> Column:
    """Every pattern that a URL may meet, with its rank: parent domains, the host, then path prefixes."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice(labels, -i, i), ".").alias("pattern"), i.alias("rank"))
    )
    paths = F.transform(
        F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")).alias("pattern"), (n + i).alias("rank")),
    )
    return F.concat(domains, paths)


def validity(entries: DataFrame) -> DataFrame:
    """``pattern, action, valid_from, valid_to``: block and allow intervals, ``valid_to`` not included, null while open."""
    force = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    known = entries.select("pattern", "action", F.col("since").cast("date").alias("valid_from"))
    known = known.where(F.col("pattern").isNotNull() & F.col("valid_from").isNotNull() & F.col("action").isin(*ACTIONS))
    day = known.groupBy("pattern", "valid_from").agg(F.max_by("action", force[F.col("action")]).alias("action"))
    later = Window.partitionBy("pattern").orderBy("valid_from")
    return day.withColumn("valid_to", F.lead("valid_from").over(later)).where("action <> 'remove'")


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", key: str = "page_id") -> DataFrame:
    """``key, url, fetched, host, pattern, action, valid_from, valid_to, kept`` for every capture."""
    rows = captures.select(F.col(key), F.col(url).alias("url"), F.col(fetched).cast("date").alias("fetched"))
    pairs = rows.where("url IS NOT NULL AND fetched IS NOT NULL").select("url", "fetched").distinct()
    host = url_host(F.col("url"))
    met = pairs.select("url", "fetched", F.explode(url_patterns(host, url_path(F.col("url")))).alias("_p"))
    met = met.select("url", "fetched", "_p.pattern", F.col("_p.rank").alias("_rank"))
    active = met.join(validity(entries), "pattern").where("fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)")
    longest = active.groupBy("url", "fetched").agg(F.max(F.struct("_rank", "pattern", "action", "valid_from", "valid_to")).alias("_v"))
    judged = rows.join(longest, ["url", "fetched"], "left")
    return judged.select(
        key,
        "url",
        "fetched",
        host.alias("host"),
        *[F.col(f"_v.{n}").alias(n) for n in ("pattern", "action", "valid_from", "valid_to")],
        (F.coalesce(F.col("_v.action"), F.lit("allow")) != "block").alias("kept"),
    )


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch day made from their id, as the table has none."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts that occur: days and actions follow from the MD5 of a pattern."""
    host = url_host(F.col("url"))
    first = F.get(url_path(F.col("url")), F.lit(0))
    seen = pages.where(F.col("url").isNotNull()).select(host.alias("h"), first.alias("s")).distinct()
    domain = seen.select(F.regexp_extract("h", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("pattern"), F.lit("domain").alias("kind"))
    paths = seen.where("s IS NOT NULL").select(F.concat("h", F.lit("/"), "s").alias("pattern"), F.lit("path").alias("kind"))
    code = F.md5(F.concat("kind", F.lit(":"), "pattern"))
    digit = lambda n: F.conv(F.substring("code", n, 1), 16, 10).cast("int")
    kept = domain.union(paths).where("pattern <> ''").distinct().withColumn("code", code)
    base = F.lit("2024-01-01").cast("date")
    start = digit(2) * 16 + digit(3)
    first_action = F.when(F.col("kind") == "domain", "block").otherwise("allow")
    steps = F.array(
        F.struct(F.date_add(base, start).alias("since"), first_action.alias("action"), F.lit(True).alias("on")),
        F.struct(F.date_add(base, start + 30 + digit(4)).alias("since"), F.lit("remove").alias("action"), (digit(5) < 8).alias("on")),
        F.struct(F.date_add(base, start + 60 + digit(6)).alias("since"), F.lit("block").alias("action"), (digit(7) < 6).alias("on")),
    )
    listed = kept.where((digit(1) < 6) | F.col("pattern").rlike("^(spam-farm|cheap-pills)"))
    rows = listed.select("pattern", F.explode(steps).alias("e")).where("e.on")
    return rows.select("pattern", "e.action", "e.since")


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    judged = url_filter(dated_captures(pages), derived_entries(pages))
    return judged.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("fetched", "valid_from", "valid_to")})


SQL = r"""
WITH c AS (
    SELECT page_id, url, DATE '2024-01-01' + ((page_id % 366 + 366) % 366)::INT AS fetched,
        nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.+$', ''), '') AS host,
        list_filter(string_split(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg
    FROM pages
), seen AS (
    SELECT DISTINCT host AS h, seg[1] AS s FROM c WHERE url IS NOT NULL
), listed AS (
    SELECT DISTINCT pattern, kind, md5(kind || ':' || pattern) AS code FROM (
        SELECT regexp_extract(h, '([^.]+\.[^.]+\.[^.]+)$', 1) AS pattern, 'domain' AS kind FROM seen
        UNION ALL SELECT h || '/' || s, 'path' FROM seen WHERE s IS NOT NULL
    ) WHERE pattern <> ''
), d AS (
    SELECT *, list_transform(range(1, 8), lambda i: strpos('0123456789abcdef', code[i:i]) - 1) AS g FROM listed
), e AS (
    SELECT pattern, kind, g, (DATE '2024-01-01' + (g[2] * 16 + g[3])::INT) AS start FROM d
    WHERE g[1] < 6 OR regexp_matches(pattern, '^(spam-farm|cheap-pills)')
), entries AS (
    SELECT pattern, CASE kind WHEN 'domain' THEN 'block' ELSE 'allow' END AS action, start AS since FROM e
    UNION ALL SELECT pattern, 'remove', start + (30 + g[4])::INT FROM e WHERE g[5] < 8
    UNION ALL SELECT pattern, 'block', start + (60 + g[6])::INT FROM e WHERE g[7] < 6
), days AS (
    SELECT pattern, since, max_by(action, CASE action WHEN 'block' THEN 0 WHEN 'remove' THEN 1 ELSE 2 END) AS action FROM entries GROUP BY ALL
), valid AS (
    SELECT pattern, action, since AS valid_from, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS valid_to FROM days
), kept AS (
    SELECT * FROM valid WHERE action <> 'remove'
), pairs AS (
    SELECT DISTINCT url, fetched, host, seg FROM c WHERE url IS NOT NULL AND host IS NOT NULL
), met AS (
    SELECT url, fetched, i AS rank, array_to_string(string_split(host, '.')[-i:], '.') AS pattern
    FROM pairs, unnest(range(1, len(string_split(host, '.')) + 1)) AS u(i)
    UNION ALL
    SELECT url, fetched, len(string_split(host, '.')) + i, host || '/' || array_to_string(seg[1:i], '/')
    FROM pairs, unnest(range(1, len(seg) + 1)) AS u(i)
), active AS (
    SELECT met.url, met.fetched, rank, kept.* FROM met JOIN kept USING (pattern)
    WHERE met.fetched >= valid_from AND (valid_to IS NULL OR met.fetched < valid_to)
), longest AS (
    SELECT * FROM active QUALIFY row_number() OVER (PARTITION BY url, fetched ORDER BY rank DESC) = 1
)
SELECT page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched, host, pattern, action,
    strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to, coalesce(action, 'allow') <> 'block' AS kept
FROM c LEFT JOIN longest ON c.url = longest.url AND c.fetched = longest.fetched
"""
