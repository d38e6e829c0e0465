"""Catalog entries: ingest from raw hits (I01-I07) with enrichment (E01-E06, E08, E09), and
reports run over the ingested tables."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from ..operators import audience as A
from ..operators import ingest as I
from ..operators.merge import merge_tables
from ..session import scratch_path
from ..sources.fixtures import read_table
from ..sources.hits import (GEO_RANGES_SQL, RAW_HITS_SQL, REFERRERS, UA_EXPECTED_SQL,
                            USER_AGENTS, V6_HIGH, V6_LOW, fixture_geo_ranges, fixture_geo_ranges6,
                            raw_hits_from_events, read_hits, with_ipv6)
from ..sources.tables import Tables, load_tables
from .catalog import CATALOG, register, source_sql

_CACHE: dict = {}
_LOCK = threading.Lock()
LOG_ROWS = 2_000_000  # hits in a file of the JSON log, at most
PACKED_ROWS = 500_000  # the same where it is compressed, as such a file is read by one task


def spread_events(spark, sf_dir):
    """The events over all cores, each part in order of dates, before hits are built from them: their few columns
    are shuffled and sorted, not the payloads, which are many times as wide."""
    events = read_table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism)
    return events.sortWithinPartitions(F.to_date("ts"))


def raw_hits(spark, sf_dir):
    """The fixture hit log, written once per application as date-partitioned Parquet under
    the shared checkpoint folder (the way collected hits land in storage), then read back."""
    key = ("raw", spark.sparkContext.applicationId, sf_dir)
    with _LOCK:
        if key not in _CACHE:
            out = scratch_path(spark, "hits")
            (raw_hits_from_events(spread_events(spark, sf_dir))  # in order of dates: the writer sorts nothing
             .withColumn("dt", F.to_date("received_at"))
             .write.partitionBy("dt").parquet(out))
            _CACHE[key] = spark.read.parquet(out).drop("dt")
        return _CACHE[key]


def json_hits(spark, sf_dir, packed: bool = False) -> str:
    """The fixture hits as JSON payloads, times in turn with ``Z``, an offset and no zone; the path.

    A micro-batch takes a few files, so a stream's are plain text, which Spark splits over the cores. A batch reads
    all files at once: ``packed`` compresses them.
    """
    key = ("packed" if packed else "json", spark.sparkContext.applicationId, sf_dir)
    with _LOCK:
        if key not in _CACHE:
            out = scratch_path(spark, "json_hits")
            raw = raw_hits_from_events(spread_events(spark, sf_dir))
            t, form = F.col("received_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
            east = F.date_format(t + F.make_dt_interval(hours=F.lit(2)), form)
            text = (F.when(F.col("hit_id") % 3 == 0, F.concat(F.date_format(t, form), F.lit("Z")))
                    .when(F.col("hit_id") % 3 == 1, F.concat(east, F.lit("+02:00")))
                    .otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS")))
            (raw.withColumn("received_at", text).write.option("maxRecordsPerFile", PACKED_ROWS if packed else LOG_ROWS)
             .json(out, compression="gzip" if packed else "none"))
            _CACHE[key] = out
        return _CACHE[key]


def json_ingested(spark, sf_dir) -> tuple[Tables, object]:
    return I.ingest(read_hits(spark, json_hits(spark, sf_dir, packed=True)), fixture_geo_ranges(spark, sf_dir))


def ingested(spark, sf_dir) -> tuple[Tables, object]:
    key = (spark.sparkContext.applicationId, sf_dir)
    raw = raw_hits(spark, sf_dir)
    with _LOCK:
        if key not in _CACHE:
            _CACHE[key] = I.ingest(raw, fixture_geo_ranges(spark, sf_dir))
        return _CACHE[key]


def _q(s):
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


# Expected host per fixture referrer, as a URL parser reports it (hand-labelled).
REFERRER_HOSTS = [
    "www.google.com", "www.bing.com", "search.yahoo.com", "m.facebook.com", "t.co", "x.com",
    "www.netflix.com", "[2001:db8::1]", None, None, None, "", "l.instagram.com",
    "www.linkedin.com", "news.example.org", None,
]
_HOSTS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({_q(r)}, {_q(h)})" for r, h in zip(REFERRERS, REFERRER_HOSTS) if r) + ") AS t(referrer, host)"

_VALID_SQL = """SELECT hit_id, received_at, user_id, visitorId AS visitor_id, sessionId AS session_id,
 type, COALESCE(NULLIF(path, ''), '/') AS page_path, COALESCE(title, '') AS page_title,
 NULLIF(referrer, '') AS referrer, COALESCE(user_agent, '') AS user_agent,
 NULLIF(language, '') AS language, NULLIF(width, 0) AS screen_width,
 NULLIF(height, 0) AS screen_height, COALESCE(NULLIF(ip, ''), NULLIF(forwarded_for, '')) AS ip
FROM raw WHERE COALESCE(visitorId, '') <> '' AND COALESCE(sessionId, '') <> ''"""

_SESSIONS_SQL = """SELECT f.hit_id AS id, f.visitor_id, f.session_id, f.received_at AS started_at,
 CAST(NULL AS TIMESTAMP) AS ended_at, CAST(NULL AS BIGINT) AS duration,
 CAST(1 + c.n AS BIGINT) AS page_views, f.referrer, h.host AS referrer_domain,
 CAST(NULL AS VARCHAR) AS utm_source, CAST(NULL AS VARCHAR) AS utm_medium,
 CAST(NULL AS VARCHAR) AS utm_campaign
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY received_at, hit_id) AS rn
      FROM valid) f
JOIN (SELECT session_id, count(CASE WHEN type = 'pageview' THEN 1 END) AS n FROM valid
      GROUP BY session_id) c ON f.session_id = c.session_id
LEFT JOIN hosts h ON f.referrer = h.referrer
WHERE f.rn = 1"""

_ADDR = "regexp_replace(trim(ip), '^::ffff:', '')"
_DETAILS_SQL = f"""SELECT v.hit_id AS id, v.visitor_id, g.country, g.country AS country_code, g.city,
 g.region, ua.browser, ua.device_type, ua.os, v.screen_width, v.screen_height, v.language,
 v.received_at AS updated_at
FROM (SELECT *,
  CASE WHEN ip IN ('127.0.0.1', '::1') OR starts_with(ip, '192.168.') OR starts_with(ip, '10.')
       THEN NULL
       WHEN regexp_full_match({_ADDR}, '[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}')
        AND CAST(split_part({_ADDR}, '.', 1) AS BIGINT) <= 255
        AND CAST(split_part({_ADDR}, '.', 2) AS BIGINT) <= 255
        AND CAST(split_part({_ADDR}, '.', 3) AS BIGINT) <= 255
        AND CAST(split_part({_ADDR}, '.', 4) AS BIGINT) <= 255
       THEN CAST(split_part({_ADDR}, '.', 1) AS BIGINT) * 16777216
          + CAST(split_part({_ADDR}, '.', 2) AS BIGINT) * 65536
          + CAST(split_part({_ADDR}, '.', 3) AS BIGINT) * 256
          + CAST(split_part({_ADDR}, '.', 4) AS BIGINT)
  END AS ip_long
  FROM valid WHERE ip IS NOT NULL) v
JOIN ua ON ua.idx = v.user_id % {len(USER_AGENTS)}
LEFT JOIN geo g ON v.ip_long BETWEEN g.ip_from AND g.ip_to"""

# IPv6 hits by the numbers their addresses are written from.
_DETAILS6_SQL = f"""SELECT d.id, d.visitor_id, d.country, d.country_code, d.city, d.region, d.browser, d.device_type,
 d.os, d.screen_width, d.screen_height, d.language, d.updated_at
FROM details_i d WHERE d.id % 2 = 1
UNION ALL
SELECT v.hit_id, v.visitor_id, n_name, n_name, 'town' || CAST(n_nationkey AS VARCHAR), r_name, ua.browser,
 ua.device_type, ua.os, v.screen_width, v.screen_height, v.language, v.received_at
FROM valid v JOIN ua ON ua.idx = v.user_id % {len(USER_AGENTS)}
LEFT JOIN (nation LEFT JOIN region ON n_regionkey = r_regionkey)
  ON v.hit_id % 50 <> 0 AND n_nationkey = v.hit_id % 25 AND v.hit_id * 37 % 65536 BETWEEN {V6_LOW} AND {V6_HIGH}
WHERE v.hit_id % 2 = 0"""

_BASE = {"raw": RAW_HITS_SQL, "valid": _VALID_SQL}


def ingest_sql(body: str, *needs: str) -> str:
    ctes = dict(_BASE)
    extra = {"hosts": _HOSTS_SQL, "sessions_i": _SESSIONS_SQL, "geo": GEO_RANGES_SQL,
             "ua": UA_EXPECTED_SQL, "details_i": _DETAILS_SQL}
    order = {"sessions_i": ["hosts"], "details_i": ["geo", "ua"]}
    for n in needs:
        for d in order.get(n, []):
            ctes[d] = extra[d]
        ctes[n] = extra[n]
    return "WITH " + ",\n".join(f"{k} AS (\n{v}\n)" for k, v in ctes.items()) + "\n" + body.strip()


@register("ingest_rejected", ingest_sql("""
SELECT hit_id, received_at,
 CASE WHEN COALESCE(visitorId, '') = '' THEN 'visitorId is required'
      ELSE 'sessionId is required' END AS reject_reason
FROM raw WHERE COALESCE(visitorId, '') = '' OR COALESCE(sessionId, '') = ''"""))
def _rejected(spark, d):
    return ingested(spark, d)[1]


@register("ingest_visitors", ingest_sql("""
SELECT f.hit_id AS id, f.visitor_id, f.ip AS ip_address, f.user_agent, a.created_at, a.last_seen
FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY received_at, hit_id) AS rn
      FROM valid) f
JOIN (SELECT visitor_id, min(received_at) AS created_at, max(received_at) AS last_seen
      FROM valid GROUP BY visitor_id) a ON f.visitor_id = a.visitor_id
WHERE f.rn = 1"""))
def _visitors(spark, d):
    return ingested(spark, d)[0].visitors


@register("ingest_sessions", ingest_sql("SELECT * FROM sessions_i", "sessions_i"))
def _sessions(spark, d):
    return ingested(spark, d)[0].sessions


@register("ingest_page_views", ingest_sql("""
SELECT hit_id AS id, session_id, visitor_id, page_path, page_title, received_at AS viewed_at,
 FALSE AS is_bounce
FROM valid WHERE type = 'pageview'"""))
def _page_views(spark, d):
    return ingested(spark, d)[0].page_views


_DETAIL_COLS = ["id", "visitor_id", "country", "country_code", "city", "region", "browser",
                "device_type", "os", "screen_width", "screen_height", "language", "updated_at"]


@register("ingest_visitor_details", ingest_sql("SELECT * FROM details_i", "details_i"))
def _details(spark, d):
    return ingested(spark, d)[0].visitor_details.select(*_DETAIL_COLS)


@register("ingest_visitor_details_ipv6", ingest_sql(_DETAILS6_SQL, "details_i"))
def _details6(spark, d):
    raw = with_ipv6(raw_hits(spark, d))
    tables, _ = I.ingest(raw, fixture_geo_ranges(spark, d), geo_ranges6=fixture_geo_ranges6(spark, d))
    return tables.visitor_details.select(*_DETAIL_COLS)


@register("ingest_events", ingest_sql("""
SELECT hit_id AS id, session_id, visitor_id, type AS event_type,
 CAST(NULL AS VARCHAR) AS event_name, CAST(NULL AS VARCHAR) AS event_data, page_path,
 received_at AS created_at
FROM valid WHERE type IS NULL OR type <> 'pageview'"""))
def _events(spark, d):
    return ingested(spark, d)[0].events


# Reports over the ingested tables: referrer URL → host → source bucket end to end, and the
# enrichment-driven audience breakdowns.
@register("ingest_referrers_all", ingest_sql(f"""
SELECT {source_sql('referrer_domain')} AS source,
 count(*) AS sessions, count(DISTINCT visitor_id) AS visitors
FROM sessions_i GROUP BY source ORDER BY sessions DESC, source ASC NULLS FIRST LIMIT 15""",
                                            "sessions_i"))
def _ing_referrers(spark, d):
    return A.referrers(ingested(spark, d)[0].sessions, "all")


def _ing_breakdown(name, keys, n):
    order = ", ".join(["visitors DESC"] + [f"{k} ASC NULLS FIRST" for k in keys])
    nn = " AND ".join(f"{k} IS NOT NULL" for k in keys[:1])
    lim = f" ORDER BY {order} LIMIT {n}" if n else ""
    sql = ingest_sql(f"""
SELECT {', '.join(keys)}, count(DISTINCT visitor_id) AS visitors FROM details_i
WHERE {nn} GROUP BY {', '.join(keys)}{lim}""", "details_i")
    fn = getattr(A, name)
    register("ingest_" + name, sql)(lambda spark, d: fn(ingested(spark, d)[0].visitor_details))


_ing_breakdown("top_countries_basic", ["country"], 10)
_ing_breakdown("top_cities", ["city", "country"], 20)
_ing_breakdown("top_browsers", ["browser"], 10)
_ing_breakdown("device_types", ["device_type"], None)
_ing_breakdown("languages", ["language"], 15)


def incremental(spark, sf_dir):
    """The hit log loaded in three parts, the latest first, each merged into the stored tables."""
    key = ("parts", spark.sparkContext.applicationId, sf_dir)
    raw, geo = raw_hits(spark, sf_dir), fixture_geo_ranges(spark, sf_dir)
    with _LOCK:
        if key not in _CACHE:
            out = scratch_path(spark, "merged")
            for part in (2, 0, 1):
                tables, _ = I.ingest(raw.where(F.col("hit_id") % 3 == part), geo)
                merge_tables(spark, tables, out)
            _CACHE[key] = load_tables(spark, out)
        return _CACHE[key]


for _name in ("visitors", "sessions", "page_views"):
    register(f"ingest_{_name}_incremental", CATALOG["ingest_" + _name].sql)(
        lambda spark, d, name=_name: incremental(spark, d).frames()[name].drop("dt"))


def repeated(spark, sf_dir):
    """The hit log loaded in two parts, each of them twice and the first one once more at the end."""
    key = ("repeated", spark.sparkContext.applicationId, sf_dir)
    raw, geo = raw_hits(spark, sf_dir), fixture_geo_ranges(spark, sf_dir)
    with _LOCK:
        if key not in _CACHE:
            out = scratch_path(spark, "repeated")
            for part in (1, 1, 0, 0, 1):
                tables, _ = I.ingest(raw.where(F.col("hit_id") % 2 == part), geo)
                merge_tables(spark, tables, out)
            _CACHE[key] = load_tables(spark, out)
        return _CACHE[key]


for _name in ("visitors", "sessions", "page_views"):
    register(f"ingest_{_name}_repeated", CATALOG["ingest_" + _name].sql)(
        lambda spark, d, name=_name: repeated(spark, d).frames()[name].drop("dt"))
register("ingest_visitor_details_repeated", CATALOG["ingest_visitor_details"].sql)(
    lambda spark, d: repeated(spark, d).visitor_details.select(*_DETAIL_COLS))

# The same tables from JSON payloads.
_JSON = {
    "rejected": lambda t, r: r,
    "visitors": lambda t, r: t.visitors,
    "sessions": lambda t, r: t.sessions,
    "page_views": lambda t, r: t.page_views,
    "visitor_details": lambda t, r: t.visitor_details.select(*_DETAIL_COLS),
}
for _name, _pick_table in _JSON.items():
    register("ingest_json_" + _name, CATALOG["ingest_" + _name].sql)(
        lambda spark, d, pick=_pick_table: pick(*json_ingested(spark, d)))
