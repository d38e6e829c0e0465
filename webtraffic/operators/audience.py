"""Acquisition (Q18-Q20) and audience breakdowns (Q21-Q31).

Breakdowns count distinct visitors per value over ``visitor_details`` for all time, as the
reference does (the report period does not apply to them). ``details_period`` optionally
restricts them to detail rows updated in a period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.enrich import referrer_source
from ..functions.period import DEFAULT_PERIOD, pcol, time_filter
from .topk import top_k


def _sessions_in(sessions, period, start, end, as_of):
    return sessions.where(time_filter("started_at", period, start, end, as_of, pcol(sessions)))


def referrers(sessions: DataFrame, period=DEFAULT_PERIOD, as_of=None, start=None, end=None,
              n: int = 15) -> DataFrame:
    """Q18: sessions and distinct visitors per referrer source bucket."""
    s = _sessions_in(sessions, period, start, end, as_of)
    agg = (s.groupBy(referrer_source(F.col("referrer_domain")).alias("source"))
           .agg(F.count(F.lit(1)).alias("sessions"),
                F.count_distinct("visitor_id").alias("visitors")))
    return top_k(agg, "sessions", ["source"], n)


def _utm(sessions, col, out, period, as_of, start, end, n):
    s = _sessions_in(sessions, period, start, end, as_of)
    agg = (s.groupBy(F.coalesce(F.col(col), F.lit("none")).alias(out))
           .agg(F.count(F.lit(1)).alias("sessions")))
    return top_k(agg, "sessions", [out], n)


def utm_sources(sessions, period=DEFAULT_PERIOD, as_of=None, start=None, end=None,
                n: int = 10) -> DataFrame:
    """Q19: sessions per ``utm_source`` (NULL → ``none``; the empty string stays its own)."""
    return _utm(sessions, "utm_source", "source", period, as_of, start, end, n)


def utm_mediums(sessions, period=DEFAULT_PERIOD, as_of=None, start=None, end=None,
                n: int = 10) -> DataFrame:
    """Q20: sessions per ``utm_medium``."""
    return _utm(sessions, "utm_medium", "medium", period, as_of, start, end, n)


def breakdown(details: DataFrame, keys: dict[str, Column] | list[str], not_null: list[str],
              n: int | None, extra: dict[str, Column] | None = None,
              details_period: tuple | None = None) -> DataFrame:
    """Distinct visitors per key combination, keys non-NULL as listed, top ``n`` (or all).

    ``COUNT(DISTINCT visitor_id)`` plans as a partial aggregate on (keys, visitor_id) before
    the shuffle, so a visitor with millions of detail rows contributes one row per map task.
    """
    if isinstance(keys, list):
        keys = {k: F.col(k) for k in keys}
    d = details
    if details_period is not None:
        period, as_of = details_period
        d = d.where(time_filter("updated_at", period, None, None, as_of, pcol(d)))
    for c in not_null:
        d = d.where(F.col(c).isNotNull())
    aggs = [F.count_distinct("visitor_id").alias("visitors")]
    aggs += [v.alias(k) for k, v in (extra or {}).items()]
    agg = d.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(*aggs)
    if n is None:
        return agg
    return top_k(agg, "visitors", list(keys), n)


def top_countries_basic(details, n: int = 10) -> DataFrame:
    """Q21 (basic report)."""
    return breakdown(details, ["country"], ["country"], n)


def top_countries(details, n: int = 20) -> DataFrame:
    """Q22: with the number of distinct cities."""
    return breakdown(details, ["country", "country_code"], ["country"], n,
                     extra={"cities": F.count_distinct("city")})


def top_cities(details, n: int = 20) -> DataFrame:
    """Q23."""
    return breakdown(details, ["city", "country"], ["city"], n)


def top_browsers(details, n: int = 10) -> DataFrame:
    """Q24."""
    return breakdown(details, ["browser"], ["browser"], n)


def browser_versions(details, n: int = 15) -> DataFrame:
    """Q25."""
    return breakdown(details, ["browser", "browser_version"], ["browser", "browser_version"], n)


def device_types(details) -> DataFrame:
    """Q26: no order and no limit, as in the reference."""
    return breakdown(details, ["device_type"], ["device_type"], None)


def device_brands(details, n: int = 10) -> DataFrame:
    """Q27."""
    return breakdown(details, ["device_brand"], ["device_brand"], n)


def device_models(details, n: int = 15) -> DataFrame:
    """Q28."""
    return breakdown(details, ["device_brand", "device_model"], ["device_model"], n)


def os_versions(details, n: int = 15) -> DataFrame:
    """Q29."""
    return breakdown(details, ["os", "os_version"], ["os", "os_version"], n)


def screen_resolutions(details, n: int = 15) -> DataFrame:
    """Q30: ``width || 'x' || height``."""
    res = F.concat(F.col("screen_width").cast("string"), F.lit("x"),
                   F.col("screen_height").cast("string"))
    return breakdown(details, {"resolution": res}, ["screen_width", "screen_height"], n)


def languages(details, n: int = 15) -> DataFrame:
    """Q31."""
    return breakdown(details, ["language"], ["language"], n)


# The enhanced report's top-k breakdowns: list name -> (group keys, non-NULL columns, limit).
# Screen resolutions group on (width, height) and are named and ordered by ``width||'x'||height``
# — one string per integer pair, so the groups are the same as grouping on the string.
ENHANCED_BREAKDOWNS = {
    "topCountries": (["country", "country_code"], ["country"], 20),
    "topCities": (["city", "country"], ["city"], 20),
    "deviceBrands": (["device_brand"], ["device_brand"], 10),
    "deviceModels": (["device_brand", "device_model"], ["device_model"], 15),
    "osVersions": (["os", "os_version"], ["os", "os_version"], 15),
    "browserVersions": (["browser", "browser_version"], ["browser", "browser_version"], 15),
    "topBrowsers": (["browser"], ["browser"], 10),
    "screenResolutions": (["screen_width", "screen_height"], ["screen_width", "screen_height"], 15),
    "languages": (["language"], ["language"], 15),
}
# The basic report's breakdown lists (Q21, Q24); no city count.
BASIC_BREAKDOWNS = {
    "topCountries": (["country"], ["country"], 10),
    "topBrowsers": (["browser"], ["browser"], 10),
}
_RESOLUTION = ["screen_width", "screen_height"]


def _resolution() -> Column:
    return F.concat(F.col("screen_width").cast("string"), F.lit("x"),
                    F.col("screen_height").cast("string"))


def _shown_keys(keys: list[str]) -> list[tuple[str, Column]]:
    """The (name, value) pairs a breakdown reports and is ordered by."""
    if keys == _RESOLUTION:
        return [("resolution", _resolution())]
    return [(k, F.col(k)) for k in keys]


def breakdown_lists(details: DataFrame, specs: dict | None = None,
                    cities_for: str | None = "topCountries") -> DataFrame:
    """Several top-k breakdowns in one pass: a one-row frame, one ordered list per breakdown.

    Equal to running :func:`breakdown` once per entry of ``specs`` (default
    ``ENHANCED_BREAKDOWNS``; the list named ``cities_for`` also counts distinct cities, as
    Q22 does) and gathering each result as a list
    ordered by visitors descending, then keys. Instead of one scan and two shuffles per
    breakdown, the detail table is read once: a grouping-sets aggregate (one Expand, combined
    map-side) yields the distinct (keys, visitor) rows of every breakdown, a second aggregate
    counts them, and a row_number cut per breakdown runs as a window group limit before its
    shuffle, so each task forwards at most ``limit`` rows per breakdown to the final gather.
    """
    specs = specs or ENHANCED_BREAKDOWNS
    names = list(specs)
    dims = []
    for keys, _, _ in specs.values():
        dims += [k for k in keys if k not in dims]
    cities = cities_for in specs
    if cities and "city" not in dims:
        dims.append("city")
    cols = dims + ["visitor_id"]

    def gid(member: list[str]) -> int:  # grouping_id(): bit set for each column left out
        return sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in member)

    sets, tags, keep = [], [], []
    for b, name in enumerate(names):
        keys, not_null, _ = specs[name]
        sets.append(keys + ["visitor_id"])
        tags.append((gid(keys + ["visitor_id"]), b))
        keep.append((gid(keys + ["visitor_id"]), not_null))
    city_gid = None
    if cities:
        ckeys = specs[cities_for][0] + ["city"]
        city_gid = gid(ckeys)
        sets.append(ckeys)
        tags.append((city_gid, names.index(cities_for)))
        keep.append((city_gid, specs[cities_for][1] + ["city"]))

    g = F.col("_g")
    level1 = details.groupingSets(sets, *cols).agg(F.grouping_id().alias("_g"))
    cond = None
    for code, not_null in keep:
        c = g == code
        for k in not_null:
            c = c & F.col(k).isNotNull()
        cond = c if cond is None else cond | c
    bid = None
    for code, b in tags:
        bid = F.when(g == code, F.lit(b)) if bid is None else bid.when(g == code, F.lit(b))
    is_city = (g == city_gid) if cities else F.lit(False)
    # City-set rows join their country's group (city blanked) and count as cities; their
    # visitor_id is NULL (not in the set), so count(visitor_id) counts visitors only.
    level2 = (level1.where(cond)
              .select(bid.alias("_b"), "visitor_id", is_city.alias("_is_city"),
                      *[F.when(is_city, None).otherwise(F.col(k)).alias(k) if k == "city"
                        else F.col(k) for k in dims])
              .groupBy("_b", *dims)
              .agg(F.count("visitor_id").alias("visitors"),
                   F.count_if("_is_city").alias("cities")))

    b = F.col("_b")
    shown = {name: _shown_keys(specs[name][0]) for name in names}
    width = max(len(v) for v in shown.values())
    order_keys = []
    for j in range(width):
        e = None
        for i, name in enumerate(names):
            v = shown[name][j][1] if j < len(shown[name]) else F.lit(None).cast("string")
            e = F.when(b == i, v) if e is None else e.when(b == i, v)
        order_keys.append(e.alias(f"_o{j}"))
    w = Window.partitionBy("_b").orderBy(F.desc("visitors"),
                                         *[F.asc_nulls_first(f"_o{j}") for j in range(width)])
    cap = max(n for _, _, n in specs.values())
    limit = None
    for i, name in enumerate(names):
        n = specs[name][2]
        limit = F.when(b == i, F.lit(n)) if limit is None else limit.when(b == i, F.lit(n))
    ranked = (level2.select("*", *order_keys)
              .withColumn("_rk", F.row_number().over(w))
              .where((F.col("_rk") <= cap) & (F.col("_rk") <= limit)))

    lists = []
    for i, name in enumerate(names):
        out = [v.alias(k) for k, v in shown[name]] + [F.col("visitors")]
        if name == cities_for:
            out.append(F.col("cities"))
        row = F.struct((-F.col("visitors").cast("double")).alias("_k0"),
                       *[v.alias(f"_k{j + 1}") for j, (_, v) in enumerate(shown[name])],
                       F.struct(*out).alias("_v"))
        lists.append(F.sort_array(F.collect_list(F.when(b == i, row))).getField("_v").alias(name))
    return ranked.agg(*lists)


# The enhanced report's acquisition lists: name -> (shown key, limit, with distinct visitors).
ACQUISITION_LISTS = {
    "referrers": ("source", 15, True),
    "utmSources": ("source", 10, False),
    "utmMediums": ("medium", 10, False),
}


def acquisition_lists(sessions: DataFrame, period=DEFAULT_PERIOD, as_of=None, start=None,
                      end=None) -> DataFrame:
    """Q18-Q20 in one pass: a one-row frame with the ``referrers``, ``utmSources`` and
    ``utmMediums`` lists, each ordered by sessions descending, then key.

    Equal to gathering :func:`referrers`, :func:`utm_sources` and :func:`utm_mediums`; the
    period's sessions are read once, a grouping-sets aggregate counts sessions per (referrer
    bucket, visitor) and per UTM value, a second aggregate folds visitors, and a window group
    limit cuts each list before the final gather.
    """
    s = _sessions_in(sessions, period, start, end, as_of).select(
        referrer_source(F.col("referrer_domain")).alias("_ref"),
        F.coalesce(F.col("utm_source"), F.lit("none")).alias("_src"),
        F.coalesce(F.col("utm_medium"), F.lit("none")).alias("_med"),
        "visitor_id")
    cols = ["_ref", "_src", "_med", "visitor_id"]
    sets = [["_ref", "visitor_id"], ["_src"], ["_med"]]

    def gid(member):
        return sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in member)

    g, b = F.col("_g"), F.col("_b")
    bid = F.when(g == gid(sets[0]), 0).when(g == gid(sets[1]), 1).otherwise(2)
    key = F.when(b == 0, F.col("_ref")).when(b == 1, F.col("_src")).otherwise(F.col("_med"))
    level1 = (s.groupingSets(sets, *cols)
              .agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("_n")))
    level2 = (level1.select(bid.alias("_b"), "visitor_id", "_n", *cols[:3])
              .select("_b", key.alias("_key"), "visitor_id", "_n")
              .groupBy("_b", "_key")
              .agg(F.sum("_n").alias("sessions"), F.count("visitor_id").alias("visitors")))
    names = list(ACQUISITION_LISTS)
    limit = F.when(b == 0, ACQUISITION_LISTS[names[0]][1]).when(
        b == 1, ACQUISITION_LISTS[names[1]][1]).otherwise(ACQUISITION_LISTS[names[2]][1])
    cap = max(n for _, n, _ in ACQUISITION_LISTS.values())
    w = Window.partitionBy("_b").orderBy(F.desc("sessions"), F.asc_nulls_first("_key"))
    ranked = (level2.withColumn("_rk", F.row_number().over(w))
              .where((F.col("_rk") <= cap) & (F.col("_rk") <= limit)))
    lists = []
    for i, name in enumerate(names):
        shown, _, with_visitors = ACQUISITION_LISTS[name]
        out = [F.col("_key").alias(shown), F.col("sessions")]
        if with_visitors:
            out.append(F.col("visitors"))
        row = F.struct((-F.col("sessions").cast("double")).alias("_k0"), F.col("_key").alias("_k1"),
                       F.struct(*out).alias("_v"))
        lists.append(F.sort_array(F.collect_list(F.when(b == i, row))).getField("_v").alias(name))
    return ranked.agg(*lists)


def breakdown_list_rows(details: DataFrame, specs: dict | None = None) -> DataFrame:
    """The lists of :func:`breakdown_lists` as rows: ``list, rank, key1, key2, visitors,
    cities`` (``key2`` NULL for one-key lists, ``cities`` only for ``topCountries``).

    One explode over the concatenated lists of the one-row frame, so the fused pass runs once.
    """
    specs = specs or ENHANCED_BREAKDOWNS
    lists = breakdown_lists(details, specs)

    def as_row(name, shown):
        def row(x, i):
            return F.struct(F.lit(name).alias("list"), (i + 1).cast("long").alias("rank"),
                            x[shown[0]].alias("key1"),
                            (x[shown[1]] if len(shown) > 1 else F.lit(None).cast("string"))
                            .alias("key2"),
                            x["visitors"].alias("visitors"),
                            (x["cities"] if name == "topCountries" else F.lit(None).cast("long"))
                            .alias("cities"))
        return row

    arrays = [F.transform(F.col(name), as_row(name, [k for k, _ in _shown_keys(keys)]))
              for name, (keys, _, _) in specs.items()]
    return lists.select(F.explode(F.concat(*arrays)).alias("r")).select("r.*")


def acquisition_list_rows(sessions: DataFrame, period=DEFAULT_PERIOD, as_of=None, start=None,
                          end=None) -> DataFrame:
    """The lists of :func:`acquisition_lists` as rows: ``list, rank, key, sessions, visitors``
    (``visitors`` only for ``referrers``)."""
    lists = acquisition_lists(sessions, period, as_of, start, end)

    def as_row(name, shown, with_visitors):
        def row(x, i):
            return F.struct(F.lit(name).alias("list"), (i + 1).cast("long").alias("rank"),
                            x[shown].alias("key"), x["sessions"].alias("sessions"),
                            (x["visitors"] if with_visitors else F.lit(None).cast("long"))
                            .alias("visitors"))
        return row

    arrays = [F.transform(F.col(name), as_row(name, shown, wv))
              for name, (shown, _, wv) in ACQUISITION_LISTS.items()]
    return lists.select(F.explode(F.concat(*arrays)).alias("r")).select("r.*")
