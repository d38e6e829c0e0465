"""Report bundles: the fused audience pass gives the same document as one query per list."""

import json
import random

from pyspark.sql import types as T

from conftest import SF_SMALL
from webtraffic.operators import audience as A
from webtraffic.plans import report as R
from webtraffic.schema import VISITOR_DETAILS
from webtraffic.sources.fixtures import fixture_tables


def _lists_separately(details):
    fns = {"topCountries": A.top_countries, "topCities": A.top_cities,
           "deviceBrands": A.device_brands, "deviceModels": A.device_models,
           "osVersions": A.os_versions, "browserVersions": A.browser_versions,
           "topBrowsers": A.top_browsers, "screenResolutions": A.screen_resolutions,
           "languages": A.languages}
    return {name: [r.asDict(recursive=True) for r in R._as_list(name, fn(details)).first()[0]]
            for name, fn in fns.items()}


def test_fused_breakdowns_match_separate_queries_on_edge_rows(spark):
    # Small domains so that NULLs, ties at the cut, shared cities across countries and
    # visitors spread over many values all occur; some visitor ids are NULL.
    rnd = random.Random(7)
    pick = lambda *xs: rnd.choice(xs)
    rows = []
    for i in range(400):
        rows.append({
            "id": i, "visitor_id": pick(None, *[f"v{k}" for k in range(40)]),
            "country": pick(None, "FR", "DE", "US"), "country_code": pick(None, "FR", "DE"),
            "city": pick(None, "Paris", "Berlin", "Lyon"), "browser": pick(None, "Chrome", "Firefox"),
            "browser_version": pick(None, *[str(v) for v in range(20)]),
            "device_type": pick(None, "desktop", "mobile"), "device_brand": pick(None, "Apple", "Samsung"),
            "device_model": pick(None, *[f"m{v}" for v in range(25)]),
            "os": pick(None, "iOS", "Android"), "os_version": pick(None, *[str(v) for v in range(9)]),
            "screen_width": pick(None, 360, 1024, 12, 1), "screen_height": pick(None, 3, 23, 800),
            "language": pick(None, "en", "fr", "de"), "updated_at": None,
        })
    schema = T.StructType([f for f in VISITOR_DETAILS.fields])
    d = spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
    got = A.breakdown_lists(d).first().asDict(recursive=True)
    assert got == _lists_separately(d)


def test_enhanced_document_same_with_and_without_fusion(spark):
    t = fixture_tables(spark, SF_SMALL)
    for kw in ({"period": "all"}, {"period": "24h"}):
        fused = R.report_json(R.enhanced_stats(t, **kw)).first()["json"]
        plain = R.report_json(R.enhanced_stats(t, fuse_audience=False, **kw)).first()["json"]
        assert fused == plain
        doc = json.loads(fused)
        assert list(doc) == R.ENHANCED_KEYS
        assert len(doc["topCountries"]) <= 20 and "cities" in doc["topCountries"][0]


def test_fused_acquisition_matches_separate_queries(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.choice([None, "v1", "v2", "v3", "v4"]), f"s{i}", None, None, 1,
             rnd.choice([None, "", "google.com", "t.co", "netflix.com", "a.org", "b.org"]),
             rnd.choice([None, "", "news", "ads"]), rnd.choice([None, "cpc", "mail"]))
            for i in range(300)]
    s = spark.createDataFrame(rows, "id long, visitor_id string, session_id string, "
                                    "started_at timestamp_ntz, duration long, page_views long, "
                                    "referrer_domain string, utm_source string, utm_medium string")
    got = A.acquisition_lists(s, "all").first().asDict(recursive=True)
    exp = {name: [r.asDict(recursive=True) for r in R._as_list(name, fn(s, "all")).first()[0]]
           for name, fn in (("referrers", A.referrers), ("utmSources", A.utm_sources),
                            ("utmMediums", A.utm_mediums))}
    assert got == exp


def test_basic_document_same_with_and_without_fusion(spark):
    t = fixture_tables(spark, SF_SMALL)
    for period in ("all", "24h"):
        fused = R.report_json(R.basic_stats(t, period), R.BASIC_KEYS).first()["json"]
        plain = R.report_json(R.basic_stats(t, period, fuse_audience=False),
                              R.BASIC_KEYS).first()["json"]
        assert fused == plain
        doc = json.loads(fused)
        assert list(doc) == R.BASIC_KEYS and "cities" not in doc["topCountries"][0]


def test_shuffled_key_joins_give_the_same_results(spark, broadcast_threshold):
    from webtraffic.operators import people as PE

    t = fixture_tables(spark, SF_SMALL)

    def both(fn):
        out = []
        for threshold in ("10m", "-1"):
            broadcast_threshold(threshold)
            out.append([tuple(r) for r in fn().collect()])
        return out

    a, b = both(lambda: PE.recent_visitors(t.visitors, t.visitor_details, t.sessions, 7))
    assert a == b and len(a) == 7
    a, b = both(lambda: PE.realtime_feed(t.page_views, t.visitors, t.visitor_details,
                                         t.as_of, n=5))
    assert a == b
