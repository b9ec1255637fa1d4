"""Golden cases and properties of the library's operators."""

import math

import pytest
from pyspark.sql import functions as F

from landgrid.functions import geo as G
from landgrid.functions import landuse as L
from landgrid.functions import text as X
from landgrid.operators import documents as D
from landgrid.operators import relational as R
from landgrid.operators import rules
from landgrid.operators import spatial as S
from landgrid.operators import workflow as W
from landgrid.sources import tables

VILLAGE = "id string, name string, district_id string, latitude double, longitude double"
CLAIM = "id string, claim_id string, village_id string, latitude double, longitude double"
M = 1 / 111194.9266  # degrees of latitude in a metre


def one(df):
    return df.collect()[0]


def test_rule_scores(spark):
    joined = spark.createDataFrame([
        ("A", "v1", "approved", "IFR", 2.5, "MP", "rural", False, None, 503, None, None, None),
        ("B", "v2", "verified", "CFR", None, None, None, None, None, None, None, None, None),
        ("C", "v3", "pending", "IFR", 0.0, None, None, None, None, 1000, None, None, None),
    ], "id string, village_id string, status string, claim_type string, area double, state_name string, type string, water_access boolean, water_quality string, population int, tribal_population int, elevation double, forest_area double")
    got = {(r.id, r.scheme): (r.score, r.benefit) for r in rules.scored(joined).collect()}
    assert got["A", "pm-kisan"] == (90, 6000) and got["A", "jal-jeevan-mission"] == (100, 3535000) and got["A", "mgnrega"] == (100, 2525000)
    assert got["B", "pm-kisan"] == (0, 0) and got["B", "jal-jeevan-mission"] == (40, 700000) and got["B", "mgnrega"] == (40, 500000)
    assert got["C", "pm-kisan"] == (50, 6000) and got["C", "jal-jeevan-mission"] == (60, 7000000) and got["C", "mgnrega"] == (40, 5000000)
    assert all(got[c, "dajgua"] == (0, 0) for c in "ABC")
    villages = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "id string")
    summary = {r.village_id: (r.total_benefit, r.level) for r in rules.village_summary(rules.village_best(rules.recommendations(joined.withColumn("id", F.translate("id", "ABC", "123")))), villages).collect()}
    assert summary == {"v1": (6066000, "high"), "v2": (0, "low"), "v3": (7000000, "low")}
    matrix = {(r.village_id, r.scheme): (r.eligible, r.benefit) for r in rules.eligibility_matrix(joined).collect()}
    assert matrix["v2", "jal-jeevan-mission"] == (0, 700000)


@pytest.mark.parametrize("points,bucket", [(80, "high"), (79, "medium"), (60, "medium"), (59, "low")])
def test_priority_edges(spark, points, bucket):
    assert one(spark.range(1).select(rules.priority(F.lit(points)).alias("p"))).p == bucket


def _link(spark, claims, villages):
    v = spark.createDataFrame(villages, VILLAGE)
    checked = S.validated(S.located(spark.createDataFrame(claims, CLAIM), v))
    return {r.id: r for r in checked.collect()}, {r.id: r for r in S.linked(checked, v).collect()}


def test_linkage_cases(spark):
    villages = [("near", "Near", "d1", 23.7041 + 300 * M, 80.934), ("mid", "Mid", "d2", 10.12345, 75.12345 + 0.0), ("dec", "Dec", "d2", 10.12345 + 5000 * M, 75.12345)]
    claims = [
        ("1", "c1", "near", 23.7041, 80.934), ("2", "c2", None, 10.12345, 60.12345), ("3", "c3", None, 91.0, 80.0),
        ("4", "c4", None, 10.12345 - 1500 * M, 75.12345), ("5", "c5", "dec", 10.12345 + 1500 * M, 75.12345), ("6", "c6", "mid", 10.12345 - 2500 * M, 75.12345),
    ]
    claims = [(a, b, c, round(d, 5), e) for a, b, c, d, e in claims]
    checked, linked = _link(spark, claims, villages)
    assert (checked["1"].confidence, checked["1"].valid, checked["1"].state) == (0.9, True, "MP") and linked["1"].linked_village == "near" and linked["1"].accuracy == 111.0
    assert (checked["2"].confidence, checked["2"].valid, len(checked["2"].warnings)) == (0.5, False, 2) and linked["2"].linked_village is None
    assert (checked["3"].confidence, checked["3"].valid, len(checked["3"].warnings)) == (0.0, False, 1)
    assert linked["4"].linked_village == "mid" and linked["4"].confidence == pytest.approx(0.8)
    assert linked["5"].linked_village == "dec" and linked["5"].confidence == pytest.approx(0.72)
    assert linked["6"].linked_village is None and linked["6"].confidence == pytest.approx(0.8)


def test_containing_is_first_by_name(spark):
    villages = [("z", "Zeta", "d", 20.0 + 200 * M, 80.0), ("a", "Alpha", "d", 20.0 + 900 * M, 80.0)]
    points = spark.createDataFrame([("p", "p", None, 20.0, 80.0)], CLAIM)
    v = spark.createDataFrame(villages, VILLAGE)
    assert one(S.containing_village(points, v)).village == "a"
    assert one(S.nearest_village(points, v)).village == "z"


def test_grid_joins_equal_all_pairs(spark):
    import random

    r = random.Random(3)
    points = [(str(i), str(i), None, round(r.uniform(-55, 55), 4), round(r.uniform(-170, 170), 4)) for i in range(60)] + [("n", "n", None, None, 1.0)]
    villages = [(str(i), f"v{i}", "d", round(p[3] + r.uniform(-0.02, 0.02), 4), round(p[4] + r.uniform(-0.02, 0.02), 4)) for i, p in enumerate(points[:40])]
    p, v = spark.createDataFrame(points, CLAIM), spark.createDataFrame(villages, VILLAGE)

    def km(a, b, c, d):
        s = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 12742 * math.atan2(math.sqrt(s), math.sqrt(1 - s))

    ends = [(90.0, 0.0), (-90.0, 10.0), (89.99, -179.9), (0.0, 180.0), (0.01, -179.99), (-70.0, 179.995), (70.0, -180.0), (60.001, 30.0), (84.5, 20.0)]
    points += [(f"e{i}", "e", None, a, b) for i, (a, b) in enumerate(ends)] + [(f"w{i}", "w", None, round(r.uniform(-90, 90), 4), round(r.uniform(-180, 180), 4)) for i in range(40)]
    villages += [("a", "A", "d", 89.995, 100.0), ("b", "B", "d", -89.99, -60.0), ("c", "C", "d", 0.0, -179.995), ("e", "E", "d", -70.0, -179.999), ("f", "F", "d", 70.004, 179.99), ("g", "G", "d", 84.505, 20.06)]
    p, v = spark.createDataFrame(points, CLAIM), spark.createDataFrame(villages, VILLAGE)
    points = [x for x in points if x[3] is not None]
    want = {x[0]: min((km(x[3], x[4], y[3], y[4]), y[0]) for y in villages)[1] for x in points}
    assert {r.id: r.village for r in S.nearest_village(p, v).collect()} == want
    assert {r.id: r.village for r in S.nearest_village(p, v, 2_000_000).collect()} == want
    for radius in (1500, 40_000, 3_000_000, 15_000_000):
        near = [(r.p_id, r.v_id) for r in S.within(S._as_points(p), S._as_features(v), radius, 1 if radius < 1e6 else 3).collect()]
        assert sorted(near) == sorted((x[0], y[0]) for x in points for y in villages if km(x[3], x[4], y[3], y[4]) * 1000 <= radius), radius
    assert S.nearest_village(p, v.limit(0)).count() == 0 and S.nearest_village(p.limit(0), v).count() == 0


def test_geometry(spark):
    d = spark.range(1).select(
        G.haversine_km(F.lit(10.0), F.lit(70.0), F.lit(11.0), F.lit(71.0)).alias("ab"), G.haversine_km(F.lit(11.0), F.lit(71.0), F.lit(10.0), F.lit(70.0)).alias("ba"), G.haversine_km(F.lit(9.0), F.lit(9.0), F.lit(9.0), F.lit(9.0)).alias("zero"))
    r = one(d)
    assert r.ab == pytest.approx(r.ba) and r.zero == 0
    points = spark.createDataFrame([(8.0 + i * 0.9, 70.0 + i * 0.8) for i in range(30)], "lat double, lng double").withColumn("zone", G.utm_zone(F.col("lng")))
    back = points.withColumn("u", G.to_utm(F.col("lat"), F.col("lng"), F.col("zone"))).withColumn("g", G.from_utm(F.col("u.x"), F.col("u.y"), F.col("zone")))
    assert max(abs(r.lat - r.g.lat) + abs(r.lng - r.g.lng) for r in back.collect()) < 1e-7  # a centimetre
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in ((0.0, 0.0), (0.0, 1.0))])
    assert one(spark.range(1).select(G.polygon_area_m2(ring).alias("a"))).a == 0


def test_land_use(spark):
    bands = spark.createDataFrame([(0.1, 0.1, 0.5, 0.2), (0.2, 0.25, 0.4, 0.3), (0.25, 0.5, 1.0, 0.9), (0.0, 0.0, 0.0, 0.0)], "red double, green double, nir double, swir double")
    rows = [r.c for r in bands.select(L.classify(*[F.col(c) for c in bands.columns]).alias("c")).collect()]
    assert (rows[0].forest, rows[0].agriculture, rows[0].confidence) == (100, 0, 95)
    assert rows[1].agriculture == 100 and round(rows[1].confidence, 1) == 87.7
    assert (rows[2].agriculture, rows[2].forest, rows[2].water, rows[2].built_up) == (0, 0, 0, 0)
    assert rows[3].forest == 0


def test_pages_counts_retries(spark):
    pages = spark.createDataFrame([("d", 3, "c", 65.0, "tam", "q3"), ("d", 1, "a", 70.0, "hin+mar", "q1"), ("d", 2, "b", 50.0, "ben", "q2")], "document_id string, page int, text string, confidence double, language string, quality string")
    r = one(R.merge_pages(pages))
    assert r.text == "a\n\nb\n\nc" and round(r.confidence, 2) == 61.67 and r.language == "tam" and r.quality == "q3"
    claims = spark.createDataFrame([("v1",), ("v1",), (None,)], "village_id string").withColumn("status", F.lit("verified"))
    assert one(R.dashboard(claims, [])).active_villages == 2
    assert one(R.page_totals(spark.range(21))).pages == 3
    q = spark.createDataFrame([("x", "failed", f"e{i}", i, str(i)) for i in range(1, 6)] + [("y", "failed", "e", 1, "1")], "document_id string, outcome string, error string, ts int, tiebreak string")
    got = {r.document_id: (r.attempts, r.state, r.priority, r.error) for r in W.retries(q).collect()}
    assert got == {"x": (4, "failed", None, "e4"), "y": (1, "queued", "low", None)}


def test_workflow(spark):
    r = one(spark.range(1).select(W.escalate(F.lit("medium"), F.lit(2)).alias("two"), W.escalate(F.lit("medium"), F.lit(3)).alias("three"), *[W.eta(F.lit("2024-01-01").cast("date"), F.lit(p)).cast("string").alias(p) for p in W.PRIORITIES]))
    assert (r.two, r.three, r.urgent, r.high, r.medium, r.low) == ("urgent", "urgent", "2024-01-04", "2024-01-08", "2024-01-15", "2024-01-22")
    steps = ["completed"] * 3 + ["failed"] + ["completed"] * 5 + ["failed"]
    events = spark.createDataFrame([("c", o, i, i) for i, o in enumerate(steps)] + [("h", "failed", 1, 1)], "claim string, outcome string, ts int, id int")
    got = {r.claim: (r.steps_done, r.status, r.attempts) for r in W.advance(events).collect()}
    assert got == {"c": (8, "completed", 9), "h": (0, "on_hold", 1)}
    ranked = W.global_rank(spark.range(0, 1000, 1, 7), F.col("id").desc())
    assert all(r.position == 1000 - r.id for r in ranked.collect())


SAMPLE = """Forest claim form
Claimant: Ravi Gond
Village: Bandhavgarh, Area 2.5 acres under Survey No. 125/2.
Individual Forest Rights (IFR) claim. Status: Approved on 15 March 2023. Application Date: 15 March 2023
North: river, South: road."""


def test_extraction(spark):
    r = one(D.claim_records(D.extract(spark.createDataFrame([("1", SAMPLE)], "id string, text string"))))
    assert (r.village_name, r.claim_type, r.status, r.area_claimed, r.survey_number) == ("Bandhavgarh", "IFR", "approved", "2.5 acre", "125/2")
    assert r.application_date == "Application Date: 15" and "Ravi Gond" in r.names
    e = one(D.extract(spark.createDataFrame([("1", None), ], "id string, text string")))
    assert all(e[k] == [] for k in X.KINDS)
    hindi = one(spark.createDataFrame([("स्थिति: अस्वीकृत",)], "t string").select(X.claim_status(X.entities(F.col("t"), "claim_status")).alias("s")))
    assert hindi.s == "rejected"
    b = one(spark.createDataFrame([("North: river bank. South: hill road.",)], "t string").select(X.entities(F.col("t"), "boundaries").alias("b")))
    assert b.b == ["North: river bank.", "South: hill road."]


def test_tables(spark):
    files = spark.createDataFrame([("application/pdf", 5), ("text/plain", 10**9), ("image/png", 10**9), (None, 1)], "t string, n long")
    assert [r.r for r in files.select(tables.landing_reason(F.col("t"), F.col("n")).alias("r")).collect()] == [None, "type", "size", "type"]
    m = spark.createDataFrame([("a", ["f"], ["c"]), ("b", ["f", "g"], ["c"]), ("c", ["f"] * 51, ["c"] * 51)], "batch_id string, files array<string>, claims array<string>")
    rows, refused = tables.pair_manifest(m)
    assert [tuple(r) for r in rows.collect()] == [("a", 0, "f", "c")] and {r.batch_id: r.reason for r in refused.collect()} == {"b": "lengths differ", "c": "too many files"}
    current = spark.createDataFrame([("1", "a", None), ("2", "b", "x")], "id string, v string, w string")
    patches = spark.createDataFrame([("1", 1, "old", None), ("1", 2, None, "new"), ("9", 1, "z", "z")], "id string, ts int, v string, w string")
    assert sorted(tuple(r) for r in tables.patch(current, patches).collect()) == [("1", "a", "new"), ("2", "b", "x")]
    assert sorted(tuple(r) for r in tables.upsert(current, patches.where("ts = 1").drop("ts")).collect()) == [("1", "old", None), ("2", "b", "x"), ("9", "z", "z")]
    claims = spark.createDataFrame([("1", "verified", "d1", "u1", "kept"), ("2", "pending", None, None, "old"), ("3", "verified", "d3", "u3", None)], "id string, status string, verified_date string, verified_by string, notes string")
    changes = spark.createDataFrame([("2", "verified", "u9", "", "t2"), ("3", "rejected", "u9", "why", "t3")], "id string, status string, user_id string, notes string, ts string")
    assert sorted(tuple(r[c] for c in claims.columns) for r in tables.apply_status(claims, changes).collect()) == [("1", "verified", "d1", "u1", "kept"), ("2", "verified", "t2", "u9", "old"), ("3", "rejected", "d3", "u3", "why")]
    ids = tables.claim_ids(spark.range(3).select(F.col("id").cast("string").alias("id")), F.lit("Odisha"), given=spark.createDataFrame([("FRA-OD-999998",), ("FRA-OD-000007",), ("FRA-XX-1000005",), ("other",)], "new_id string"))
    assert sorted(r.new_id for r in ids.collect()) == ["FRA-OD-1000000", "FRA-OD-1000001", "FRA-OD-999999"]
    users = spark.createDataFrame([("u", "field")], "id string, role string")
    asked = spark.createDataFrame([("u", "create_claim"), ("u", "reprocess"), ("x", "create_claim"), ("u", "unknown")], "user_id string, permission string")
    assert {(r.user_id, r.permission): r.allowed for r in R.permission_filter(asked, users).collect()} == {("u", "create_claim"): True, ("u", "reprocess"): False, ("x", "create_claim"): False, ("u", "unknown"): False}


def test_words_of_indic_scripts_are_whole(spark):
    def of(text, kind):
        return spark.createDataFrame([(text,)], "t string").select(X.entities(F.col("t"), kind)).first()[0]

    assert of("आवेदक का नाम: सीता देवी, 40.", "names") == ["आवेदक का नाम: सीता देवी, 40.", "आवेदक का नाम", "सीता देवी"]
    assert of("রাম দাস, 40. సీత లక్ష్మి దేవి; லட்சுமி நாயர்", "names") == ["রাম দাস", "సీత లక్ష్మి దేవి", "லட்சுமி நாயர்"]
    assert of("स्थिति: अस्वीकृत।", "claim_status") == ["अस्वीकृत"]
    assert of("स्वीकृत मंजूर जांचा गया", "claim_status") == ["स्वीकृत", "मंजूर", "जांचा गया"]
    assert of("12 मार्च 1997 और 3 জুন 1998", "dates") == ["12 मार्च 1997", "3 জুন 1998"]
    assert of(None, "names") == of("", "names") == []


def test_quality_counts_each_value_of_a_document_once(spark):
    found = spark.createDataFrame([("a", "x", ["p", "p", "q"], ["1"]), ("b", "x", [], None), ("c", "y", ["r"], [])], "id string, lang string, names array<string>, dates array<string>")
    truth = spark.createDataFrame([("a", "x", "names", "p"), ("a", "x", "names", "p"), ("b", "x", "names", "s"), ("d", "y", "dates", "2")], "id string, lang string, kind string, value string")
    got = {(r.lang, r.kind): tuple(r)[2:] for r in D.extraction_quality(found, truth, ["names", "dates"], ["lang"]).collect()}
    assert got == {("x", "names"): (2, 2, 1, 0.5, 0.5), ("x", "dates"): (1, 0, 0, 0.0, None), ("y", "names"): (1, 0, 0, 0.0, None), ("y", "dates"): (0, 1, 0, None, 0.0)}
    assert D.extraction_quality(found.limit(0), truth.limit(0), ["names"]).isEmpty()
