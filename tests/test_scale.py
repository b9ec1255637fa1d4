"""What larger tables need: work dealt over tasks, nothing that grows faster than the input."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from landgrid.functions import geo as G
from landgrid.functions import text as X
from landgrid.operators import documents as D
from landgrid.operators import relational as R
from landgrid.operators import spatial as S
from landgrid.operators.lineage import spread
from landgrid.plans import spatial as PS
from landgrid.plans import text as PT

#: Texts that fit one or few patterns each, in any case, and texts that fit almost.
SAID = [
    "IFR cfr CR rights", "COMMUNITY   RIGHTS of 3 acres", "community\nforest resource right", "Non-Timber Forest Produce Collection", "FORM b Application", "form c आवेदन", "Forms A1", "फॉर्म 12",
    "survey NUMBER: 12/3", "Survey done", "सर्वेक्षण हो गया", "सर्वेक्षण संख्या 12", "under review, withdrawn", "Title issued", "Survey Settlement Record", "application for forest rights",
    "5 SQ M", "1/2 bigha", "3 – 4 acre", "3-4 एकड़", "12 Cent", "7 வேலி", "Area: 12 hectare", "क्षेत्रफल: 5 एकड़", "28°36'N, 77°12'E", "28N77E", "10.5, 20.25", "latitude: 10 longitude 20", "VILL: Abc", "V. xyz", "Vill",
    "1/2/2020 and 2020-03-04", "3 March 2021", "JUNE 4, 2020", "3 मार्च 2021", "৩ 3 মার্চ 2021", "Application dated: 1/2/20", "आवेदन तारीख: 1.2.20", "Approval Date 3", "Sita Devi\nRam Prasad Singh", "নাম রাম দাস", "मोहन लाल यादव", "North: a b c. East d e f West g h", "उत्तर: नदी का", "", "Khasra No 5", "İFR",
]


def test_rows_of_one_partition_are_dealt(spark):
    none = spark.range(0, 8, 1, 8).where("id < 0")
    rows = none.unionAll(spark.range(0, 20_000, 1, 1))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    each = spread(rows, "id").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert each.max() < 10_000 and each.sum() == 20_000
    assert spread(rows, "id", rows=100).rdd.getNumPartitions() == 200


def test_patterns_left_out_match_nowhere(spark, sf_dir, monkeypatch):
    said = spark.createDataFrame([(t,) for t in [*SAID, *map(str.upper, SAID), *map(str.lower, SAID), " ; ".join(SAID), None]], "text string")
    texts = said.unionAll(PT.all_letters(spark, sf_dir).select("text"))
    found = lambda: texts.select("text", *[X.entities(F.col("text"), k).alias(k) for k in X.KINDS]).collect()
    fast = found()
    monkeypatch.setattr(X, "NEEDS", {k: [None] * len(ps) for k, (_, ps) in X.PATTERNS.items()})
    assert fast == found()
    assert all(any(r[k] for r in fast) for k in X.KINDS)


def _by_sparks_engine(text, kind):
    """Values of a kind by Spark's own expressions, every pattern over the whole text."""
    group, patterns = X.PATTERNS[kind]
    trim = lambda x: F.trim(x, F.lit(" \t\n\v\f\r"))
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(X.pattern_text(kind, p)), F.lit(group)) for p in patterns]))
    found = F.transform(F.coalesce(found, F.array().cast("array<string>")), trim if kind in X.TRIMMED else lambda x: x)
    if kind == "villages":
        found = F.transform(found, lambda x: F.regexp_replace(x, "[,.;]", ""))
    found = F.filter(found, lambda x: F.length(trim(x)) > X.LONGER_THAN[kind])
    if kind == "names":
        found = F.filter(found, lambda x: ~x.rlike("|".join(X.NAME_EXCLUSIONS)) & ~x.rlike(r"^\s*\d+\s*$") & x.rlike("^\\s*[A-Za-zऀ-ॿঀ-৿ఀ-౿஀-௿]"))
    return F.array_distinct(found)


def _mixed_texts(n, seed=11):
    """Words of all patterns, numbers, blanks, signs and marks, in any order."""
    r = random.Random(seed)
    words = [re.findall(r"[A-Za-z]{2,}|[\u0900-\u0c7f]+", p) or ["x"] for _, ps in X.PATTERNS.values() for p in ps]
    some = lambda ws: " ".join(ws[i] for i in sorted(r.sample(range(len(ws)), min(len(ws), r.choice([1, 1, 2, 2, 3]))))) + r.choice(["", "", " 12/3", " 7"])
    odd = ["1", "23", "2020", "3.5", "12/3", "1/2/2020", "2020-03-04", "28°36'N, 77°12'E", "10.5, 20.25", "3-4", "5–6", ".", ",", ";", ":", "-", "/", "\n", "\r\n", "\t", "\u00a0", "\u2028", "\u0085", "\v", "_", "é", "\u0301", "\u0902", "\u093e", "।", "॰", "½", "²", "٣", "İ", "K", "ſ", "日本", "𝔘", "ป่า", "N", "S", "E", "W", "A", "b", "Asha", "Ram Das", "का", "में", "Form A1"]
    say = lambda: r.choice([str, str, str.upper, str.lower, str.title])(some(r.choice(words))) if r.random() < 0.6 else r.choice(odd)
    return ["".join(say() + r.choice([" ", " ", " ", "", ": ", "  ", ", ", "\n", ". "]) for _ in range(r.randrange(1, 40))) for _ in range(n)]


def test_entities_are_those_of_sparks_engine(spark, sf_dir):
    texts = [*SAID, *map(str.upper, SAID), *map(str.lower, SAID), " ; ".join(SAID), *_mixed_texts(4000), *[t[:i] + c + t[i:] for t in SAID for i in range(0, len(t), 3) for c in "\u0301\u0902é_1. "], None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8).unionAll(PT.all_letters(spark, sf_dir).select("text"))
    for kind in X.KINDS:
        both = rows.select("text", X.entities(F.col("text"), kind).alias("got"), _by_sparks_engine(F.col("text"), kind).alias("want"))
        assert both.where("got <> want or got is null").limit(3).collect() == []
        assert both.where("size(want) > 0").count() > 100


def test_quality_of_letters_makes_no_row_for_each_value(spark, sf_dir):
    """Found and true values are compared inside their row: no join, and only counts are shuffled; repeated and null ids as in SQL."""
    plan = PT.PAIRS["extraction_quality_languages"][0](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    kinds = {"a": ["x", "y"], "b": ["z"]}
    rows = [("1", "eng", ["x", "y"], ["z"], ["x"], ["w", "w"]), ("1", "eng", ["y", "v"], [], ["y", "x"], ["z"]), ("2", "hin", [], [], ["q"], []), ("3", "eng", ["u"], [], [], []), (None, "eng", ["u"], [], ["u"], [])]
    told = spark.createDataFrame(rows, "id string, language string, a array<string>, b array<string>, true_a array<string>, true_b array<string>")
    each = lambda side: F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(side + k).alias("vs")) for k in kinds])).alias("e")
    truth = told.where("id is not null").select("id", "language", each("true_")).select("id", "language", "e.kind", F.explode("e.vs").alias("value"))
    want = D.extraction_quality(told.where("id is not null"), truth, list(kinds), ["language"])
    got = D.quality_within(told, list(kinds), ["language"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.count() == 3


def test_totals_are_those_of_the_claims_that_users_see(spark):
    claims = spark.createDataFrame([("1", "a", "s"), ("2", "a", "s"), ("3", "b", "s"), ("4", "c", "t"), ("5", None, None)], "id string, district_id string, state_id string")
    users = spark.createDataFrame([("d", "district", "s", "a"), ("e", "district", None, "x"), ("f", "district", None, None), ("g", "state", "s", None), ("h", "state", "u", None), ("i", "admin", "s", "a"), ("j", None, None, None)], "id string, role string, state string, district string")
    bound, free = R.role_scope(claims, users)
    seen = bound.select("user_id", "id").unionAll(free.crossJoin(claims.select("id")))
    want = {(r.user_id, r.claims, r.least) for r in seen.groupBy("user_id").agg(F.count("id").alias("claims"), F.min("id").alias("least")).collect()}
    totals = R.scope_totals(claims, users)
    assert {tuple(r) for r in totals.collect()} == want == {("d", 2, "1"), ("g", 3, "1"), ("f", 5, "1"), ("i", 5, "1"), ("j", 5, "1")}
    assert R.scope_totals(claims.where("id = '9'"), users).isEmpty()


def _crowd(spark, n, name, side="0.2"):
    """A crowded square, a few places far off, one place with many rows, and rows without a place."""
    lat = f"CASE WHEN id % 50 = 7 THEN 30 + id % 13 WHEN id % 50 = 8 THEN NULL WHEN id % 5 = 0 THEN 20.05e0 ELSE 20 + (id * 7919 % 10007) / 10007e0 * {side} END"
    lng = f"CASE WHEN id % 50 = 7 THEN 179.9e0 - id % 9 WHEN id % 5 = 0 THEN 80.05e0 ELSE 80 + (id * 104729 % 9973) / 9973e0 * {side} END"
    return spark.range(n).selectExpr(f"concat('{name}', id) AS id", f"CAST({lat} AS DOUBLE) AS latitude", f"CAST({lng} AS DOUBLE) AS longitude")


def _pairs(points, features, radius_m):
    m = G.distance_m(F.col("p_lat"), F.col("p_lng"), F.col("f_lat"), F.col("f_lng"))
    good = G.valid_latlng(F.col("f_lat"), F.col("f_lng")) & G.valid_latlng(F.col("p_lat"), F.col("p_lng"))
    return points.crossJoin(features).where(good).withColumn("meters", m).where(F.col("meters") <= radius_m)


def test_few_nearest_without_all_pairs(spark, monkeypatch):
    points = _crowd(spark, 400, "p").toDF("point", "p_lat", "p_lng")
    features = _crowd(spark, 3000, "f").selectExpr("id", "CAST(hash(id) % 2 AS STRING) AS kind", "latitude AS f_lat", "longitude AS f_lng")
    pairs = _pairs(points, features, 25_000).withColumn("km", F.round(F.col("meters") / 1000, 4))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("km", "kind", "id"))).where("rank <= 20")
    met, within = [], S.within
    monkeypatch.setattr(S, "within", lambda *a: met.append(within(*a)) or met[-1])
    got = S.nearest_few(points, features, 20, 25_000, ["kind", "id"])
    columns = ["point", "rank", "kind", "id", "km"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert pairs.count() > 600_000 and sum(m.count() for m in met) < 200_000


def test_counts_within_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "within", None)
    odd = [("a", 89.99, 0.0), ("b", 89.9, 180.0), ("c", -90.0, 3.0), ("d", 0.0, 180.0), ("e", 0.1, -179.95), ("f", 60.0, -180.0), ("g", 60.0, 179.8), ("h", 0.0, 0.0), ("i", None, 1.0), ("j", 1.0, float("nan")), ("k", -0.05, -0.05)]
    odd = spark.createDataFrame(odd, "id string, lat double, lng double")
    points = _crowd(spark, 700, "p", "0.6").unionAll(odd).toDF("point", "p_lat", "p_lng")
    features = _crowd(spark, 3000, "f", "0.6").unionAll(odd).select("id", F.col("latitude").alias("f_lat"), F.col("longitude").alias("f_lng"))
    for radius, most in ((25_000, 300_000), (25_000, 100), (3_000_000, 1000)):
        want = _pairs(points, features, radius).groupBy("point").count()
        assert sorted(map(tuple, S.count_within(points, features, radius, most).collect())) == sorted(map(tuple, want.collect()))


def test_pairs_within_cost_little_beyond_themselves(spark, sf_dir, monkeypatch):
    odd = [("a", 89.99, 0.0), ("b", 89.9, 180.0), ("c", -90.0, 3.0), ("d", 0.0, 180.0), ("e", 0.1, -179.95), ("f", 60.0, -180.0), ("g", 60.0, 179.8), ("h", 0.0, 0.0), ("i", None, 1.0), ("j", 1.0, float("nan")), ("k", -0.05, -0.05), ("l", 91.0, 0.0)]
    odd += [(f"m{i}", i * 0.0001234, 25 / 6371.0 * 57.29577951308232) for i in range(9)] + [(f"n{i}", i * 0.00000045, 0.0) for i in range(9)]  # at the radius, and near rounding ties
    odd = spark.createDataFrame(odd, "id string, lat double, lng double")
    points = _crowd(spark, 700, "p", "3").unionAll(odd).toDF("point", "p_lat", "p_lng")
    features = _crowd(spark, 3000, "f", "3").unionAll(odd).select("id", F.col("latitude").alias("f_lat"), F.col("longitude").alias("f_lng"))
    for radius, fine in ((25_000, 3), (25_000, 1), (190_000, 2)):
        want = _pairs(points, features, radius).select("point", "id", F.round(F.col("meters") / 1000, 4).alias("km"))
        assert sorted(map(tuple, S.km_within(points, features, radius, fine, some=100).select("point", "id", "km").collect())) == sorted(map(tuple, want.collect()))
    assert S.km_within(points.where("false"), features, 25_000).isEmpty()

    plan = PS.PAIRS["radius_search"][0](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("7919") == 4  # the places of villages as points, and of three kinds of features: each computed once, not for each condition on it
    spaced = points.where("p_lat <> 20.05e0 and p_lat < 24"), features.where("f_lat <> 20.05e0")
    kept = S.km_within(*spaced, 25_000).count()
    monkeypatch.setattr(S, "_reached", lambda radius_m: F.lit(True))
    assert kept > 1000 and S.km_within(*spaced, 25_000).count() < 2.2 * kept


ODD = [("a", 89.99, 0.0), ("b", 89.9, 180.0), ("c", -90.0, 3.0), ("d", 0.0, 180.0), ("e", 0.1, -179.95), ("f", 60.0, -180.0), ("g", 60.0, 179.8), ("h", 0.0, 0.0), ("i", None, 1.0), ("j", 1.0, float("nan")), ("k", -0.05, -0.05), ("l", 91.0, 0.0)]
ODD += [(f"m{i}", i * 0.0001234, 25 / 6371.0 * 57.29577951308232) for i in range(9)] + [(f"n{i}", i * 0.00000045, 0.0) for i in range(9)]  # at the radius, and near rounding ties


@pytest.mark.parametrize("radius,most,some", [(25_000, 500_000, 50_000), (25_000, 500_000, 20), (25_000, 1500, 50_000), (25_000, 300, 100), (190_000, 1000, 30)])
def test_all_near_in_order(spark, radius, most, some):
    """Whole tiles, dealt points, smaller tiles, and tiles too crowded for one task: the pairs and ranks of a window over all pairs."""
    odd = spark.createDataFrame(ODD, "id string, lat double, lng double")
    points = _crowd(spark, 300, "p", "3").unionAll(odd).toDF("point", "p_lat", "p_lng")
    points = points.unionAll(points.where("point in ('p1', 'p7', 'h')").selectExpr("point", "p_lat + 0.01", "p_lng")).unionAll(points.where("point = 'p2'").selectExpr("CAST(NULL AS STRING)", "p_lat", "p_lng"))
    features = _crowd(spark, 3000, "f", "3").unionAll(odd).selectExpr("CASE WHEN hash(id) % 2 = 0 THEN 'x' END AS kind", "id", "latitude AS f_lat", "longitude AS f_lng")
    pairs = _pairs(points, features, radius).select("point", "kind", "id", F.round(F.col("meters") / 1000, 4).alias("km"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("km", "kind", "id"))).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(S.near(points, features, radius, ["kind", "id"], most, some, 700).collect(), key=key) == sorted(want, key=key)
    assert sorted(S.near(points, features, radius, None, most, some, 700).collect(), key=key) == sorted((r[:4] for r in want), key=key)
    assert max(r.rank for r in want) > 300 and S.near(points.where("false"), features, radius).isEmpty() and S.near(points, features.where("false"), radius, ["id"]).isEmpty()


def test_near_shuffles_no_copies_of_points(spark, sf_dir):
    """What is dealt over tasks: points once, features once or a little more often, instead of 49 copies of each point."""
    plan = PS.PAIRS["radius_search"][0](spark, sf_dir)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    tables = [plan.sparkSession.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("customer", "customer", "orders", "part")]
    dealt = S.dealt(PS._points(spark, sf_dir), PS._places(spark, sf_dir), 25_000)[0]
    assert dealt.where("_side = 1").count() == tables[0] and dealt.count() < 2 * sum(tables)


def test_radius_sorted_keeps_all(spark, sf_dir, tmp_path):
    """Thirty claims of a village: more than twenty of them are sorted, too."""
    for t in ("customer", "part"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_custkey", F.lit(7).cast("long")).limit(30).write.parquet(f"{tmp_path}/orders.parquet")
    rows, pairs = (PS.PAIRS[q][0](spark, str(tmp_path)) for q in ("radius_sorted", "radius_search"))
    assert rows.drop("rank").exceptAll(pairs).isEmpty() and rows.count() == pairs.count()
    assert rows.agg(F.max("rank")).first()[0] > 20


def test_crowded_villages_without_all_pairs(spark, monkeypatch):
    """Most villages within a kilometre of most places, one place far from the crowd for every few: few pairs are made for each place."""
    claims = spark.range(600).selectExpr("CAST(id AS STRING) AS id", "CAST(CASE WHEN id % 5 = 1 THEN 23.5e0 WHEN id % 50 = 7 THEN -80e0 WHEN id % 50 = 8 THEN NULL ELSE 23 + (id * 7919 % 10007) / 10007e0 / 50 END AS DOUBLE) AS latitude", "CAST(CASE WHEN id % 50 = 7 THEN -179.9e0 ELSE 80 + (id * 104729 % 9973) / 9973e0 / 50 END AS DOUBLE) AS longitude")
    villages = spark.range(4000).selectExpr("concat('v', id) AS id", "concat('n', id * 37 % 1999) AS name", "CAST(id % 7 AS STRING) AS district_id", "23 + (id * 3571 % 10007) / 10007e0 / 50 AS latitude", "80 + (id * 7727 % 9973) / 9973e0 / 50 AS longitude")
    villages = villages.unionAll(villages.where("id < 'v2'").selectExpr("concat('w', id)", "concat('m', name)", "district_id", "latitude", "longitude"))
    pairs = _pairs(S._as_points(claims), S._as_features(villages), 1e9)
    inside = F.min(F.when(F.col("meters") <= 1000, F.struct("v_name", "v_id")))
    want = pairs.groupBy("p_id").agg(F.min(F.struct("meters", "v_name", "v_id", "district_id")).alias("b"), inside.alias("c"))
    want = want.select("p_id", "c.v_id", F.col("b.v_id").alias("nearest"), "b.district_id", "b.meters")
    met, within = [], S.within
    monkeypatch.setattr(S, "within", lambda *a, **k: met.append(within(*a, **k)) or met[-1])
    got = S.located(claims, villages).where("nearest is not null").select("id", "contained", "nearest", "nearest_district", "nearest_m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert pairs.where("meters <= 1000").count() > 500_000 and sum(m.count() for m in met) < 50_000
