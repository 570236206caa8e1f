import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lanewise.functions import domain, similarity, text, times


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).collect()[0][0]


@pytest.mark.parametrize(
    "given, normal, ms",
    [
        ("1:05,00", "1:05,00", 65000),
        ("1:05.5", "1:05,50", 65500),
        ("59.999", "59,99", 59990),
        ("X 1:02.34", "X1:02,34", 62340),
        ("4:55.44S", "4:55,44", 295440),
        ("1'05'3", "1:05,30", 65300),
        ("32'41", "32,41", 32410),
        ("1:02:03.4", "62:03,40", 3723400),
        ("0:00:07", "7,00", 7000),
        ("dns", "DNS", None),
        ("NT", "NT", None),
        ("  ", None, None),
        (None, None, None),
        ("abc", "abc", None),
        ("45", "45,00", 45000),
    ],
)
def test_times(spark, given, normal, ms):
    assert one(spark, given, times.normal_time) == normal
    assert one(spark, given, times.time_ms) == ms


def test_format_and_delta(spark):
    assert one(spark, 65300, times.format_ms, "long") == "1:05,30"
    df = spark.createDataFrame([(100, 90), (0, 5), (None, 5), (90, 105)], "a long, b long")
    assert [None if r[0] is None else float(r[0]) for r in df.select(times.seed_delta_seconds(F.col("a"), F.col("b"))).collect()] == [0.01, None, None, -0.02]


@pytest.mark.parametrize(
    "given, out",
    [("Free", "freestyle"), ("4x50 libre", "freestyle_relay"), ("4x50 mts comb", "medley_relay"), ("Individual-Medley", "individual_medley"), ("fly 25 a 29", "butterfly"),
     ("comb relay", "medley_relay"), ("crol", "freestyle_relay"), ("back stroke extra", "backstroke"), ("water polo", "water_polo"), (None, None), (" ", None)],
)
def test_strokes(spark, given, out):
    assert one(spark, given, domain.stroke) == out


def test_catalogues(spark):
    assert one(spark, " Damas ", domain.event_gender) == "women"
    assert one(spark, "W", domain.athlete_gender) == "female"
    assert one(spark, "other", domain.event_gender) == "other"
    assert one(spark, None, domain.event_gender) is None
    assert one(spark, "cp", domain.course) == "SC"
    assert one(spark, "4x50", domain.distance_m) == 200 and one(spark, "x", domain.distance_m) is None
    df = spark.createDataFrame([("Valid", None), (None, "dq"), (None, "SCRATCH"), ("bad", "1:00"), (None, None)], "s string, t string")
    assert [r[0] for r in df.select(domain.status(F.col("s"), F.col("t"))).collect()] == ["valid", "dsq", "scratch", "unknown", "unknown"]
    ages = spark.createDataFrame([(1977,), (1976,), (1972,), (1971,), (None,)], "y int")
    assert [r[0] for r in ages.select(domain.age_category(F.col("y"), 2001)).collect()] == ["premaster", "25-29", "25-29", "30-34", "Sin categoría"]
    sums = spark.createDataFrame([(79,), (80,), (96,), (97,), (99,), (100,), (319,), (320,)], "s int")
    assert [r[0] for r in sums.select(domain.relay_category(F.col("s"))).collect()] == [None, "premaster", "premaster", None, None, "100-119", "280-319", None]
    ranks = spark.createDataFrame([(1,), (8,), (9,), (None,)], "r int")
    assert [r[0] and float(r[0]) for r in ranks.select(domain.expected_points(F.col("r"), True)).collect()] == [18.0, 2.0, None, None]


def test_text(spark):
    assert one(spark, "  Club  Ñandú-Sur  ", text.match_key) == "club nandu sur"
    assert one(spark, "!!", text.match_key) is None
    assert one(spark, "Ãção", text.search_fold) == "açao"
    assert one(spark, "Straße Č", text.strip_accents) == "Straße C"
    assert one(spark, "Beto Alfá", text.name_key) == "alfa beto"
    assert one(spark, "Copa Año 2019 / 2021 x", text.last_year) == 2021
    assert one(spark, "none", text.last_year) is None
    assert one(spark, "Copa Ñandú 1", text.slug) == "copa-nandu-1"
    assert one(spark, "12.345.678-5", text.id_number_valid) is True
    assert one(spark, "12.345.678-4", text.id_number_valid) is False
    df = spark.createDataFrame([("José Pérez",), ("Ana",), (None,)], "n string")
    hit = lambda q: [r.n for r in df.where(text.token_search([F.col("n")], text.search_tokens(q))).collect()]
    assert hit("perez jose") == ["José Pérez"] and hit("%") == [] and len(hit("")) == 3


def test_similarity(spark):
    from difflib import SequenceMatcher

    df = spark.createDataFrame([Row(a="copa sur master", b="copa sur"), Row(a="abcd", b="bcde"), Row(a="x", b="x")])
    got = [r[0] for r in df.select(similarity.competition_score(F.col("a"), F.col("b"))).collect()]
    assert got == [0.95, SequenceMatcher(None, "abcd", "bcde").ratio(), 1.0]
    assert [r[0] for r in df.select(similarity.within_one_edit(F.col("a"), F.col("b"))).collect()] == [False, False, True]


