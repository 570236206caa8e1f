import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions import domain
from lanewise.operators import core
from lanewise.plans import curation, documents, loading, relays
from lanewise.sources import bundles


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_as_of_and_carry(spark):
    marks = spark.createDataFrame([("a", 1, "t1"), ("a", 5, "t2"), ("b", 9, "t3")], "g string, line int, team string")
    lines = spark.createDataFrame([("a", 0, 10), ("a", 1, 11), ("a", 7, 12), ("b", 3, 13)], "g string, line int, x int")
    assert rows(core.as_of(lines, marks, ["g"], ["line"], "team"), "x", "team") == [(10, None), (11, "t1"), (12, "t2"), (13, None)]


def test_closure(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("p", "q"), ("q", "p"), ("s", "s"), (None, "z")], "s string, t string")
    got = dict(rows(core.closure(pairs, "s", "t")))
    assert {k: got[k] for k in "abcx"} == {"a": "d", "b": "d", "c": "d", "x": "y"}
    assert got["p"] == got["q"] == "p"


def test_band_pairs_match_brute_force(spark):
    random.seed(3)
    data = [(random.choice("fm"), i, random.choice([None, 1990, 1991, 1993, 1994])) for i in range(40)]
    df = spark.createDataFrame(data, "g string, id int, y int")
    want = sorted((a[1], b[1]) for a, b in itertools.combinations(data, 2) if a[0] == b[0] and a[2] and b[2] and abs(a[2] - b[2]) <= 1)
    assert sorted(rows(core.band_pairs(df, ["g"], "y", 1, "id"), "a", "b")) == want


def test_paging_and_names(spark):
    df = spark.range(7)
    assert [r.id for r in core.page(df, 2, 3, F.asc("id")).collect()] == [3, 4, 5]
    with pytest.raises(ValueError):
        core.page(df, 0, 3, F.asc("id"))
    slugs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "i int, s string").withColumn("k", F.lit(1))
    assert rows(core.occurrence_names(slugs, ["k"], "s", F.asc("i")), "i", "s") == [(1, "a"), (2, "a-2"), (3, "b"), (4, "a-3")]


def test_load_twice_adds_nothing(spark):
    clubs = spark.createDataFrame([(1, "Club Nandu"), (2, "Delfin")], "club_id long, club_name string")
    staging = spark.createDataFrame([("Club Ñandú",), ("club nandu",), ("Nuevo",), ("NUEVO",), (None,), ("--",)], "club_name string")
    once = loading.upsert_clubs(clubs, staging)
    assert rows(once) == [(1, "Club Ñandú"), (2, "Delfin"), (None, "NUEVO")]
    assert rows(loading.upsert_clubs(once, staging)) == rows(once)


def test_athletes(spark):
    kind = "athlete_id long, athlete_name string, athlete_gender string, birth_year int, club_id long"
    core_ = spark.createDataFrame([(1, "Alfa, Beto", "male", 1990, 1), (2, "Gama, Ana", None, None, 2)], kind)
    staged = spark.createDataFrame(
        [(None, "ALFA, BETO", None, 1990, 9), (None, "Alfa, Beto", "male", None, 1), (None, "Alfa, Beto", "male", None, 2), (None, "Gama, Ana", "female", 1985, 2), (None, "Gama, Ana", "female", 1985, 3), (None, "Alfa, Beto", "female", 1990, 1)], kind
    ).drop("athlete_id")
    got = rows(loading.insert_athletes(core_, staged).where("athlete_id IS NULL"), "athlete_name", "athlete_gender", "birth_year", "club_id")
    assert got == sorted([("Alfa, Beto", "male", None, 2), ("Gama, Ana", "female", 1985, 3), ("Alfa, Beto", "female", 1990, 1)], key=str)
    filled = loading.backfill_birth_years(core_, staged)
    assert rows(filled.where("athlete_id = 2"), "birth_year") == [(1985,)]


def test_merges_and_documents(spark):
    people = spark.createDataFrame([(1, "male"), (2, "male"), (3, "female")], "athlete_id long, athlete_gender string")
    merges = spark.createDataFrame([(2, 1), (3, 1), (9, 8)], "duplicate_id long, canonical_id long")
    assert {r[1] for r in rows(loading.merge_guards(merges, people))} == {"genders differ", "unknown target"}
    facts = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "athlete_id long, e string")
    assert rows(loading.merge_duplicates(facts, merges.limit(1))) == [(1, "x"), (1, "y")]
    known = spark.createDataFrame([("u1", "c1", "t"), ("u2", None, "t2")], "url string, checksum string, title string")
    new = spark.createDataFrame([("u9", "c1", None), ("u2", "c2", None), ("u3", "c3", "n")], "url string, checksum string, title string")
    assert rows(loading.register_documents(known, new)) == [("u2", "c2", "t2"), ("u3", "c3", "n"), ("u9", "c1", "t")]


def test_rules_cascade_sees_earlier_kinds(spark):
    people = spark.createDataFrame([("Alfa Beto", "male", None), ("Zeta", "female", 1980), (None, None, None)], "full_name string, gender string, birth_year int")
    rules = spark.createDataFrame(
        [("name", 2, "alfa beto", None, None, "Wrong", None, None), ("name", 1, "alfa beto", "male", None, "Alfa, Beto", None, None), ("year", 1, "alfa beto", None, None, None, None, 1990), ("name", 1, "zeta", "male", None, "No", None, None)],
        "kind string, rule_order int, match_key string, gender string, birth_year int, new_name string, new_gender string, new_year int",
    )
    assert rows(curation.apply_rules(people, rules, ["name", "year"])) == sorted([("Alfa, Beto", "male", 1990), ("Zeta", "female", 1980), (None, None, None)], key=str)


def test_clubs_and_years(spark):
    aliases = spark.createDataFrame([("C. Uno", "Club 1"), ("Club 1", "Club Uno")], "alias_name string, canonical_name string")
    df = spark.createDataFrame([("c uno", 1), ("Other", 2), (None, 3)], "club_name string, i int")
    assert rows(curation.apply_aliases(df, aliases, "club_name"), "i", "club_name") == [(1, "Club Uno"), (2, "Other"), (3, None)]
    teams = spark.createDataFrame([("Club Uno A",), ("Club Uno Sur B",), ("Zzz",)], "team string")
    clubs = spark.createDataFrame([("Club Uno",), ("Club Uno Sur",)], "club_name string")
    assert rows(curation.longest_prefix_club(teams, clubs)) == [("Club Uno A", "Club Uno"), ("Club Uno Sur B", "Club Uno Sur"), ("Zzz", None)]
    years = spark.createDataFrame([("1990:1 | 1991:4", "1990:2 | 1991:9"), ("1990:2 | 1991:4", "1991:9"), (None, None), ("1990:1 | 1991:4", "1991:9"), ("1990:1 | 1991:4", "1990:0 | 1991:9"), ("1990:1 | 1991:4", "1990:9 | 1991:9"), ("1990:1 | 1991:4", "1991:9 | 1990:9")], "a string, b string")
    assert [r[0] for r in years.select(curation.preferred_year(F.col("a"), F.col("b"))).collect()] == [1991, None, None, None, None, None, 1991]
    names = spark.createDataFrame([("Alfa, Beto",), ("",), ("Club 1:02,33 DNS [a",), ("a b c d e",), ("Alfa (x",)], "n string")
    assert [list(r[0]) for r in names.select(curation.name_reasons(F.col("n"))).collect()] == [
        [], ["empty_name"], ["contains_digit", "contains_time_token", "contains_status_token", "contains_club_word", "contains_layout_punctuation", "unbalanced_brackets"], ["single_letter_ocr_run"], ["unbalanced_brackets"],
    ]
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("p", "q"), ("q", "r"), ("m", "m")] + [(f"n{k:03}", f"n{k + 1:03}") for k in range(100)], "s string, t string")
    ends = dict(rows(core.closure(loop, "s", "t"), "s", "t"))
    assert ends["a"] == ends["b"] == ends["c"] == ends["x"] == "a" and ends["p"] == ends["q"] == "r" and {ends[f"n{k:03}"] for k in range(100)} == {"n100"}
    scored = spark.createDataFrame([("p", "a", 0.9), ("p", "b", 0.85), ("q", "c", 0.9), ("r", "d", 0.95), ("r", "e", 0.7)], "p string, c string, score double")
    assert rows(curation.top_two(scored, ["p"], "score", F.asc("c")), "p", "c") == [("q", "c"), ("r", "d")]


def test_lines(spark):
    text = "\n".join(["Event 3 Women 30-34 100 LC Meter Freestyle", "1 Alfa, Ana 31 Club Uno 1:05,00 1:03,00 9", "2 Beta, Bea 33 Club Dos X1:04.5", "3 Gama, Eva 30 Club Uno NT DNS", "Evento 4 Mixto 120-159 4x50 CP Metros comb relay", "1 Club Uno A NT 2:10,00 18", "1) Alfa, Ana W31 2) Beto, Leo M40", "???"])
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "d int, t string")
    out = {(r.d, r.line_number): r for r in documents.parsed_documents(documents.lines(docs, "d", "t"), ["d"], ["line_number"]).collect()}
    kinds = [out[1, k].kind for k in range(1, 9)]
    assert kinds == ["header", "result", "result", "result", "header", "relay", "members", "unparsed"]
    assert out[1, 2].result.asDict() | {"points": None} == {"rank": 1, "name": "Alfa, Ana", "age": 31, "team": "Club Uno", "seed_text": "1:05,00", "time_text": "1:03,00", "time_ms": 63000, "points": None, "status": "valid"}
    assert out[1, 3].result.rank is None and out[1, 3].result.time_ms == 64500
    assert out[1, 4].result.status == "dns" and out[1, 4].event.distance_m == 100
    assert out[1, 6].relay.team == "Club Uno A" and out[1, 6].event.stroke == "medley_relay" and out[1, 6].event.distance_m == 200
    assert [(m.leg, m.name, m.gender, m.age) for m in out[1, 7].members] == [(1, "Alfa, Ana", "female", 31), (2, "Beto, Leo", "male", 40)]


def test_links_and_calendar(spark):
    page = '<a href="/a.pdf">A <b>b</b></a> <a class=x href="b.pdf">B</a><a href="http://o.org/c">C</a><a href="//h/d">D</a>'
    df = spark.createDataFrame([(1, "http://s.org/x/y.html?q=1", page), (2, "http://s.org/", None)], "page_id int, url string, html string")
    assert [r.target for r in documents.links(df).orderBy("position").collect()] == ["http://s.org/a.pdf", "http://s.org/x/b.pdf", "http://o.org/c", "http://h/d"]
    grid = spark.createDataFrame([(1, ["March 2026", "", ""]), (2, ["mon", "tue", "wed"]), (3, ["1", "2", ""]), (4, ["Copa", "", ""]), (5, ["8", "9", "10"]), (6, ["", "Final", "X"])], "row int, cells array<string>")
    assert rows(documents.calendar(grid)) == [(2026, "march", 1, "Copa"), (2026, "march", 10, "X"), (2026, "march", 9, "Final")]


def test_bundle_and_manifest(spark, tmp_path):
    for name, columns in bundles.REQUIRED.items():
        header = columns.split() if name != "athlete" else [c for c in columns.split() if c != "birth_year"]
        (tmp_path / f"{name}.csv").write_text("﻿" + ", ".join([*header, "extra"]) + "\n" + ",".join(["v"] * (len(header) + 1)) + "\n", encoding="utf-8")
    got = bundles.read_bundle(spark, str(tmp_path))
    assert set(got) == set(bundles.REQUIRED) and got["athlete"].columns == bundles.REQUIRED["athlete"].split()
    assert got["athlete"].collect()[0].birth_year is None
    (tmp_path / "relay_team.csv").write_text("event_name\n")
    with pytest.raises(FileNotFoundError):
        bundles.read_bundle(spark, str(tmp_path))
    m = tmp_path / "m.jsonl"
    m.write_text('﻿{"source_url": "u", "pdf": "p"}\n\n# note\n{"source_url": "w"}\n', encoding="utf-8")
    schema = T.StructType().add("source_url", "string").add("pdf", "string")
    assert rows(bundles.read_manifest(spark, str(m), schema)) == [("u", "p"), ("w", None)]
    m.write_text('{"a": 1}\n[1]\n')
    with pytest.raises(ValueError):
        bundles.read_manifest(spark, str(m), schema)
    assert bundles.read_manifest(spark, str(m), schema, strict=False).count() == 1


def test_relays_match_all_choices(spark):
    random.seed(5)
    people = [(1, i, random.choice(["female", "male"]), random.choice([20, 24, 28, 35, 41]), {s: random.randint(25000, 60000) for s in set(domain.RELAY_STROKES["medley"]) if random.random() < 0.9}) for i in range(11)]
    roster = spark.createDataFrame(people, "club_id long, athlete_id long, athlete_gender string, age int, times map<string,int>").withColumn("times", F.col("times").cast("map<string,bigint>"))
    found = relays.candidates(roster, "medley", "mixed").toPandas()
    strokes, want = domain.RELAY_STROKES["medley"], {}
    bands = {k: range(a, b + 1) for k, a, b in domain.RELAY_CATEGORIES}
    for group in itertools.combinations(people, 4):
        if sorted(p[2] for p in group) != ["female", "female", "male", "male"]:
            continue
        category = next((k for k, band in bands.items() if sum(p[3] for p in group) in band), None)
        totals = [sum(p[4][s] for p, s in zip(order, strokes)) for order in itertools.permutations(group) if all(s in p[4] for p, s in zip(order, strokes))]
        if category and totals:
            want.setdefault(category, []).append(min(totals))
    for category, totals in want.items():
        assert sorted(found[found.category == category].total_ms) == sorted(totals)[: relays.PER_CATEGORY]
    few = pd.concat([part.head(6) for _, part in found.groupby("category")]).reset_index(drop=True)
    chosen = relays.choose_disjoint(few)
    options = []
    for n in range(len(bands) + 1):
        for pick in itertools.combinations(few.index, n):
            part = few.loc[list(pick)]
            people_in = list(itertools.chain(*part.ids))
            if part.category.is_unique and len(set(people_in)) == len(people_in):
                options.append((-n, int(part.total_ms.sum())))
    assert (-len(chosen), int(few.loc[chosen].total_ms.sum())) == min(options)


def test_stream_is_idempotent(spark, tmp_path):
    from lanewise.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1 Alfa, Ana 31 Club Uno 1:05,00 1:03,00 9\n1 Alfa, Ana 31 Club Uno 1:05,00 1:03,00 9\nnoise\n")
    target = str(tmp_path / "out")
    for k in range(3):
        if k == 1:
            (tmp_path / "in/b.txt").write_text("2 Beta, Bea 33 Club Dos 1:06,00 1:04,00\n")
        ingest.start(spark, str(tmp_path / "in"), target, str(tmp_path / f"check{k // 2}")).awaitTermination()
    assert rows(spark.read.parquet(target), "rank", "name") == [(1, "Alfa, Ana"), (2, "Beta, Bea")]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert ingest.windowed_counts(events).agg(F.sum("n")).collect()[0][0] == events.count()


def test_club_pairs_of_all_clubs_match_brute_force(spark):
    from lanewise import catalog
    from lanewise.plans.star import Star

    sf = "/root/testdata/sf0.001"
    of: dict = {}
    for r in Star(spark, sf).result.where("club_id IS NOT NULL AND start_date IS NOT NULL").select("club_id", "athlete_id", F.year("start_date").alias("y")).collect():
        of.setdefault((r.athlete_id, r.y), set()).add(r.club_id)
    shared: dict = {}
    for (athlete, _), clubs in of.items():
        for pair in itertools.combinations(sorted(clubs), 2):
            shared.setdefault(pair, []).append(athlete)
    want = sorted(((*p, len(v), len(set(v))) for p, v in shared.items()), key=str)
    assert rows(catalog.QUERIES["club_cooccurrence"](spark, sf), "club_a", "club_b", "n_athlete_years", "n_athletes") == want
    data = [(5, 1, "2020-01-02"), (30, 1, "2020-09-01"), (40, 1, "2020-03-01"), (None, 1, "2020-03-01"), (30, 2, None), (5, 2, "2020-01-01")]
    made = spark.createDataFrame(data, "club_id long, athlete_id long, start_date string").withColumn("start_date", F.col("start_date").cast("date"))
    assert rows(curation.club_pairs(made)) == [(30, 40, 1, 1), (5, 30, 1, 1), (5, 40, 1, 1)]


def test_band_pairs_of_all_athletes_match_brute_force(spark):
    from lanewise import catalog
    from lanewise.plans.star import Star

    sf = "/root/testdata/sf0.001"
    people = Star(spark, sf).athlete.where("birth_year IS NOT NULL").orderBy("athlete_id").collect()
    want = [(a.athlete_id, b.athlete_id, abs(a.birth_year - b.birth_year)) for a, b in itertools.combinations(people, 2) if (a.segment, a.athlete_gender) == (b.segment, b.athlete_gender) and abs(a.birth_year - b.birth_year) <= 1]
    assert any(a % 4 != b % 4 for a, b, _ in want)
    assert rows(catalog.QUERIES["band_birth_year_pairs"](spark, sf), "a", "b", "gap") == sorted(want, key=str)


def test_stream_keeps_a_swimmer_of_several_events(spark, tmp_path):
    from lanewise.streaming import ingest

    (tmp_path / "in").mkdir()
    line = "1 Gama, Eva 30 Club Uno NT DNS"
    (tmp_path / "in/a.txt").write_text(f"Event 3 Women 30-34 100 LC Meter Freestyle\n{line}\n{line}\nEvent 4 Women 30-34 200 LC Meter Freestyle\n{line}\n")
    for k in range(2):
        ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / f"check{k}")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.select("event.distance_m", "name", "status")) == [(100, "Gama, Eva", "dns"), (200, "Gama, Eva", "dns")]


def test_global_rank(spark):
    random.seed(8)
    data = [(k, random.choice([None, *range(40)])) for k in range(300)]
    df = spark.createDataFrame(data, "id int, ms int")
    got = core.global_rank(df, F.expr("ms div 7"), F.asc_nulls_first("ms"), F.desc("id"))
    want = {k: n for n, (k, _) in enumerate(sorted(data, key=lambda d: (d[1] is not None, d[1] or 0, -d[0])), 1)}
    assert dict(rows(got, "id", "rank")) == want
