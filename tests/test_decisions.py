import itertools
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lanewise.plans import decisions, relays, reports, results
from lanewise.sources import bundles


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_greedy_relays_against_a_plain_search(spark):
    people = [(1, k, "male", 30 + k % 5 * 8, {"freestyle": 30_000 + (k * 7919) % 5000}) for k in range(14)] + [(2, 50, "male", 40, {"freestyle": 1})]
    roster = spark.createDataFrame(people, "club_id long, athlete_id long, athlete_gender string, age int, times map<string,bigint>")
    bounds = {"160-199": (160, 199), "120-159": (120, 159)}
    left, want = {p[1]: p for p in people if p[0] == 1}, []
    for category, (low, high) in bounds.items():
        fours = [c for c in itertools.combinations(sorted(left), 4) if low <= sum(left[i][3] for i in c) <= high]
        best = min(fours, key=lambda c: (sum(left[i][4]["freestyle"] for i in c), c))
        want.append((category, list(best)))
        left = {k: v for k, v in left.items() if k not in best}
    found = relays.greedy(roster, "freestyle", "men", list(bounds))
    assert sorted((r.category, sorted(r.ids)) for r in found.collect()) == sorted(want)
    idle = rows(relays.unassigned(roster, found), "club_id", "athlete_id")
    assert idle == sorted([(1, k) for k in left] + [(2, 50)], key=str)
    told = {r.club_id: r.response for r in relays.responses(roster, found).collect()}
    assert told[2] == '{"proposal":[],"unassigned":[50]}' and f'"unassigned":[{",".join(map(str, sorted(left)))}]' in told[1]


def test_person_scores_against_plain_python(spark):
    people = spark.createDataFrame([(1, "u", "Ana Eva", "Alfa Soto", "Alfa, A", "female", 1990), (2, "u", "Leo", "Beta", "", "male", None)], "person_id int, club_key string, first_name string, last_name string, competition_name string, gender string, birth_year int")
    names = {10: "Alfa, Ana", 11: "Beta, Leo", 12: "Zeta, Eva", 13: "Alfa Soto, Ana Eva"}
    athletes = spark.createDataFrame([(k, "u", n, "female" if k != 11 else "male", 1990 if k != 12 else 1980) for k, n in names.items()] + [(14, "other", "Alfa, Ana", "female", 1990)], "athlete_id int, club_key string, full_name string, gender string, birth_year int")
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    forms = {1: ["Alfa, A", "Alfa Soto, Ana Eva", "Alfa, Ana", "Ana Eva Alfa Soto"], 2: ["Beta, Leo", "Leo Beta"]}
    want = {}
    for p, k in itertools.product(forms, names):
        score = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), len(set(a.split()) & set(b.split())) / len(set(a.split())))
        want[p, k] = max(score(plain(a), plain(names[k])) for a in forms[p])
    got = {(r.person_id, r.athlete_id): r for r in decisions.person_scores(people, athletes).collect()}
    assert {k: round(r.score, 9) for k, r in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert got[1, 13].label == "high" and got[2, 11].label == "high" and got[1, 12].label == "review" and "birth_year_mismatch" in got[1, 12].reasons
    assert [got[1, k].place for k in sorted(names, key=lambda k: (-want[1, k], k))] == [1, 2, 3, 4]


def test_guards_of_people_links_and_names(spark):
    kind = "row int, id_number string, name_key string, birth_date string"
    people = spark.createDataFrame([(1, "1", "a", "x"), (2, "1", "b", "x"), (3, None, "c", "y"), (4, None, "c", "y"), (5, None, "d", "z"), (6, "9", None, None)], kind)
    known = spark.createDataFrame([(70, "1", "a", "x"), (71, None, "d", "z"), (72, None, "d", "z")], "person_id int, id_number string, name_key string, birth_date string")
    assert rows(decisions.resolved_people(people, known), "row", "person_id", "how") == [(1, 70, "id_number"), (2, 70, "id_number"), (3, None, "missing"), (4, None, "missing"), (5, None, "ambiguous"), (6, None, "missing")]
    assert rows(decisions.import_guards(people, known)) == [("ambiguous", 5), ("id number twice", 1), ("id number twice", 2), ("person twice", 3), ("person twice", 4)]
    links = spark.createDataFrame([(1, 10, "high"), (2, 11, "medium"), (3, 12, "review")], "person_id int, athlete_id int, label string")
    existing = spark.createDataFrame([(1, 10)], "person_id int, athlete_id int")
    assert [tuple(map(float, r)) for r in rows(decisions.added_links(links, existing))] == [(2, 11, 0.85), (3, 12, 0.75)]
    athletes = spark.createDataFrame([(1, "Alfa", "male", 1990), (2, "Beta", "male", 1990)], "athlete_id int, athlete_name string, athlete_gender string, birth_year int")
    update = lambda *r: spark.createDataFrame(list(r), "athlete_id int, expected array<string>, canonical_name string")
    assert rows(decisions.with_canonical_names(athletes, update((1, ["Alfa"], "Alfa Soto"))), "athlete_id", "athlete_name") == [(1, "Alfa Soto"), (2, "Beta")]
    for bad in ((1, ["Gama"], "Alfa Soto"), (1, ["Alfa"], " beta "), (9, [], "x")):
        with pytest.raises(ValueError):
            decisions.with_canonical_names(athletes, update(bad))


def test_names_years_and_ledger(spark):
    df = spark.createDataFrame([("ANA de la CRUZ PAZ",), ("JOSÉ de la CRUZ",), ("ana (x 4",), ("Cruz, Ana",), ("one1 two",), (None,), ("GAMA BETA (LANE 4)",)], "n string")
    assert [r[0] for r in df.select(decisions.surname_first(F.col("n"))).collect()] == ["PAZ, ANA de la CRUZ", "de la CRUZ, JOSÉ", "ana", "Cruz, Ana", "one1 two", None, "BETA, GAMA"]
    assert [r[0] for r in df.select(decisions.person_case(F.col("n"))).collect()][:2] == ["Ana de la Cruz Paz", "José de la Cruz"]
    years = spark.createDataFrame([("1985",), ("1985.0",), ("1985-1990",), (" 1990 ",), (None,), ("85",)], "y string")
    assert [r[0] for r in years.select(decisions.birth_year(F.col("y"))).collect()] == [1985, 1985, None, 1990, None, None]
    frames = {"club": spark.range(3), "result": spark.range(7)}
    begun = decisions.started("l1", frames, "d").first()
    assert (begun.load, begun.state, begun.rows_club, begun.rows_result) == ("l1", "started", 3, 7)
    checks = spark.createDataFrame([("a", 0), ("b", 2)], "check string, n int")
    assert rows(decisions.open_issues(checks, "l1")) == [("l1", "b", 2)]


def test_sinks_and_modes(spark, tmp_path):
    df = spark.createDataFrame([("Ñandú", 1), ("b", 2)], "name string, n int").coalesce(1)
    bundles.write_bundle({"club": df}, str(tmp_path), {"parser_version": "1"})
    (part,) = (tmp_path / "club.csv").glob("part-*.csv")
    assert part.read_bytes().startswith("﻿name,n\nÑandú,1".encode())
    assert spark.read.json(f"{tmp_path}/metadata.json").first().parser_version == "1"
    bundles.write_summary(spark.createDataFrame([("https://u:p@h/x", 1)], "url string, n int"), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").first().url == "https://***@h/x"
    bundles.write_documents(df.withColumn("document", F.lit("d1")), f"{tmp_path}/docs")
    assert (tmp_path / "docs" / "document=d1").is_dir()
    assert bundles.one_mode(folder="x", tables=None) == "folder"
    for modes in ({"folder": "x", "tables": "y"}, {"folder": None}):
        with pytest.raises(ValueError):
            bundles.one_mode(**modes)
    (tmp_path / "rules.csv").write_bytes("\xefmage;a\n\xf1and\xfa;1\n".encode("latin-1"))
    assert rows(bundles.read_rules(spark, f"{tmp_path}/rules.csv")) == [("ñandú", "1")]
    (tmp_path / "quoted.csv").write_bytes("name\u2019s;a\n\u201cO\u2019Neil\u201d \u2013 \xf1;\u20ac\n".encode("cp1252"))
    quoted = bundles.read_rules(spark, f"{tmp_path}/quoted.csv")
    assert quoted.columns == ["name\u2019s", "a"] and rows(quoted) == [("\u201cO\u2019Neil\u201d \u2013 \xf1", "\u20ac")]
    with pytest.raises(ValueError):
        results.participation(None, "town")


def test_frames_and_once(spark):
    kind = "club_name string, event_name string, athlete_name string, birth_year int, gender string, i int"
    rows_ = spark.createDataFrame([("Uno", "e", "Alfa, Ana", 1990, "female", 1), ("UNO", "e", "ALFA ANA", 1990, "female", 2), ("Dos", "f", None, None, None, 3)], kind)
    out = reports.frames(rows_, ["i"])
    assert rows(out["club"]) == [("Dos",), ("Uno",)] and rows(out["event"]) == [("e",), ("f",)] and rows(out["athlete"]) == [("Alfa, Ana", "Uno", 1990, "female")] and out["result"].count() == 3
    assert rows(reports.once(rows_, ["event_name"], F.asc("i")), "i") == [(1,), (3,)]
