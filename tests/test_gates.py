from pyspark.sql import functions as F

from lanewise.plans import gates, identity
from lanewise.sources.bundles import OPTIONAL, REQUIRED


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def frame(spark, name, *records):
    columns = (REQUIRED | OPTIONAL)[name].split()
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in records], ", ".join(f"{c} string" for c in columns))


GOOD = dict(event_name="men 35-39 100 LC Meter freestyle", athlete_name="Alfa, Beto", club_name="Uno", rank_position="1", seed_time_text="1:05,00", seed_time_ms="65000", result_time_text="1:03,00", result_time_ms="63000", age_at_event="36", birth_year_estimated="1990", points="9", status="valid")


def bundle(spark, *results, athletes=({"full_name": "Alfa, Beto", "gender": "male", "club_name": "Uno", "birth_year": "1990"},)):
    return {
        "club": frame(spark, "club", {"name": "Uno"}),
        "event": frame(spark, "event", {"event_name": GOOD["event_name"], "gender": "men", "stroke": "freestyle"}),
        "athlete": frame(spark, "athlete", *athletes),
        "result": frame(spark, "result", *results),
    }


def test_bundle_gates(spark):
    assert rows(gates.bundle_issues(bundle(spark, GOOD))) == []
    bad = bundle(
        spark, GOOD, GOOD | {"status": "odd"}, GOOD | {"age_at_event": "50"}, GOOD | {"athlete_name": " "}, GOOD | {"result_time_ms": "900"}, GOOD | {"rank_position": ""}, GOOD | {"points": "90,5"}, GOOD | {"event_name": "women 35-39 50 LC Meter freestyle"},
        athletes=({"full_name": "Alfa, Beto", "gender": "male", "club_name": "Uno", "birth_year": "1990"}, {"full_name": "No comma", "gender": "x"}),
    )
    unparsed = spark.createDataFrame([("Event 9 Mixed 4x50 LC Meter Medley Relay",), ("x",), (None,)], "raw_line string")
    meta = spark.createDataFrame([("a.pdf", "short", "1")], "pdf_name string, pdf_sha256 string, parser_version string")
    got = dict(rows(gates.bundle_issues(bad, unparsed, meta), "issue_key", "n"))
    assert got == {"invalid_status": 1, "result_event_age_mismatch": 1, "result_missing_identity": 1, "implausible_time": 1, "time_text_disagrees": 1, "points_without_rank": 1, "points_over_maximum": 1,
                   "result_event_gender_mismatch": 1, "invalid_athlete_gender": 1, "athlete_name_without_comma": 1, "debug_ratio_exceeded": 3, "unparsed_relay_headers": 1, "metadata_incomplete": 1}


def test_relay_gates(spark):
    b = bundle(spark, GOOD)
    team = {"event_name": "e", "relay_team_name": "Uno A", "rank_position": "1", "result_time_text": "2:00,00", "result_time_ms": "120000", "status": "valid"}
    b["relay_team"] = frame(spark, "relay_team", team, team)
    b["relay_swimmer"] = frame(spark, "relay_swimmer", {"leg_order": "5", "gender": "male"}, {"leg_order": "1", "gender": "z"})
    assert dict(rows(gates.bundle_issues(b), "issue_key", "n")) == {"duplicate_relay_team": 1, "invalid_relay_swimmer_leg_order": 1, "invalid_relay_swimmer_gender": 1}


def test_states(spark):
    docs = spark.createDataFrame([("a", "local"), ("b", "other"), ("c", "local")], "document string, scope string")
    issues = spark.createDataFrame([("a", "warning"), ("c", "error")], "document string, severity string")
    assert rows(gates.document_states(docs, issues), "document", "state") == [("a", "validated"), ("b", "validated"), ("c", "requires_review")]
    assert rows(gates.document_states(docs, issues, "local"), "document", "state") == [("a", "validated"), ("b", "requires_review"), ("c", "requires_review")]
    state = lambda *s: gates.manifest_state(spark.createDataFrame([(x,) for x in s], "state string")).first().state
    assert [state("loaded", "loaded"), state("loaded", "validated"), state("loaded", "requires_review"), state("failed", "requires_review")] == ["loaded", "validated", "requires_review", "failed"]


def test_competitions(spark):
    known = spark.createDataFrame([(1, "c1", "u1"), (2, None, "u2")], "competition_id long, checksum string, url string")
    new = spark.createDataFrame([(1, "c1", "x"), (1, "c9", "u1"), (2, None, "u2"), (2, None, "u9"), (3, "c", "u")], "competition_id long, checksum string, url string")
    assert rows(gates.revision_conflicts(known, new)) == [(1, "c9", "u1"), (2, None, "u9")]
    comps = spark.createDataFrame([(1, "a", "lcm"), (2, None, "scm")], "competition_id long, city string, course_type string")
    patch = spark.createDataFrame([(1, None, "scm"), (2, "b", "unknown")], "competition_id long, city string, course_type string")
    assert rows(gates.patch_competitions(comps, patch, ["city", "course_type"])) == [(1, "a", "scm"), (2, "b", "scm")]
    have = spark.createDataFrame([(1, "Copa Sur", 2024, False), (2, "Copa Sur", 2025, False), (3, "Gran Copa Norte Master", 2025, True), (4, "Other", 2025, True)], "competition_id long, name string, season int, planned boolean")
    ask = spark.createDataFrame([(1, 9, "x", 2025), (2, None, "copa sur!", 2025), (3, None, "Copa Norte Master", 2025), (4, None, "Zzz", 2025)], "ref int, competition_id long, name string, season int")
    assert rows(gates.resolve_competitions(ask, have), "ref", "resolved_id", "how") == [(1, 9, "given"), (2, 2, "name"), (3, 3, "planned"), (4, None, "new")]
    docs = spark.createDataFrame([(1, "a/etapa1.pdf", "Etapa 1"), (1, "a/r.pdf", "Resultados completos"), (2, "b/1.pdf", "Etapa 1")], "competition_id int, url string, title string")
    assert rows(gates.canonical_documents(docs), "url") == [("a/r.pdf",), ("b/1.pdf",)]


def test_members(spark):
    m = spark.createDataFrame([(1, "Ana", "Alfa", "12345678-5", "1990-01-02"), (2, "Eva", "Beta", "12.345.678-4", "31/12/1980"), (3, "", "Gama", None, "x")], "source_row int, first_name string, last_name string, id_number string, birth_date string")
    got = {r.source_row: (r.action, set(r.issues)) for r in gates.member_preview(m).collect()}
    assert got == {1: ("import", set()), 2: ("review", {"invalid_id_number"}), 3: ("skip", {"missing_name", "missing_id_number", "invalid_birth_date"})}


def test_partial_and_expanded_names(spark):
    people = spark.createDataFrame([(1, "Alfa Soto, Ana", "female", 1990), (2, "Alfa, Ana", "female", 1990), (3, "Alfa, A", "female", 1990), (4, "Zeta, Eva", "female", 1990), (5, "Alfa, Ana", "male", 1990), (6, "Alfa Soto Rojo Paz, Ana", "female", 1990)], "athlete_id long, athlete_name string, athlete_gender string, birth_year int")
    got = {(r.a, r.b): (r.shorter, list(r.added), list(r.initials)) for r in identity.partial_candidates(people).collect()}
    assert got[1, 2] == ("b", ["soto"], []) and got[2, 3] == ("b", [], ["a->ana"]) and (2, 6) not in got and (1, 4) not in got and got[1, 6][0] == "a"
    df = spark.createDataFrame([("Alfa Soto, Ana", "Alfa, Ana", 0), ("Alfa, Ana Eva", "Alfa, Ana", 0), ("Alfa, Ana", "Alva, Ana", 1), ("Alfa, Ana", "Beta, Ana", 1), (None, "x", 0)], "a string, b string, gap int")
    assert [list(r[0]) for r in df.select(identity.expanded_reasons(F.col("a"), F.col("b"), F.col("gap"))).collect()] == [["surname_left_out"], ["given_name_left_out"], ["year_differs_by_one"], [], []]
    pairs = spark.createDataFrame([("joseeph", "joseph", 1, 3), ("ana", "ana", 1, 1), ("anna", "ana", 1, 1), (None, "x", 1, 1), ("maria jose", "mara jose", 1, 9), ("maría joosé", "maría josé", 2, 1), ("joose", "jose", 5, 1), ("jooose", "jose", 1, 9)], "a string, b string, n int, m int")
    safe = identity.safe_vowel_repair(F.col("a"), F.col("b"), F.col("n"), F.col("m"))
    assert [r[0] for r in pairs.select(safe).collect()] == [True, False, False, False, False, True, True, False]
    more = spark.createDataFrame([("Alfa, Ana Eva", "Alfa, E Ana", 0), ("Alfa, Ana", "Alfa, Anna", 0), ("Alfa Soto, Anna", "Alfa, Ana", 0), ("A, Ana", "Alfa, Ana", 0)], "a string, b string, gap int")
    assert [list(r[0]) for r in more.select(identity.expanded_reasons(F.col("a"), F.col("b"), F.col("gap"))).collect()] == [["given_name_left_out"], [], ["surname_left_out"], []]


def test_gender_conflicts_and_pruning(spark):
    results = spark.createDataFrame([("p", "men", 200, 30000, 1), ("p", "women", 100, 60000, 2), ("q", "men", 100, 60000, 3), ("q", "mixed", 100, 1, 4), ("r", "men", 50, 1, 5), (None, "men", 50, 1, 6)], "who string, event_gender string, distance_m int, time_ms long, i int")
    athletes = spark.createDataFrame([("p", "male"), ("q", "female"), ("r", "male"), ("r", "female")], "who string, athlete_gender string")
    assert rows(identity.drop_gender_conflicts(results, athletes, ["who"]), "i") == [(2,), (4,), (5,), (6,)]
    kind = "name_key string, birth_year int, gender string, club_key string"
    a = spark.createDataFrame([("x", 1990, "male", "u"), ("x", 1991, "male", "u"), ("y", None, None, None), (None, 1, None, None)], kind)
    o = spark.createDataFrame([("x", 1990, None, "u"), ("y", None, "female", "v")], kind)
    assert rows(identity.prune_unobserved(a, o), "name_key", "birth_year") == sorted([("x", 1990), ("y", None), (None, 1)], key=str)


def test_roster_and_relay_lines(spark):
    kind = "id_number string, name_key string, gender string, birth_year int"
    roster = spark.createDataFrame([("1-9", "a", "male", 1990), (None, "b", "female", None)], kind)
    present = lambda *r: spark.createDataFrame(list(r), kind)
    assert rows(identity.attending(roster, present(("1-9", "zz", None, None), (None, "b", "female", None))), "name_key") == [("a",)]
    assert rows(identity.attending(roster, present((None, "b", "female", None))), "name_key") == [("b",)]
    assert identity.attending(roster, present()).count() == 2
    lines = spark.createDataFrame([("d", 1, 1, 1, "a"), ("d", 1, 1, 2, "b"), ("d", 1, 2, 1, "c")], "document string, page_number int, line_number int, leg_order int, swimmer string")
    fix = spark.createDataFrame([("d", 1, 1, 1, "z")], lines.schema)
    assert rows(identity.replace_relay_lines(lines, fix), "line_number", "swimmer") == [(1, "z"), (2, "c")]
    swimmers = spark.createDataFrame([(1, "u", None, "Ana Alfa"), (2, "u", "male", "Ana Alfa")], "swimmer_id int, club_key string, gender string, name string")
    people = spark.createDataFrame([("u", "female", "Alfa, Ana"), ("u", "female", "Zeta, Olga")], "club_key string, gender string, name string")
    assert rows(identity.reconcile(swimmers, people), "swimmer_id", "name") == [(1, "Alfa, Ana")]
