import pytest
from pyspark.sql import functions as F

from lanewise.plans import reports


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "line, want",
    [
        ("Event 1 Women 35-39 100 LC Meter Free", (1, "women", "35-39", 100, "LC", "freestyle")),
        ("(Evento 2 Hombres 40-44 50 CP Metro Espalda)", (2, "men", "40-44", 50, "SC", "backstroke")),
        ("Evento 3 Mixto 160-199 4x50 CP Metro Relevo Libre", (3, "mixed", "160-199", 200, "SC", "freestyle_relay")),
        ("Event 4 Women 40-44 100 SC Meter Breast 40 a 99 años", (4, "women", "40-44", 100, "SC", "breaststroke")),
        ("Event 10 Women 400 SC Meter Freestyle Relay 240 a 279", (10, "women", "240 a 279", 400, "SC", "freestyle_relay")),
        ("Event 7 Mixed 200 SC Meter Medley C 160 a 199 años Relay", (7, "mixed", "C 160 a 199 años", 200, "SC", "medley_relay")),
        ("Event 11 Mixed 100 SC Meter 4x100 mts Libres PM Relay", (11, "mixed", "PM", 100, "SC", "freestyle_relay")),
        ("Evento 11 Mixto 200 CL Metro Combinado 120 a 159 años Relevo", (11, "mixed", "120 a 159 años", 200, "LC", "medley_relay")),
        ("Evento 12 Mixto 200 CL Metro 4x50 comb 120 años Relevo", (12, "mixed", "120 años", 200, "LC", "medley_relay")),
        ("Evento 17 Mixed 72-99 4x50 SC Metros Combinado Relay", (17, "mixed", "72-99", 200, "SC", "medley_relay")),
        ("Evento 1 Damas 18-24 400 SC Metros Comb. Ind.", (1, "women", "18-24", 400, "SC", "individual_medley")),
        ("#1 Women 18-24 100 Meter IM", (1, "women", "18-24", 100, "SC", "individual_medley")),
        ("E vento 5 Mujeres 25-29 50 CC Metro Estilo Libre Pre Master - Master", (5, "women", "25-29", 50, "SC", "freestyle")),
        ("1 Alfa, Ana 31 Uno 35,00 34,00", None),
        ("Event of the year", None),
        (None, None),
    ],
)
def test_event_headers(spark, line, want):
    got = spark.createDataFrame([(line,)], "l string").select(reports.event_context(F.col("l"))).collect()[0][0]
    assert (tuple(got) if got else None) == want


def test_slipped_columns(spark):
    given = [
        ("1", "Uno", "35,00", "7", None, 50), ("2", "Uno", "9", "35,00", "36,00", 50), ("3", "Uno", "9", "DQ", "36,00", 50), ("---", "Uno", "40,00", "DNS", "36,00", 50),
        ("---", "Uno", "40,00", "X39,00", "4", 50), ("4", "Club A 49.33", "DQ", "DQ", None, 50), ("5", "Club A 49.33", "NT", "50,00", None, 50), ("6", "Uno", "20,00", "1:20,00", None, 100), (None, None, None, None, None, None),
    ]
    out = reports.settle(spark.createDataFrame(given, "rank string, team string, seed string, final string, points string, distance_m int"))
    assert [tuple(r)[1:5] for r in out.collect()] == [
        ("Uno", None, "35,00", "7"), ("Uno", "35,00", "36,00", None), ("Uno", "DQ", "36,00", None), ("Uno", "40,00", "DNS", None),
        ("Uno", "40,00", "X39,00", None), ("Club A", "49.33", "DQ", None), ("Club A", "NT", "50,00", None), ("Uno", None, "1:20,00", None), (None, None, None, None),
    ]


def test_relay_names_over_lines(spark):
    lines = [(1, "Event 3 Mixed 160-199 4x50 SC Meter Free Relay"), (2, "1 Uno A NT 2:01,00"), (3, "1) Alfa, Ana W35 2) Beta,"), (4, "Leo M40"), (5, "2 Dos B 2:10,00 2:11,50"), (6, "1) Gama, Eva W30"), (20, "3) Far, Off W30")]
    got = reports.relay_teams(spark.createDataFrame([("d", *l) for l in lines], "document string, line_number int, raw_line string")).collect()
    found = {r.team: (r.rank, r.time_ms, [(m.leg, m.name, m.gender, m.age) for m in r.members]) for r in got}
    assert found == {"Uno A": (1, 121000, [(1, "Alfa, Ana", "female", 35), (2, "Beta, Leo", "male", 40)]), "Dos B": (2, 131500, [(1, "Gama, Eva", "female", 30)])}


def test_relay_lines_of_odd_texts(spark):
    from lanewise.plans.documents import parse_relay_line, parse_swimmers

    lines = ["1 C\x01D A NT 2:01,00 7,5", "1\tNT\tNT\tX1:59,00\n", "--- Uno (a) 9'9 DQ", "*12 Uno 35,1 34,1\r\n", "1 Uno NT", "x 1 Uno NT 1:00,00", "", None]
    got = spark.createDataFrame([(l,) for l in lines], "l string").select(parse_relay_line(F.col("l")).alias("r"), "l").collect()
    assert [g.r and tuple(g.r) for g in got] == [(1, "C\x01D A", "NT", "2:01,00", 121000), (1, "NT", "NT", "X1:59,00", 119000), (None, "Uno (a)", "9'9", "DQ", None), (12, "Uno", "35,1", "34,10", 34100), None, None, None, None]
    lines = ["x) 1) Ana $1 W35 2)Leo\\ 40  3) \x01 M7 ", "1) Ana W35 2) Leo) M40 3) Eva 1234 4) Luz 99 rest (5)", "9) (a M1)", "none)", "", None]
    got = spark.createDataFrame([(l,) for l in lines], "l string").select(parse_swimmers(F.col("l")).alias("m")).collect()
    assert [g.m if g.m is None else [tuple(m) for m in g.m] for g in got] == [[(2, "Leo\\", None, 40), (3, "\x01", "male", 7)], [(1, "Ana", "female", 35)], [], [], [], None]


def test_relay_lines_are_dealt_out_once(spark):
    """The rows are shuffled once, before they are printed, and swimmers are read at one place of the plan."""
    from lanewise.plans.documents import SWIMMER

    plan = reports.QUERIES["relay_swimmers_over_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert str(plan.executedPlan()).count("Exchange hashpartitioning") == 1
    assert str(plan.optimizedPlan()).count(SWIMMER) == 1


def test_pages_in_columns(spark):
    lines = [("d", 1, "Event 1 Women 35-39 Event 2 Men 35-39"), ("e", 1, "#1 Women 18-24 100 #2 Men 18-24"), ("f", 1, f"x {reports.WATERMARK}"), ("g", 1, "Event 1 Women 35-39"), ("h", 3, "Event 1 Women Event 2 Men"), ("h", 1, None)]
    assert rows(reports.layouts(spark.createDataFrame(lines, "document string, page_number int, raw_line string"))) == [("d", "two columns"), ("e", "columns"), ("f", "coordinates"), ("g", "plain"), ("h", "plain")]
    words = spark.createDataFrame([("d", 1, "Event", 10.0, 600.0, 1), ("d", 1, "Evento", 320.0, 600.0, 1), ("d", 1, "a", 11.0, 600.0, 2)], "document string, page_number int, text string, x0 double, page_width double, line int")
    assert rows(reports.reading_order(words), "line_number", "text") == [(1, "Event"), (2, "a"), (3, "Evento")]


def test_meet_header_and_counters(spark):
    lines = spark.createDataFrame([("d", 1, "x"), ("d", 2, "Copa Uno - 2-3-2026 a 04/03/2026"), ("d", 3, "Copa Dos - 1/1/2020"), ("e", 1, "Copa - 31/2/2026")], "document string, line_number int, raw_line string")
    got = rows(reports.meet_header(lines), "document", "name", "start_date", "end_date", "year")
    assert [tuple(map(str, g)) for g in got] == [("d", "Copa Uno", "2026-03-02", "2026-03-04", "2026"), ("e", "Copa", "None", "None", "None")]
    kinds = spark.createDataFrame([("d", "header"), ("d", "result"), ("d", "result"), ("e", "unparsed")], "document string, kind string")
    assert rows(reports.counters(kinds), "document", "n_header", "n_result", "n_unparsed") == [("d", 1, 2, 0), ("e", 0, 0, 1)]


def test_staged_relays(spark):
    kind = "event_name string, team string, page_number int, line_number int, club_name string, rank_position int, result_time_ms long, position int"
    teams = spark.createDataFrame([("e", "Uno A", 1, 5, None, 1, 100, 1), ("e", "UNO A", 1, 20, None, 2, 200, 2), ("e", "Dos", 2, 1, "Club Dos", 3, 300, 3)], kind)
    swimmers = spark.createDataFrame([("E", "Uno A", 1, 6, "a"), ("e", "uno a", 1, 30, "b"), ("e", "Uno A", 3, 1, "c"), ("e", "Dos", 2, 0, "d"), ("e", "Tres", 1, 1, "x"), ("e", "Uno A", None, None, "n")], "event_name string, team string, page_number int, line_number int, name string")
    clubs = spark.createDataFrame([("Uno",), ("Tres",)], "club_name string")
    staged, members = reports.staged_relays(teams, swimmers, clubs)
    assert rows(staged, "team", "club_name") == [("Dos", "Club Dos"), ("UNO A", "Uno"), ("Uno A", "Uno")]
    assert rows(members, "name", "club_name", "relay_rank_position", "relay_result_time_ms") == [("a", "Uno", 1, 100), ("b", "Uno", 2, 200), ("c", "Uno", 2, 200), ("d", "Club Dos", 3, 300), ("n", "Uno", 2, 200), ("x", "Tres", None, None)]
