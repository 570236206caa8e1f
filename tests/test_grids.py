from pyspark.sql import functions as F

from lanewise.plans import grids


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_word_rows(spark):
    words = spark.createDataFrame([(1, "b", 50.0, 10.5), (1, "a", 1.0, 10.0), (1, "c", 5.0, 12.1), (1, "d", 5.0, 14.0), (2, "z", 0.0, 0.0)], "page int, text string, x0 double, top double")
    lined = grids.word_rows(words, ["page"])
    assert rows(lined, "text", "line") == [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("z", 0)]
    assert rows(grids.between(lined, ["page", "line"], 0, 40, "left"), "page", "line", "left") == [(1, 0, "a"), (1, 1, "c d"), (2, 0, "z")]


def test_entries(spark):
    form = [["Primer nombre", "Apellido paterno", "Apellido materno", "RUT", "Fecha de nacimiento", "Género", "50 Crol", "50 Pecho"], ["Ana", "Alfa", None, "1-9", "1990-01-02", "F", "32,41", "x"], [None] * 8, ["Leo", "Beta", "Gama", None, "01/02/1980", "varon", None, "0:40.5"]]
    block = [["", "50 espalda", "", "", ""], ["Nombre", "Tiempo", "Apellido paterno", "RUT", "Fecha nacimiento"], ["Eva", "45,1", "Zeta", "2-7", "02-03-1970"], ["", "", "", "", ""]]
    grid = [("form", n, r) for n, r in enumerate(form)] + [("50 Damas", n, r) for n, r in enumerate(block)] + [("none", 0, ["x"])]
    got = rows(grids.entries(spark.createDataFrame(grid, "sheet string, row int, cells array<string>"), 2026), "full_name", "id_number", "gender", "birth_year", "age", "times")
    assert got == [("Ana Alfa", "19", "female", 1990, 36, {"freestyle": 32410}), ("Eva Zeta", "27", "female", 1970, 56, {"backstroke": 45100}), ("Leo Beta Gama", None, "male", 1980, 46, {"breaststroke": 40500})]


def test_competition_table(spark):
    html = '<table><tr><td><a href="/info?id=7&x=1">Copa <b>A</b></a></td><td>2026-01-02<br>2026-01-03</td><td>Here</td></tr><tr><td><a href="/info?id=8">B</a></td><td>2026-02-01</td><td></td></tr><tr><td><a href="/info?id=7">again</a></td><td></td><td></td></tr>'
    got = rows(grids.competition_table(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")), "competition_id", "title", "start_text", "end_text", "place")
    assert got == [(7, "Copa A", "2026-01-02", "2026-01-03", "Here"), (8, "B", "2026-02-01", "2026-02-01", "")]


def test_combined(spark):
    lines = spark.createDataFrame([("1 Alfa, Ana 31 Uno 2:40,00 35,00 38,10 41,2 DNS",), ("Beta, Bea Dos 35,00 - 41,2 NT",), ("nothing here",), (None,)], "raw_line string")
    got = rows(grids.combined_results(lines), "name", "leg", "stroke", "time_ms", "status")
    assert [g for g in got if g[0].startswith("Alfa")] == [("Alfa, Ana", 1, "butterfly", 35000, "valid"), ("Alfa, Ana", 2, "backstroke", 38100, "valid"), ("Alfa, Ana", 3, "breaststroke", 41200, "valid"), ("Alfa, Ana", 4, "freestyle", None, "dns")]
    assert [g[1] for g in got if g[0].startswith("Beta")] == [1, 3, 4]


def test_small_helpers(spark):
    df = spark.createDataFrame([("Copa Here",), ("Open There y Here",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(grids.local_hint(F.col("t"), ["here"], ["there"])).collect()] == ["local", "foreign", "unknown", "unknown"]
    assert grids.page_url("http://a/b/", 1) == "http://a/b/" and grids.page_url("http://a/b/", 3) == "http://a/b/page/3/"
    names = spark.createDataFrame([("U1", "p"), ("U2", "p"), ("U2", "q"), ("V", "p")], "club_name string, athlete_name string")
    aliases = spark.createDataFrame([("U1", "U"), ("U2", "U"), ("V", "V")], "club_name string, canonical_name string")
    assert rows(grids.alias_evidence(names, aliases)) == [("U", "U1", "U2", 1)]
