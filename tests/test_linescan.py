"""Lines of the page, result fields and what is left unread."""

import pytest
from pyspark.sql import functions as F

from lanewise.plans import linescan, repair, reports

PAGE = [
    "HY-TEK's MEET MANAGER 8.0", "1 - 10:02 PM 12-11-2023 Page 4", "Results", "resultados - Final", "Combined Events", "=====", "Name Age Team Seed Time Finals Time", "Nombre Edad Equipo Sembrar Finales Puntos",
    "Nombre Edad Equipo Tiempo para SembradoTiempo de Finales", "Lugar Nombre Equipo Total 50FLY 50BK 50BR 50FR", "Estadio Nacional", "Page 3", "Página 12", "Copa Sur - 1/2/2003", "Copa Sur - 1-2-2003 a 3-2-2003",
    "(Combined Team Scores", "Puntajes - Mujeres", "R.M.: 1:02,33", "1:02,33 35,10 1:40.2", "Women - Masters Team Rankings", "1. Club Uno 123 2. Club Dos 45,5", "DQ No se presenta", "SW7.1 patada", "SUDAMERICANO: 1:02,33", "1:02,33 (31,20) DQ", "", "   ",
]
OTHER = ["1 Soto, Ana 35 Club 1:02,33 1:01,20", "Event 1 Women 30-34 100 LC Meter Free", "Results of Ana", "Team Uno", "1) Soto, Ana W35", "12", "SWIM Team", "Page of 3 x", "Nombre de Ana", "1. Club"]


def test_lines_of_the_page(spark):
    df = spark.createDataFrame([(t, True) for t in PAGE] + [(t, False) for t in OTHER] + [(None, True)], "t string, page boolean")
    got = df.withColumn("is", linescan.page_line(F.col("t"))).where("NOT (is <=> page)").collect()
    assert got == []


@pytest.mark.parametrize(
    "line, age, team",
    [("1 Soto, Ana 3 35 Club Uno 1:02,33", 35, "Club Uno"), ("1 Soto, Ana 8 Club B 1:02,33", 8, "Club B"), ("1 Soto, Ana 35 40 Club 1:02,33", 35, "40 Club")],
)
def test_doubled_ages(spark, line, age, team):
    costs = repair.word_costs(spark.createDataFrame([("ana",)], "n string"), "n")
    rows = [("d", 1, 1, "Event 5 Women 30-34 100 LC Meter Free"), ("d", 1, 2, line), ("d", 1, 3, None)]
    scan = linescan.scanned(spark.createDataFrame(rows, "document string, page_number int, line_number int, raw_line string"), costs)
    found = linescan.result_rows(scan, F.lit(2001)).first()
    assert (found.age, found.team, found.birth_year, found.time_ms) == (age, team, 2001 - age, 62330)
    assert scan.where("raw_line IS NULL").first().kind == "skipped"
    assert linescan.scanned(spark.createDataFrame([], "document string, page_number int, line_number int, raw_line string"), costs).count() == 0


def test_relay_ages_in_nine_places(spark):
    lines = {
        "Event 1 Women 200 SC Meter Freestyle Relay 240 a 279": ("240 a 279", "freestyle_relay"), "Event 1 Women 200 SC Meter Medley C 160 a 199 años Relay": ("C 160 a 199 años", "medley_relay"),
        "Evento 1 Mixto 200 CP Metro 4x50 libre 120 años Relevo": ("120 años", "freestyle_relay"), "Evento 1 Mixto 200 CP Metro Combinado 30 años y más Relevo": ("30 años y más", "medley_relay"),
        "Event 1 Women 200 SC Meter Medley Relay PM": ("PM", "medley_relay"), "#1 Women 18-24 50 Meter Free": ("18-24", "freestyle"), "Event 1 Women 200 SC Meter Freestyle": None,
    }
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    got = {r.t: (r.e.age_group, r.e.stroke) if r.e else None for r in df.select("t", reports.event_context(F.col("t")).alias("e")).collect()}
    assert got == lines
