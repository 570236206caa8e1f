"""Printed results from raw lines to settled rows: repair, page lines, headers, results, relays, and what is left and why.

Each line is a row; the only order is that of a document's lines, for the event that a line stands under. Whatever isn't read
has a reason, so that nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.functions import domain, text, times
from lanewise.functions.times import let
from lanewise.operators import core
from lanewise.plans.documents import RESULT_LINE, RESULT_NO_SEED, parse_relay_line, parse_swimmers
from lanewise.plans.repair import mended, unbroken, word_costs
from lanewise.plans.reports import MEET_HEADER, event_context, settle
from lanewise.plans.star import Star

QUERIES: dict = {}
ORACLES: dict = {}

# What lines of the page itself consist of or begin with.
HEAD_WORDS = (
    "name age team seed time finals points relay nombre edad equipo sembrar finales puntos tiempo de para sembrado sembradotiempo relevo place lugar total 50fly 50bk 50br 50fr"
).split()
HEAD_OPENERS = ("name", "team", "nombre", "equipo", "place", "lugar")
PAGE_LINES = ("results", "resultados", "combined events", "eventos combinados")
PAGE_OPENERS = (
    "results -", "resultados -", "estadio ", "combined team scores", "(combined team scores", "scores -", "(scores -", "puntajes -", "(puntajes -", "r.m.:", "r.s.:",
    "dnf no ", "dq no ", "world:", "world :", "sudamericano:", "sudamericano :", "sudameri:", "sudameri :",
)
PAGE_WORDS = ("page", "pagina", "página")
PROGRAM = ("hy-tek's meet manager", "hy-teks meet manager")
RANKINGS, GENDERS = ("team rankings", "lugar por equipo"), ("women", "men", "mujeres", "hombres")
ADULT, CHILD = 18, 10


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return add


def page_line(line: Column) -> Column:
    """Whether a line belongs to the page: heads of columns, page numbers, programs, dates, standings, records, split times."""

    def of(low: Column) -> Column:
        words = F.split(low, r"\s+")
        first, last, n = F.get(words, F.lit(0)), F.element_at(words, -1), F.size(words)
        digits = lambda c: (c != "") & (F.translate(c, "0123456789", "") == "")
        number = lambda c: digits(F.translate(c, ".,", ""))
        any_ = lambda some, test: F.exists(F.array(*map(F.lit, some)), test)
        clock = lambda w: (F.translate(w, ".,", "") != w) & digits(F.translate(w, ".,:", "")) & times.time_ms(w).isNotNull()
        return (
            F.forall(words, lambda w: w.isin(*HEAD_WORDS)) & first.isin(*HEAD_OPENERS)
            | low.isin(*PAGE_LINES)
            | any_(PAGE_OPENERS, lambda o: F.startswith(low, o))
            | any_(PROGRAM, lambda o: F.contains(low, o))
            | ((n == 2) & first.isin(*PAGE_WORDS) & digits(last))
            | F.coalesce(F.try_element_at(words, F.lit(-2)).isin(*PAGE_WORDS) & digits(last) & F.contains(low, F.lit(" - ")), F.lit(False))
            | (F.translate(low, "=", "") == "")
            | low.rlike(MEET_HEADER)
            | ((n > 1) & F.forall(words, clock))
            | ((F.translate(low, "0123456789:,. ()dqnsf", "") == "") & low.rlike("[0-9][:.,][0-9]"))
            | (F.endswith(first, F.lit(".")) & digits(F.translate(first, ".", "")) & (n > 2) & number(last))
            | (first.isin(*GENDERS) & (F.get(words, F.lit(1)) == "-") & any_(RANKINGS, lambda o: F.contains(low, o)))
            | (F.startswith(first, F.lit("sw")) & (n > 1) & digits(F.translate(F.substring(first, F.lit(3), F.length(first)), ".", "")))
        )

    return F.coalesce(let(F.lower(F.trim(line)), lambda low: (low == "") | of(low)), F.lit(True))


def result_fields(line: Column) -> Column:
    """(rank, name, age, team, seed, final, points) of an individual result as printed; null where the line is none."""
    part = lambda form, g: F.regexp_extract(line, form, g)
    read = lambda form, seed: F.struct(
        part(form, 1).alias("rank"), part(form, 2).alias("name"), part(form, 3).cast("int").alias("age"), part(form, 4).alias("team"),
        (part(form, 5) if seed else F.lit(None).cast("string")).alias("seed"), part(form, 6 if seed else 5).alias("final"), F.nullif(part(form, 7 if seed else 6), F.lit("")).alias("points"),
    )
    return F.when(line.rlike(RESULT_LINE), read(RESULT_LINE, True)).when(line.rlike(RESULT_NO_SEED), read(RESULT_NO_SEED, False))


def scanned(lines: DataFrame, costs: DataFrame, document: str = "document", order: tuple[str, ...] = ("page_number", "line_number")) -> DataFrame:
    """lines (document, page_number, line_number, raw_line, ...) with line (repaired), kind, event, fields, relay, members, reason.

    kind: skipped (of the page, or before any event), header, result, relay, members, unparsed; the reason of unparsed lines tells
    whether they stand in a relay. Lines printed letter by letter are put together by the words of `costs`."""
    # settled before several branches read it, and before filters that would work all of it out once more
    fixed = unbroken(core.settled(core.spread(lines).withColumn("line", mended(F.col("raw_line")))), costs, "line")
    marked = fixed.withColumn("_page", page_line(F.col("line"))).withColumn("_header", F.when(~F.col("_page"), event_context(F.col("line"))))
    under = core.carry_forward(marked, [document], list(order), F.col("_header"), "event")
    relay = F.coalesce(F.col("event.stroke").endswith("_relay"), F.lit(False))
    open_ = ~F.col("_page") & F.col("_header").isNull() & F.col("event").isNotNull()
    read = under.withColumns({
        "fields": F.when(open_ & ~relay, result_fields(F.col("line"))),
        "members": F.when(open_ & relay & F.col("line").rlike(r"^\d\)"), parse_swimmers(F.col("line"))),
        "relay": F.when(open_ & relay & ~F.col("line").rlike(r"^\d\)"), parse_relay_line(F.col("line"))),
    })
    kind = (
        F.when(F.col("_header").isNotNull(), "header").when(F.col("_page") | F.col("event").isNull(), "skipped").when(F.col("fields").isNotNull(), "result")
        .when(F.col("relay").isNotNull(), "relay").when(F.size("members") > 0, "members").otherwise("unparsed")
    )
    return core.settled(read.withColumn("kind", kind)).withColumn("reason", F.when(F.col("kind") == "unparsed", F.when(relay, "unparsed_relay_line").otherwise("unparsed_inside_event"))).drop("_page", "_header")


def result_rows(scan: DataFrame, year: Column, document: str = "document", order: tuple[str, ...] = ("page_number", "line_number")) -> DataFrame:
    """The individual results of scanned lines, columns set right: document, order, event, rank, name, age, birth_year, team, seed_text,
    seed_ms, time_text, time_ms, status, points. year: of the competition, for birth years."""
    keys = [document, *order]
    flat = scan.where("kind = 'result'").select(*keys, "event", year.cast("int").alias("_year"), "fields.*", F.col("event.distance_m").alias("distance_m"))
    right = settle(flat)
    # a child's age in an adult's event is the first digit of the adult's, which then opens the team's name
    first = text.number_in(F.col("event.age_group"), r"([0-9]+)")
    doubled = F.coalesce((F.col("age") < CHILD) & (first >= ADULT) & F.col("team").rlike(r"^[1-9][0-9]\s+\S"), F.lit(False))
    aged = right.withColumn("_doubled", doubled).withColumns({
        "age": F.when(F.col("_doubled"), F.left("team", F.lit(2)).cast("int")).otherwise(F.col("age")), "team": F.when(F.col("_doubled"), F.trim(F.substring("team", F.lit(3), F.length("team")))).otherwise(F.col("team")),
    })
    shown = aged.withColumn("time_text", times.normal_time(F.col("final"))).withColumn("seed_text", times.normal_time(F.col("seed")))
    timed = shown.withColumn("time_ms", times.time_ms(F.col("time_text"))).withColumn("seed_ms", times.time_ms(F.col("seed_text")))
    exhibition = F.coalesce(F.upper("time_text").startswith("X"), F.lit(False))
    return timed.select(
        *keys, "event", F.when(~exhibition, text.number_in(F.col("rank"), r"([0-9]+)")).alias("rank"), "name", "age", (F.col("_year") - F.col("age")).alias("birth_year"), "team", "seed_text", "seed_ms", "time_text", "time_ms",
        F.when(F.col("time_ms").isNotNull(), "valid").otherwise(domain.status(F.lit(None).cast("string"), F.col("time_text"))).alias("status"), F.translate("points", ", ", ".").alias("points"),
    )


# --- registered forms


def printed_lines(s: Star) -> DataFrame:
    """A report a customer, a line an order, in eight forms under two events, with lines of the page between them."""
    o = s.raw("orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    key, n = F.col("o_orderkey"), F.col("n").cast("string")
    ms = (key % 4000 + 6000) * 10
    final, seed, age = times.format_ms(ms), times.format_ms(ms + 1000), (key % 50 + 30).cast("string")
    name, team = F.concat(F.lit("Munñ oz"), key.cast("string"), F.lit(", Joseí")), F.concat(F.lit("Club "), F.col("o_orderstatus"))
    say = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    spaced = lambda c: F.regexp_replace(c, r"(?<=.)(?=.)", " ")
    forms = [
        say(n, name, age, team, seed, final, "9,5"), say(n, name, age, team, final), say("---", name, age, team, "NS", "DQ"), say(n, name, age, team, final, "9"),
        say("Page", n), say("Texto suelto", key.cast("string")), say(n, name, F.lit("3"), age, team, F.concat(F.lit("X"), final)), say(n, name, age, team, seed, spaced(final), "14"),
    ]
    line = F.element_at(F.array(*forms), (key % 8 + 1).cast("int"))
    rows = o.select(F.col("o_custkey").alias("document"), F.lit(1).alias("page_number"), (F.col("n") + 10).alias("line_number"), line.alias("raw_line"))
    docs = o.select(F.col("o_custkey").alias("document")).distinct()
    top = ["Results", "Meet of all - 1/2/2001", "stray line before any event", "Event 5 Women 30-34 100 LC Meter Free", "Name Age Team Seed Time Finals Time Points", "=========="]
    heads = docs.select("document", F.lit(1).alias("page_number"), F.posexplode(F.array(*map(F.lit, top))).alias("line_number", "raw_line"))
    relay = ["(Evento 6 Mixto 200 CP Metro 4x50 libre 120 años Relevo)", "1 Club Uno A NT 2:10,00", "1) Soto, Ana W35 2) Paz, Luis M36", "otra cosa"]
    ends = docs.select("document", F.lit(2).alias("page_number"), F.posexplode(F.array(*map(F.lit, relay))).alias("line_number", "raw_line"))
    return rows.unionByName(heads).unionByName(ends)


_DOCS = "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, (o_orderkey % 8)::INTEGER AS form, ((o_orderkey % 4000 + 6000) * 10)::BIGINT AS ms FROM orders), d AS (SELECT DISTINCT o_custkey FROM orders)"


@query(f"""{_DOCS} SELECT o_custkey AS document, (n + 10)::INTEGER AS line_number, 5 AS event_number, CASE WHEN form NOT IN (2, 6) THEN n::INTEGER END AS rank, 'Muñoz' || o_orderkey || ', José' AS name, (o_orderkey % 50 + 30)::INTEGER AS age, (1971 - o_orderkey % 50)::INTEGER AS birth_year,
  'Club ' || o_orderstatus AS team, CASE WHEN form IN (0, 7) THEN ms + 1000 END AS seed_ms, CASE WHEN form <> 2 THEN ms END AS time_ms, CASE WHEN form = 2 THEN 'dsq' ELSE 'valid' END AS status, CASE form WHEN 0 THEN '9.5' WHEN 3 THEN '9' WHEN 7 THEN '14' END AS points
FROM o WHERE form NOT IN (4, 5)""")
def settled_results(s: Star) -> DataFrame:
    """Raw lines to settled results: accents and broken times repaired, slipped columns and doubled ages set right."""
    scan = scanned(printed_lines(s), word_costs(s.raw("part"), "p_name"))
    rows = result_rows(scan, F.lit(2001))
    return rows.select("document", F.col("line_number").cast("int").alias("line_number"), F.col("event.number").alias("event_number"), "rank", "name", "age", "birth_year", "team", "seed_ms", "time_ms", "status", "points")


@query(f"""{_DOCS}, k AS (SELECT o_custkey, CASE form WHEN 4 THEN 'skipped' WHEN 5 THEN 'unparsed' ELSE 'result' END AS kind, CASE WHEN form = 5 THEN 'unparsed_inside_event' END AS reason FROM o
UNION ALL SELECT o_custkey, unnest(['skipped', 'skipped', 'skipped', 'header', 'skipped', 'skipped', 'header', 'relay', 'members']), NULL FROM d UNION ALL SELECT o_custkey, 'unparsed', 'unparsed_relay_line' FROM d)
SELECT o_custkey AS document, kind, reason, count(*)::BIGINT AS n FROM k GROUP BY ALL""")
def scanned_kinds(s: Star) -> DataFrame:
    """How many lines of each report are read as what, and why the others aren't."""
    scan = scanned(printed_lines(s), word_costs(s.raw("part"), "p_name"))
    return scan.groupBy("document", "kind", "reason").agg(F.count("*").alias("n"))
