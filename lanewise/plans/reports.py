"""Printed reports: event headers, the columns of result lines, relay teams with their swimmers, and the frames they fill.

Everything is a column expression or a window over a document's lines; a document is the only group that is ever ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.functions import domain, text, times
from lanewise.functions.times import let
from lanewise.operators import core
from lanewise.plans.documents import parse_relay_line, parse_swimmers
from lanewise.plans.star import STAR_SQL, Star

QUERIES: dict = {}
ORACLES: dict = {}

# Words and bounds of the printed forms.
OPENER = r"(?i)^\(?(?:E\s*vento?\s+|#)(\d+)\s+(Women|Men|Mixed|Mujeres|Hombres|Damas|Varones|Mixto)\s+(.*?)\)?$"
SWUM = r"(?i)^(?:(.+?)\s+)?(\d+(?:x\d+)?)\s+(?:(LC|SC|CL|CP|CC)\s+)?Met(?:er|ros?)\s+(.+)$"
#: Words of an age band by class: a number, a, years, and, more, a band's letter or PM. Shapes that they may form, a letter before them.
AGE_WORDS = {"a": "a", "años": "o", "anos": "o", "y": "y", "más": "m", "mas": "m", "pm": "p", "relay": "r", "relevo": "r"}
AGE_SHAPES = ("nan", "nano", "nym", "noym", "no", "p")
MEET_HEADER = r"(?i)^(.+?)\s+-\s+(\d{1,2}[-/]\d{1,2}[-/]\d{4})(?:\s+(?:a|to)\s+(\d{1,2}[-/]\d{1,2}[-/]\d{4}))?$"
ABSENT = ("dns", "dnf", "dq", "dsq")
MOST_POINTS_MS, PLAUSIBLE_MS, LONG_MS, SEED_FROM_M = 9_000, 25_000, 10_000, 100
TEAM_LINES = 8


def query(sql: str | None = None, star: bool = True):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (STAR_SQL if star else "") + sql
        return f

    return add


def _relay_ages(words: Column) -> Column:
    """(stroke, ages) of a relay's words: the ages follow the word for a relay or stand right before it, at the end."""
    kind = lambda w: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in AGE_WORDS.items() for x in kv]), F.lower(w)), F.when(w.rlike("^[0-9]+$"), "n").when(w.rlike("^[A-Za-z]$"), "p").otherwise("w"))
    joined = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    shapes = [*AGE_SHAPES, *[lead + x for lead in "pay" for x in AGE_SHAPES], "a", "y"]

    def of(kinds: Column) -> Column:
        n = F.length(kinds)
        at = F.instr(kinds, "r")
        behind = F.when((at > 1) & F.substring(kinds, at + 1, n).isin(*shapes), F.struct(joined(F.lit(1), at).alias("stroke"), joined(at + 1, n - at).alias("ages")))
        # what stands between the last word of the stroke and the relay's at the end
        words_before = F.length(F.rtrim(F.translate(F.left(kinds, n - 1), "nayompr", "       ")))
        own = F.greatest(words_before, F.lit(1))
        between = F.substring(kinds, own + 1, n - 1 - own)
        ahead = F.when(kinds.endswith("r") & (n > 2) & between.isin(*shapes), F.struct(F.concat(joined(F.lit(1), own), F.lit(" "), joined(n, F.lit(1))).alias("stroke"), joined(own + 1, n - 1 - own).alias("ages")))
        return F.coalesce(behind, ahead)

    return let(F.array_join(F.transform(words, kind), ""), of)


def event_context(line: Column) -> Column:
    """(number, gender, age_group, distance_m, course, stroke) of an event's header, null where the line is none.

    A header opens with its number and gender; then come distance, course and what is swum, and the ages either before the
    distance or behind the stroke, there before or after the word for a relay. A header without a course is short course.
    """
    part = F.regexp_extract

    def header(t: Column) -> Column:
        parts = lambda rest: F.struct(F.nullif(part(rest, SWUM, 1), F.lit("")).alias("before"), part(rest, SWUM, 2).alias("distance"), part(rest, SWUM, 3).alias("course"), part(rest, SWUM, 4).alias("swum"))
        return let(part(t, OPENER, 3), lambda rest: F.when(rest.rlike(SWUM), let(parts(rest), lambda p: let(relayed(p), lambda r: shown(t, p, r)))))

    def relayed(p: Column) -> Column:
        relay = let(let(F.split(p["swum"], r"\s+"), _relay_ages), lambda r: F.struct(r["ages"].alias("ages"), r["stroke"].alias("stroke")))
        return F.when(p["before"].isNotNull(), F.struct(F.trim(p["before"]).alias("ages"), p["swum"].alias("stroke"))).otherwise(relay)

    def shown(t: Column, p: Column, r: Column) -> Column:
        return F.when(
            r["ages"].isNotNull(),
            F.struct(
                part(t, OPENER, 1).try_cast("int").alias("number"),
                domain.event_gender(part(t, OPENER, 2)).alias("gender"),
                r["ages"].alias("age_group"),
                F.coalesce(domain.distance_m(p["distance"]), F.lit(0)).alias("distance_m"),
                domain.course(F.coalesce(F.nullif(p["course"], F.lit("")), F.lit("SC"))).alias("course"),
                domain.stroke(r["stroke"]).alias("stroke"),
            ),
        )

    # each part is worked out once, and none for lines that don't open as a header
    return F.when(F.trim(line).rlike(OPENER), let(F.trim(line), header))


def settle(rows: DataFrame) -> DataFrame:
    """rows with (rank, team, seed, final, points: texts, distance_m) whose columns may have slipped, set right.

    One place to the left: the points stand where the time should, behind a real time. One to the right: a number too small
    for a seed stands before seed and time. Points go if they are a time behind a status, or belong to an unranked line of
    a status or an exhibition. A status in the seed's place leaves the seed at the end of the team. A seed too fast for its
    distance is none. Each step reads the times that the one before left.
    """
    key, known = lambda c: F.lower(F.trim(c)), lambda c: F.coalesce(c, F.lit(False))
    absent = known(key("final").isin(*ABSENT))
    timed = rows.withColumns({f"_{c}": times.time_ms(F.col(c)) for c in ("seed", "final", "points")})
    left = known(F.col("points").isNull() & (F.col("_seed") > MOST_POINTS_MS) & (F.col("_final") <= MOST_POINTS_MS))
    right = known((F.col("_seed") < PLAUSIBLE_MS) & ((F.col("_final") >= PLAUSIBLE_MS) | absent | (key("final") == "nt")) & (F.col("_points") >= PLAUSIBLE_MS))
    move = timed.withColumn("_move", F.when(left, "left").when(right, "right").when(absent & known(F.col("_points") >= LONG_MS), "behind").otherwise(""))
    at, none = F.col("_move"), F.lit(None).cast("string")
    moved = move.withColumns({
        "seed": F.when(at == "left", none).when(at == "right", F.col("final")).otherwise(F.col("seed")),
        "final": F.when(at == "left", F.col("seed")).when(at == "right", F.col("points")).otherwise(F.col("final")),
        "points": F.when(at == "left", F.col("final")).when(at.isin("right", "behind"), none).otherwise(F.col("points")),
    })
    out_of_rank = F.trim("rank").isin("---", "--") & (key("final").isin(*ABSENT) | F.upper("final").startswith("X"))
    held = r"(?i)^(.+?)\s+(X?\d{1,3}(?::\d{2})?(?:[.,']\d+)?[A-Z]?|NT|NS|DNS|DNF|DQ|DSQ|DFS)$"
    stuck = moved.withColumn("_stuck", known(F.col("seed").isNotNull() & times.time_ms(F.col("seed")).isNull() & F.col("team").rlike(held)))
    own = stuck.withColumns({
        "points": F.when(~known(out_of_rank), F.col("points")),
        "seed": F.when(F.col("_stuck") & (key("seed") == key("final")), F.regexp_extract("team", held, 2)).otherwise(F.col("seed")),
        "team": F.when(F.col("_stuck"), F.regexp_extract("team", held, 1)).otherwise(F.col("team")),
    })
    fast = known((F.col("distance_m") >= SEED_FROM_M) & (times.time_ms(F.col("seed")) < PLAUSIBLE_MS))
    return own.withColumn("seed", F.when(~fast, F.col("seed"))).select(*rows.columns)


def normal_results(rows: DataFrame) -> DataFrame:
    """rows (rank_position, seed_time_text, seed_time_ms, result_time_text, result_time_ms, points, status, ...) in canonical
    form: milliseconds are derived only where none are given, exhibition times have no rank, points have a point."""
    given = lambda c: text.blank_to_null(F.col(c))
    out = rows
    for side in ("seed", "result"):
        shown = times.normal_time(F.col(f"{side}_time_text"))
        out = out.withColumn(f"{side}_time_text", shown).withColumn(f"{side}_time_ms", F.coalesce(given(f"{side}_time_ms").try_cast("long"), times.time_ms(F.col(f"{side}_time_text"))))
    exhibition = F.coalesce(F.upper("result_time_text").startswith("X"), F.lit(False))
    status = F.when(F.col("result_time_ms").isNotNull() & ~F.coalesce(domain.lower_canon(F.col("status")).isin(*domain.STATUSES), F.lit(False)), "valid").otherwise(domain.status(F.col("status"), F.regexp_replace("result_time_text", "^X", "")))
    return out.withColumn("rank_position", F.when(~exhibition, given("rank_position"))).withColumn("points", F.replace(given("points"), F.lit(","), F.lit("."))).withColumn("status", status)


def relay_teams(lines: DataFrame, document: str = "document") -> DataFrame:
    """(document, team_line, team, rank, seed_text, time_text, time_ms, members) of lines (document, line_number, raw_line).

    A team's swimmers are those of the lines below it, up to the next team or header and at most TEAM_LINES, read as one
    text: a name that breaks over two lines is one name. Lines of no team leave before those of a team are put together.
    """
    raw = F.col("_raw")
    marked = raw.rlike(r"^\d\)\s")
    # each step that several columns read is a column of its own, as each of its uses would work it out once more
    read = lines.select(document, "line_number", F.trim("raw_line").alias("_raw")).withColumn("_head", event_context(raw).isNotNull())
    read = read.withColumn("_team", F.when(~F.col("_head") & ~marked, parse_relay_line(raw)))
    own = F.when(F.col("_head") | F.col("_team").isNotNull(), F.struct("line_number", F.col("_team").isNotNull().alias("team")))
    rows = core.carry_forward(read, [document], ["line_number"], own, "_own").where("_own.team AND line_number <= _own.line_number + " + str(TEAM_LINES))
    below = F.sort_array(F.collect_list(F.when(F.col("line_number") > F.col("_own.line_number"), F.struct("line_number", "_raw"))))
    held = rows.groupBy(document, F.col("_own.line_number").alias("team_line")).agg(F.first("_team", ignorenulls=True).alias("t"), below.alias("below"))
    return held.select(document, "team_line", "t.team", "t.rank", "t.seed_text", "t.time_text", "t.time_ms", parse_swimmers(F.array_join(F.col("below._raw"), " ")).alias("members"))


def once(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key, null parts of a key being equal, in the order of the documents."""
    return core.first_by(rows, keys, *order)


def frames(results: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """The dimension and fact frames of result rows (club_name, event_name, athlete_name, gender, birth_year, ...): clubs by
    match key, events by name, athletes by name, club, year and gender, each as first seen."""
    rows = results.withColumn("club_key", text.match_key(F.col("club_name"))).withColumn("athlete_key", text.match_key(F.col("athlete_name")))
    by = [F.asc(c) for c in order]
    named = lambda c: F.col(c).isNotNull()
    return {
        "club": once(rows.where(named("club_key")), ["club_key"], *by).select("club_name"),
        "event": once(rows.where(named("event_name")), ["event_name"], *by).select("event_name"),
        "athlete": once(rows.where(named("athlete_key")), ["athlete_key", "club_key", "birth_year", "gender"], *by).select("athlete_name", "club_name", "birth_year", "gender"),
        "result": results,
    }


def meet_header(lines: DataFrame, document: str = "document") -> DataFrame:
    """(document, name, start_date, end_date, year): the first line that names a meet and its dates; one day: both are it."""
    part = lambda g: F.regexp_extract(F.trim("raw_line"), MEET_HEADER, g)
    day = lambda c: F.coalesce(F.try_to_date(F.translate(c, "-", "/"), "d/M/yyyy"))
    found = lines.where(F.trim("raw_line").rlike(MEET_HEADER)).select(document, "line_number", part(1).alias("name"), day(part(2)).alias("start_date"), day(F.nullif(part(3), F.lit(""))).alias("last"))
    first = core.first_by(found, [document], F.asc("line_number"))
    return first.select(document, "name", "start_date", F.coalesce("last", "start_date").alias("end_date"), F.year("start_date").alias("year"))


# The mark of reports set by coordinates; the x-ranges of two columns.
WATERMARK = "Sistemas de Natação Swim It Up"
TWO_COLUMNS = ((0, 300), (300, 620))


def layout_signs(early: Column) -> dict[str, Column]:
    """The aggregates over a document's lines (raw_line) that tell its layout, of the lines that are early in it."""
    seen = lambda sign: F.when(early, sign)
    heads = lambda opener: F.max(seen(F.regexp_count("raw_line", F.lit(rf"{opener}\d+\s+(?:Women|Men|Mixed)"))))
    return {
        "marked": F.bool_or(seen(F.contains("raw_line", F.lit(WATERMARK)))),
        "two": heads(r"\bEvent\s+"),
        "many": heads("#"),
        "aged": F.bool_or(seen(F.col("raw_line").rlike(r"#\d+\s+(?:Women|Men|Mixed)\s+\d"))),
    }


def layout_of(signs: dict[str, Column]) -> Column:
    return F.when(signs["marked"], "coordinates").when(signs["two"] > 1, "two columns").when((signs["many"] > 1) & signs["aged"], "columns").otherwise("plain")


def layouts(lines: DataFrame, document: str = "document") -> DataFrame:
    """(document, layout) of lines (document, page_number, raw_line), by the first two pages: by the watermark, or by lines
    that hold more than one event header, which stand in two columns or, numbered by a hash, in several."""
    signs = layout_signs(F.lit(True))
    seen = lines.where("page_number <= 2").groupBy(document).agg(*[sign.alias(k) for k, sign in signs.items()])
    return seen.select(document, layout_of({k: F.col(k) for k in signs}).alias("layout"))


def reading_order(rows: DataFrame, columns: int = 2) -> DataFrame:
    """Visual rows (document, page_number, line, x0, page_width, ...) numbered page by page, column by column, row by row."""
    column = F.floor(F.col("x0") * columns / F.col("page_width"))
    order = Window.partitionBy("document").orderBy("page_number", "_column", "line", "x0")
    return rows.withColumn("_column", column).withColumn("line_number", F.row_number().over(order)).drop("_column")


def counters(parsed: DataFrame, document: str = "document") -> DataFrame:
    """How many lines of each kind a document has, one row a document."""
    kinds = ("header", "result", "relay", "members", "unparsed")
    return parsed.groupBy(document).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def course_of(names: DataFrame, document: str = "document", first: int = 20) -> DataFrame:
    """(document, course): LC or SC if one of the document's first `first` event names says so."""
    some = core.top_by(names, [document], first, F.asc("line_number"))
    says = lambda c: F.bool_or(F.col("event_name").rlike(rf"(?i)\b{c}\b"))
    return some.groupBy(document).agg(F.when(says("LC"), "LC").when(says("SC"), "SC").alias("course"))


# --- registered forms: lines printed from the star tables and read again


def printed_headers(s: Star) -> DataFrame:
    """Every event's header in one of eight forms."""
    k, number = F.col("event_id"), F.col("event_id").cast("string")
    english = F.initcap("event_gender")
    spanish = F.when(F.col("event_gender") == "women", "Mujeres").when(F.col("event_gender") == "men", "Hombres").otherwise("Mixto")
    d, say = F.col("distance_m").cast("string"), F.concat
    lit = F.lit
    forms = [
        say(lit("Event "), number, lit(" "), english, lit(" 35-39 "), d, lit(" LC Meter Free")),
        say(lit("(Evento "), number, lit(" "), spanish, lit(" 40-44 "), d, lit(" CP Metro Espalda)")),
        say(lit("Event "), number, lit(" "), english, lit(" "), d, lit(" SC Meter Freestyle Relay 240 a 279")),
        say(lit("Event "), number, lit(" "), english, lit(" "), d, lit(" SC Meter Medley C 160 a 199 años Relay")),
        say(lit("Evento "), number, lit(" "), spanish, lit(" "), d, lit(" CL Metro Combinado 120 a 159 años Relevo")),
        say(lit("Evento "), number, lit(" "), spanish, lit(" 160-199 "), d, lit(" CC Metros Relevo Libre")),
        say(lit("#"), number, lit(" "), english, lit(" 18-24 "), d, lit(" Meter IM")),
        say(lit("E vento "), number, lit(" "), spanish, lit(" 25-29 "), d, lit(" CC Metro Estilo Libre Pre Master")),
    ]
    line = F.lit(None).cast("string")
    for n, form in enumerate(forms):
        line = F.when(k % 9 == n, form).otherwise(line)
    return s.event.select("event_id", F.coalesce(line, F.concat(F.lit("Result "), number)).alias("raw_line"))


@query("""SELECT event_id, event_id::INTEGER AS number, event_gender AS gender, distance_m,
['35-39', '40-44', '240 a 279', 'C 160 a 199 años', '120 a 159 años', '160-199', '18-24', '25-29'][f + 1] AS age_group, ['LC', 'SC', 'SC', 'SC', 'LC', 'SC', 'SC', 'SC'][f + 1] AS course,
['freestyle', 'backstroke', 'freestyle_relay', 'medley_relay', 'medley_relay', 'freestyle_relay', 'individual_medley', 'freestyle'][f + 1] AS stroke
FROM (SELECT *, (event_id % 9)::INTEGER AS f FROM event) WHERE f < 8""")
def event_headers(s: Star) -> DataFrame:
    """Event headers of eight forms read back; lines that are none give nothing."""
    lines = core.spread(printed_headers(s))
    # exploded, as a filter would read each header twice
    read = lines.select("event_id", F.explode(F.array_compact(F.array(event_context(F.col("raw_line"))))).alias("e"))
    return read.select("event_id", "e.number", "e.gender", "e.distance_m", "e.age_group", "e.course", "e.stroke")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, (l_quantity::INTEGER * 700)::BIGINT AS s, (l_partkey % 90 * 600)::BIGINT AS f, CASE l_suppkey % 5 WHEN 0 THEN (l_quantity::INTEGER * 1100)::BIGINT END AS p, l_linenumber * 25 AS d,
  l_returnflag = 'A' AS away, l_suppkey % 3 = 0 AS unranked FROM lineitem),
m AS (SELECT *, NOT away AND p IS NULL AND s > 9000 AND f <= 9000 AS toleft, s < 25000 AND (away OR f >= 25000) AND coalesce(p >= 25000, false) AS toright, away AND coalesce(p >= 10000, false) AS behind FROM l),
r AS (SELECT *, CASE WHEN toleft THEN NULL WHEN toright THEN (CASE WHEN away THEN NULL ELSE f END) ELSE s END AS s2, CASE WHEN toleft THEN s WHEN toright THEN p WHEN away THEN NULL ELSE f END AS f2, CASE WHEN toleft THEN f WHEN toright OR behind THEN NULL ELSE p END AS p2 FROM m)
SELECT l_orderkey, l_linenumber::INTEGER AS l_linenumber, CASE WHEN NOT (d >= 100 AND s2 < 25000) OR s2 IS NULL THEN s2 END AS seed_ms, f2 AS time_ms, CASE WHEN NOT (unranked AND away AND NOT toright) THEN p2 END AS points_ms FROM r""", star=False)
def slipped_columns(s: Star) -> DataFrame:
    """Result columns set right again; every value is shown as a time, as the printed columns are."""
    shown = lambda ms: times.format_ms(ms.cast("long"))
    l = s.raw("lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.when(F.col("l_suppkey") % 3 == 0, "---").otherwise("1").alias("rank"), F.lit("Club").alias("team"), shown(F.col("l_quantity").cast("int") * 700).alias("seed"),
        F.when(F.col("l_returnflag") == "A", "DNS").otherwise(shown(F.col("l_partkey") % 90 * 600)).alias("final"), F.when(F.col("l_suppkey") % 5 == 0, shown(F.col("l_quantity").cast("int") * 1100)).alias("points"), (F.col("l_linenumber") * 25).alias("distance_m"),
    )
    return settle(l).select("l_orderkey", "l_linenumber", *[times.time_ms(F.col(c)).alias(n) for c, n in (("seed", "seed_ms"), ("final", "time_ms"), ("points", "points_ms"))])


@query("""SELECT l_orderkey, l_linenumber::INTEGER AS l_linenumber, CASE WHEN l_suppkey % 4 = 0 THEN l_quantity::BIGINT ELSE (l_partkey % 3000 + 1000)::BIGINT * 10 END AS result_time_ms,
CASE WHEN l_suppkey % 3 <> 0 THEN l_linenumber::VARCHAR END AS rank_position, CASE WHEN l_returnflag = 'A' THEN 'dsq' ELSE 'valid' END AS status FROM lineitem""", star=False)
def normal_result_rows(s: Star) -> DataFrame:
    """Milliseconds derived only where none are given, exhibitions out of rank, statuses in their catalogue."""
    ms = (F.col("l_partkey") % 3000 + 1000) * 10
    rows = s.raw("lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_linenumber").cast("string").alias("rank_position"), F.lit(None).cast("string").alias("seed_time_text"), F.lit("").alias("seed_time_ms"),
        F.concat(F.when(F.col("l_suppkey") % 3 == 0, "X").otherwise(""), times.format_ms(ms)).alias("result_time_text"), F.when(F.col("l_suppkey") % 4 == 0, F.col("l_quantity").cast("long").cast("string")).otherwise(" ").alias("result_time_ms"),
        F.lit("7,5").alias("points"), F.when(F.col("l_returnflag") == "A", " DSQ ").alias("status"),
    )
    return normal_results(rows).select("l_orderkey", "l_linenumber", "result_time_ms", "rank_position", "status")


@query("""SELECT o_orderkey AS document, count(*)::BIGINT AS n_members, max(l_linenumber)::INTEGER AS last_leg, (o_custkey % 60 + 60)::BIGINT * 1000 AS time_ms, string_agg('Name' || l_suppkey || ' Of Line', '|' ORDER BY l_linenumber) AS names
FROM orders JOIN (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL) ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey""", star=False)
def relay_swimmers_over_lines(s: Star) -> DataFrame:
    """Relay teams printed one an order, a swimmer to a line and every name broken in two; read back whole."""
    orders, items = s.raw("orders"), s.raw("lineitem").where("l_linenumber <= 4")
    # the team is printed first, without a leg; dealt out by document before anything is printed, the texts need no other shuffle
    o = orders.select(F.col("o_orderkey").alias("document"), F.lit(None).cast("long").alias("leg"), F.col("o_custkey").alias("n"))
    both = o.unionByName(items.select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").cast("long").alias("leg"), F.col("l_suppkey").alias("n")))
    dealt = core.dealt(both, orders.count() + 2 * items.count(), "document").groupBy("document", "leg").agg(F.min("n").alias("n"))
    leg, name = F.col("leg"), F.translate(F.col("n").cast("string"), "0123456789", "abcdefghij")
    line = lambda number, *raw: F.struct(number.alias("line_number"), F.concat(*raw).alias("raw_line"))
    team = line(F.lit(1).cast("long"), F.lit("1 Club Uno A NT "), times.format_ms((F.col("n") % 60 + 60) * 1000))
    broken = F.array(line(2 * leg, leg.cast("string"), F.lit(") Nom")), line(2 * leg + 1, name, F.lit(" W35")))
    found = relay_teams(dealt.select("document", F.inline(F.when(leg.isNull(), F.array(team)).otherwise(broken))))
    # exploded, as a filter would read the swimmers twice
    read = found.select("document", "time_ms", F.explode(F.filter(F.array("members"), lambda m: F.size(m) > 0)).alias("members"))
    digits = lambda n: F.translate(F.regexp_replace(n, "^Nom ", ""), "abcdefghij", "0123456789")
    joined = F.array_join(F.transform(F.sort_array("members"), lambda m: F.concat(F.lit("Name"), digits(m["name"]), F.lit(" Of Line"))), "|")
    return read.select("document", F.size("members").cast("long").alias("n_members"), F.array_max(F.col("members.leg")).alias("last_leg"), "time_ms", joined.alias("names"))


@query("""SELECT o_orderkey AS document, 'Meet ' || o_orderkey AS name, o_orderdate::DATE AS start_date, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE + 2 ELSE o_orderdate::DATE END AS end_date, year(o_orderdate)::INTEGER AS year FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 'Other', DATE '1990-01-01', DATE '1990-01-01', 1990 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 > 0""", star=False)
def meet_headers(s: Star) -> DataFrame:
    """Names and dates of meets from the first line that has them; documents with no such line have none."""
    day, last = F.date_format("o_orderdate", "d-M-yyyy"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 2), "d/M/yyyy")
    head = F.concat(F.lit("Meet "), F.col("o_orderkey").cast("string"), F.lit(" - "), day, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" a "), last)).otherwise(""))
    o = s.raw("orders").withColumn("x", F.explode(F.array(F.struct(F.lit(1).alias("line_number"), F.lit("Results").alias("raw_line")), F.struct(F.lit(2).alias("line_number"), F.when(F.col("o_orderkey") % 5 != 0, head).alias("raw_line")), F.struct(F.lit(3).alias("line_number"), F.when((F.col("o_orderkey") % 5 != 0) | (F.col("o_orderkey") % 3 > 0), "Other - 1/1/1990").otherwise("Other").alias("raw_line")))))
    return meet_header(o.select(F.col("o_orderkey").alias("document"), "x.line_number", "x.raw_line"))


@query("""SELECT club_name, athlete_name, gender, birth_year FROM (SELECT club_name, athlete_name, athlete_gender AS gender, birth_year, row_number() OVER (PARTITION BY athlete_id, club_id ORDER BY competition_id, rank_position, event_id, time_ms) AS n
FROM result JOIN athlete USING (athlete_id) JOIN club USING (club_id)) WHERE n = 1""")
def athlete_frame(s: Star) -> DataFrame:
    """The athletes of all result rows, each with a club once, as first seen."""
    rows = s.result.join(s.athlete, "athlete_id").join(s.club.select("club_id", "club_name"), "club_id").withColumn("gender", F.col("athlete_gender")).withColumn("event_name", F.col("event_id").cast("string"))
    return frames(rows, ["competition_id", "rank_position", "event_id", "time_ms"])["athlete"].select("club_name", "athlete_name", "gender", "birth_year")


@query("""SELECT user_id AS document, CASE WHEN bool_or(event_type = 'purchase') THEN 'LC' WHEN bool_or(event_type = 'signup') THEN 'SC' END AS course FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 20 GROUP BY 1""", star=False)
def course_inference(s: Star) -> DataFrame:
    """The course that a document's first event names tell."""
    kind = F.when(F.col("event_type") == "purchase", "100 LC Meter").when(F.col("event_type") == "signup", "50 sc Meter").otherwise("LCX 50 Meter")
    return course_of(s.raw("events").select(F.col("user_id").alias("document"), F.col("event_id").alias("line_number"), kind.alias("event_name")))


def staged_relays(teams: DataFrame, swimmers: DataFrame, clubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed relay teams and swimmers as staging rows: (relay results, relay members).

    A team without a club has the one with the longest name that its own begins with. A swimmer belongs to the last team of
    that event and name on the page at or above their line, else to the document's last one of that event and name.
    """
    from lanewise.plans.curation import longest_prefix_club

    keys = {"_e": text.match_key(F.col("event_name")), "_t": text.match_key(F.col("team"))}
    names = teams.select("team").union(swimmers.select("team")).distinct()
    inferred = longest_prefix_club(names, clubs).withColumnRenamed("club_name", "_club")
    results = teams.join(inferred, "team", "left").withColumn("club_name", F.coalesce("club_name", "_club"))
    marked = results.withColumns(keys).withColumn("_mark", F.struct("club_name", "rank_position", "result_time_ms"))
    last = marked.groupBy("_e", "_t").agg(F.max_by("_mark", "position").alias("_last"))
    placed = core.as_of(swimmers.withColumns(keys), marked.withColumn("_of", F.col("_mark")).select("_e", "_t", "page_number", "line_number", "_of"), ["_e", "_t", "page_number"], ["line_number"], "_of")
    joined = placed.join(last, ["_e", "_t"], "left").join(inferred, "team", "left").withColumn("_m", F.coalesce("_of", "_last"))
    members = joined.select(*swimmers.columns, F.coalesce("_m.club_name", "_club").alias("club_name"), F.col("_m.rank_position").alias("relay_rank_position"), F.col("_m.result_time_ms").alias("relay_result_time_ms"))
    return results.select(*teams.columns), members


@query(""", t AS (SELECT team AS e, athlete_id % 4 AS k, athlete_id % 3 AS page, observation_id AS line, (time_ms % 10)::INTEGER AS rank FROM relay WHERE leg_order = 1)
SELECT observation_id, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.e = r.team AND t.k = r.athlete_id % 4) OR r.athlete_id % 4 < 3 THEN 'Uno' END AS club_name,
coalesce((SELECT arg_max(rank, line) FROM t WHERE t.e = r.team AND t.k = r.athlete_id % 4 AND t.page = r.athlete_id % 3 AND t.line <= r.observation_id), (SELECT arg_max(rank, line) FROM t WHERE t.e = r.team AND t.k = r.athlete_id % 4)) AS rank
FROM relay r WHERE leg_order > 1""")
def staged_relay_members(s: Star) -> DataFrame:
    """Relay members with their team's club and rank, found by page and line."""
    shaped = s.relay.select("observation_id", "leg_order", F.col("team").alias("event_name"), F.concat(F.lit("Uno "), (F.col("athlete_id") % 4).cast("string")).alias("team"), (F.col("athlete_id") % 3).alias("page_number"), F.col("observation_id").alias("line_number"),
        F.lit(None).cast("string").alias("club_name"), (F.col("time_ms") % 10).cast("int").alias("rank_position"), F.col("time_ms").alias("result_time_ms"), F.col("observation_id").alias("position"))
    clubs = s.raw("region").limit(1).select(F.lit("Uno").alias("club_name"))
    _, members = staged_relays(shaped.where("leg_order = 1").drop("leg_order", "observation_id"), shaped.where("leg_order > 1").select("observation_id", "event_name", "team", "page_number", "line_number"), clubs)
    return members.select("observation_id", "club_name", F.col("relay_rank_position").alias("rank"))
