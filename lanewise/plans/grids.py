"""Grids: workbook sheets given as rows of cells, word boxes of a page, tables in pages, and combined events.

A sheet or page is a small group by nature (one person's form, one printed page), so the sequential parts run as grouped
functions, one sheet or page at a time; everything around them is columns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.functions import domain, text, times
from lanewise.operators import core
from lanewise.plans.star import STAR_SQL, Star

QUERIES: dict = {}
ORACLES: dict = {}

ROW_GAP = 2.0
# Headers of the form layout, with folded letters.
FORM_HEADERS = {
    "first_name": "primer nombre", "paternal": "apellido paterno", "maternal": "apellido materno", "id_number": "rut", "birth_date": "fecha de nacimiento", "gender": "genero",
    "breaststroke": "50 pecho", "backstroke": "50 espalda", "butterfly": "50 mariposa", "freestyle": "50 crol",
}
STROKE_WORDS = {"espalda": "backstroke", "pecho": "breaststroke", "mariposa": "butterfly", "crol": "freestyle", "libre": "freestyle"}
GENDER_WORDS = {"dama": "female", "mujer": "female", "female": "female", "varon": "male", "hombre": "male", "male": "male"}
QUAD_STROKES = ("butterfly", "backstroke", "breaststroke", "freestyle")


def query(sql: str | None = None, star: bool = True):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (STAR_SQL if star else "") + sql
        return f

    return add


def word_rows(words: DataFrame, page: list[str]) -> DataFrame:
    """words (page keys, text, x0, top) with `line`: a word starts a new line where its top lies more than ROW_GAP from
    that of its line's first word, which depends on the line so far."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["top", "x0"], kind="stable")
        line, first, lines = -1, None, []
        for top in part["top"]:
            if first is None or abs(first - top) > ROW_GAP:
                line, first = line + 1, top
            lines.append(line)
        return part.assign(line=lines)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.groupBy(*page).applyInPandas(run, f"{kinds}, line int")


def between(words: DataFrame, keys: list[str], left: float, right: float, into: str) -> DataFrame:
    """Text of the words of each line whose left edge lies in [left, right)."""
    inside = words.where((F.col("x0") >= left) & (F.col("x0") < right))
    return inside.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias(into))


def _folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), text.MATCH_FROM, text.MATCH_TO), r"\s+", " "))


def _gender_in(c: Column) -> Column:
    """The gender of the first of GENDER_WORDS that a folded text holds; "male" only where no letter comes before it."""
    hits = [F.when(c.rlike(rf"(?<![a-z]){w}") if w == "male" else F.contains(c, F.lit(w)), g) for w, g in GENDER_WORDS.items()]
    return F.coalesce(*hits)


def _last_place(cells: Column, test) -> Column:
    """The place, from 0, of the last cell that passes."""
    return F.array_max(F.filter(F.transform(cells, lambda v, k: F.when(test(v), k)), lambda k: k.isNotNull()))


def _first_place(cells: Column, test) -> Column:
    return F.array_min(F.filter(F.transform(cells, lambda v, k: F.when(test(v), k)), lambda k: k.isNotNull()))


ENTRY_FIELDS = ("first_name", "paternal", "maternal", "id_number", "birth_date", "gender", *sorted(set(STROKE_WORDS.values())))
_PLACES = "struct<" + ", ".join(f"{f}: int" for f in ENTRY_FIELDS) + ">"


def raw_entries(grid: DataFrame) -> DataFrame:
    """(sheet, row, ENTRY_FIELDS as text) of the people in sheets given as (sheet, row, cells).

    Each row looks up where its fields stand in the header above it: a form's is its first row, a block's the last row of
    block headers so far, carried down the sheet. A block's gender is in the sheet's name or the three rows below its
    header, its strokes are above the header, in up to four rows. Blocks of no gender have no people.
    """
    sheet = Window.partitionBy("sheet").orderBy("at")
    rows = grid.select("sheet", F.row_number().over(Window.partitionBy("sheet").orderBy("row")).alias("at"), "cells", F.transform("cells", _folded).alias("names"))
    is_ = lambda text_: lambda v: v == text_
    form_places = [_last_place(F.col("names"), is_(FORM_HEADERS[f])).alias(f) for f in ENTRY_FIELDS]
    is_form = (F.col("at") == 1) & F.forall(F.array(*[F.lit(FORM_HEADERS[f]) for f in ("first_name", "paternal", "birth_date", "gender")]), lambda h: F.array_contains("names", h))
    born = lambda v: F.contains(v, F.lit("nacimiento"))
    is_block = F.array_contains("names", "nombre") & F.array_contains("names", "rut") & F.exists("names", born)
    surname = lambda which: lambda v: F.contains(v, F.lit("apellido")) & F.contains(v, F.lit(which))
    block_places = {"first_name": is_("nombre"), "id_number": is_("rut"), "paternal": surname("paterno"), "maternal": surname("materno"), "birth_date": born}
    above, below = sheet.rowsBetween(-4, -1), sheet.rowsBetween(1, 3)
    for stroke in sorted(set(STROKE_WORDS.values())):
        words = [w for w, of in STROKE_WORDS.items() if of == stroke]
        own = _last_place(F.col("names"), lambda v, words=words: F.contains(v, F.lit("50")) & v.rlike("|".join(words)))
        rows = rows.withColumn(f"_own_{stroke}", own).withColumn(f"_{stroke}", F.last(f"_own_{stroke}", ignorenulls=True).over(above))
    placed = {f: _first_place(F.col("names"), t) for f, t in block_places.items()} | {s: F.col(f"_{s}") for s in set(STROKE_WORDS.values())}
    block_struct = F.struct(*[(placed[f] if f in placed else F.lit(None)).cast("int").alias(f) for f in ENTRY_FIELDS])
    rows = rows.withColumn("_said", _gender_in(_folded(F.array_join(F.col("cells"), " ", ""))))
    rows = rows.withColumn("_sex", F.coalesce(_gender_in(_folded(F.col("sheet"))), F.first("_said", ignorenulls=True).over(below)))
    head = F.when(is_form, F.struct(F.lit("form").alias("kind"), F.lit(None).cast("string").alias("sex"), F.struct(*[p.cast("int").alias(f) for p, f in zip(form_places, ENTRY_FIELDS)]).cast(_PLACES).alias("places")))
    head = head.when(is_block, F.struct(F.lit("block").alias("kind"), F.col("_sex").alias("sex"), block_struct.cast(_PLACES).alias("places")))
    upto = sheet.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_head", head).withColumn("_form", F.first("_head", ignorenulls=False).over(upto)).withColumn("_last", F.last("_head", ignorenulls=True).over(upto))
    form = F.coalesce(F.col("_form.kind") == "form", F.lit(False))  # a sheet with a form's first row is a form throughout
    people = rows.withColumn("_h", F.when(form, F.col("_form")).otherwise(F.col("_last"))).where(F.when(form, F.col("at") > 1).otherwise(F.col("_head").isNull() & F.col("_h").isNotNull()))
    values = {f: F.get("cells", F.col(f"_h.places.{f}")) for f in ENTRY_FIELDS}
    values["gender"] = F.when(form, values["gender"]).otherwise(F.col("_h.sex"))
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    there = F.when(form, F.exists("cells", filled)).otherwise(F.col("_h.sex").isNotNull() & (filled(values["first_name"]) | filled(values["paternal"]) | filled(values["id_number"])))
    return people.where(there).select("sheet", F.col("at").alias("row"), *[v.alias(f) for f, v in values.items()])


def entries(grid: DataFrame, competition_year: int) -> DataFrame:
    """People of an entries workbook given as (sheet, row, cells): the form layout where a sheet has its headers, else
    blocks under repeated headers. Gender, birth date and times are read; rows without a name or a known gender go."""
    born = F.coalesce(*[F.try_to_date(F.trim("birth_date"), f) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy")])
    marks = [F.struct(F.lit(s).alias("key"), times.time_ms(F.col(s)).alias("value")) for s in sorted(set(STROKE_WORDS.values()))]
    name = F.trim(F.concat_ws(" ", "first_name", "paternal", "maternal"))
    out = raw_entries(grid).withColumn("born", born).select(
        "sheet", "row", name.alias("full_name"), text.id_number_key(F.col("id_number")).alias("id_number"), domain.athlete_gender(F.col("gender")).alias("gender"),
        F.year("born").alias("birth_year"), (F.lit(competition_year) - F.year("born")).alias("age"), F.map_from_entries(F.filter(F.array(*marks), lambda m: m["value"].isNotNull())).alias("times"),
    )
    return out.where((F.col("full_name") != "") & F.col("gender").isin("female", "male"))


def competition_table(pages: DataFrame) -> DataFrame:
    """(competition_id, title, start_text, end_text, place, href) of table rows whose link names an id; the first of each."""
    row = r'(?is)<tr>\s*<td>\s*<a\s+href="([^"]*\bid=(\d+)[^"]*)">(.*?)</a>\s*</td>\s*<td>(.*?)</td>\s*<td>(.*?)</td>'
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(row), 0)).alias("at", "x"))
    part = lambda g: F.regexp_extract("x", row, g)
    dates = F.filter(F.transform(F.split(part(4), r"(?i)<br\s*/?>"), strip), lambda d: d != "")
    cells = rows.select("page_id", "at", part(2).cast("long").alias("competition_id"), strip(part(3)).alias("title"), F.get(dates, F.lit(0)).alias("start_text"), F.coalesce(F.get(dates, F.lit(1)), F.get(dates, F.lit(0))).alias("end_text"), strip(part(5)).alias("place"), part(1).alias("href"))
    return core.first_by(cells, ["competition_id"], F.asc("page_id"), F.asc("at")).drop("page_id", "at")


# What a detail page prints before and behind a competition's title.
TITLE_AFTER, TITLE_BEFORE, TITLE_LENGTH = "campeonato info", "lugar:", 180


def competition_details(pages: DataFrame, key: str = "competition_id", html: str = "html") -> DataFrame:
    """(key, title, start_date, end_date) of detail pages. The title is what the last TITLE_AFTER and a TITLE_BEFORE behind it enclose,
    else the first heading that isn't that label, else made of the key. Dates are the first two in ISO form, or else in the form
    d/m/Y; one date is both."""
    single = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rows = pages.select(key, F.col(html).alias("_html"), single(F.regexp_replace(html, r"(?s)<[^>]*>", " ")).alias("_text"))
    parts = F.split("_text", f"(?i){TITLE_AFTER}")
    upto = lambda t: F.instr(F.lower(t), TITLE_BEFORE)
    titles = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda t: F.trim(F.left(t, F.greatest(upto(t) - 1, F.lit(0)))))
    own = F.filter(titles, lambda t: F.length(t).between(1, TITLE_LENGTH))
    heads = F.transform(F.regexp_extract_all("_html", F.lit(r"(?is)<h([1-4])[^>]*>(.*?)</h\1>"), 2), lambda h: single(F.regexp_replace(h, r"(?s)<[^>]*>", " ")))
    heading = F.get(F.filter(heads, lambda h: (h != "") & ~F.startswith(F.lower(h), F.lit(TITLE_AFTER))), F.lit(0))
    iso = F.regexp_extract_all("_text", F.lit(r"\b(20\d{2}-\d{2}-\d{2})\b"), 1)
    slashed = F.transform(F.regexp_extract_all("_text", F.lit(r"\b(\d{2}/\d{2}/20\d{2})\b"), 1), lambda d: F.concat_ws("-", F.right(d, F.lit(4)), F.substring(d, F.lit(4), F.lit(2)), F.left(d, F.lit(2))))
    dated = rows.select(key, F.coalesce(F.try_element_at(own, F.lit(-1)), heading, F.concat(F.lit("competition-"), F.col(key).cast("string"))).alias("title"), F.when(F.size(iso) > 0, iso).otherwise(slashed).alias("_d"))
    return dated.select(key, "title", F.get("_d", F.lit(0)).alias("start_date"), F.coalesce(F.get("_d", F.lit(1)), F.get("_d", F.lit(0))).alias("end_date"))


def combined_results(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    """A combined event's line `[rank] name [age] club [total] t1 t2 t3 t4` as four rows, one a stroke; `-` has none."""
    time = r"X?(?:\d{1,3}[:']\d{2}(?:[.,']\d{1,2})?|\d{1,3}[.,']\d{1,2}|NT|NS|DNS|DNF|DQ|DSQ|DFS)|-"
    shape = rf"(?i)^(?:(\d+)\s+)?(.+?)\s+(?:(\d{{1,3}})\s+)?(\S+)\s+(?:({time})\s+)?({time})\s+({time})\s+({time})\s+({time})$"
    part = lambda g: F.regexp_extract(F.trim(F.col(line)), shape, g)
    legs = F.array(*[F.struct(F.lit(k + 1).alias("leg"), F.lit(s).alias("stroke"), part(6 + k).alias("raw")) for k, s in enumerate(QUAD_STROKES)])
    rows = lines.where(F.trim(F.col(line)).rlike(shape)).select(*lines.columns, part(1).try_cast("int").alias("rank"), part(2).alias("name"), part(3).try_cast("int").alias("age"), part(4).alias("club"), F.explode(legs).alias("l"))
    ms = times.time_ms(F.col("l.raw"))
    return rows.where("l.raw <> '-'").select(*lines.columns, "rank", "name", "age", "club", "l.leg", "l.stroke", ms.alias("time_ms"), F.when(ms.isNotNull(), "valid").otherwise(domain.status(F.lit(None).cast("string"), F.col("l.raw"))).alias("status"))


def matching(rows: DataFrame, token: str, title: str, own: list[str]) -> DataFrame:
    """Rows of groups that hold the token: where the group's title does, all its rows, else the rows that do. Each row
    carries its group's title, so nothing is gathered to be searched."""
    hit = lambda c: F.coalesce(F.contains(text.search_fold(F.col(c)), F.lit(token)), F.lit(False))
    found = hit(title)
    for c in own:
        found = found | hit(c)
    return rows.where(found)


# --- registered forms


@query("""SELECT user_id, event_type AS state, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""", star=False)
def latest_artifact(s: Star) -> DataFrame:
    """The latest event of each record in one aggregate."""
    last = F.max_by(F.struct(F.col("event_type").alias("state"), "event_id"), F.struct("ts", "event_id"))
    return s.raw("events").groupBy("user_id").agg(last.alias("x")).select("user_id", "x.state", "x.event_id")


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'error') AND count(*) FILTER (WHERE event_type = 'error') * 4 > count(*) THEN 'failed' WHEN bool_or(event_type = 'purchase') THEN 'loaded' WHEN bool_or(event_type = 'signup') THEN 'validated' ELSE 'downloaded' END AS category, count(*)::BIGINT AS n
FROM events GROUP BY 1""", star=False)
def artifact_categories(s: Star) -> DataFrame:
    """The category of each record from the kinds of its events."""
    t, n = F.col("event_type"), lambda k: F.count_if(F.col("event_type") == k)
    category = F.when(n("error") * 4 > F.count("*"), "failed").when(F.bool_or(t == "purchase"), "loaded").when(F.bool_or(t == "signup"), "validated").otherwise("downloaded")
    return s.raw("events").groupBy("user_id").agg(category.alias("category"), F.count("*").alias("n"))


@query("""SELECT rule, count(*)::BIGINT AS violations FROM (SELECT 'order without customer' AS rule FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'quantity' FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 45 UNION ALL SELECT 'repeated line key' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'name shape' FROM supplier WHERE NOT regexp_full_match(s_name, 'Supplier#[0-9]*[02468]')) GROUP BY 1""", star=False)
def constraint_violations(s: Star) -> DataFrame:
    """Foreign keys, checks and unique keys as counts of what breaks them."""
    broken = {
        "order without customer": s.raw("orders").join(s.raw("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "quantity": s.raw("lineitem").where(~F.col("l_quantity").between(1, 45)),
        "repeated line key": s.raw("lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "name shape": s.raw("supplier").where(~F.col("s_name").rlike("^Supplier#[0-9]*[02468]$")),
    }
    out = None
    for rule, rows in broken.items():
        one = rows.select(F.lit(rule).alias("rule"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("rule").agg(F.count("*").alias("violations"))


@query("""SELECT signature, n_names, names FROM (SELECT left(t, 1) || regexp_replace(substr(t, 2, greatest(length(t) - 2, 0)), '[aeiou]', '', 'g') || CASE WHEN length(t) > 1 THEN right(t, 1) ELSE '' END AS signature, count(DISTINCT t)::BIGINT AS n_names, string_agg(DISTINCT t, ' | ' ORDER BY t) AS names
FROM (SELECT unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) AS t FROM benchmark) WHERE t <> '' GROUP BY 1) WHERE n_names > 1""", star=False)
def signature_groups(s: Star) -> DataFrame:
    """Words that share a signature, for review."""
    words = s.raw("benchmark").select(F.explode(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " ")).alias("t")).where("t <> ''").distinct()
    groups = words.groupBy(text.signature(F.col("t")).alias("signature")).agg(F.count("*").alias("n_names"), F.array_join(F.array_sort(F.collect_list("t")), " | ").alias("names"))
    return groups.where("n_names > 1")


@query("""SELECT competition_id, scope, count(*)::BIGINT AS n FROM result JOIN event USING (event_id) WHERE contains(lower(scope), 'low') OR contains(lower(event_name), 'low') GROUP BY ALL""")
def nested_search(s: Star) -> DataFrame:
    """Search in nested results: a title that matches keeps all its rows, else the rows that match stay."""
    found = matching(s.result.join(s.event, "event_id"), "low", "scope", ["event_name"])
    return found.groupBy("competition_id", "scope").agg(F.count("*").alias("n"))


@query("""SELECT season, month, count(*)::BIGINT AS n, string_agg(competition_id::VARCHAR, ',' ORDER BY start_date, competition_id) AS ids FROM (SELECT *, year(start_date)::INTEGER AS season, month(start_date)::INTEGER AS month FROM competition WHERE start_date IS NOT NULL) GROUP BY ALL""")
def competitions_by_month(s: Star) -> DataFrame:
    rows = s.competition.where("start_date IS NOT NULL").select(F.year("start_date").alias("season"), F.month("start_date").alias("month"), "start_date", "competition_id")
    listed = F.array_sort(F.collect_list(F.struct("start_date", "competition_id")))
    return rows.groupBy("season", "month").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda c: c["competition_id"].cast("string")), ",").alias("ids"))


@query("""SELECT event_age_group, first_number, n, row_number() OVER (ORDER BY first_number, event_age_group)::INTEGER AS place FROM (SELECT event_age_group, coalesce(try_cast(nullif(regexp_extract(event_age_group, '[0-9]+'), '') AS INTEGER), 0) AS first_number, count(DISTINCT (distance_m, stroke, event_gender))::BIGINT AS n FROM event GROUP BY ALL)""")
def category_order(s: Star) -> DataFrame:
    """Age categories by the first number in their label, with their distinct events."""
    first = F.coalesce(F.regexp_extract("event_age_group", "[0-9]+", 0).try_cast("int"), F.lit(0))
    groups = s.event.groupBy("event_age_group", first.alias("first_number")).agg(F.countDistinct(F.struct("distance_m", "stroke", "event_gender")).alias("n"))
    return groups.withColumn("place", F.row_number().over(Window.orderBy("first_number", "event_age_group")))


@query("""SELECT o_orderkey AS competition_id, CASE WHEN o_orderkey % 7 = 0 THEN 'competition-' || o_orderkey WHEN o_orderkey % 5 = 0 THEN 'Copa ' || o_orderkey ELSE 'Meet & ' || o_orderkey END AS title,
strftime(o_orderdate::DATE, '20%y-%m-%d') AS start_date, strftime(o_orderdate::DATE + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END, '20%y-%m-%d') AS end_date FROM orders""", star=False)
def detail_pages(s: Star) -> DataFrame:
    """Titles and dates of printed detail pages: titles between labels, in a heading or in neither; dates in two forms, one or two of them."""
    k, o = F.col("o_orderkey"), s.raw("orders")
    n, d = k.cast("string"), F.col("o_orderdate").cast("date")
    last = F.date_add(d, 2)
    form = lambda day: F.when(k % 2 == 0, F.concat(F.lit("20"), F.date_format(day, "yy-MM-dd"))).otherwise(F.concat(F.date_format(day, "dd/MM/"), F.lit("20"), F.date_format(day, "yy")))
    head = F.when(k % 7 == 0, F.lit("<h2> Campeonato Info</h2><p>nothing</p>")).when(k % 5 == 0, F.concat(F.lit("<h1>campeonato info</h1><h3>Copa <b>"), n, F.lit("</b></h3>")))
    head = F.coalesce(head, F.concat(F.lit("<h1>Other</h1><div>Campeonato Info</div> Campeonato  Info <b>Meet &"), F.lit(" </b>\n"), n, F.lit("<p>Lugar: x</p>")))
    days = F.concat(F.lit("<td>"), form(d), F.when(k % 3 != 0, F.concat(F.lit("</td><td>"), form(last))).otherwise(""), F.lit("</td>"))
    return competition_details(o.select(k.alias("competition_id"), F.concat(head, days).alias("html")))


#: The order in which a review goes through same-name groups; other classes come last.
REVIEW_ORDER = ("adjacent_years", "one_club", "same_year", "homonyms")


def by_class(rows: DataFrame, column: str, order: tuple[str, ...], *then: Column, into: str = "place") -> DataFrame:
    """rows with their place in a custom order of classes; classes that it doesn't name come last, alike."""
    at = F.array_position(F.array(*map(F.lit, order)), F.coalesce(column, F.lit("")))
    return core.global_rank(rows, F.when(at > 0, at).otherwise(len(order) + 1), *then, into=into)


@query("""SELECT name_key, class, n, row_number() OVER (ORDER BY CASE class WHEN 'adjacent_years' THEN 1 WHEN 'one_club' THEN 2 WHEN 'same_year' THEN 3 WHEN 'homonyms' THEN 4 ELSE 5 END, n DESC, name_key)::BIGINT AS place FROM (
SELECT name_key, n, CASE WHEN years = 1 THEN 'same_year' WHEN gap <= 1 THEN 'adjacent_years' WHEN clubs = 1 THEN 'one_club' ELSE 'homonyms' END AS class FROM (
SELECT event_name || ' ' || event_age_group AS name_key, count(*)::BIGINT AS n, count(DISTINCT distance_m)::BIGINT AS years, (max(distance_m) - min(distance_m)) / 25 AS gap, count(DISTINCT event_gender)::BIGINT AS clubs FROM event GROUP BY 1 HAVING count(*) > 1))""")
def same_name_review(s: Star) -> DataFrame:
    """Same-name groups in the order of a review: by class, then the larger ones first."""
    g = s.event.groupBy(F.concat_ws(" ", "event_name", "event_age_group").alias("name_key")).agg(
        F.count("*").alias("n"), F.countDistinct("distance_m").alias("years"), ((F.max("distance_m") - F.min("distance_m")) / 25).alias("gap"), F.countDistinct("event_gender").alias("clubs")
    )
    kind = F.when(F.col("years") == 1, "same_year").when(F.col("gap") <= 1, "adjacent_years").when(F.col("clubs") == 1, "one_club").otherwise("homonyms")
    ranked = by_class(g.where("n > 1").withColumn("class", kind), "class", REVIEW_ORDER, F.desc("n"), F.asc("name_key"))
    return ranked.select("name_key", "class", "n", F.col("place").cast("long").alias("place"))


def alias_evidence(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Variants of one canonical club that are seen with the same person: (canonical, a, b, n_people)."""
    seen = names.join(aliases, "club_name").select("canonical_name", "club_name", "athlete_name").distinct()
    a, b = seen.withColumnRenamed("club_name", "a"), seen.withColumnRenamed("club_name", "b")
    return a.join(b, ["canonical_name", "athlete_name"]).where("a < b").groupBy("canonical_name", "a", "b").agg(F.countDistinct("athlete_name").alias("n_people"))


def page_url(base: str, page: int) -> str:
    """The address of a listing's page; the first is the base itself."""
    return base if page == 1 else f"{base.rstrip('/')}/page/{page}/"


def local_hint(c: Column, local: list[str], foreign: list[str]) -> Column:
    """foreign, local or unknown by the words a text holds; foreign words win."""
    has = lambda words: F.lower(c).rlike("|".join(map(re.escape, words)))
    return F.when(has(foreign), "foreign").when(has(local), "local").otherwise("unknown")
