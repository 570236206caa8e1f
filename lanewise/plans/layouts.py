"""Layouts of printed pages, read from word boxes (document, page_number, top, x0, x1, text).

Two readers. Pages in columns: gutters are found by a sweep over a document's horizontal coverage and the text is put into
reading order, whatever the number of columns. Pages set by coordinates: the bands of a table's columns are learned from the
words of its head, for each page anew, and words are put into the band that holds them. The first is windows and joins, the second
windows and groupings by document, so that boxes dealt out by document are never shuffled or stored; a page, or the few hundred
places of a document's sweep, is the largest group that is ever held or ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lanewise.functions import domain, text, times
from lanewise.operators import core
from lanewise.plans.reports import WATERMARK, event_context, layout_of, layout_signs, layouts
from lanewise.plans.star import STAR_SQL, Star

QUERIES: dict = {}
ORACLES: dict = {}

#: A word starts a new line where its top lies more than this below that of its line's first word.
ROW_GAP = 2.0
#: Least width of a gutter, places of the sweep a point, share of a document's lines that may cross a gutter (at least one),
#: and how far behind a gutter an event's header may begin.
GUTTER, GRAIN, CROSSING, INDENT = 6.0, 2, 0.25, 15.0
PAGE = ["document", "page_number"]
# What an event's header begins with, heads of the columns set by coordinates, their bands where a page has no
# heads, and rank marks.
OPENERS = r"(?i)^\(?(?:#\d+|Evento?|E)$"
HEADS = {"athlete": ("atleta", "nome", "nombre"), "club": ("clube", "club", "entidade"), "time": ("tempo", "tiempo"), "points": ("pontos", "puntos", "pts")}
BANDS = {"athlete": (120.0, 316.0), "club": (316.0, 412.0), "time": (412.0, 450.0), "points": (450.0, 472.0)}
RANK_MARK = r"(?i)^(?:\d+[º°]|---|N/C)$"
ATTACHED = r"^(.+?)(\d{1,2}:\d{2}(?:[.,]\d+)?|\d{1,3}[.,]\d{2})$"
#: How far left of its head a column's text may begin, the width of the last column, and the cells of the interval join.
SLACK, LAST_WIDTH, CELL = 2.0, 22.0, 16.0


def query(sql: str | None = None, star: bool = True):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (STAR_SQL if star else "") + sql
        return f

    return add


def visual_rows(boxes: DataFrame) -> DataFrame:
    """boxes with `line`, from 0 on each page. Which top starts a line depends on the line before, so a page's different tops are
    folded in order and each gets its line; boxes look up their top's while a page is one row, so no join is needed."""
    rows = boxes.withColumn("top", F.col("top").cast("double")).where(core.all_of(*[F.col(k).isNotNull() for k in PAGE]))
    own = [c for c in rows.columns if c not in PAGE]
    pages = rows.groupBy(*PAGE).agg(F.collect_list(F.struct(*own)).alias("_boxes"), F.array_sort(F.collect_set("top")).alias("_tops"))
    state = lambda top, n, lines: F.struct(top.alias("top"), n.alias("n"), F.concat(lines, F.array(n)).alias("lines"))
    none = F.struct(F.lit(None).cast("double").alias("top"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("lines"))
    fold = F.aggregate("_tops", none, lambda s, t: F.when(s["top"].isNull() | (t - s["top"] > ROW_GAP), state(t, s["n"] + 1, s["lines"])).otherwise(state(s["top"], s["n"], s["lines"])), lambda s: s["lines"])
    placed = pages.withColumn("_lines", fold).select(*PAGE, "_tops", "_lines", F.inline("_boxes"))
    return placed.withColumn("line", F.coalesce(F.try_element_at("_lines", F.array_position("_tops", F.col("top")).cast("int")), F.lit(-1))).select(*rows.columns, "line")


def in_order(words: Column) -> Column:
    """The texts of words (x0, text) from left to right."""
    return F.array_join(F.sort_array(words)["text"], " ")


def phrases(rows: DataFrame) -> DataFrame:
    """(page, line, x0, x1) of the runs of words of a line that no gap as wide as a gutter parts."""
    along = Window.partitionBy(*PAGE, "line").orderBy("x0", "x1")
    reach = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.select(*PAGE, "line", "x0", "x1", F.when(F.col("x0") - reach < GUTTER, 0).otherwise(1).alias("new"))
    runs = new.withColumn("run", F.sum("new").over(along))
    return runs.groupBy(*PAGE, "line", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def _islands(rows: DataFrame, keys: list[str], keep: str, into: str) -> DataFrame:
    """The rows that `keep` holds for, numbered by the run of neighbours that they are in."""
    run = F.sum(F.when(F.col(keep), 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy("at"))
    return rows.withColumn(into, run).where(keep)


def gutters(rows: DataFrame) -> DataFrame:
    """(document, gutters): the columns' gutters, (left, right) from left to right, of rows with `line`.

    A sweep over the places where phrases begin and end gives how many lines cover each stretch. Stretches that few lines
    cover, titles for instance, hold a gutter where the least lines leave one and an event's header begins right behind: gaps between
    the fields of one column have no header behind them.
    """
    place = lambda c: F.round(F.col(c) * GRAIN).cast("long")
    edges = phrases(rows).select("document", F.explode(F.array(F.struct(place("x0").alias("at"), F.lit(1).alias("step")), F.struct(place("x1").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = edges.groupBy("document", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    n_lines = rows.select(*PAGE, "line").distinct().groupBy("document").agg(F.greatest(F.lit(1), F.floor(F.count("*") * CROSSING)).alias("few"))
    order = Window.partitionBy("document").orderBy("at")
    swept = steps.join(n_lines, "document").withColumn("cover", F.sum("step").over(order)).withColumn("to", F.lead("at").over(order))
    low = _islands(swept.withColumn("low", F.col("to").isNotNull() & (F.col("cover") <= F.col("few"))), ["document"], "low", "run")
    levels = low.select("document", "run", F.col("cover").alias("level")).distinct()
    under = low.join(levels, ["document", "run"]).withColumn("under", F.col("cover") <= F.col("level"))
    gaps = _islands(under, ["document", "run", "level"], "under", "part").groupBy("document", "run", "level", "part").agg((F.min("at") / GRAIN).alias("left"), (F.max("to") / GRAIN).alias("right"))
    wide = gaps.where(F.col("right") - F.col("left") >= GUTTER).select("document", "level", "left", "right", (F.col("right") - 1).alias("from"), (F.col("right") + INDENT).alias("until"))
    heads = rows.where(F.col("text").rlike(OPENERS)).select("document", F.round("x0").alias("head")).distinct()
    behind = core.interval_join(heads, wide, ["document"], "head", "from", "until", CELL)
    found = core.first_by(behind, ["document", "head"], F.asc("level"), F.desc("right")).select("document", "left", "right").distinct()
    return found.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("left", "right"))).alias("gutters"))


def ordered_lines(rows: DataFrame) -> DataFrame:
    """(document, line_number, page_number, column, raw_line) of rows with `line` in reading order: page by page, column by column, row by row. A line
    across a gutter stands alone (column -1), and what is above it is read before what is below."""
    known = rows.join(gutters(rows), "document", "left").withColumn("gutters", F.coalesce("gutters", F.array().cast("array<struct<left:double,right:double>>")))
    across = F.exists("gutters", lambda g: (F.col("x0") < g["right"] - 1) & (F.col("x1") > g["left"] + 1))
    column = F.size(F.filter("gutters", lambda g: F.col("x0") >= g["left"]))
    on_line = Window.partitionBy(*PAGE, "line")
    placed = known.withColumn("spans", F.max(across).over(on_line)).withColumn("column", F.when(F.col("spans"), -1).otherwise(column))
    lines = placed.groupBy(*PAGE, "line", "column").agg(in_order(F.collect_list(F.struct("x0", "text"))).alias("raw_line"))
    zone = F.sum(F.when(F.col("column") == -1, 1).otherwise(0)).over(Window.partitionBy(*PAGE).orderBy("line"))
    order = Window.partitionBy("document").orderBy("page_number", "zone", "column", "line")
    return lines.withColumn("zone", zone).select("document", F.row_number().over(order).alias("line_number"), "page_number", "column", "raw_line")


def along() -> WindowSpec:
    """A document's lines in order; all windows over them share it, so that they are sorted once."""
    return Window.partitionBy("document").orderBy("page_number", "line")


#: A window's frame that is all of it.
ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def worded(rows: DataFrame) -> DataFrame:
    """(document, page_number, line, words: array of (x0, text), raw_line) of rows with `line`."""
    lines = rows.groupBy(*PAGE, "line").agg(F.sort_array(F.collect_list(F.struct("x0", "text"))).alias("words"))
    return lines.withColumn("raw_line", F.array_join(F.col("words.text"), " "))


def head_bands(lines: DataFrame) -> DataFrame:
    """Worded lines with a column for each name of HEADS, the (left, right) of its bands: the columns of each page by the heads in the first line that has
    those of athlete, club and time; a page without such a line has the bands of the page before, a document without any the fixed ones."""
    word = lambda w: F.lower(text.strip_accents(w["text"]))
    name = lambda w: times.let(word(w), lambda t: F.coalesce(*[F.when(t.isin(*words), k) for k, words in HEADS.items()]))
    heads = F.array_sort(F.filter(F.transform("words", lambda w: F.struct(w["x0"].alias("left"), name(w).alias("name"))), lambda h: h["name"].isNotNull()))
    # few lines hold the head of the time, so the words of the others aren't looked at
    some = F.lower(text.strip_accents(F.col("raw_line"))).rlike("|".join(HEADS["time"]))
    whole = F.forall(F.array(*map(F.lit, ("athlete", "club", "time"))), lambda k: F.exists("_heads", lambda h: h["name"] == k))

    def band(h: Column, at: Column) -> Column:
        right = F.coalesce(F.try_element_at("_heads", at + 2)["left"], h["left"] + LAST_WIDTH + SLACK) - SLACK
        return F.struct(h["name"].alias("name"), (h["left"] - SLACK).alias("left"), right.alias("right"))

    own_bands = lambda k: F.filter(F.transform("_heads", band), lambda b: b["name"] == k).alias(k)
    own = lines.withColumn("_heads", F.when(some, heads)).withColumn("_heads", F.when(F.col("_heads").isNotNull() & whole, F.struct("line", *[own_bands(k) for k in HEADS])))
    held = own.withColumn("_heads", F.min("_heads").over(Window.partitionBy(*PAGE).orderBy("line").rowsBetween(*ALL)))
    held = held.withColumn("_heads", F.last("_heads", ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0)))
    fixed = {k: F.array(F.struct(F.lit(k).alias("name"), F.lit(left).alias("left"), F.lit(right).alias("right"))) for k, (left, right) in BANDS.items()}
    fixed["points"] = F.array(F.struct(F.lit("points").alias("name"), F.lit(BANDS["points"][0]).alias("left"), F.lit(BANDS["points"][0] + LAST_WIDTH + SLACK).alias("right")))
    return held.withColumns({k: F.when(F.col("_heads").isNotNull(), F.col(f"_heads.{k}")).otherwise(fixed[k]) for k in HEADS}).drop("_heads")


def coordinate_rows(lines: DataFrame) -> DataFrame:
    """Result, team and swimmer rows of documents set by coordinates, given as worded lines: document, page_number, line, kind, event (of the header
    above), rank, name (athlete, team or swimmer), club, time_text, time_ms, status, points, leg.

    A result or team begins with a rank mark (a result with a number behind it), a swimmer of a relay with a number; swimmers
    beyond the fourth of a team are none. A time that is stuck to the club is taken off it.
    """
    line = [*PAGE, "line"]
    inside = lambda b: lambda w: (w["x0"] >= b["left"]) & (w["x0"] < b["right"])
    found = lambda k: F.when(F.size(k) == 1, F.filter("words", inside(F.col(k)[0]))).otherwise(F.filter("words", lambda w: F.exists(k, lambda b: inside(b)(w))))
    cell = lambda k: F.array_join(found(k)["text"], " ")
    word = lambda k: F.coalesce(F.try_element_at("words", F.lit(k))["text"], F.lit(""))
    whole = head_bands(lines).select(*line, F.col("raw_line").alias("raw"), F.replace(word(1), F.lit("Â"), F.lit("")).alias("mark"), word(2).alias("number"), "words", *HEADS)
    # only rows with a rank mark have more than the athlete's cell
    whole = whole.withColumn("_marked", F.col("mark").rlike(RANK_MARK))
    whole = whole.select(*line, "raw", "mark", "number", "_marked", *[(cell(k) if k == "athlete" else F.when(F.col("_marked"), cell(k))).alias(k) for k in HEADS])
    whole = core.carry_forward(whole.withColumn("_event", event_context(F.col("raw"))), ["document"], ["page_number", "line"], F.col("_event"), "event")
    relay, marked = F.coalesce(F.col("event.stroke").endswith("_relay"), F.lit(False)), F.col("_marked")
    named = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    digits = lambda c: F.col(c).rlike(r"^\d+$")
    kind = (
        F.when(F.col("event").isNull() | F.col("_event").isNotNull() | ~named("athlete"), None)
        .when(~relay & marked & digits("number") & named("club"), "result")
        .when(relay & marked & named("club"), "team")
        .when(relay & digits("mark"), "swimmer")
    )
    kinds = whole.withColumn("kind", kind)
    team = F.sum(F.when(F.col("kind") == "team", 1).when(F.col("_event").isNotNull(), 1).otherwise(0)).over(along())
    placed = kinds.withColumn("_team", team).where("kind IS NOT NULL")
    own = Window.partitionBy("document", "_team").orderBy("page_number", "line")
    legged = placed.withColumn("leg", F.when(F.col("kind") == "swimmer", F.row_number().over(own) - 1)).where("leg IS NULL OR leg BETWEEN 1 AND 4")
    # step by step, so that no expression is worked out twice
    glued = ~named("time") & F.col("club").rlike(ATTACHED)
    timed = legged.withColumn("_glued", times.normal_time(F.when(glued, F.regexp_extract("club", ATTACHED, 2))))
    timed = timed.withColumn("_stuck", times.time_ms(F.col("_glued")).isNotNull())
    timed = timed.withColumn("shown", F.when(F.col("_stuck"), F.col("_glued")).otherwise(times.normal_time(F.nullif("time", F.lit("")))))
    timed = timed.withColumn("ms", times.time_ms(F.col("shown")))
    line_up, ms = F.col("kind") != "swimmer", F.col("ms")
    return timed.select(
        *line, "kind", "event", F.when(line_up, text.number_in(F.col("mark"), r"^(\d+)")).alias("rank"), F.col("athlete").alias("name"),
        F.when(line_up, F.when(F.col("_stuck"), F.trim(F.regexp_extract("club", ATTACHED, 1))).otherwise(F.col("club"))).alias("club"), F.when(line_up, F.col("shown")).alias("time_text"), F.when(line_up, ms).alias("time_ms"),
        F.when(line_up, F.when(ms.isNotNull(), "valid").otherwise(domain.status(F.lit(None).cast("string"), F.col("shown")))).alias("status"),
        F.when(line_up, F.replace(F.nullif("points", F.lit("")), F.lit(" "), F.lit(""))).alias("points"), F.col("leg").cast("int").alias("leg"),
    )


def read_reports(boxes: DataFrame, about: int = 0) -> tuple[DataFrame, DataFrame]:
    """(lines in reading order, rows by coordinates): each document goes to the reader that its layout asks for. about: how many
    boxes there are, more or less; they are dealt out by document once, and what follows stays in these tasks."""
    rows = core.settled(visual_rows(core.dealt(boxes, about, "document")))
    kinds = layouts(worded(rows)).select("document", (F.col("layout") == "coordinates").alias("_set"))
    told = core.settled(rows.join(kinds, "document", "left"))
    return ordered_lines(told.where("NOT coalesce(_set, false)").drop("_set")), coordinate_rows(worded(told.where("_set")))


def read_coordinates(boxes: DataFrame) -> DataFrame:
    """The rows by coordinates of read_reports alone, for boxes that are dealt out by document: all steps are windows and groupings within a
    document, so boxes stay in their task and none is stored, whatever their number."""
    lines = worded(visual_rows(boxes))
    layout = layout_of({k: sign.over(along().rowsBetween(*ALL)) for k, sign in layout_signs(F.col("page_number") <= 2).items()})
    return coordinate_rows(lines.withColumn("_layout", layout).where("_layout = 'coordinates'").drop("_layout"))


# --- registered forms: pages printed from the star tables and read again


def printed(lines: DataFrame, shift: Column | None = None) -> DataFrame:
    """Boxes of lines (document, page_number, top, words: array of (x0, text)), shifted to the right: a word's width follows its length."""
    each = lines.select(*PAGE, F.col("top").cast("double").alias("top"), (F.lit(0.0) if shift is None else shift).alias("shift"), F.explode("words").alias("w"))
    x0 = F.col("w.x0").cast("double") + F.col("shift")
    return each.select(*PAGE, "top", x0.alias("x0"), (x0 + 4 * F.length("w.text")).cast("double").alias("x1"), F.col("w.text").alias("text"))


def _at(x, *texts) -> Column:
    """Words set one behind the other from x on."""
    out, x = [], F.lit(x) if isinstance(x, int) else x
    for t in texts:
        t = F.lit(t) if isinstance(t, str) else t
        out.append(F.struct(x.cast("double").alias("x0"), t.alias("text")))
        x = x + 4 * F.length(t) + 3
    return F.array(*out)


#: Documents of the printed pages: a customer's orders, 40 lines a page.
BOXES = 20  # printed for an order, about
_RANKED = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders"


def _orders(s: Star) -> DataFrame:
    orders = s.raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return core.dealt(orders, s.raw("orders").count() * BOXES, "o_custkey").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)


@query(f"""WITH o AS ({_RANKED}), r AS (SELECT *, o_custkey % 3 = 0 AS relay, n * 3 AS line FROM o),
c AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 4000 + 1500)::BIGINT * 10 END AS ms FROM r)
SELECT o_custkey AS document, o_orderkey AS number, CASE WHEN relay THEN 'team' ELSE 'result' END AS kind, o_custkey::INTEGER AS event_number, CASE WHEN o_orderkey % 11 <> 0 THEN (n + 1)::INTEGER END AS rank,
  'Nome ' || o_orderkey || ' Da Silva' AS name, 'Clube ' || o_orderpriority[3:] AS club, ms AS time_ms, CASE WHEN ms IS NULL THEN 'dns' ELSE 'valid' END AS status, (n % 9)::VARCHAR AS points, NULL::INTEGER AS leg FROM c
UNION ALL SELECT o_custkey, o_orderkey, 'swimmer', o_custkey::INTEGER, NULL, 'Atletas ' || o_orderkey || ' ' || k, NULL, NULL, NULL, NULL, k::INTEGER FROM c, range(1, 5) t(k) WHERE relay""", star=False)
def coordinate_results(s: Star) -> DataFrame:
    """Results and relays of pages set by coordinates, shifted from document to document, in bands learned from the heads."""
    o, key = _orders(s), F.col("o_orderkey")
    shift, relay = (F.col("o_custkey") % 37).cast("double"), F.col("o_custkey") % 3 == 0
    ms = F.when(key % 5 == 0, F.lit(None)).otherwise((key % 4000 + 1500) * 10)
    time, id_ = F.coalesce(times.format_ms(ms), F.lit("DNS")), key.cast("string")
    glued = (key % 7 == 0) & ms.isNotNull()
    club = F.substring("o_orderpriority", F.lit(3), F.length("o_orderpriority"))
    mark = F.when(key % 11 == 0, "---").otherwise(F.concat((F.col("n") + 1).cast("string"), F.lit("º")))
    front = F.concat(_at(60, mark), _at(90, (F.col("n") + 1).cast("string")), _at(121, "Nome", id_, "Da", "Silva"))
    row = F.when(glued, F.concat(front, _at(317, "Clube", F.concat(club, time)), _at(451, (F.col("n") % 9).cast("string")))).otherwise(
        F.concat(front, _at(317, "Clube", club), _at(413, time), _at(451, (F.col("n") % 9).cast("string")))
    )
    # each order has room for its row and five swimmers, the fifth of whom is none; a page has 40 orders. Its first order prints a page's
    # watermark, a document's first its header and heads, so orders stay where they were dealt to
    line = lambda top, words: F.struct(F.lit(top).cast("double").alias("top"), words.alias("words"))
    top = lambda k: 100 + (F.col("n") % 40) * 60 + 10 * k
    swimmer = lambda k: F.concat(_at(62, k.cast("string")), _at(121, F.when(k == 5, F.lit("Rodape")).otherwise("Atletas"), id_, k.cast("string")))
    document = F.col("o_custkey").cast("string")
    header = F.when(relay, _at(40, "Event", document, "Women", "200", "SC", "Meter", "Freestyle", "Relay", "160", "a", "199")).otherwise(_at(40, "Event", document, "Women", "35-39", "100", "LC", "Meter", "Free"))
    heads = F.concat(_at(60, "Col"), _at(120, "Atleta"), _at(316, "Clube"), _at(412, "Tempo"), _at(450, "Pontos"))
    some = lambda when, *lines: F.when(when, F.array(*lines)).otherwise(F.array().cast("array<struct<top:double,words:array<struct<x0:double,text:string>>>>"))
    five = [line(top(k), swimmer(F.lit(k))) for k in range(1, 6)]
    lines = F.concat(
        F.array(line(top(0), row)), some(relay, *five), some(F.col("n") == 0, line(20, header), line(40, heads)), some(F.col("n") % 40 == 0, line(5000, _at(500, *WATERMARK.split())))
    )
    all_ = o.withColumn("shift", shift).select(F.col("o_custkey").alias("document"), (F.expr("n div 40") + 1).alias("page_number"), "shift", F.inline(lines))
    found = read_coordinates(printed(all_, F.col("shift")))
    own = text.number_in(F.col("name"), r"^\w+ (\d+)", "long")
    return found.select("document", own.alias("number"), "kind", F.col("event.number").alias("event_number"), "rank", "name", "club", "time_ms", "status", "points", "leg")


@query(f"""WITH o AS ({_RANKED}), d AS (SELECT *, (o_custkey % 4 + 1)::INTEGER AS n_columns FROM o),
c AS (SELECT o_custkey AS document, n_columns, (n % n_columns)::INTEGER AS col, n // n_columns AS row, (n + 1) || ' Name' || o_orderkey || ' ' || (o_orderkey % 60 + 30) || ' ' || o_orderpriority[1:1] AS raw_line FROM d),
u AS (SELECT document, -1 AS zone, -1 AS col, -1 AS row, 'Resultados oficiais do campeonato nacional de natação master ' || document AS raw_line FROM (SELECT DISTINCT document FROM c)
  UNION ALL SELECT DISTINCT document, CASE WHEN row >= 4 THEN 1 ELSE 0 END, col, row, raw_line FROM c
  UNION ALL SELECT DISTINCT document, 0, col, -1, '#' || (col + 1) || ' Women 18-24 50 Meter Free' FROM c
  UNION ALL SELECT document, 1, -1, -1, 'Continuação dos resultados oficiais do campeonato nacional de natação ' || document FROM c GROUP BY document HAVING max(row) >= 4)
SELECT document, row_number() OVER (PARTITION BY document ORDER BY zone, col, row)::INTEGER AS line_number, CASE WHEN n > 1 THEN 1 ELSE 0 END::INTEGER AS in_columns, raw_line FROM (
  SELECT *, max(col) OVER (PARTITION BY document) + 1 AS n FROM u)""", star=False)
def ordered_columns(s: Star) -> DataFrame:
    """Pages of one to four columns with unequal gutters, and titles across them, in reading order."""
    o = _orders(s).withColumn("n_columns", F.col("o_custkey") % 4 + 1)
    column, row = F.col("n") % F.col("n_columns"), F.expr("n div n_columns")
    # a column is 130 points wide, gutters are 10 to 26 points, wider to the right
    left = lambda c: 20 + c * (140 + F.col("o_custkey") % 9) + c * (c - 1) * 4
    first = lambda t: 60 + 12 * t + F.when(t >= 4, 20).otherwise(0)
    key, one = F.col("o_orderkey"), F.lit(1).alias("page_number")
    doc = F.col("o_custkey").alias("document")
    words = _at(left(column), (F.col("n") + 1).cast("string"), F.concat(F.lit("Name"), key.cast("string")), (key % 60 + 30).cast("string"), F.substring("o_orderpriority", 1, 1))
    heads = o.select("o_custkey", column.alias("c")).distinct()
    lines = [
        o.select(doc, one, first(row).alias("top"), words.alias("words")),
        heads.select(doc, one, F.lit(45).alias("top"), _at(left(F.col("c")), F.concat(F.lit("#"), (F.col("c") + 1).cast("string")), "Women", "18-24", "50", "Meter", "Free").alias("words")),
        o.select(doc).distinct().select("document", one, F.lit(20).alias("top"), _at(20, "Resultados", "oficiais", "do", "campeonato", "nacional", "de", "natação", "master", F.col("document").cast("string")).alias("words")),
        o.where(row >= 4).select(doc).distinct().select("document", one, F.lit(118).alias("top"), _at(20, "Continuação", "dos", "resultados", "oficiais", "do", "campeonato", "nacional", "de", "natação", F.col("document").cast("string")).alias("words")),
    ]
    all_ = lines[0]
    for more in lines[1:]:
        all_ = all_.unionByName(more)
    found, _ = read_reports(printed(all_), s.raw("orders").count() * BOXES)
    several = F.max("column").over(Window.partitionBy("document")) > 0
    return found.select("document", "line_number", F.when(several, 1).otherwise(0).alias("in_columns"), "raw_line")
