"""Documents, pages and lines: discovery of links, line scans, the fold that carries context, and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.functions import domain, text, times
from lanewise.operators import core
from lanewise.plans.star import Star

QUERIES: dict = {}
ORACLES: dict = {}

ANCHOR = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
TIME = r"(?:X?\d{1,3}(?:[:']\d{2})?(?:[.,']\d{1,2})?|NT|NS|DNS|DNF|DQ|DSQ|DFS|SCRATCH)"
RESULT_LINE = rf"(?i)^(\*?\d+|---?)\s+(.+?)\s+(\d{{1,3}})\s+(.+?)\s+({TIME})\s+({TIME})(?:\s+(\d+(?:[.,]\d+)?))?$"
RESULT_NO_SEED = rf"(?i)^(\*?\d+|---?)\s+(.+?)\s+(\d{{1,3}})\s+(.+?)\s+({TIME})(?:\s+(\d+(?:[.,]\d+)?))?$"
EVENT_HEADER = r"(?i)^\(?Event(?:o)?\s+(\d+)\s+(Women|Men|Mixed|Mujeres|Hombres|Damas|Varones|Mixto)\s+(.+?)\s+(\d+(?:x\d+)?)\s+(LC|SC|CL|CP|CC)\s+Met(?:er|ros?)\s+(.+?)\)?$"
RELAY_LINE = rf"(?i)^(\*?\d+|---?)\s+(.+?)\s+({TIME})\s+({TIME})(?:\s+(\d+(?:[.,]\d+)?))?$"
SWIMMER = r"(\d)\)\s*([^0-9)]+?)\s+([MWFH])?(\d{1,3})(?=\s+\d\)|\s*$)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lines(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_number from 1, raw_line) of every line."""
    return docs.select(key, F.posexplode(F.split(body, "\n")).alias("line_number", "raw_line")).withColumn("line_number", F.col("line_number") + 1)


def parse_event_header(line: Column) -> Column:
    """(number, gender, age_group, distance_m, course, stroke), null where the line is none."""
    part = lambda g: F.regexp_extract(line, EVENT_HEADER, g)
    return F.when(
        line.rlike(EVENT_HEADER),
        F.struct(part(1).cast("int").alias("number"), domain.event_gender(part(2)).alias("gender"), part(3).alias("age_group"), domain.distance_m(part(4)).alias("distance_m"), domain.course(part(5)).alias("course"), domain.stroke(part(6)).alias("stroke")),
    )


def parse_result_line(line: Column) -> Column:
    """(rank, name, age, team, seed_text, time_text, time_ms, points, status) of an individual result."""
    seed, bare = line.rlike(RESULT_LINE), line.rlike(RESULT_NO_SEED)
    part = lambda a, b: F.when(seed, F.regexp_extract(line, RESULT_LINE, a)).otherwise(F.regexp_extract(line, RESULT_NO_SEED, b))
    final = part(6, 5)
    exhibition = F.upper(final).startswith("X")
    ms = times.time_ms(final)
    rank = F.when(~exhibition, text.number_in(part(1, 1), r"(\d+)"))
    return F.when(
        seed | bare,
        F.struct(
            rank.alias("rank"), part(2, 2).alias("name"), part(3, 3).cast("int").alias("age"), part(4, 4).alias("team"),
            F.when(seed, F.regexp_extract(line, RESULT_LINE, 5)).alias("seed_text"), times.normal_time(final).alias("time_text"), ms.alias("time_ms"),
            F.replace(F.nullif(part(7, 6), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(10,2)").alias("points"),
            F.when(ms.isNotNull(), "valid").otherwise(domain.status(F.lit(None).cast("string"), final)).alias("status"),
        ),
    )


#: A relay's parts as one text: those of known letters, then the team, which may hold any. The mark is none of what parts a line's words.
RELAY_PARTS, MARK = "$1\x01$3\x01$4\x01$2", "\x01"
#: Swimmers with what stands before each, and what stands behind the last; their parts as one text, whose mark no part holds.
SWIMMERS, SWIMMER_PARTS = rf"(?s:.*?){SWIMMER}|(?s:.+)", "$1)$3)$4)$2)"


def parse_relay_line(line: Column) -> Column:
    """(rank, team, seed_text, time_text, time_ms) of a relay team's line, null where it is none; the line is matched once."""

    def shown(p: Column) -> Column:
        rank, final = F.get(p, F.lit(0)), F.get(p, F.lit(2))
        return F.struct(text.number_in(rank, r"(\d+)").alias("rank"), F.get(p, F.lit(3)).alias("team"), F.get(p, F.lit(1)).alias("seed_text"), times.normal_time(final).alias("time_text"), times.time_ms(final).alias("time_ms"))

    # behind $ the pattern takes the end of the line, too, which would stay behind the parts
    parts = F.regexp_replace(line, F.lit(RELAY_LINE + r"[\n\r\x{85}\x{2028}\x{2029}]*"), F.lit(RELAY_PARTS))
    return F.when(line.rlike(r"^[*\d-]"), times.let(parts, lambda t: F.when(t != line, times.let(F.split(t, MARK, 4), shown))))


def parse_swimmers(line: Column) -> Column:
    """Array of (leg, name, gender, age) of a line of relay members; the line is matched once."""

    def swimmer(p: Column, k: Column) -> Column:
        at = lambda n: F.get(p, k + n)
        return F.struct(at(0).cast("int").alias("leg"), F.trim(at(3)).alias("name"), domain.athlete_gender(F.nullif(at(1), F.lit(""))).alias("gender"), at(2).try_cast("int").alias("age"))

    # what stands behind the last swimmer leaves marks only, and a swimmer's name is never empty
    parts = F.split(F.rtrim(F.regexp_replace(line, F.lit(SWIMMERS), F.lit(SWIMMER_PARTS)), F.lit(")")), r"\)")
    firsts = lambda p: F.when(F.size(p) > 1, F.sequence(F.lit(0), F.size(p) - 1, F.lit(4))).otherwise(F.array().cast("array<int>"))
    return times.let(parts, lambda p: F.when(p.isNotNull(), F.transform(firsts(p), lambda k: swimmer(p, k))))


def parsed_documents(rows: DataFrame, key: list[str], order: list[str], line: str = "raw_line") -> DataFrame:
    """Every line with the event header above it and what it parses to: kind is header, result, relay, members or unparsed."""
    raw = F.trim(F.col(line))
    header = parse_event_header(raw)
    out = core.carry_forward(rows.withColumn("_header", header), key, order, F.col("_header"), "event").withColumn("result", parse_result_line(raw)).withColumn("relay", parse_relay_line(raw)).withColumn("members", parse_swimmers(raw))
    relay_event = F.coalesce(F.col("event.stroke").endswith("_relay"), F.lit(False))
    kind = (
        F.when(F.col("_header").isNotNull(), "header")
        .when(F.size("members") > 0, "members")
        .when(relay_event & F.col("relay").isNotNull(), "relay")
        .when(F.col("result").isNotNull(), "result")
        .otherwise("unparsed")
    )
    return out.withColumn("kind", kind).drop("_header")


def links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, position, href, label, target: absolute) of every anchor, in page order."""
    whole = F.regexp_extract_all(html, F.lit(ANCHOR), 0)
    rows = pages.select(key, url, F.posexplode(whole).alias("position", "anchor"))
    href = F.regexp_extract("anchor", ANCHOR, 1)
    label = F.trim(F.regexp_replace(F.regexp_extract("anchor", ANCHOR, 2), "<[^>]*>", ""))
    site = F.regexp_extract(url, r"^([a-z]+://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(F.col(url), r"[?#].*$", ""), "[^/]*$", "")
    target = F.when(href.rlike("^[a-z]+:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(url, "^([a-z]+:)", 1), href)).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(folder, href))
    return rows.select(key, url, "position", href.alias("href"), label.alias("label"), target.alias("target"))


@query("""SELECT target, page_id, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY page_id, position) AS rn FROM (
SELECT page_id, position - 1 AS position, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href
ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS target FROM (SELECT page_id, url, position, regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM (
SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="[^"]*"[^>]*>.*?</a>')) AS a, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*?href="[^"]*"[^>]*>.*?</a>'), 1) AS position FROM pages)))) WHERE rn = 1""")
def html_links(s: Star) -> DataFrame:
    """All links, absolute, each where it was first seen."""
    return core.first_by(links(s.raw("pages")), ["target"], F.asc("page_id"), F.asc("position")).select("target", "page_id", "position")


@query("""SELECT page_id, host, CASE WHEN n > 1 THEN host || '-' || n ELSE host END AS slug FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM (
SELECT page_id, trim(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)), '[^a-z0-9]+', '-', 'g'), '-') AS host FROM pages))""")
def slug_dedupe(s: Star) -> DataFrame:
    """A slug for each page, unique by a running number."""
    rows = s.raw("pages").select("page_id", text.slug(F.parse_url(F.col("url"), F.lit("HOST"))).alias("host")).withColumn("slug", F.col("host"))
    return core.occurrence_names(rows, ["host"], "slug", F.asc("page_id")).select("page_id", "host", "slug")


@query("""SELECT doc_id, line_number::INTEGER AS line_number, length(line)::INTEGER AS chars, last_value(CASE WHEN length(line) < 30 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_number) AS header
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)""")
def line_context_fold(s: Star) -> DataFrame:
    """Every line with the last short line above it as its header."""
    rows = lines(s.raw("documents"), "doc_id", "text")
    out = core.carry_forward(rows, ["doc_id"], ["line_number"], F.when(F.length("raw_line") < 30, F.col("raw_line")), "header")
    return out.select("doc_id", "line_number", F.length("raw_line").alias("chars"), "header")


@query("""SELECT source, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE contains(line, '|'))::BIGINT AS n_debug, max(CASE WHEN contains(line, '|') THEN 1 ELSE 0 END)::INTEGER AS worst, count(DISTINCT doc_id)::BIGINT AS n_docs
FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""")
def debug_ratio(s: Star) -> DataFrame:
    """Share of lines that a parser can't read, by source; here lines with a bar."""
    odd = F.contains("raw_line", F.lit("|"))
    rows = s.raw("documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("raw_line"))
    return rows.groupBy("source").agg(F.count("*").alias("n_lines"), F.count_if(odd).alias("n_debug"), F.max(F.when(odd, 1).otherwise(0)).alias("worst"), F.countDistinct("doc_id").alias("n_docs"))


@query("""SELECT checksum, min(doc_id) AS first_id, count(*)::BIGINT AS n, CASE WHEN count(*) = 1 THEN 'new' ELSE 'unchanged' END AS state FROM (SELECT doc_id, sha256(text) AS checksum FROM documents) GROUP BY 1""")
def document_register(s: Star) -> DataFrame:
    """Documents by checksum: the first of each is new, later ones are unchanged copies."""
    rows = s.raw("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))
    return rows.groupBy("checksum").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).withColumn("state", F.when(F.col("n") == 1, "new").otherwise("unchanged"))


@query("""SELECT conv_id, first_role, n_turns, last_assistant FROM (SELECT conv_id, arg_min(role, turn) AS first_role, count(*)::BIGINT AS n_turns, max(turn) FILTER (WHERE role = 'assistant') AS last_assistant FROM conversations GROUP BY 1)""")
def latest_turns(s: Star) -> DataFrame:
    """The latest event of each kind of a record by its order, in one aggregate."""
    return s.raw("conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.count("*").alias("n_turns"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_assistant"))


@query("""SELECT page_id, key, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(url, '[?&]([a-z]+)=', 1)) AS key FROM pages) GROUP BY ALL""")
def url_parameters(s: Star) -> DataFrame:
    rows = s.raw("pages").select("page_id", F.explode(F.regexp_extract_all("url", F.lit("[?&]([a-z]+)="), 1)).alias("key"))
    return rows.groupBy("page_id", "key").agg(F.count("*").alias("n"))


def calendar(grid: DataFrame, order: str = "row") -> DataFrame:
    """A calendar grid (row, cells) as (year, month, day, text): month heads carry down, day rows carry to the event cells
    below them, cells meet their day by column. The grid is one sheet, so its window is one small partition."""
    months = "|".join("january february march april may june july august september october november december enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split())
    joined = F.lower(F.array_join("cells", " "))
    head = F.when(joined.rlike(rf"\b({months})\b.*\b\d{{4}}\b"), F.struct(F.regexp_extract(joined, rf"\b({months})\b", 1).alias("month"), F.regexp_extract(joined, r"\b(\d{4})\b", 1).cast("int").alias("year")))
    filled = F.filter("cells", lambda c: F.trim(c) != "")
    days = F.when((F.size(filled) > 0) & F.forall(filled, lambda c: F.trim(c).rlike(r"^\d{1,2}$")), F.col("cells"))
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.withColumn("head", F.last(head, True).over(w)).withColumn("days", F.last(days, True).over(w)).where(head.isNull() & days.isNull() & F.col("days").isNotNull())
    cells = rows.select(order, "head", "days", F.posexplode("cells").alias("column", "text")).where(F.trim("text") != "")
    return cells.select("head.year", "head.month", F.trim(F.get("days", F.col("column"))).try_cast("int").alias("day"), F.trim("text").alias("text")).where("day IS NOT NULL")
