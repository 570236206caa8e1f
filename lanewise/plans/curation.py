"""Identities: aliases, candidates by blocks and bands, ordered rules, and the evidence for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.functions import domain, similarity, text
from lanewise.functions.times import let
from lanewise.operators import core, simjoin
from lanewise.plans.star import STAR_SQL, Star

QUERIES: dict = {}
ORACLES: dict = {}
#: Score from which, and lead over the second from which, a fuzzy match holds by itself.
MATCH_SCORE, MATCH_MARGIN = 0.8, 0.12


def query(sql: str | None = None, star: bool = True):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (STAR_SQL if star else "") + sql
        return f

    return add


def apply_aliases(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """`column` replaced by the end of its alias chain, matched on match keys."""
    ends = core.closure(aliases.select(text.match_key(F.col("alias_name")).alias("k"), text.match_key(F.col("canonical_name")).alias("to")), "k", "to")
    named = aliases.select(text.match_key(F.col("canonical_name")).alias("to"), "canonical_name").groupBy("to").agg(F.min("canonical_name").alias("canonical_name"))
    table = core.small_side(ends.join(named, "to", "left").select("k", "canonical_name"))
    keyed = df.withColumn("k", text.match_key(F.col(column)))
    return keyed.join(table, "k", "left").withColumn(column, F.coalesce("canonical_name", column)).select(*df.columns)


def apply_rules(df: DataFrame, rules: DataFrame, kinds: list[str]) -> DataFrame:
    """The ordered cascade: one left join a rule kind; the first rule (by rule_order) that fits a row's name key, with
    gender and year compatible, sets name, gender and year, and later kinds see what earlier ones set. The rule is found
    once for each different key, gender and year, so rows need no number of their own."""
    out = df
    for kind in kinds:
        keyed = out.withColumn("_key", text.match_key(F.col("full_name")))
        some = core.small_side(rules.where(F.col("kind") == kind).select("rule_order", F.col("match_key").alias("_key"), F.col("gender").alias("g"), F.col("birth_year").alias("y"), "new_name", "new_gender", "new_year"))
        who = ["_key", "gender", "birth_year"]
        hit = keyed.select(*who).distinct().join(some, "_key").where(domain.compatible(F.col("gender"), F.col("g")) & domain.compatible(F.col("birth_year"), F.col("y")))
        first = core.first_by(hit, who, F.asc("rule_order"), F.asc("new_name"), F.asc("new_year")).select(F.col("_key").alias("_k"), F.col("gender").alias("_g"), F.col("birth_year").alias("_y"), "new_name", "new_gender", "new_year")
        same = (F.col("_key") == F.col("_k")) & F.col("gender").eqNullSafe(F.col("_g")) & F.col("birth_year").eqNullSafe(F.col("_y"))
        new = {"full_name": "new_name", "gender": "new_gender", "birth_year": "new_year"}
        out = keyed.join(first, same, "left").select(*[F.coalesce(new[c], c).alias(c) if c in new else F.col(c) for c in df.columns])
    return out


def preferred_year(counts: Column, observed: Column) -> Column:
    """From `year:sources | year:sources` of exactly two years, one with one source and one with more: the latter, if the
    observation counts name exactly two years too, none of them 0, and agree (the one named first, on a tie)."""
    split = lambda c: F.transform(F.split(c, r" \| "), lambda e: F.struct(F.split_part(e, F.lit(":"), F.lit(2)).try_cast("int").alias("n"), F.split_part(e, F.lit(":"), F.lit(1)).alias("year")))
    by, seen = F.array_sort(split(counts)), split(observed)
    two = (F.size(by) == 2) & (F.size(seen) == 2) & F.forall(F.concat(by, seen), lambda e: e["n"] > 0)
    agreed = F.when(F.get(seen, F.lit(0))["n"] >= F.get(seen, F.lit(1))["n"], F.get(seen, F.lit(0))["year"]).otherwise(F.get(seen, F.lit(1))["year"])
    return F.when(two & (F.get(by, F.lit(0))["n"] == 1) & (F.get(by, F.lit(1))["n"] > 1) & (agreed == F.get(by, F.lit(1))["year"]), F.get(by, F.lit(1))["year"].try_cast("int"))


def longest_prefix_club(teams: DataFrame, clubs: DataFrame) -> DataFrame:
    """(team, club_name): the club whose key is the team's, else the team's without a one-letter end, else the longest
    that is a prefix of it. Prefixes are met by an equi-join on every prefix of whole words."""
    k = text.match_key(F.col("team"))
    words = F.split(k, " ")
    forms = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    keyed = teams.select("team", F.explode(forms).alias("k"))
    found = keyed.join(clubs.select(text.match_key(F.col("club_name")).alias("k"), "club_name"), "k")
    best = core.first_by(found, ["team"], F.desc(F.length("k")), F.desc("club_name"))
    return teams.join(best.select("team", "club_name"), "team", "left")


# Words that no athlete's name has.
STATUS_WORDS = ("DQ", "DNS", "DNF", "SCR", "NS", "NT")
CLUB_WORDS = ("club", "natacion", "swim", "team", "master", "masters", "deportivo", "deportiva", "universidad")
PAGE_WORDS = ("page", "pagina", "evento", "event", "resultados", "results", "finals")


def _is_time(word: Column) -> Column:
    """Whether two neighbouring numbers of a word, parted by a colon, point or comma, read as a clock: one or two digits, then two."""
    groups = F.split(F.translate(word, ".,", "::"), ":")
    number = lambda g, least: (F.translate(g, "0123456789", "") == "") & F.length(g).between(least, 2)
    pairs = F.arrays_zip(groups.alias("a"), F.slice(groups, F.lit(2), F.size(groups)).alias("b"))
    return F.exists(pairs, lambda p: F.coalesce(number(p["a"], 1) & number(p["b"], 2), F.lit(False)))


def name_reasons(name: Column) -> Column:
    """What is odd about an athlete's name, in a fixed order; an empty one has that reason only. Characters and words are sorted
    into classes, and each reason asks for a class."""

    def of(clean: Column) -> Column:
        among = lambda words, some: F.arrays_overlap(words, F.array(*map(F.lit, some)))
        often = lambda some: F.length(clean) - F.length(F.translate(clean, some, ""))
        words = F.filter(F.split(F.lower(text.strip_accents(clean)), "[^a-z0-9]+"), lambda w: w != "")
        asked = {
            "contains_digit": often("0123456789") > 0,
            "contains_time_token": F.exists(F.split(clean, r"[^\w:.,]+"), _is_time),
            "contains_status_token": among(F.split(F.upper(clean), "[^A-Z]+"), STATUS_WORDS),
            "too_few_name_tokens": F.size(words) < 2,
            "single_letter_ocr_run": F.contains(text.shape(clean), F.lit("llll")),
            "contains_club_word": among(words, CLUB_WORDS),
            "contains_pdf_noise": among(words, PAGE_WORDS),
            "contains_layout_punctuation": often("|_{}[]<>") > 0,
            "unbalanced_brackets": (often("(") != often(")")) | (often("[") != often("]")),
        }
        return F.when(clean.isNotNull(), F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(r)) for r, t in asked.items()])))

    return F.coalesce(let(text.blank_to_null(F.regexp_replace(name, r"\s+", " ")), of), F.array(F.lit("empty_name")))


def top_two(scored: DataFrame, keys: list[str], score: str, *order: Column) -> DataFrame:
    """The best candidate of each group, if it scores enough and leads the second by enough; no second counts as 0."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *order)
    led = scored.withColumn("second", F.coalesce(F.lead(score).over(w), F.lit(0.0))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return led.where((F.col(score) >= MATCH_SCORE) & (F.col(score) - F.col("second") >= MATCH_MARGIN))


#: Rows of clubs, athletes and years of a task of club_pairs.
SEEN_A_TASK = 100_000


def club_pairs(results: DataFrame) -> DataFrame:
    """Clubs that share an athlete within a year: distinct first, then the clubs of an athlete's year against each other in the
    athlete's own task, which counts them by athlete. Tasks grow in number with the rows, not in size."""
    seen = results.where("club_id IS NOT NULL AND athlete_id IS NOT NULL AND start_date IS NOT NULL").select("club_id", "athlete_id", F.year("start_date").alias("y")).distinct()
    seen = core.settled(seen)
    tasks = max(8, seen.count() // SEEN_A_TASK)
    year = seen.repartition(tasks, "athlete_id").groupBy("athlete_id", "y").agg(F.sort_array(F.collect_list("club_id")).alias("clubs"))
    first = year.select("athlete_id", "clubs", F.posexplode("clubs").alias("k", "club_a"))
    pairs = first.select("athlete_id", "club_a", F.explode(F.slice("clubs", F.col("k") + 2, F.size("clubs"))).alias("club_b"))
    each = pairs.groupBy("club_a", "club_b", "athlete_id").agg(F.count("*").alias("n"))
    return each.repartition(tasks, "club_a", "club_b").groupBy("club_a", "club_b").agg(F.sum("n").alias("n_athlete_years"), F.count("*").alias("n_athletes"))


# --- registered forms


@query("""WITH RECURSIVE pair AS (SELECT p_partkey AS s, p_partkey - p_size AS t FROM part WHERE p_size > 0 AND p_partkey >= p_size AND p_partkey % 3 <> 0),
walk AS (SELECT s, t FROM pair UNION ALL SELECT w.s, p.t FROM walk w JOIN pair p ON w.t = p.s)
SELECT s AS alias, min(t) AS canonical FROM walk GROUP BY s""", star=False)
def alias_closure(s: Star) -> DataFrame:
    """Alias chains followed to their ends, log2 of the longest chain in joins."""
    pairs = s.raw("part").where("p_size > 0 AND p_partkey >= p_size AND p_partkey % 3 <> 0").select(F.col("p_partkey").alias("alias"), (F.col("p_partkey") - F.col("p_size")).alias("canonical"))
    return core.closure(pairs, "alias", "canonical")


@query("SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name)::INTEGER AS distance FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name AND split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) AND levenshtein(a.p_name, b.p_name) <= 4", star=False)
def edit_distance_pairs(s: Star) -> DataFrame:
    """Near names of one block (first word) by bounded edit distance."""
    names = s.raw("part").select("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("block")).distinct()
    pairs = names.select("block", F.col("p_name").alias("a")).join(names.select("block", F.col("p_name").alias("b")), "block").where("a < b")
    return pairs.select("a", "b", F.levenshtein("a", "b", 4).alias("distance")).where("distance >= 0")


@query("""SELECT a.athlete_id AS a, b.athlete_id AS b, abs(a.birth_year - b.birth_year)::INTEGER AS gap FROM athlete a JOIN athlete b
ON a.athlete_id < b.athlete_id AND a.segment = b.segment AND a.athlete_gender = b.athlete_gender AND abs(a.birth_year - b.birth_year) <= 1""")
def band_birth_year_pairs(s: Star) -> DataFrame:
    """Pairs of a block whose years differ by one at most, by an equi-join on exploded years."""
    pairs = core.band_pairs(s.athlete.where("birth_year IS NOT NULL"), ["segment", "athlete_gender"], "birth_year", 1, "athlete_id")
    return pairs.select("a", "b", F.abs(F.col("number_a") - F.col("number_b")).cast("int").alias("gap"))


@query("""SELECT a.club_id AS club_a, b.club_id AS club_b, count(*)::BIGINT AS n_athlete_years, count(DISTINCT a.athlete_id)::BIGINT AS n_athletes FROM (SELECT DISTINCT club_id, athlete_id, year(start_date) AS y FROM result WHERE club_id IS NOT NULL AND start_date IS NOT NULL) a
JOIN (SELECT DISTINCT club_id, athlete_id, year(start_date) AS y FROM result WHERE club_id IS NOT NULL AND start_date IS NOT NULL) b ON a.athlete_id = b.athlete_id AND a.y = b.y AND a.club_id < b.club_id GROUP BY ALL""")
def club_cooccurrence(s: Star) -> DataFrame:
    """Clubs that share an athlete within a year."""
    return club_pairs(s.result)


@query("""SELECT name_key, n, years, clubs, CASE WHEN years = 1 THEN 'same_year' WHEN gap <= 1 THEN 'adjacent_years' WHEN clubs = 1 THEN 'one_club' ELSE 'homonyms' END AS class FROM (
SELECT event_name AS name_key, count(*)::BIGINT AS n, count(DISTINCT distance_m)::BIGINT AS years, (max(distance_m) - min(distance_m)) / 25 AS gap, count(DISTINCT event_age_group)::BIGINT AS clubs FROM event GROUP BY 1 HAVING count(*) > 1)""")
def same_name_groups(s: Star) -> DataFrame:
    g = s.event.groupBy(F.col("event_name").alias("name_key")).agg(
        F.count("*").alias("n"), F.countDistinct("distance_m").alias("years"), ((F.max("distance_m") - F.min("distance_m")) / 25).alias("gap"), F.countDistinct("event_age_group").alias("clubs")
    )
    kind = F.when(F.col("years") == 1, "same_year").when(F.col("gap") <= 1, "adjacent_years").when(F.col("clubs") == 1, "one_club").otherwise("homonyms")
    return g.where("n > 1").select("name_key", "n", "years", "clubs", kind.alias("class"))


@query("""SELECT athlete_id, coalesce(birth_year, CASE WHEN n = 1 THEN only_year END) AS birth_year, birth_year IS NULL AND n = 1 AS filled FROM (
SELECT a.*, count(DISTINCT birth_year) OVER (PARTITION BY athlete_id // 3) AS n, max(birth_year) OVER (PARTITION BY athlete_id // 3) AS only_year FROM athlete a)""")
def missing_year_fill(s: Star) -> DataFrame:
    """Groups with exactly one known year fill the unknown ones."""
    group = F.expr("athlete_id div 3")
    known = s.athlete.groupBy(group.alias("g")).agg(F.countDistinct("birth_year").alias("n"), F.max("birth_year").alias("only_year"))
    joined = s.athlete.withColumn("g", group).join(known, "g")
    return joined.select("athlete_id", F.coalesce("birth_year", F.when(F.col("n") == 1, F.col("only_year"))).alias("birth_year"), (F.col("birth_year").isNull() & (F.col("n") == 1)).alias("filled"))


@query("""SELECT token, n_first::BIGINT AS n_first, n_last::BIGINT AS n_last, CASE WHEN n_first >= 10 AND n_first >= 5 * n_last THEN 'first' WHEN n_last >= 10 AND n_last >= 5 * n_first THEN 'last' ELSE 'either' END AS place FROM (
SELECT token, count(*) FILTER (WHERE k = 1) AS n_first, count(*) FILTER (WHERE k = 2) AS n_last FROM (SELECT unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) AS k FROM part) GROUP BY 1)""", star=False)
def token_statistics(s: Star) -> DataFrame:
    """In which place of a name each token stands, over the corpus."""
    tokens = s.raw("part").select(F.posexplode(F.split("p_name", " ")).alias("k", "token"))
    n = tokens.groupBy("token").agg(F.count_if(F.col("k") == 0).alias("n_first"), F.count_if(F.col("k") == 1).alias("n_last"))
    place = F.when((F.col("n_first") >= 10) & (F.col("n_first") >= 5 * F.col("n_last")), "first").when((F.col("n_last") >= 10) & (F.col("n_last") >= 5 * F.col("n_first")), "last").otherwise("either")
    return n.withColumn("place", place)


@query("""SELECT event_type AS name, n AS uses, n_users FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, event_type) AS rn FROM (
SELECT user_id % 10 AS k, event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_users FROM events GROUP BY 1, 2)) WHERE rn = 1""", star=False)
def canonical_choice(s: Star) -> DataFrame:
    """The commonest spelling of each group, ties broken by a fixed order."""
    n = s.raw("events").groupBy((F.col("user_id") % 10).alias("k"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))
    return core.first_by(n, ["k"], F.desc("n"), F.asc("event_type")).select(F.col("event_type").alias("name"), F.col("n").alias("uses"), "n_users")


@query()
def club_alias_candidates(s: Star) -> DataFrame:
    """Pairs of names of one block that look alike, scored. Ratcliff-Obershelp has no SQL; tests hold it against difflib."""
    names = s.raw("part").select(F.col("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("block")).distinct()
    pairs = names.select("block", F.col("name").alias("a")).join(names.select("block", F.col("name").alias("b")), "block").where("a < b")
    return pairs.select("a", "b", F.round(similarity.name_score(F.col("a"), F.col("b")), 6).alias("score")).where(F.col("score") >= 0.5)


@query()
def name_score_topn(s: Star) -> DataFrame:
    """The five best-scoring candidates of each name within its block."""
    names = s.raw("part").select(F.col("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("block")).distinct()
    pairs = names.select("block", F.col("name").alias("person")).join(names.select("block", F.col("name").alias("candidate")), "block").where("person <> candidate")
    scored = pairs.withColumn("score", F.round(similarity.competition_score(F.col("person"), F.col("candidate")), 6))
    return core.top_by(scored, ["person"], 5, F.desc("score"), F.asc("candidate")).select("person", "candidate", "score", "place")


#: Titles of the pages and copies of them with letters lost and changed, as misread ones are.
_TITLES = """SELECT DISTINCT lower(t) AS t FROM (SELECT regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS t, page_id FROM pages
UNION ALL SELECT replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), 'nd', 'n'), 'th', 'tb'), page_id FROM pages WHERE page_id % 3 = 0) WHERE t <> ''"""


def titles(s: Star) -> DataFrame:
    own = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    misread = F.replace(F.replace(own, F.lit("nd"), F.lit("n")), F.lit("th"), F.lit("tb"))
    pages = s.raw("pages")
    both = pages.select(own.alias("t")).unionByName(pages.where("page_id % 3 = 0").select(misread.alias("t")))
    return both.where("t <> ''").select(F.lower("t").alias("t")).distinct()


@query(f"""WITH t AS ({_TITLES}), g AS (SELECT DISTINCT t, (chr(1) || chr(1) || t || chr(2) || chr(2))[k:k + 2] AS gram FROM (SELECT t, unnest(range(1, length(t) + 3)) AS k FROM t)),
n AS (SELECT t, count(*) AS n FROM g GROUP BY 1), c AS (SELECT x.t AS a, y.t AS b, count(*) AS n_common FROM g x JOIN g y ON x.gram = y.gram AND x.t < y.t GROUP BY ALL)
SELECT a, b, n_common::INTEGER AS n_common, (p.n + q.n - n_common)::INTEGER AS n_all FROM c JOIN n p ON p.t = a JOIN n q ON q.t = b WHERE 100 * n_common >= 60 * (p.n + q.n - n_common)""", star=False)
def similar_titles(s: Star) -> DataFrame:
    """All pairs of titles, misread ones too, that share three fifths of their trigrams."""
    return simjoin.similar_texts(titles(s), "t", 60)


@query()
def alike_titles(s: Star) -> DataFrame:
    """All pairs of titles with a Ratcliff-Obershelp ratio of 0.9 or more. It has no SQL; tests hold it against all pairs."""
    return simjoin.alike_texts(titles(s), "t", 90, similarity.ratio).withColumn("score", F.round("score", 6))
