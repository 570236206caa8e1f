"""The functions of the other plans over the star tables: loads, gates, rules, merges, names and rosters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions import domain, text, times
from lanewise.operators import core
from lanewise.plans import curation, gates, identity, loading, relays, results
from lanewise.plans.star import STAR_SQL, Star

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, star: bool = True):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (STAR_SQL if star else "") + sql
        return f

    return add


def accented(c):
    """Every third name with accents, as staged spellings have them."""
    return F.when(F.length(c) % 3 == 0, F.translate(c, "aeo", "áéó")).otherwise(F.upper(c))


KEY = "nullif(trim(regexp_replace(translate(lower(trim({0})), 'áéíóúüñ', 'aeiouun'), '[^a-z0-9]+', ' ', 'g')), '')"
ACCENTS = "(length(lower(trim({0}))) - length(translate(lower(trim({0})), 'áéíóúüñ', '')))"


@query(f"""WITH c AS (SELECT p_partkey AS club_id, p_name AS club_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1 AND p_partkey % 2 = 0),
s AS (SELECT DISTINCT CASE WHEN length(p_name) % 3 = 0 THEN translate(p_name, 'aeo', 'áéó') ELSE upper(p_name) END AS name FROM part),
b AS (SELECT k, name, q FROM (SELECT {KEY.format("name")} AS k, trim(name) AS name, {ACCENTS.format("name")} AS q, row_number() OVER (PARTITION BY {KEY.format("name")} ORDER BY {ACCENTS.format("name")} DESC, trim(name)) AS n FROM s) WHERE n = 1)
SELECT club_id, CASE WHEN b.q > {ACCENTS.format("club_name")} THEN b.name ELSE club_name END AS club_name FROM c LEFT JOIN b ON b.k = {KEY.format("club_name")}
UNION ALL SELECT NULL, name FROM b WHERE k NOT IN (SELECT {KEY.format("club_name")} FROM c)""", star=False)
def upserted_clubs(s: Star) -> DataFrame:
    """Clubs after a load: better spellings taken over, unknown ones appended."""
    first = core.first_by(s.raw("part"), ["p_name"], F.asc("p_partkey"))
    clubs = first.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("club_id"), F.col("p_name").alias("club_name"))
    return loading.upsert_clubs(clubs, s.raw("part").select(accented(F.col("p_name")).alias("club_name")).distinct())


@query("""SELECT athlete_id, coalesce(birth_year, (SELECT min(1900 + rank_position)::INTEGER FROM result r JOIN athlete o USING (athlete_id) WHERE o.segment = a.segment AND r.rank_position > 1 AND r.club_id % 5 = a.athlete_id % 5 AND (o.athlete_gender = a.athlete_gender))) AS birth_year FROM athlete a""")
def backfilled_birth_years(s: Star) -> DataFrame:
    """Unknown birth years from staged rows of the same key, gender and club."""
    athletes = s.athlete.select("athlete_id", F.col("segment").alias("athlete_name"), "athlete_gender", "birth_year", (F.col("athlete_id") % 5).alias("club_id"))
    staged = s.result.where("rank_position > 1 AND club_id IS NOT NULL").join(s.athlete.select("athlete_id", "segment", "athlete_gender"), "athlete_id")
    staged = staged.select(F.col("segment").alias("athlete_name"), "athlete_gender", (F.col("club_id") % 5).alias("club_id"), (1900 + F.col("rank_position")).cast("int").alias("birth_year"))
    return loading.backfill_birth_years(athletes, staged).select("athlete_id", "birth_year")


@query()
def inserted_athletes(s: Star) -> DataFrame:
    """What staged people add to the athletes: those that no athlete of a like key, gender, year and club stands for."""
    kind = lambda k: [F.concat(F.col("segment"), F.lit(" "), (F.col("athlete_id") % k).cast("string")).alias("athlete_name"), "athlete_gender", "birth_year", (F.col("athlete_id") % 3).alias("club_id")]
    old = s.athlete.where("athlete_id % 4 <> 1").select("athlete_id", *kind(20))
    staged = s.athlete.where("athlete_id % 4 <> 2").select(*kind(25)).distinct()
    new = loading.insert_athletes(old, staged).where("athlete_id IS NULL")
    return new.groupBy("athlete_name", "athlete_gender", "birth_year", "club_id").agg(F.count("*").alias("n"))


ORACLES["inserted_athletes"] = STAR_SQL + """, o AS (SELECT segment || ' ' || (athlete_id % 20) AS k, athlete_gender AS g, birth_year AS y, athlete_id % 3 AS c FROM athlete WHERE athlete_id % 4 <> 1),
t AS (SELECT DISTINCT segment || ' ' || (athlete_id % 25) AS k, athlete_gender AS g, birth_year AS y, athlete_id % 3 AS c FROM athlete WHERE athlete_id % 4 <> 2)
SELECT k AS athlete_name, g AS athlete_gender, y AS birth_year, c AS club_id, 1::BIGINT AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = t.k AND o.g = t.g AND ((t.y IS NOT NULL AND (o.y = t.y OR (o.y IS NULL AND o.c = t.c))) OR (t.y IS NULL AND o.c = t.c)))"""


@query("""WITH f AS (SELECT user_id, event_type, ts::DATE AS day FROM events), m AS (SELECT DISTINCT user_id AS d, user_id - user_id % 3 AS c FROM f WHERE user_id % 3 > 0),
moved AS (SELECT DISTINCT c AS user_id, event_type, day FROM f JOIN m ON d = user_id), rest AS (SELECT * FROM f WHERE user_id NOT IN (SELECT d FROM m))
SELECT user_id, event_type, day, count(*)::BIGINT AS n FROM (SELECT * FROM rest UNION ALL (SELECT * FROM moved EXCEPT SELECT * FROM rest)) GROUP BY ALL""", star=False)
def merged_duplicates(s: Star) -> DataFrame:
    """Facts after a merge of identities; repeats that were there before stay."""
    facts = s.raw("events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"))
    merges = facts.select(F.col("user_id").alias("duplicate_id"), (F.col("user_id") - F.col("user_id") % 3).alias("canonical_id")).where("duplicate_id <> canonical_id").distinct()
    return loading.merge_duplicates(facts, merges, "user_id").groupBy("user_id", "event_type", "day").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey FROM orders), k AS (SELECT 'u' || o_orderkey AS url, CASE WHEN o_orderkey % 3 > 0 THEN 's' || o_orderkey END AS checksum, 'old' AS title FROM o WHERE o_orderkey % 5 < 3),
i AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'moved' || o_orderkey ELSE 'u' || o_orderkey END AS url, CASE WHEN o_orderkey % 3 = 1 THEN 's' || o_orderkey END AS checksum, CASE WHEN o_orderkey % 2 = 0 THEN 'new' END AS title FROM o WHERE o_orderkey % 5 > 0),
a AS (SELECT i.url, i.checksum, coalesce(i.title, k.title) AS title FROM k JOIN i USING (checksum)), ri AS (SELECT * FROM i WHERE checksum IS NULL OR checksum NOT IN (SELECT checksum FROM k WHERE checksum IS NOT NULL)), rk AS (SELECT * FROM k WHERE checksum IS NULL OR checksum NOT IN (SELECT checksum FROM i WHERE checksum IS NOT NULL))
SELECT * FROM a UNION ALL SELECT rk.url, coalesce(ri.checksum, rk.checksum), coalesce(ri.title, rk.title) FROM rk LEFT JOIN ri USING (url) UNION ALL SELECT * FROM ri WHERE url NOT IN (SELECT url FROM rk)""", star=False)
def registered_documents(s: Star) -> DataFrame:
    """Documents upserted by checksum, else by address; each incoming row comes twice."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    known = s.raw("orders").where(k % 5 < 3).select(F.concat(F.lit("u"), n).alias("url"), F.when(k % 3 > 0, F.concat(F.lit("s"), n)).alias("checksum"), F.lit("old").alias("title"))
    incoming = s.raw("orders").where(k % 5 > 0).select(F.concat(F.when(k % 4 == 0, "moved").otherwise("u"), n).alias("url"), F.when(k % 3 == 1, F.concat(F.lit("s"), n)).alias("checksum"), F.when(k % 2 == 0, "new").alias("title"))
    return loading.register_documents(known, incoming.unionAll(incoming))


@query("""SELECT * FROM (SELECT 'error' AS severity, unnest(['invalid_event_gender', 'invalid_event_stroke', 'athlete_name_without_comma', 'invalid_status', 'implausible_time', 'points_over_maximum', 'points_without_rank', 'result_event_age_mismatch', 'result_event_gender_mismatch']) AS issue_key,
unnest([(SELECT count(*) FROM event WHERE event_id % 19 = 0), (SELECT count(*) FROM event WHERE event_id % 23 = 0), (SELECT count(*) FROM athlete WHERE athlete_id % 7 = 0), (SELECT count(*) FROM result WHERE status IS NULL), (SELECT count(*) FROM result WHERE status = 'valid' AND time_ms // 100 < 15000),
(SELECT count(*) FROM result WHERE points * 2 > 50), (SELECT count(*) FROM result WHERE points > 0 AND rank_position = 7), (SELECT count(*) FROM result WHERE athlete_id % 60 NOT BETWEEN 20 AND 49), (SELECT count(*) FROM result JOIN athlete USING (athlete_id) WHERE CASE WHEN event_id % 2 = 0 THEN 'female' ELSE 'male' END <> athlete_gender)]) AS n) WHERE n > 0""")
def bundle_checks(s: Star) -> DataFrame:
    """The gate's issues of a bundle made of the star tables, faults put in at known places."""
    as_text = lambda c: F.col(c).cast("string")
    event = s.event.select(F.when(F.col("event_id") % 19 == 0, "men?").otherwise(F.col("event_gender")).alias("gender"), F.when(F.col("event_id") % 23 == 0, "swim").otherwise("freestyle").alias("stroke"), as_text("event_id").alias("name"))
    people = s.athlete.select("athlete_id", F.concat(F.col("athlete_name"), F.when(F.col("athlete_id") % 7 == 0, " Ana").otherwise(", Ana")).alias("full_name"), F.lit("Uno").alias("club_name"), as_text("athlete_id").alias("birth_year"), F.col("athlete_gender").alias("gender"))
    rows = s.result.join(people, "athlete_id").select(
        F.concat(F.when(F.col("event_id") % 2 == 0, "women ").otherwise("men "), F.lit("20-49 100 LC Meter")).alias("event_name"), F.col("full_name").alias("athlete_name"), "club_name", F.col("birth_year").alias("birth_year_estimated"),
        (F.col("athlete_id") % 60).cast("string").alias("age_at_event"), F.coalesce("status", F.lit("odd")).alias("status"), (F.expr("time_ms div 100")).cast("string").alias("result_time_ms"), times.format_ms(F.expr("time_ms div 100 div 10 * 10")).alias("result_time_text"),
        F.lit("20000").alias("seed_time_ms"), (F.col("points") * 2).cast("string").alias("points"), F.when(F.col("rank_position") != 7, as_text("rank_position")).alias("rank_position"),
    )
    found = gates.bundle_issues({"event": event, "athlete": people.drop("athlete_id"), "result": rows})
    return found.where("issue_key <> 'time_text_disagrees'")


@query("""SELECT user_id AS document, min(event_type) AS scope, CASE WHEN bool_or(event_type = 'error') THEN 'requires_review' WHEN min(event_type) <> 'click' THEN 'requires_review' ELSE 'validated' END AS state FROM events GROUP BY 1""", star=False)
def document_review_states(s: Star) -> DataFrame:
    """The state of every document: an error or another scope than the load's needs review."""
    e = s.raw("events").select(F.col("user_id").alias("document"), "event_type")
    docs = e.groupBy("document").agg(F.min("event_type").alias("scope"))
    return gates.document_states(docs, e.select("document", F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("severity")), "click")


@query("""SELECT o_orderkey AS competition_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new ' || o_orderkey ELSE 'Meet' END AS name, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'LC' ELSE o_orderstatus END AS course_type FROM orders""", star=False)
def patched_competitions(s: Star) -> DataFrame:
    """Competitions with their patches: new values over old ones, never an unknown course."""
    k = F.col("o_orderkey")
    old = s.raw("orders").select(k.alias("competition_id"), F.lit("Meet").alias("name"), F.col("o_orderstatus").alias("course_type"))
    patch = s.raw("orders").where(k % 3 == 0).select(k.alias("competition_id"), F.concat(F.lit("new "), k.cast("string")).alias("name"), F.when(k % 2 == 0, "LC").otherwise("unknown").alias("course_type"))
    return gates.patch_competitions(old, patch, ["name", "course_type"])


@query("""SELECT o_orderkey AS ref, CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE x.id END AS resolved_id, CASE WHEN o_orderkey % 7 = 0 THEN 'given' WHEN x.id IS NOT NULL THEN 'name' ELSE 'new' END AS how FROM orders o LEFT JOIN (
SELECT k, season, arg_min(id, (far, id)) AS id FROM (SELECT c.p_partkey AS id, c.p_name AS k, s.season, (c.p_size % 3 <> s.season)::INTEGER AS far FROM part c, (SELECT unnest([0, 1, 2]) AS season) s) GROUP BY 1, 2) x
ON x.season = o.o_custkey % 3 AND x.k = (SELECT p_name FROM part WHERE p_partkey = o.o_custkey % 180 + 1 AND o.o_orderkey % 2 = 0)""", star=False)
def resolved_competitions(s: Star) -> DataFrame:
    """Incoming meets resolved by id, else by name, the same season first, else new. None is planned here."""
    o, k = s.raw("orders"), F.col("o_orderkey")
    named = o.join(s.raw("part").select((F.col("p_partkey") - 1).alias("_n"), "p_name"), F.col("o_custkey") % 180 == F.col("_n"), "left")
    incoming = named.select(k.alias("ref"), F.when(k % 7 == 0, 5).cast("long").alias("competition_id"), F.when(k % 2 == 0, F.col("p_name")).alias("name"), (F.col("o_custkey") % 3).cast("int").alias("season"))
    known = s.raw("part").select(F.col("p_partkey").alias("competition_id"), F.col("p_name").alias("name"), (F.col("p_size") % 3).cast("int").alias("season"), F.lit(False).alias("planned"))
    return gates.resolve_competitions(incoming, known).select("ref", "resolved_id", "how")


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'Ana' WHEN o_custkey % 5 = 1 AND o_orderkey % 2 = 0 THEN 'Eva' ELSE 'name ' || (o_custkey % 5) END AS full_name, CASE WHEN o_custkey % 5 = 1 AND o_orderkey % 2 = 0 THEN 'female' WHEN o_orderkey % 2 = 0 THEN 'female' WHEN o_orderkey % 3 = 0 THEN 'male' END AS gender,
CASE WHEN o_custkey % 5 = 0 THEN 2000 ELSE (1990 + o_custkey % 7)::INTEGER END AS birth_year FROM orders""", star=False)
def applied_rules(s: Star) -> DataFrame:
    """Names, genders and years after an ordered cascade of two kinds of rules."""
    o, k, c = s.raw("orders"), F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select(k.alias("id"), F.concat(F.lit("name "), (c % 5).cast("string")).alias("full_name"), F.when(k % 2 == 0, "female").when(k % 3 == 0, "male").alias("gender"), (1990 + c % 7).cast("int").alias("birth_year"))
    kinds = "kind string, rule_order int, match_key string, gender string, birth_year int, new_name string, new_gender string, new_year int"
    rules = s.spark.createDataFrame([("name", 1, "name 0", None, None, "Ana", None, None), ("name", 2, "name 0", None, None, "Other", None, None), ("year", 1, "ana", None, None, None, None, 2000)], kinds)
    by_region = s.raw("region").limit(1).select(F.lit("name").alias("kind"), F.lit(3).alias("rule_order"), F.lit("name 1").alias("match_key"), F.lit("female").alias("gender"), F.lit(None).cast("int").alias("birth_year"), F.lit("Eva").alias("new_name"), F.lit(None).cast("string").alias("new_gender"), F.lit(None).cast("int").alias("new_year"))
    known = rows.where("gender IS NOT NULL")  # a rule for women also fits a row of no gender
    return curation.apply_rules(known, rules.unionByName(by_region), ["name", "year"])


ORACLES["applied_rules"] += " WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"


@query("""SELECT p_name || ' ' || p_partkey % 9 AS team, (SELECT c FROM (SELECT DISTINCT p_name AS c FROM part WHERE p_partkey % 3 = 0 UNION SELECT split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 5 = 0) q WHERE p.p_name = c OR starts_with(p.p_name, c || ' ') ORDER BY length(c) DESC LIMIT 1) AS club_name FROM part p GROUP BY ALL""", star=False)
def longest_prefix_clubs(s: Star) -> DataFrame:
    """The club with the longest name that a relay team's name begins with."""
    part = s.raw("part")
    teams = part.select(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 9).cast("string")).alias("team")).distinct()
    clubs = part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("club_name")).union(part.where("p_partkey % 5 = 0").select(F.split_part("p_name", F.lit(" "), F.lit(1)))).distinct()
    return curation.longest_prefix_club(teams, clubs)


@query("""SELECT a.athlete_id, segment, birth_year FROM athlete a WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT o.segment, o.birth_year, o.athlete_gender, CASE WHEN r.club_id % 3 > 0 THEN r.club_id % 4 END AS c FROM result r JOIN athlete o USING (athlete_id) WHERE r.club_id IS NOT NULL) x
WHERE x.segment = a.segment AND x.birth_year IS NOT DISTINCT FROM a.birth_year AND x.athlete_gender = a.athlete_gender AND (x.c IS NULL OR x.c = a.athlete_id % 4))""")
def pruned_unobserved(s: Star) -> DataFrame:
    """Athletes with an observation of their name and year, gender and club compatible."""
    a = s.athlete.select("athlete_id", "segment", "birth_year", F.col("segment").alias("name_key"), F.col("athlete_gender").alias("gender"), (F.col("athlete_id") % 4).alias("club_key"))
    seen = s.result.where("club_id IS NOT NULL").join(s.athlete, "athlete_id").select(F.col("segment").alias("name_key"), "birth_year", F.col("athlete_gender").alias("gender"), F.when(F.col("club_id") % 3 > 0, F.col("club_id") % 4).alias("club_key"))
    return identity.prune_unobserved(a, seen).select("athlete_id", "segment", "birth_year")


@query("""SELECT a, b, CASE WHEN na THEN 'a' ELSE 'b' END AS shorter FROM (SELECT x.id AS a, y.id AS b, len(x.t) < len(y.t) AS na FROM (WITH p AS (SELECT c_custkey AS id, c_mktsegment AS g, list_sort(string_split('alfa' || c_custkey % 7 || CASE c_custkey % 3 WHEN 0 THEN ' soto' WHEN 1 THEN ' soto paz' ELSE ' rojo paz luz' END, ' ')) AS t FROM customer WHERE c_custkey % 5 < 4) SELECT * FROM p) x
JOIN (WITH p AS (SELECT c_custkey AS id, c_mktsegment AS g, list_sort(string_split('alfa' || c_custkey % 7 || CASE c_custkey % 3 WHEN 0 THEN ' soto' WHEN 1 THEN ' soto paz' ELSE ' rojo paz luz' END, ' ')) AS t FROM customer WHERE c_custkey % 5 < 4) SELECT * FROM p) y
ON x.g = y.g AND x.id < y.id AND x.t <> y.t AND (list_has_all(x.t, y.t) OR list_has_all(y.t, x.t)))""", star=False)
def partial_name_pairs(s: Star) -> DataFrame:
    """Pairs of people one of whose names lies in the other's."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("alfa"), (k % 7).cast("string"), F.when(k % 3 == 0, " soto").when(k % 3 == 1, " soto paz").otherwise(" rojo paz luz"))
    people = s.raw("customer").where(k % 5 < 4).select(k.alias("athlete_id"), name.alias("athlete_name"), F.col("c_mktsegment").alias("athlete_gender"), F.lit(1990).alias("birth_year"))
    return identity.partial_candidates(people).select("a", "b", "shorter")


@query("""SELECT raw, ['freestyle', 'backstroke', 'freestyle_relay', 'medley_relay', 'individual_medley', 'butterfly', 'water_polo'][f + 1] AS stroke, ['women', 'men', 'mixed', 'women', 'men', 'mixed', 'x'][f + 1] AS gender, ['valid', 'dns', 'dsq', 'unknown', 'dnf', 'scratch', 'dsq'][f + 1] AS status, count(*)::BIGINT AS n
FROM (SELECT p_partkey % 7 AS f, ['Free ' || p_size, 'Espalda', '4x50 libre', '4x100 mts comb', 'Comb. Ind.', 'fly 25 a 29', 'Water-Polo'][p_partkey % 7 + 1] AS raw FROM part) GROUP BY ALL""", star=False)
def normal_words(s: Star) -> DataFrame:
    """Strokes, genders and statuses of printed words."""
    k = F.col("p_partkey") % 7
    pick = lambda *words: F.get(F.array(*[w if not isinstance(w, str) else F.lit(w) for w in words]), k.cast("int"))
    raw = pick(F.concat(F.lit("Free "), F.col("p_size").cast("string")), "Espalda", "4x50 libre", "4x100 mts comb", "Comb. Ind.", "fly 25 a 29", "Water-Polo")
    gender, state, time = pick(" Damas", "Hombres", "mix", "F", "varon", "MIXTO", "X"), pick("Valid", "", "", "odd", "", "", ""), pick("1:00", "dns", "DQ", "1:00", "DNF", "scratch", "dfs")
    rows = s.raw("part").select(raw.alias("raw"), domain.stroke(raw).alias("stroke"), domain.event_gender(gender).alias("gender"), domain.status(state, time).alias("status"))
    return rows.groupBy("raw", "stroke", "gender", "status").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, nullif(trim(c_mktsegment), '') AS plain, lower(c_mktsegment) AS low, array_to_string(list_sort(string_split(lower(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')), ' ')), ' ') AS name_key, (2000 + c_custkey % 20)::INTEGER AS year FROM customer", star=False)
def normal_texts(s: Star) -> DataFrame:
    """Blanks, small letters, name keys and years of texts."""
    c = s.raw("customer")
    return c.select("c_custkey", text.blank_to_null(F.concat(F.lit(" "), "c_mktsegment", F.lit("\t"))).alias("plain"), text.lower_canon(F.col("c_mktsegment")).alias("low"), text.name_key(F.col("c_name")).alias("name_key"), text.last_year(F.concat(F.lit("Copa 1999 y "), (2000 + F.col("c_custkey") % 20).cast("string"))).alias("year"))


@query("""SELECT athlete_id, 'k' || athlete_id % 90 AS name_key, b.ms FROM athlete a LEFT JOIN (SELECT 'k' || r.athlete_id % 90 AS k, athlete_gender AS g, birth_year AS y, min(time_ms) AS ms FROM result r JOIN athlete USING (athlete_id) WHERE rank_position = 1 AND status = 'valid' GROUP BY ALL) b
ON b.k = 'k' || a.athlete_id % 90 AND b.g = a.athlete_gender AND b.y IS NOT DISTINCT FROM a.birth_year""")
def known_best_times(s: Star) -> DataFrame:
    """Athletes of a workbook with the best times known of them in place of their own."""
    key = F.concat(F.lit("k"), (F.col("athlete_id") % 90).cast("string"))
    people = s.athlete.select("athlete_id", key.alias("name_key"), F.col("athlete_gender").alias("gender"), "birth_year", F.create_map(F.lit("freestyle"), F.lit(1).cast("long")).alias("times"))
    best = results.eligible(s.result).where("rank_position = 1").join(s.athlete.select("athlete_id", "athlete_gender", "birth_year"), "athlete_id")
    best = best.select(key.alias("name_key"), F.col("athlete_gender").alias("gender"), "birth_year", F.lit("freestyle").alias("stroke"), F.col("time_ms").alias("ms"), F.lit(None).cast("long").alias("athlete_id"))
    return relays.with_known_times(people, best).select("athlete_id", "name_key", F.try_element_at("times", F.lit("freestyle")).alias("ms"))


@query()
def cross_relay_errors(s: Star) -> DataFrame:
    """What is wrong between the relays of a club: one relay an order, the customers behind the swimmers."""
    o = s.raw("orders").where("o_orderkey % 4 = 0")
    lined = o.select((F.col("o_orderkey") % 60).alias("club_id"), F.col("o_orderkey").alias("relay"), F.col("o_orderpriority").alias("category"), F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("ids"))
    away = s.raw("customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("athlete_id"))
    return relays.cross_errors(lined, away).select("club_id", "relay", F.array_join("errors", ";").alias("errors"))


ORACLES["cross_relay_errors"] = """WITH l AS (SELECT o_orderkey % 60 AS club_id, o_orderkey AS relay, o_orderpriority AS category, o_custkey AS c FROM orders WHERE o_orderkey % 4 = 0),
g AS (SELECT club_id, relay, unnest([c, c + 1]) AS a FROM l), n AS (SELECT club_id, a, count(DISTINCT relay) AS n FROM g GROUP BY ALL),
t AS (SELECT g.club_id, g.relay, bool_or(n > 1) AS twice, bool_or(g.a % 50 = 0 AND g.a IN (SELECT c_custkey FROM customer)) AS away FROM g JOIN n USING (club_id, a) GROUP BY ALL)
SELECT club_id, relay, array_to_string(list_filter([CASE WHEN twice THEN 'athlete in two relays' END, CASE WHEN away THEN 'athlete not available' END, CASE WHEN count(*) OVER (PARTITION BY club_id, category) > 1 THEN 'category twice' END], lambda x: x IS NOT NULL), ';') AS errors FROM l JOIN t USING (club_id, relay)"""


@query("""SELECT club_id, athlete_id FROM (SELECT DISTINCT c_custkey % 40 AS club_id, c_custkey AS athlete_id FROM customer) EXCEPT SELECT o_custkey % 40, o_custkey FROM orders WHERE o_orderkey % 5 = 0""", star=False)
def unassigned_athletes(s: Star) -> DataFrame:
    """Athletes of a roster who swim in no line-up of their club."""
    roster = s.raw("customer").select((F.col("c_custkey") % 40).alias("club_id"), F.col("c_custkey").alias("athlete_id"))
    lined = s.raw("orders").where("o_orderkey % 5 = 0").select((F.col("o_custkey") % 40).alias("club_id"), F.array("o_custkey").alias("ids"))
    return relays.unassigned(roster, lined)


@query("SELECT DISTINCT distance_m FROM event WHERE stroke = (SELECT min(stroke) FROM event)")
def stroke_distances(s: Star) -> DataFrame:
    """Distances that go with the first stroke of the catalogue."""
    first = s.event.agg(F.min("stroke").alias("stroke"))
    return relays.distances(s.event.join(F.broadcast(first), "stroke"), None)  # one row
