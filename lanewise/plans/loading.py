"""Staging to core: natural keys, upserts, resolution and the checks around a load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions import domain, text, times
from lanewise.operators import core
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


# --- upserts as functions (core, staging) -> new core


def upsert_clubs(clubs: DataFrame, staging: DataFrame) -> DataFrame:
    """clubs (club_id, club_name) and staged names: a known club takes the staged spelling with strictly more accents,
    unknown keys are appended with null ids. One spelling a key: most accents, then the first of the alphabet."""
    key, quality = text.match_key(F.col("club_name")), text.accent_count(F.col("club_name"))
    new = staging.select(key.alias("k"), F.trim("club_name").alias("new_name"), quality.alias("new_quality")).where("k IS NOT NULL")
    new = core.first_by(new, ["k"], F.desc("new_quality"), F.asc("new_name"))
    old = clubs.select("club_id", "club_name", key.alias("k"), quality.alias("quality"))
    better = F.col("new_quality") > F.col("quality")
    kept = old.join(new, "k", "left").select("club_id", F.when(better, F.col("new_name")).otherwise(F.col("club_name")).alias("club_name"))
    added = new.join(old.select("k"), "k", "left_anti").select(F.lit(None).cast("long").alias("club_id"), F.col("new_name").alias("club_name"))
    return kept.unionByName(added)


def insert_missing(target: DataFrame, batch: DataFrame, keys: list[str], *order) -> DataFrame:
    """target with the batch's rows of unseen keys; the batch's own duplicates go first, by the given order."""
    return target.unionByName(core.missing_from(core.first_by(batch, keys, *order), target, keys).select(*target.columns))


def backfill_birth_years(athletes: DataFrame, staging: DataFrame) -> DataFrame:
    """Unknown birth years from staged rows of the same name key, compatible gender and null-safe club; the least, if several."""
    a = athletes.withColumn("k", text.match_key(F.col("athlete_name"))).alias("a")
    s = staging.select(text.match_key(F.col("athlete_name")).alias("k"), "athlete_gender", "club_id", "birth_year").where("k IS NOT NULL AND birth_year IS NOT NULL")
    # only the least year of a key, gender and club can be found
    s = s.groupBy("k", "athlete_gender", "club_id").agg(F.min("birth_year").alias("birth_year")).alias("s")
    same = (F.col("a.k") == F.col("s.k")) & F.col("a.club_id").eqNullSafe(F.col("s.club_id")) & domain.compatible(F.col("a.athlete_gender"), F.col("s.athlete_gender"))
    found = a.where("birth_year IS NULL").join(s, same).groupBy("a.athlete_id").agg(F.min("s.birth_year").alias("found"))
    return athletes.join(found, "athlete_id", "left").withColumn("birth_year", F.coalesce("birth_year", "found")).select(*athletes.columns)


def insert_athletes(athletes: DataFrame, staging: DataFrame) -> DataFrame:
    """Appends staged people that no athlete stands for: same key and compatible gender, and the same year, or a year
    unknown on one side with the same club. Asymmetric on purpose: staged rows are held against athletes, never against
    each other beyond exact duplicates."""
    names = ["k", "athlete_gender", "birth_year", "club_id"]
    staged = core.first_by(staging.withColumn("k", text.match_key(F.col("athlete_name"))).where("k IS NOT NULL"), names, F.asc("athlete_name")).alias("s")
    a = athletes.withColumn("k", text.match_key(F.col("athlete_name"))).alias("a")
    year, club = F.col("s.birth_year") == F.col("a.birth_year"), F.col("s.club_id").eqNullSafe(F.col("a.club_id"))
    known = F.col("s.birth_year").isNotNull()
    same = (F.col("a.k") == F.col("s.k")) & domain.compatible(F.col("a.athlete_gender"), F.col("s.athlete_gender"))
    same = same & ((known & (year | (F.col("a.birth_year").isNull() & club))) | (~known & club))
    new = staged.join(a, F.coalesce(same, F.lit(False)), "left_anti")
    return athletes.unionByName(new.select(F.lit(None).cast("long").alias("athlete_id"), "athlete_name", "athlete_gender", "birth_year", "club_id"))


def merge_duplicates(facts: DataFrame, merges: DataFrame, column: str = "athlete_id") -> DataFrame:
    """Facts with duplicate ids replaced by their canonical ones. Of rows that the merge makes equal one stays; repeats that
    were there before it stay as they are, and rows of other ids aren't touched or shuffled for it."""
    m = core.small_side(merges.select(F.col("duplicate_id").alias(column), "canonical_id"))
    moved = facts.join(m, column).withColumn(column, F.col("canonical_id")).select(*facts.columns).distinct()
    rest = facts.join(m.select(column), column, "left_anti")
    there = rest.join(core.small_side(merges.select(F.col("canonical_id").alias(column)).distinct()), column, "left_semi")
    return rest.select(*facts.columns).unionByName(core.missing_from(moved, there, facts.columns))


def merge_guards(merges: DataFrame, athletes: DataFrame) -> DataFrame:
    """Reasons why a merge table must not run; empty if it may: repeated duplicates, targets that are duplicates
    themselves, unknown ids, different known genders."""
    ids = athletes.select(F.col("athlete_id").alias("id"), F.col("athlete_gender").alias("gender"))
    twice = merges.groupBy("duplicate_id").agg(F.countDistinct("canonical_id").alias("n")).where("n > 1").select("duplicate_id", F.lit("several targets").alias("reason"))
    chain = merges.join(merges.select(F.col("duplicate_id").alias("canonical_id")), "canonical_id", "left_semi").select("duplicate_id", F.lit("target is a duplicate").alias("reason"))
    sides = merges.join(ids.select(F.col("id").alias("duplicate_id"), F.col("gender").alias("g1")), "duplicate_id", "left").join(ids.select(F.col("id").alias("canonical_id"), F.col("gender").alias("g2"), F.lit(True).alias("known")), "canonical_id", "left")
    unknown = sides.where("known IS NULL").select("duplicate_id", F.lit("unknown target").alias("reason"))
    gender = sides.where(~domain.compatible(F.col("g1"), F.col("g2"))).select("duplicate_id", F.lit("genders differ").alias("reason"))
    return twice.unionByName(chain).unionByName(unknown).unionByName(gender).distinct()


def register_documents(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """(url, checksum, title) upserted by checksum, else by url, new values over old nulls and the reverse. Of several incoming
    rows of one checksum, or of one url, the first of the alphabet counts."""
    order = [F.asc_nulls_last(c) for c in known.columns]
    incoming = core.first_by(incoming.where("checksum IS NOT NULL"), ["checksum"], *order).unionByName(incoming.where("checksum IS NULL"))
    incoming = core.first_by(incoming.where("url IS NOT NULL"), ["url"], F.desc(F.col("checksum").isNotNull()), *order).unionByName(incoming.where("url IS NULL"))
    i, k = incoming.alias("i"), known.alias("k")
    merged_sum = k.join(i, F.col("i.checksum") == F.col("k.checksum")).select(*[F.coalesce(F.col(f"i.{c}"), F.col(f"k.{c}")).alias(c) for c in known.columns])
    rest_i = i.join(k, F.col("i.checksum") == F.col("k.checksum"), "left_anti").alias("i")
    rest_k = k.join(i, F.col("i.checksum") == F.col("k.checksum"), "left_anti").alias("k")
    merged_url = rest_k.join(rest_i, F.col("i.url") == F.col("k.url"), "left").select(*[F.coalesce(F.col(f"i.{c}"), F.col(f"k.{c}")).alias(c) for c in known.columns])
    new = rest_i.join(rest_k, F.col("i.url") == F.col("k.url"), "left_anti").select(*known.columns)
    return merged_sum.unionByName(merged_url).unionByName(new)


# --- registered forms over the star tables


@query("""SELECT club_key, club_name, quality FROM (SELECT *, row_number() OVER (PARTITION BY club_key ORDER BY quality DESC, club_name) AS rn FROM (
SELECT nullif(trim(regexp_replace(translate(lower(trim(p_name)), 'áéíóúüñ', 'aeiouun'), '[^a-z0-9]+', ' ', 'g')), '') AS club_key, p_name AS club_name,
length(lower(trim(p_name))) - length(translate(lower(trim(p_name)), 'áéíóúüñ', '')) AS quality FROM (SELECT p_name FROM part UNION ALL SELECT upper(replace(p_name, 'i', 'í')) FROM part))) WHERE rn = 1""", star=False)
def distinct_on_quality(s: Star) -> DataFrame:
    """One spelling a club key: the one with most accents."""
    names = s.raw("part").select("p_name").union(s.raw("part").select(F.upper(F.replace("p_name", F.lit("i"), F.lit("í")))))
    rows = names.select(text.match_key(F.col("p_name")).alias("club_key"), F.col("p_name").alias("club_name"), text.accent_count(F.col("p_name")).alias("quality"))
    return core.first_by(rows, ["club_key"], F.desc("quality"), F.asc("club_name"))


@query("SELECT DISTINCT s_name AS name, nullif(trim(regexp_replace(translate(lower(trim(s_name)), 'áéíóúüñ', 'aeiouun'), '[^a-z0-9]+', ' ', 'g')), '') AS key FROM supplier UNION SELECT n_name, nullif(trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')), '') FROM nation", star=False)
def match_key(s: Star) -> DataFrame:
    names = s.raw("supplier").select(F.col("s_name").alias("name")).union(s.raw("nation").select("n_name")).distinct()
    return names.select("name", text.match_key(F.col("name")).alias("key"))


@query("""SELECT o_orderkey, ms, place FROM (SELECT o.o_orderkey, m.ms, m.place FROM orders o LEFT JOIN LATERAL (
SELECT round(l_extendedprice * 100)::BIGINT AS ms, l_linenumber::INTEGER AS place FROM lineitem l WHERE l.l_orderkey = o.o_orderkey
ORDER BY CASE WHEN l.l_suppkey % 5 = o.o_custkey % 5 THEN 0 ELSE 1 END, l.l_linenumber, l.l_extendedprice LIMIT 1) m ON true)""", star=False)
def best_match_window(s: Star) -> DataFrame:
    """The best candidate by an order that reads the outer row: an equi-join and a rank."""
    o, r = s.raw("orders").select("o_orderkey", "o_custkey"), s.raw("lineitem")
    near = F.when(F.col("l_suppkey") % 5 == F.col("o_custkey") % 5, 0).otherwise(1)
    best = core.best_match(o, r, F.col("o_orderkey") == F.col("l_orderkey"), ["o_orderkey"], near, F.asc("l_linenumber"), F.asc("l_extendedprice"))
    return best.select("o_orderkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("ms"), F.col("l_linenumber").cast("int").alias("place"))


@query("""SELECT e.event_id, e.user_id, (SELECT max(m.ts) FROM events m WHERE m.user_id = e.user_id AND m.event_type = 'signup' AND (m.ts, m.event_id) <= (e.ts, e.event_id)) AS team_ts
FROM events e WHERE e.event_type = 'purchase'""", star=False)
def asof_team_line(s: Star) -> DataFrame:
    """Each swimmer line with the last team line before it in its group."""
    e = s.raw("events")
    marks = e.where("event_type = 'signup'").select("user_id", "ts", "event_id", F.col("ts").alias("team_ts"))
    return core.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), marks, ["user_id"], ["ts", "event_id"], "team_ts").select("event_id", "user_id", "team_ts")


@query("""SELECT athlete_id, event_id, club_id, rank_position, time_ms, status FROM (SELECT DISTINCT athlete_id, event_id, club_id, rank_position, time_ms, coalesce(status, '') AS status FROM result WHERE rank_position > 3) b
WHERE NOT EXISTS (SELECT 1 FROM result c WHERE c.rank_position <= 3 AND c.athlete_id = b.athlete_id AND c.event_id = b.event_id AND c.club_id IS NOT DISTINCT FROM b.club_id)""")
def idempotent_insert_antijoin(s: Star) -> DataFrame:
    """What a second load adds: the batch's duplicates gone first, then the keys that are there already."""
    rows = s.result.select("athlete_id", "event_id", "club_id", "rank_position", "time_ms", F.coalesce("status", F.lit("")).alias("status"))
    return core.missing_from(rows.where("rank_position > 3").distinct(), rows.where("rank_position <= 3"), ["athlete_id", "event_id", "club_id"])


@query("""SELECT 'results_without_club' AS check, count(*)::BIGINT AS n FROM result WHERE club_id IS NULL
UNION ALL SELECT 'results_without_athlete', count(*) FROM result r LEFT JOIN athlete a ON a.athlete_id = r.athlete_id AND birth_year IS NOT NULL WHERE a.athlete_id IS NULL
UNION ALL SELECT 'results_without_event', count(*) FROM result r LEFT JOIN (SELECT * FROM event WHERE event_id % 97 <> 0) e USING (event_id) WHERE e.event_name IS NULL
UNION ALL SELECT 'relays_without_club', count(*) FROM relay r LEFT JOIN club c USING (club_id) WHERE c.club_name IS NULL
UNION ALL SELECT 'members_without_athlete', count(*) FROM relay r LEFT JOIN athlete a ON a.athlete_id = r.athlete_id AND birth_year IS NOT NULL WHERE a.athlete_id IS NULL
UNION ALL SELECT 'athletes_without_result', count(*) FROM athlete WHERE athlete_id NOT IN (SELECT athlete_id FROM result)""")
def validation_unmatched_counts(s: Star) -> DataFrame:
    """Rows without a counterpart, one count a check; anti joins that Catalyst picks the strategy for."""
    r, known = s.result, s.athlete.where("birth_year IS NOT NULL").select("athlete_id")
    checks = {
        "results_without_club": r.where("club_id IS NULL"),
        "results_without_athlete": r.join(known, "athlete_id", "left_anti"),
        "results_without_event": r.join(s.event.where("event_id % 97 <> 0").select("event_id"), "event_id", "left_anti"),
        "relays_without_club": s.relay.join(s.club.select("club_id"), "club_id", "left_anti"),
        "members_without_athlete": s.relay.join(known, "athlete_id", "left_anti"),
        "athletes_without_result": s.athlete.join(r.select("athlete_id"), "athlete_id", "left_anti"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT field, count(*)::BIGINT AS rows, sum(bad)::BIGINT AS violations FROM (
SELECT 'status' AS field, (status IS NOT NULL AND status NOT IN ('valid', 'dns', 'dnf'))::INTEGER AS bad FROM result
UNION ALL SELECT 'scope', (NOT regexp_full_match(lower(scope), '[a-z][a-z0-9_]*'))::INTEGER FROM result
UNION ALL SELECT 'course', (course NOT IN ('F', 'O'))::INTEGER FROM result
UNION ALL SELECT 'rank', (rank_position NOT BETWEEN 1 AND 4)::INTEGER FROM result) GROUP BY 1""")
def canon_violations(s: Star) -> DataFrame:
    """Values outside their catalogue, all fields in one pass."""
    bad = {
        "status": F.col("status").isNotNull() & ~F.col("status").isin("valid", "dns", "dnf"),
        "scope": ~F.lower("scope").rlike("^[a-z][a-z0-9_]*$"),
        "course": ~F.col("course").isin("F", "O"),
        "rank": ~F.col("rank_position").between(1, 4),
    }
    sums = s.result.agg(F.count("*").alias("rows"), *[F.count_if(v).alias(k) for k, v in bad.items()])
    return sums.select("rows", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("violations")) for k in bad])).alias("x")).select("x.field", "rows", "x.violations")


@query("""SELECT club_id, count(*) FILTER (WHERE points IS NOT NULL AND status IS DISTINCT FROM 'valid')::BIGINT AS points_without_rank, count(*) FILTER (WHERE points > 45)::BIGINT AS over_maximum,
count(*) FILTER (WHERE status = 'valid' AND time_ms < 200000)::BIGINT AS implausible FROM result GROUP BY 1""")
def points_quality(s: Star) -> DataFrame:
    valid = F.coalesce(F.col("status") == "valid", F.lit(False))
    return s.result.groupBy("club_id").agg(
        F.count_if(F.col("points").isNotNull() & ~valid).alias("points_without_rank"), F.count_if(F.col("points") > 45).alias("over_maximum"), F.count_if(valid & (F.col("time_ms") < 200000)).alias("implausible")
    )


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT - (SELECT count(*) FROM (SELECT DISTINCT athlete_id, coalesce(club_id, -1), start_date, leg_order, team FROM relay))::BIGINT AS duplicates FROM relay")
def relay_duplicates(s: Star) -> DataFrame:
    keys = F.struct("athlete_id", F.coalesce("club_id", F.lit(-1)).alias("club_id"), "start_date", "leg_order", "team")
    return s.relay.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct(keys)).alias("duplicates"))


@query("""SELECT competition_id, severity, n_issues FROM (SELECT competition_id, max(CASE WHEN status IS NULL THEN 2 WHEN club_id IS NULL THEN 1 ELSE 0 END)::INTEGER AS severity,
count(*) FILTER (WHERE status IS NULL OR club_id IS NULL)::BIGINT AS n_issues FROM result GROUP BY 1) WHERE severity > 0""")
def gate_rollup(s: Star) -> DataFrame:
    """The worst severity of each load and its count of issues."""
    severity = F.when(F.col("status").isNull(), 2).when(F.col("club_id").isNull(), 1).otherwise(0)
    return s.result.groupBy("competition_id").agg(F.max(severity).alias("severity"), F.count_if(severity > 0).alias("n_issues")).where("severity > 0")


@query("""SELECT line, kind, minutes, ms FROM (SELECT DISTINCT l_extendedprice::VARCHAR AS raw, l_linenumber AS n FROM lineitem), LATERAL (SELECT
CASE n % 4 WHEN 0 THEN 'X' || (p // 6000)::VARCHAR || ':' || lpad((p // 100 % 60)::VARCHAR, 2, '0') || ',' || lpad((p % 100)::VARCHAR, 2, '0') WHEN 1 THEN (p // 100 % 1000)::VARCHAR || '.' || lpad((p % 100)::VARCHAR, 2, '0')
WHEN 2 THEN 'dns' ELSE (p // 6000)::VARCHAR || '''' || lpad((p // 100 % 60)::VARCHAR, 2, '0') || '''' || lpad((p % 100)::VARCHAR, 2, '0') END AS line,
CASE n % 4 WHEN 0 THEN 'exhibition' WHEN 1 THEN 'seconds' WHEN 2 THEN 'status' ELSE 'apostrophes' END AS kind, p // 6000 AS minutes,
CASE WHEN n % 4 IN (0, 3) THEN CASE WHEN p // 6000 < 1000 THEN p * 10 END WHEN n % 4 = 1 THEN (p % 100000) * 10 END AS ms FROM (SELECT round(raw::DOUBLE * 10)::BIGINT AS p))""", star=False)
def swim_time_parse(s: Star) -> DataFrame:
    """Times written in four ways and read back."""
    rows = s.raw("lineitem").select("l_extendedprice", F.col("l_linenumber").alias("n")).distinct().select(F.round(F.col("l_extendedprice") * 10).cast("long").alias("p"), "n")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minutes, seconds, hundredths = F.expr("p div 6000"), F.expr("p div 100 % 60"), F.col("p") % 100
    k = F.col("n") % 4
    line = (
        F.when(k == 0, F.concat(F.lit("X"), minutes.cast("string"), F.lit(":"), two(seconds), F.lit(","), two(hundredths)))
        .when(k == 1, F.concat(F.expr("p div 100 % 1000").cast("string"), F.lit("."), two(hundredths)))
        .when(k == 2, "dns")
        .otherwise(F.concat(minutes.cast("string"), F.lit("'"), two(seconds), F.lit("'"), two(hundredths)))
    )
    kind = F.when(k == 0, "exhibition").when(k == 1, "seconds").when(k == 2, "status").otherwise("apostrophes")
    return rows.select(line.alias("line"), kind.alias("kind"), minutes.alias("minutes"), times.time_ms(line).alias("ms"))
