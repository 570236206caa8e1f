"""Rankings, profiles, clubs and competitions: the read queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.functions import domain, text, times
from lanewise.operators import core
from lanewise.plans.star import AS_OF, AS_OF_YEAR, STAR_SQL, Star

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, star: bool = True):
    """Registers a plan under its own name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (STAR_SQL if star else "") + sql
        return f

    return add


def eligible(r: DataFrame) -> DataFrame:
    return r.where((F.col("status") == "valid") & F.col("time_ms").isNotNull())


def ranked(s: Star, distance: int | None = None, stroke: str | None = None, gender: str | None = "all", year: int | None = None, scope: str | None = "all", course: str | None = "all") -> DataFrame:
    """The best time of each athlete among the results that pass the optional filters, ranked over all.

    Dates are half-open ranges and filters stand on the scans' own columns, so they are pushed down. The global rank
    runs on one row an athlete, in buckets of a second.
    """
    start = F.col("start_date")
    period = (start >= F.lit(f"{year}-01-01").cast("date")) & (start < F.lit(f"{year + 1}-01-01").cast("date")) if year else start >= F.add_months(F.lit(AS_OF).cast("date"), -12)
    events = s.event.where(core.all_of(core.wanted(F.col("distance_m"), distance), core.wanted(F.col("stroke"), stroke), core.wanted(F.col("event_gender"), gender)))
    results = eligible(s.result).where(core.all_of(period, core.wanted(F.col("scope"), scope), core.wanted(F.col("course"), course)))
    rows = results.join(events, "event_id")
    order = [F.asc("time_ms"), F.desc_nulls_last("start_date"), F.desc("competition_id"), F.desc("event_id"), F.desc_nulls_last("club_id"), F.asc("rank_position")]
    best = core.first_by(rows, ["athlete_id"], *order).join(s.athlete, "athlete_id").join(s.club.select("club_id", "club_name"), "club_id", "left")  # names for the rows that stay
    places = [F.asc("time_ms"), F.desc_nulls_last("start_date"), F.desc("competition_id"), F.desc("event_id"), F.desc("athlete_id")]
    return core.global_rank(best, F.expr("time_ms div 1000"), *places).withColumn("category", domain.age_category(F.col("birth_year"), AS_OF_YEAR))


RANKED_SQL = f"""
, filtered AS (
  SELECT r.*, e.event_name, e.stroke, e.distance_m, e.event_gender, a.athlete_name, a.birth_year, c.club_name,
    row_number() OVER (PARTITION BY r.athlete_id ORDER BY time_ms, r.start_date DESC NULLS LAST, competition_id DESC, r.event_id DESC, r.club_id DESC NULLS LAST, rank_position) AS best
  FROM result r JOIN event e USING (event_id) JOIN athlete a ON a.athlete_id = r.athlete_id LEFT JOIN club c ON c.club_id = r.club_id
  WHERE status = 'valid' AND time_ms IS NOT NULL AND PERIOD
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY time_ms, start_date DESC NULLS LAST, competition_id DESC, event_id DESC, athlete_id DESC) AS rank,
    CASE WHEN birth_year IS NULL THEN 'Sin categoría' WHEN {AS_OF_YEAR} - birth_year < 25 THEN 'premaster'
      ELSE (({AS_OF_YEAR} - birth_year) // 5 * 5)::VARCHAR || '-' || (({AS_OF_YEAR} - birth_year) // 5 * 5 + 4)::VARCHAR END AS category
  FROM filtered WHERE best = 1
)
"""
LAST_YEAR = f"r.start_date >= DATE '{AS_OF}' - INTERVAL 1 YEAR"
SEARCH_SQL = f"translate(lower(athlete_name), '{text.SEARCH_FROM}', '{text.SEARCH_TO}')"


@query(RANKED_SQL.replace("PERIOD", LAST_YEAR) + f"SELECT rank, athlete_id, athlete_name, club_name, time_ms, competition_id, start_date, stroke, distance_m, category FROM ranked WHERE contains({SEARCH_SQL}, '00') ORDER BY rank LIMIT 100 OFFSET 100")
def ranking_best_times(s: Star) -> DataFrame:
    """Ranked, then searched, so a hit keeps its rank among all; the second page of 100."""
    found = ranked(s).where(text.token_search([F.col("athlete_name")], text.search_tokens("00")))
    return core.page(found, 2, 100, F.asc("rank")).select("rank", "athlete_id", "athlete_name", "club_name", "time_ms", "competition_id", "start_date", "stroke", "distance_m", "category")


@query(RANKED_SQL.replace("PERIOD", "r.start_date >= DATE '1999-01-01' AND r.start_date < DATE '2000-01-01' AND e.event_gender = 'women' AND scope = '5-LOW'") + "SELECT rank, athlete_id, time_ms, start_date, category FROM ranked")
def ranking_filtered(s: Star) -> DataFrame:
    return ranked(s, gender="women", year=1999, scope="5-LOW").select("rank", "athlete_id", "time_ms", "start_date", "category")


@query(RANKED_SQL.replace("PERIOD", LAST_YEAR) + "SELECT count(*)::BIGINT AS total, ceil(count(*) / 20.0)::BIGINT AS pages FROM ranked")
def ranking_page_count(s: Star) -> DataFrame:
    """A ranking has one row an athlete, so its length is the number of athletes that have an eligible result; none is ranked."""
    recent = eligible(s.result).where(F.col("start_date") >= F.add_months(F.lit(AS_OF).cast("date"), -12))
    some = recent.join(s.event.select("event_id"), "event_id", "left_semi").select("athlete_id").distinct().join(s.athlete.select("athlete_id"), "athlete_id")
    return some.agg(F.count("*").alias("total"), F.ceil(F.count("*") / 20).cast("long").alias("pages"))


@query("""SELECT DISTINCT 'distance' AS kind, distance_m::VARCHAR AS value FROM event JOIN result USING (event_id) WHERE status = 'valid' AND stroke NOT LIKE '%_relay'
UNION SELECT DISTINCT 'stroke', stroke FROM event JOIN result USING (event_id) WHERE status = 'valid' AND stroke NOT LIKE '%_relay'
UNION SELECT DISTINCT 'gender', event_gender FROM event JOIN result USING (event_id) WHERE status = 'valid' AND stroke NOT LIKE '%_relay'
UNION SELECT DISTINCT 'scope', scope FROM result WHERE status = 'valid' UNION SELECT DISTINCT 'course', course FROM result WHERE status = 'valid'
UNION SELECT DISTINCT 'year', year(start_date)::VARCHAR FROM result WHERE status = 'valid' AND start_date IS NOT NULL""")
def ranking_filter_options(s: Star) -> DataFrame:
    """All catalogues from one pass: values are exploded with their kind and made distinct together."""
    r = eligible(s.result).join(s.event, "event_id")
    single = ~F.col("stroke").like("%_relay")
    pair = lambda kind, value, when=None: F.struct(F.lit(kind).alias("kind"), (F.when(when, value) if when is not None else value).cast("string").alias("value"))
    options = F.array(
        pair("distance", F.col("distance_m"), single), pair("stroke", F.col("stroke"), single), pair("gender", F.col("event_gender"), single),
        pair("scope", F.col("scope")), pair("course", F.col("course")), pair("year", F.year("start_date")),
    )
    return r.select(F.explode(options).alias("o")).select("o.kind", "o.value").where(F.col("value").isNotNull()).distinct()


def observations(s: Star) -> DataFrame:
    """Where athletes were seen: individual results and relay legs, one shape."""
    single = s.result.where("club_id IS NOT NULL").select("athlete_id", "club_id", "competition_id", "start_date", F.lit("individual").alias("kind"), F.lit(0).alias("turn"), F.col("event_id").alias("observation_id"))
    relay = s.relay.where("club_id IS NOT NULL").select("athlete_id", "club_id", F.col("observation_id").alias("competition_id"), "start_date", F.lit("relay").alias("kind"), F.lit(1).alias("turn"), "observation_id")
    return single.unionByName(relay)


OBSERVED_SQL = """, observed AS (
  SELECT athlete_id, club_id, competition_id, start_date, 'individual' AS kind, 0 AS turn, event_id AS observation_id FROM result WHERE club_id IS NOT NULL
  UNION ALL SELECT athlete_id, club_id, observation_id, start_date, 'relay', 1, observation_id FROM relay WHERE club_id IS NOT NULL
), current AS (
  SELECT o.*, club_name FROM (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY start_date DESC NULLS LAST, competition_id DESC, turn, observation_id DESC, club_id DESC) AS rn FROM observed) o
  JOIN club USING (club_id) WHERE rn = 1
)
"""


def current_clubs(s: Star) -> DataFrame:
    order = [F.desc_nulls_last("start_date"), F.desc("competition_id"), F.asc("turn"), F.desc("observation_id"), F.desc("club_id")]
    return core.first_by(observations(s), ["athlete_id"], *order).join(s.club.select("club_id", "club_name"), "club_id")


@query(OBSERVED_SQL + "SELECT athlete_id, club_id, club_name, competition_id, start_date, kind FROM current")
def current_club(s: Star) -> DataFrame:
    return current_clubs(s).select("athlete_id", "club_id", "club_name", "competition_id", "start_date", "kind")


@query(OBSERVED_SQL + "SELECT athlete_id, count(DISTINCT club_id)::BIGINT AS n_clubs, string_agg(DISTINCT club_name, ' | ' ORDER BY club_name) AS clubs FROM observed JOIN club USING (club_id) GROUP BY athlete_id")
def historical_clubs(s: Star) -> DataFrame:
    seen = observations(s).select("athlete_id", "club_id").distinct().join(s.club.select("club_id", "club_name"), "club_id")
    return seen.groupBy("athlete_id").agg(F.countDistinct("club_id").alias("n_clubs"), F.array_join(F.array_sort(F.collect_set("club_name")), " | ").alias("clubs"))


@query(OBSERVED_SQL + """SELECT a.athlete_id, athlete_name, athlete_gender, c.club_name FROM athlete a LEFT JOIN current c USING (athlete_id)
WHERE contains(lower(athlete_name), '01') AND a.athlete_gender = 'female' AND EXISTS (SELECT 1 FROM result r WHERE r.athlete_id = a.athlete_id AND status = 'valid') ORDER BY athlete_name, athlete_id LIMIT 100""")
def athlete_list_search(s: Star) -> DataFrame:
    active = eligible(s.result).select("athlete_id").distinct()
    found = s.athlete.where(text.token_search([F.col("athlete_name")], ["01"]) & (F.col("athlete_gender") == "female")).join(active, "athlete_id", "left_semi")
    listed = found.join(current_clubs(s).select("athlete_id", "club_name"), "athlete_id", "left")
    return core.page(listed, 1, 100, F.asc("athlete_name"), F.asc("athlete_id")).select("athlete_id", "athlete_name", "athlete_gender", "club_name")


@query("""SELECT athlete_id, place, start_date, event, time_ms, status FROM (
  SELECT athlete_id, start_date, distance_m::VARCHAR || 'm ' || stroke AS event, time_ms, status,
    row_number() OVER (PARTITION BY athlete_id ORDER BY start_date DESC NULLS FIRST, distance_m, r.event_id, competition_id, time_ms, status NULLS LAST, rank_position, club_id NULLS LAST)::INTEGER AS place
  FROM result r JOIN event USING (event_id)) WHERE place <= 50""")
def athlete_recent_results(s: Star) -> DataFrame:
    """Up to 50 results an athlete, unknown dates first, as the profile shows them."""
    rows = s.result.join(s.event, "event_id").withColumn("event", F.concat(F.col("distance_m").cast("string"), F.lit("m "), F.col("stroke")))
    order = [F.desc_nulls_first("start_date"), F.asc("distance_m"), F.asc("event_id"), F.asc("competition_id"), F.asc("time_ms"), F.asc_nulls_last("status"), F.asc("rank_position"), F.asc_nulls_last("club_id")]
    return core.top_by(rows, ["athlete_id"], 50, *order).select("athlete_id", "place", "start_date", "event", "time_ms", "status")


PERSONAL_SQL = """, best AS (
  SELECT *, row_number() OVER (PARTITION BY athlete_id, distance_m, stroke, event_gender, course ORDER BY time_ms, start_date NULLS LAST, competition_id, event_id, club_id NULLS LAST, rank_position) AS rn
  FROM result JOIN event USING (event_id) WHERE status = 'valid' AND time_ms IS NOT NULL
)
"""


@query(PERSONAL_SQL + "SELECT athlete_id, distance_m, stroke, event_gender, course, time_ms, start_date, competition_name FROM best WHERE rn = 1")
def personal_bests(s: Star) -> DataFrame:
    order = [F.asc("time_ms"), F.asc_nulls_last("start_date"), F.asc("competition_id"), F.asc("event_id"), F.asc_nulls_last("club_id"), F.asc("rank_position")]
    best = core.first_by(eligible(s.result).join(s.event, "event_id"), ["athlete_id", "distance_m", "stroke", "event_gender", "course"], *order)
    return best.select("athlete_id", "distance_m", "stroke", "event_gender", "course", "time_ms", "start_date", "competition_name")


@query("""SELECT athlete_id, stroke, start_date, time_ms, place FROM (SELECT *, row_number() OVER (PARTITION BY athlete_id, stroke ORDER BY start_date, time_ms, competition_id, event_id)::INTEGER AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY athlete_id, stroke ORDER BY start_date DESC, time_ms, competition_id, event_id) AS back FROM result JOIN event USING (event_id)
  WHERE status = 'valid' AND start_date IS NOT NULL) WHERE back <= 5)""")
def trend_last5(s: Star) -> DataFrame:
    """The last five dated times of an athlete's stroke, in order of time."""
    rows = eligible(s.result).where("start_date IS NOT NULL").join(s.event, "event_id")
    last = core.top_by(rows, ["athlete_id", "stroke"], 5, F.desc("start_date"), F.asc("time_ms"), F.asc("competition_id"), F.asc("event_id"), into="back")
    place = F.row_number().over(Window.partitionBy("athlete_id", "stroke").orderBy("start_date", "time_ms", "competition_id", "event_id"))
    return last.withColumn("place", place).select("athlete_id", "stroke", "start_date", "time_ms", "place")


@query("""SELECT competition_id, event_id, athlete_id, time_ms, seed_ms, ((CASE WHEN d < 0 THEN -((5 - d) // 10) ELSE (d + 5) // 10 END) / 100)::DECIMAL(12,2) AS delta
FROM (SELECT *, nullif(time_ms, 0) - nullif(seed_ms, 0) AS d FROM result WHERE status = 'valid')""")
def seed_delta(s: Star) -> DataFrame:
    return s.result.where("status = 'valid'").select("competition_id", "event_id", "athlete_id", "time_ms", "seed_ms", times.seed_delta_seconds(F.col("time_ms"), F.col("seed_ms")).alias("delta"))


@query(OBSERVED_SQL + """SELECT club_id, club_name, city, region, CASE WHEN club_id % 5 = 0 THEN coalesce(m.members, 0) ELSE coalesce(n.athletes, 0) END::BIGINT AS n_athletes FROM club
LEFT JOIN (SELECT club_id, count(*) AS athletes FROM current GROUP BY 1) n USING (club_id)
LEFT JOIN (SELECT c_custkey % 50 AS club_id, count(*) AS members FROM customer GROUP BY 1) m USING (club_id)""")
def club_roster_counts(s: Star) -> DataFrame:
    """Members where a club keeps memberships (here: every fifth), else athletes whose current club it is: two grouped
    counts in place of correlated ones."""
    members = s.athlete.groupBy((F.col("athlete_id") % 50).alias("club_id")).agg(F.count("*").alias("members"))
    now = current_clubs(s).groupBy("club_id").agg(F.count("*").alias("athletes"))
    count = F.when(F.col("club_id") % 5 == 0, F.coalesce("members", F.lit(0))).otherwise(F.coalesce("athletes", F.lit(0)))
    return s.club.join(members, "club_id", "left").join(now, "club_id", "left").select("club_id", "club_name", "city", "region", count.cast("long").alias("n_athletes"))


ATTENDED_SQL = """, part AS (
  SELECT club_id, athlete_id, year(start_date) AS season, count(*) AS n, bool_or(coalesce(status, 'unknown') NOT IN ('dns', 'scratch')) AS attended FROM result WHERE club_id IS NOT NULL AND start_date IS NOT NULL GROUP BY ALL
  UNION ALL SELECT club_id, athlete_id, year(start_date), count(*), true FROM relay WHERE club_id IS NOT NULL GROUP BY ALL
), matrix AS (SELECT club_id, athlete_id, season::INTEGER AS season, sum(n)::BIGINT AS n, bool_or(attended) AS attended FROM part GROUP BY ALL)
"""


def attendance(s: Star) -> DataFrame:
    """Two partial aggregates, individual and relay, then one over both."""
    single = s.result.where("club_id IS NOT NULL AND start_date IS NOT NULL").groupBy("club_id", "athlete_id", F.year("start_date").alias("season")).agg(F.count("*").alias("n"), F.bool_or(domain.counted(F.col("status"))).alias("attended"))
    relay = s.relay.where("club_id IS NOT NULL").groupBy("club_id", "athlete_id", F.year("start_date").alias("season")).agg(F.count("*").alias("n"), F.lit(True).alias("attended"))
    return single.unionByName(relay).groupBy("club_id", "athlete_id", "season").agg(F.sum("n").alias("n"), F.bool_or("attended").alias("attended"))


@query(ATTENDED_SQL + "SELECT * FROM matrix")
def club_attendance_matrix(s: Star) -> DataFrame:
    return attendance(s)


@query(ATTENDED_SQL + "SELECT club_id, season, count(*)::BIGINT AS n_athletes, count(*) FILTER (WHERE attended)::BIGINT AS n_attended, (count(*) FILTER (WHERE attended) * 200 + count(*)) // (2 * count(*)) AS percent FROM matrix GROUP BY ALL")
def attendance_percent(s: Star) -> DataFrame:
    """Whole percents, halves up, in integers."""
    here = F.count_if("attended")
    return attendance(s).groupBy("club_id", "season").agg(F.count("*").alias("n_athletes"), here.alias("n_attended"), F.expr("(count_if(attended) * 200 + count(*)) div (2 * count(*))").alias("percent"))


def competitions(s: Star, search: tuple[str, str] | None = None, timeframe: str = "all", number: int = 1, size: int = 100, today: str = AS_OF) -> DataFrame:
    """A page of competitions: upcoming ones nearest first, past and all latest first; none dated last."""
    day, now = F.col("start_date"), F.lit(today).cast("date")
    hit = None if search is None else F.col("competition_name").ilike(f"%{search[0]}%") | F.col("scope").ilike(f"%{search[1]}%")
    when = {"upcoming": day >= now, "past": day < now, "all": None}[timeframe]
    order = [F.asc_nulls_last(day), F.asc("competition_id")] if timeframe == "upcoming" else [F.desc_nulls_last(day), F.desc("competition_id")]
    return core.page(s.competition.where(core.all_of(hit, when)), number, size, *order).select("competition_id", "competition_name", "start_date", "scope", "course")


@query(f"SELECT competition_id, competition_name, start_date, scope, course FROM competition WHERE (competition_name ILIKE '%1%' OR scope ILIKE '%urgent%') AND start_date < DATE '{AS_OF}' ORDER BY start_date DESC NULLS LAST, competition_id DESC LIMIT 100")
def competition_list(s: Star) -> DataFrame:
    return competitions(s, ("1", "urgent"), "past")


@query("SELECT competition_id, competition_name, start_date, scope, course FROM competition WHERE start_date >= DATE '2000-01-01' ORDER BY start_date, competition_id LIMIT 50 OFFSET 50")
def upcoming_competitions(s: Star) -> DataFrame:
    """The second page of what is to come."""
    return competitions(s, None, "upcoming", 2, 50, "2000-01-01")


@query("SELECT competition_id, competition_name, start_date, scope, course FROM competition ORDER BY start_date DESC NULLS LAST, competition_id DESC LIMIT 100")
def all_competitions(s: Star) -> DataFrame:
    return competitions(s)


@query("SELECT year(start_date)::INTEGER AS season, count(*)::BIGINT AS n FROM competition WHERE start_date IS NOT NULL GROUP BY 1")
def competition_years(s: Star) -> DataFrame:
    return s.competition.where("start_date IS NOT NULL").groupBy(F.year("start_date").alias("season")).agg(F.count("*").alias("n"))


@query("""SELECT competition_id, count(DISTINCT athlete_id) FILTER (WHERE coalesce(status, 'unknown') NOT IN ('dns', 'scratch'))::BIGINT AS n_athletes,
count(DISTINCT club_id) FILTER (WHERE coalesce(status, 'unknown') NOT IN ('dns', 'scratch'))::BIGINT AS n_clubs, count(DISTINCT event_id)::BIGINT AS n_events, count(*)::BIGINT AS n_results FROM result GROUP BY 1""")
def competition_stats(s: Star) -> DataFrame:
    on = domain.counted(F.col("status"))
    return s.result.groupBy("competition_id").agg(
        F.countDistinct(F.when(on, F.col("athlete_id"))).alias("n_athletes"), F.countDistinct(F.when(on, F.col("club_id"))).alias("n_clubs"), F.countDistinct("event_id").alias("n_events"), F.count("*").alias("n_results")
    )


@query("""SELECT competition_id, event_id, event_name, count(*)::BIGINT AS n, string_agg(rank_position::VARCHAR || ':' || time_ms::VARCHAR || ':' || coalesce(status, 'unknown'), ',' ORDER BY rank_position, time_ms, coalesce(status, 'unknown')) AS results
FROM result JOIN event USING (event_id) GROUP BY ALL""")
def competition_detail_flat(s: Star) -> DataFrame:
    """Results nested under their event: one grouped collection in place of a query for every event."""
    rows = s.result.withColumn("status", F.coalesce("status", F.lit("unknown"))).join(s.event, "event_id")
    nested = rows.groupBy("competition_id", "event_id", "event_name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank_position", "time_ms", "status"))).alias("all"))
    text_of = lambda r: F.concat_ws(":", r["rank_position"].cast("string"), r["time_ms"].cast("string"), r["status"])
    return nested.select("competition_id", "event_id", "event_name", "n", F.array_join(F.transform("all", text_of), ",").alias("results"))


@query("""SELECT row_number() OVER (ORDER BY n_results DESC, n_athletes DESC, club_name, club_id) AS rank, * FROM (
SELECT club_id, club_name, count(*) AS n_results, count(DISTINCT athlete_id) AS n_athletes, count(DISTINCT competition_id) AS n_competitions FROM result JOIN club USING (club_id)
WHERE coalesce(status, 'unknown') NOT IN ('dns', 'scratch') GROUP BY ALL)""")
def club_participation(s: Star) -> DataFrame:
    return participation(s)


def participation(s: Star, sort: str | None = None) -> DataFrame:
    """Clubs ranked by what they swam, or by name. Ranks are taken within buckets."""
    if sort not in (None, "results", "name"):
        raise ValueError(f"clubs are sorted by results or name, not {sort}")
    per = s.result.where(domain.counted(F.col("status"))).groupBy("club_id").agg(F.count("*").alias("n_results"), F.countDistinct("athlete_id").alias("n_athletes"), F.countDistinct("competition_id").alias("n_competitions"))
    named = core.settled(per.join(s.club.select("club_id", "club_name"), "club_id"))
    if sort == "name":
        ranked_ = core.global_rank(named, F.substring("club_name", 1, 12), F.asc("club_name"), F.asc("club_id"))
    else:
        order = [F.desc("n_results"), F.desc("n_athletes"), F.asc("club_name"), F.asc("club_id")]
        ranked_ = core.global_rank(named, -F.expr("length(bin(n_results))"), *order)  # buckets: powers of two of the first key
    return ranked_.select(F.col("rank").cast("long").alias("rank"), "club_id", "club_name", "n_results", "n_athletes", "n_competitions")


@query("""SELECT row_number() OVER (ORDER BY club_name, club_id) AS rank, * FROM (
SELECT club_id, club_name, count(*) AS n_results, count(DISTINCT athlete_id) AS n_athletes, count(DISTINCT competition_id) AS n_competitions FROM result JOIN club USING (club_id)
WHERE coalesce(status, 'unknown') NOT IN ('dns', 'scratch') GROUP BY ALL)""")
def club_participation_by_name(s: Star) -> DataFrame:
    return participation(s, "name")


@query("""SELECT scope, club_id, club_name, count(*) AS n_results, count(DISTINCT athlete_id) AS n_athletes, sum(coalesce(points, 0))::DECIMAL(20,2) AS points,
count(*) FILTER (WHERE rank_position = 1) AS first, count(*) FILTER (WHERE rank_position = 2) AS second, count(*) FILTER (WHERE rank_position = 3) AS third FROM result LEFT JOIN club USING (club_id) GROUP BY ALL""")
def club_medal_table(s: Star) -> DataFrame:
    place = lambda n: F.count_if(F.col("rank_position") == n)
    per = s.result.groupBy("scope", "club_id").agg(
        F.count("*").alias("n_results"), F.countDistinct("athlete_id").alias("n_athletes"), F.sum(F.coalesce("points", F.lit(0).cast("decimal(10,2)"))).cast("decimal(20,2)").alias("points"),
        place(1).alias("first"), place(2).alias("second"), place(3).alias("third"),
    )
    return per.join(s.club.select("club_id", "club_name"), "club_id", "left").select("scope", "club_id", "club_name", "n_results", "n_athletes", "points", "first", "second", "third")


@query("SELECT club_id, club_name, athlete_id, athlete_name, min(start_date) AS first_seen, max(start_date) AS last_seen, coalesce(max(birth_year), min(1900)) AS birth_year FROM result JOIN club USING (club_id) JOIN athlete USING (athlete_id) GROUP BY ALL")
def athletes_by_club(s: Star) -> DataFrame:
    per = s.result.where("club_id IS NOT NULL").groupBy("club_id", "athlete_id").agg(F.min("start_date").alias("first_seen"), F.max("start_date").alias("last_seen"))
    return per.join(s.club, "club_id").join(s.athlete, "athlete_id").select("club_id", "club_name", "athlete_id", "athlete_name", "first_seen", "last_seen", F.coalesce("birth_year", F.lit(1900)).alias("birth_year"))


@query("""SELECT event_id, event_name, athlete_id, time_ms, place FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY time_ms NULLS LAST, athlete_id, competition_id, rank_position, club_id NULLS LAST)::INTEGER AS place
FROM result JOIN event USING (event_id) WHERE status = 'valid') WHERE place <= 10""")
def event_ranking(s: Star) -> DataFrame:
    rows = eligible(s.result).join(s.event, "event_id")
    return core.top_by(rows, ["event_id"], 10, F.asc("time_ms"), F.asc("athlete_id"), F.asc("competition_id"), F.asc("rank_position"), F.asc_nulls_last("club_id")).select("event_id", "event_name", "athlete_id", "time_ms", "place")


@query("SELECT club_id, club_name, athlete_id, observation_id, start_date, team, leg_order, time_ms FROM relay JOIN club USING (club_id)")
def relay_results_by_club(s: Star) -> DataFrame:
    return s.relay.join(s.club, "club_id").select("club_id", "club_name", "athlete_id", "observation_id", "start_date", "team", "leg_order", "time_ms")


@query("""SELECT 'individual' AS kind, athlete_id, athlete_name, start_date, club_id, NULL::INTEGER AS leg_order, time_ms, status FROM result JOIN athlete USING (athlete_id)
UNION ALL SELECT 'relay', athlete_id, athlete_name, start_date, club_id, leg_order, time_ms, NULL FROM relay JOIN athlete USING (athlete_id)""")
def activity_union(s: Star) -> DataFrame:
    single = s.result.select(F.lit("individual").alias("kind"), "athlete_id", "start_date", "club_id", F.lit(None).cast("int").alias("leg_order"), "time_ms", "status")
    relay = s.relay.select(F.lit("relay").alias("kind"), "athlete_id", "start_date", "club_id", "leg_order", "time_ms", F.lit(None).cast("string").alias("status"))
    return single.unionByName(relay).join(s.athlete.select("athlete_id", "athlete_name"), "athlete_id")


@query("SELECT lower(regexp_replace(trim(event_name), '\\s+', ' ', 'g')) AS name_key, count(*)::BIGINT AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM event GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(s: Star) -> DataFrame:
    groups = s.event.groupBy(text.collapse(F.col("event_name")).alias("name_key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("event_id")).alias("ids"))
    return groups.where("n > 1").select("name_key", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("""SELECT competition_id, competition_name, latest.time_ms AS latest_ms, latest.event_id AS latest_event FROM competition c LEFT JOIN LATERAL (
SELECT time_ms, event_id FROM result r WHERE r.competition_id = c.competition_id AND r.status = 'valid' ORDER BY rank_position DESC, time_ms DESC, event_id DESC LIMIT 1) latest ON true""")
def latest_document_lateral(s: Star) -> DataFrame:
    last = core.first_by(s.result.where("status = 'valid'"), ["competition_id"], F.desc("rank_position"), F.desc("time_ms"), F.desc("event_id"))
    return s.competition.join(last.select("competition_id", "time_ms", "event_id"), "competition_id", "left").select("competition_id", "competition_name", F.col("time_ms").alias("latest_ms"), F.col("event_id").alias("latest_event"))


@query("SELECT competition_id, event_id, rank_position, (CASE WHEN rank_position BETWEEN 1 AND 8 THEN [9, 7, 6, 5, 4, 3, 2, 1][rank_position] END)::DECIMAL(10,2) AS expected, (CASE WHEN rank_position BETWEEN 1 AND 8 THEN 2 * [9, 7, 6, 5, 4, 3, 2, 1][rank_position] END)::DECIMAL(10,2) AS expected_relay FROM result")
def expected_points(s: Star) -> DataFrame:
    rank = F.col("rank_position")
    return s.result.select("competition_id", "event_id", "rank_position", domain.expected_points(rank).alias("expected"), domain.expected_points(rank, True).alias("expected_relay"))


@query(f"""SELECT category, count(*)::BIGINT AS n, min(birth_year) AS youngest_from, max(birth_year) AS to_year FROM (SELECT birth_year, CASE WHEN birth_year IS NULL THEN 'Sin categoría' WHEN {AS_OF_YEAR} - birth_year < 25 THEN 'premaster'
ELSE (({AS_OF_YEAR} - birth_year) // 5 * 5)::VARCHAR || '-' || (({AS_OF_YEAR} - birth_year) // 5 * 5 + 4)::VARCHAR END AS category FROM athlete) GROUP BY 1""")
def age_category(s: Star) -> DataFrame:
    return s.athlete.groupBy(domain.age_category(F.col("birth_year"), AS_OF_YEAR).alias("category")).agg(F.count("*").alias("n"), F.min("birth_year").alias("youngest_from"), F.max("birth_year").alias("to_year"))

