"""Relay line-ups: rosters, best times, the best groups of four, best order of each, and disjoint choices.

Clubs are many. Windows cut each roster to those who can be in one of its best line-ups at all, a number that doesn't grow
with the club; the search among these (`lineups`) and what is chosen from it, out of all their groups or category by category, run
in one function, one club a row, so that candidates never leave their task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.functions import domain
from lanewise.operators import core
from lanewise.plans import lineups
from lanewise.plans.results import current_clubs, eligible
from lanewise.plans.star import AS_OF_YEAR, STAR_SQL, Star

QUERIES: dict = {}
ORACLES: dict = {}
PER_CATEGORY, ALTERNATIVES = 40, 5
#: Found rows that a task holds before it hands them on.
ROWS = 20_000
GENDER_RULES = ("mixed", "women", "men")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = STAR_SQL + sql
        return f

    return add


def best_times(results: DataFrame, keys: list[str] = ["athlete_id", "stroke"]) -> DataFrame:  # noqa: B006
    return results.where("time_ms IS NOT NULL").groupBy(*keys).agg(F.min("time_ms").alias("best_ms"))


_LINE_UP = "club_id bigint, category string, age_sum int, total_ms bigint, ids array<bigint>"


def _searched(roster: DataFrame, style: str, rule: str, most: int, search: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """What search(ids, female, age, times by position) finds in each club, behind its club_id.

    roster: club_id, athlete_id, athlete_gender, age, times (map stroke -> ms). Who is behind `most` others of the same gender and age
    in each place is left out.
    """
    strokes = domain.RELAY_STROKES[style]
    places = list(dict.fromkeys(strokes))
    genders = {"mixed": ("female", "male"), "women": ("female",), "men": ("male",)}[rule]
    own = [f"_{n}" for n in range(len(places))]
    able = roster.where(F.col("age").isNotNull() & F.col("athlete_gender").isin(*genders)).select(
        "club_id", "athlete_id", F.col("athlete_gender").eqNullSafe(F.lit("female")).alias("female"), F.col("age").cast("int").alias("age"), *[F.try_element_at("times", F.lit(k)).cast("long").alias(c) for c, k in zip(own, places)]
    )
    behind = lambda c: F.row_number().over(Window.partitionBy("club_id", "female", "age").orderBy(F.asc_nulls_last(c), "athlete_id"))
    ranked = able.withColumns({f"{c}_place": behind(c) for c in own})
    near = [F.col(c).isNotNull() & (F.col(f"{c}_place") <= most) for c in own]
    some = ranked.where(reduce(lambda a, b: a | b, near)).withColumns({c: F.coalesce(c, F.lit(lineups._NEVER)) for c in own})
    # a club is one row, dealt out whatever its bytes: few bytes take long
    dealt = some.repartition(int(roster.sparkSession.conf.get("spark.sql.shuffle.partitions")), "club_id")
    clubs = dealt.groupBy("club_id").agg(F.collect_list(F.struct("athlete_id", "female", "age", *own)).alias("c"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for club_id, ids, female, age, *own_times in batch.itertuples(index=False, name=None):
                times = np.stack([np.asarray(own_times[places.index(k)], np.int64) for k in strokes])
                out += [(club_id, *row) for row in search(np.asarray(ids, np.int64), np.asarray(female, bool), np.asarray(age, np.int64), times)]
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return clubs.select("club_id", "c.athlete_id", "c.female", "c.age", *[f"c.{c}" for c in own]).mapInPandas(run, schema)


def _placed(found: list[tuple]) -> list[tuple]:
    """Line-ups, best first in each category, with their place in it."""
    return [(*row, n) for _, rows in groupby(found, key=lambda r: r[0]) for n, row in enumerate(rows, 1)]


def candidates(roster: DataFrame, style: str, rule: str, categories: list[str] | None = None) -> DataFrame:
    """Up to PER_CATEGORY line-ups of each club and category: club_id, category, place, ids (by position), total_ms,
    age_sum.

    roster: club_id, athlete_id, athlete_gender, age, times (map stroke -> ms). Groups are taken in order of athlete_id;
    of a group's 24 orders the first with the least total counts, and of groups with equal totals the one with least ids.
    """

    def search(*club) -> list[tuple]:
        return _placed(lineups.line_ups(*club, rule, categories, PER_CATEGORY))

    return _searched(roster, style, rule, PER_CATEGORY + 3, search, f"{_LINE_UP}, place int")


def choose_disjoint(line_ups: pd.DataFrame) -> list[int]:
    """The labels of the line-ups (category, place, ids, total_ms) to swim: as many categories as possible, then the least total, no athlete twice; of equals the
    one that leaves out earlier categories, then the one with better places in them."""
    rows = line_ups.sort_values("place", kind="stable")
    parts = [part for key, *_ in domain.RELAY_CATEGORIES if len(part := rows[rows["category"] == key])]
    if not parts:
        return []
    athletes, members = np.unique(np.concatenate([np.stack(part["ids"]) for part in parts]), return_inverse=True)
    groups = np.split(members.reshape(-1, 4), np.cumsum([len(part) for part in parts])[:-1])
    lists = [(part["total_ms"].to_numpy(np.int64) * lineups.GRAIN, own) for part, own in zip(parts, groups)]
    for count in range(min(len(lists), len(athletes) // 4), 0, -1):
        if found := lineups.choose(lists, count, len(athletes), sum(int(t.max()) for t, _ in lists) + 1, lineups.GRAIN):
            return [part.index[p] for part, p in zip(parts, found[1]) if p >= 0]
    return []


def proposals(line_ups: DataFrame) -> DataFrame:
    """The line-ups of each club to swim, chosen of those given."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        return part.loc[choose_disjoint(part), ["club_id", "category", "ids", "total_ms", "age_sum"]]

    return line_ups.groupBy("club_id").applyInPandas(run, "club_id bigint, category string, ids array<bigint>, total_ms bigint, age_sum int")


def proposed(roster: DataFrame, style: str, rule: str) -> DataFrame:
    """The line-ups of each club to swim, chosen out of all that its roster can form, in the task that forms them."""
    # a line-up of every category takes 28 athletes, so whoever is behind 28 others of the same gender and age in each place is in none
    most = 4 * len(domain.RELAY_CATEGORIES)
    return _searched(roster, style, rule, most, lambda *club: lineups.disjoint(*club, rule), _LINE_UP).select("club_id", "category", "ids", "total_ms", "age_sum")


def validation(legs: Column, rule: str) -> Column:
    """Errors of a line-up given as an array of (athlete_id, gender, age, time_ms)."""
    n = lambda g: F.size(F.filter(legs, lambda x: x["gender"] == g))
    ids = F.filter(F.transform(legs, lambda x: x["athlete_id"]), lambda i: i.isNotNull())
    ages = F.aggregate(legs, F.lit(0), lambda a, x: a + x["age"].cast("int"))
    right = {"mixed": (n("female") == 2) & (n("male") == 2), "women": n("female") == 4, "men": n("male") == 4}[rule]
    tests = {
        "not four legs": F.size(ids) != 4,
        "athlete twice": F.size(F.array_distinct(ids)) != F.size(ids),
        "time missing": F.exists(legs, lambda x: x["time_ms"].isNull()),
        "age missing": F.exists(legs, lambda x: x["age"].isNull()),
        "genders": ~right,
        "no category": ages.isNotNull() & domain.relay_category(ages).isNull(),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))


# --- registered forms: strokes of the star table stand for the four strokes

STAR_STROKES = {"economy": "backstroke", "large": "breaststroke", "medium": "butterfly", "promo": "freestyle"}
STROKE_CASE = "CASE stroke " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAR_STROKES.items()) + " END"


def star_roster(s: Star) -> DataFrame:
    """Athletes of each club (current club) with their best times."""
    mapped = F.coalesce(*[F.when(F.col("stroke") == k, v) for k, v in STAR_STROKES.items()])
    timed = eligible(s.result).join(s.event, "event_id").withColumn("stroke", mapped).where("stroke IS NOT NULL")
    times = best_times(timed).groupBy("athlete_id").agg(F.map_from_entries(F.collect_list(F.struct("stroke", "best_ms"))).alias("times"))
    people = current_clubs(s).select("athlete_id", "club_id").join(s.athlete, "athlete_id").withColumn("age", F.lit(AS_OF_YEAR) - F.col("birth_year"))
    return people.join(times, "athlete_id").select("club_id", "athlete_id", "athlete_gender", "age", "times")


@query(f"""SELECT athlete_id, {STROKE_CASE} AS stroke, min(time_ms) AS best_ms FROM result JOIN event USING (event_id) WHERE status = 'valid' AND {STROKE_CASE} IS NOT NULL GROUP BY ALL""")
def relay_best_times(s: Star) -> DataFrame:
    mapped = F.coalesce(*[F.when(F.col("stroke") == k, v) for k, v in STAR_STROKES.items()])
    return best_times(eligible(s.result).join(s.event, "event_id").withColumn("stroke", mapped).where("stroke IS NOT NULL"))


@query(f"""SELECT category, min(age_sum)::INTEGER AS least, max(age_sum)::INTEGER AS most, count(*)::BIGINT AS n FROM (SELECT a + b AS age_sum, CASE WHEN a + b BETWEEN 80 AND 96 THEN 'premaster' WHEN a + b BETWEEN 100 AND 119 THEN '100-119'
WHEN a + b BETWEEN 120 AND 159 THEN '120-159' WHEN a + b BETWEEN 160 AND 199 THEN '160-199' WHEN a + b BETWEEN 200 AND 239 THEN '200-239' WHEN a + b BETWEEN 240 AND 279 THEN '240-279' WHEN a + b BETWEEN 280 AND 319 THEN '280-319' END AS category
FROM (SELECT ({AS_OF_YEAR} - birth_year) * 2 AS a, athlete_id % 200 AS b FROM athlete WHERE birth_year IS NOT NULL)) GROUP BY 1""")
def relay_categories(s: Star) -> DataFrame:
    """Categories of age sums; sums between and outside the bands have none."""
    sums = s.athlete.where("birth_year IS NOT NULL").select(((F.lit(AS_OF_YEAR) - F.col("birth_year")) * 2 + F.col("athlete_id") % 200).cast("int").alias("age_sum"))
    return sums.groupBy(domain.relay_category(F.col("age_sum")).alias("category")).agg(F.min("age_sum").alias("least"), F.max("age_sum").alias("most"), F.count("*").alias("n"))


@query()
def relay_lineups(s: Star) -> DataFrame:
    """Medley mixed line-ups chosen for each club, out of all groups. A search has no SQL; tests hold it against all choices of small rosters."""
    return proposed(star_roster(s), "medley", "mixed").withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query()
def relay_alternatives(s: Star) -> DataFrame:
    """The five best line-ups of each club and category, freestyle women."""
    found = candidates(star_roster(s), "freestyle", "women").where(F.col("place") <= ALTERNATIVES)
    return found.select("club_id", "category", "place", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), "total_ms", "age_sum")


# --- rosters and proposals beyond one call


def by_ids(roster: DataFrame, ids: DataFrame) -> DataFrame:
    """The roster's athletes of the given ids."""
    return roster.join(core.small_side(ids.select("athlete_id").distinct()), "athlete_id", "left_semi")


def with_known_times(athletes: DataFrame, best: DataFrame) -> DataFrame:
    """athletes (name_key, gender, birth_year, times, athlete_id, ...) with the known best times (name_key, gender, birth_year,
    stroke, ms, athlete_id) in place of those they came with; a stroke without a known time has none."""
    keys = ["name_key", "gender", "birth_year"]
    known = best.where("ms IS NOT NULL").groupBy(*keys, "stroke").agg(F.min_by(F.struct("ms", "athlete_id"), "ms").alias("b"))
    held = known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("stroke", "b.ms"))).alias("_times"), F.max("b.athlete_id").alias("_id"))
    a, h = athletes.alias("a"), held.alias("h")
    same = core.all_of(*[F.col(f"a.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys])
    new = {"times": F.coalesce("h._times", F.create_map().cast("map<string,bigint>")), "athlete_id": F.coalesce("h._id", "a.athlete_id")}
    return a.join(h, same, "left").select(*[new[c].alias(c) if c in new else F.col(f"a.{c}") for c in athletes.columns])


def unassigned(roster: DataFrame, line_ups: DataFrame) -> DataFrame:
    """The roster's athletes who swim in no line-up of their club."""
    swims = line_ups.select("club_id", F.explode("ids").alias("athlete_id")).distinct()
    return roster.join(swims, ["club_id", "athlete_id"], "left_anti")


def cross_errors(line_ups: DataFrame, unavailable: DataFrame) -> DataFrame:
    """line_ups (club_id, relay, category, ids) with what is wrong between them: an athlete in two of them, one who isn't
    available, two of one category."""
    legs = line_ups.select("club_id", "relay", F.explode("ids").alias("athlete_id"))
    often = legs.groupBy("club_id", "athlete_id").agg(F.countDistinct("relay").alias("n"))
    away = core.small_side(unavailable.select("athlete_id").distinct().withColumn("_away", F.lit(True)))
    per = legs.join(often, ["club_id", "athlete_id"]).join(away, "athlete_id", "left").groupBy("club_id", "relay").agg(F.max(F.col("n") > 1).alias("_twice"), F.bool_or(F.coalesce("_away", F.lit(False))).alias("_away"))
    same = line_ups.groupBy("club_id", "category").agg(F.count("*").alias("_same"))
    joined = line_ups.join(per, ["club_id", "relay"], "left").join(same, ["club_id", "category"], "left")
    tests = {"athlete in two relays": F.col("_twice"), "athlete not available": F.col("_away"), "category twice": F.col("_same") > 1}
    errors = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))
    return joined.select(*[F.col(c) for c in line_ups.columns], errors.alias("errors"))


def greedy(roster: DataFrame, style: str, rule: str, order: list[str], fixed: DataFrame | None = None) -> DataFrame:
    """The line-ups of each club category by category, in the given order: the best of those athletes that no fixed and no
    earlier relay has. Not the choice with most relays (proposals is), but the one that a person steps through."""
    # an earlier relay takes four athletes, so of those of one gender and age and their times four a relay are enough
    def search(ids, female, age, times) -> list[tuple]:
        out = []
        for category in order:
            best = lineups.line_ups(ids, female, age, times, rule, [category], 1)
            left = ~np.isin(ids, [i for *_, line_up in best for i in line_up])
            ids, female, age, times = ids[left], female[left], age[left], times[:, left]
            out += best
        return out

    left = roster if fixed is None else unassigned(roster, fixed)
    return _searched(left, style, rule, 4 * len(order), search, _LINE_UP).select("club_id", "category", "ids", "total_ms", "age_sum")


def responses(roster: DataFrame, line_ups: DataFrame) -> DataFrame:
    """(club_id, response): what a club is told, as JSON: its line-ups and who swims in none."""
    idle = unassigned(roster, line_ups).groupBy("club_id").agg(F.array_sort(F.collect_list("athlete_id")).alias("unassigned"))
    lined = line_ups.groupBy("club_id").agg(F.array_sort(F.collect_list(F.struct("category", "total_ms", "age_sum", "ids"))).alias("proposal"))
    both = roster.select("club_id").distinct().join(lined, "club_id", "left").join(idle, "club_id", "left")
    return both.select("club_id", F.to_json(F.struct(F.coalesce("proposal", F.array().cast("array<struct<category:string,total_ms:bigint,age_sum:int,ids:array<bigint>>>")).alias("proposal"), F.coalesce("unassigned", F.array().cast("array<bigint>")).alias("unassigned"))).alias("response"))


def distances(events: DataFrame, stroke: str | None) -> DataFrame:
    """The distances that may be chosen beside a stroke."""
    return events.where(core.all_of(core.wanted(F.col("stroke"), stroke))).select("distance_m").distinct()


@query()
def greedy_relays(s: Star) -> DataFrame:
    """Freestyle men category by category. Tests hold it against a plain search."""
    found = greedy(star_roster(s), "freestyle", "men", ["160-199", "200-239", "120-159"])
    return found.select("club_id", "category", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), "total_ms", "age_sum")
