"""What reviewed decisions do to identities: keys, corrections, rules, links and the guards before any of it is applied.

Decision tables are small next to the rows they are applied to, but nothing relies on it: every application is an equi-join
that is broadcast behind a count, and every guard is a table of what stands against the decisions, empty if nothing does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.functions import domain, similarity, text
from lanewise.functions.times import let
from lanewise.operators import core
from lanewise.plans.identity import tokens
from lanewise.plans.star import STAR_SQL, Star

QUERIES: dict = {}
ORACLES: dict = {}

# Words that say nothing of a club, number words, particles of names, scores and their labels.
GENERIC_WORDS = "club master masters swim swimming team natacion de del la las los".split()
NUMBER_WORDS = {"100": "cien"}
PARTICLES = "da das de del do dos e la las los y".split()
EXACT_SCORE, SIMILAR_SCORE = 0.98, 0.82
CONFIDENCE = {"high": 1.0, "medium": 0.85, "review": 0.75}
WRAPPED_LINES = 8


def query(sql: str | None = None, star: bool = True):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (STAR_SQL if star else "") + sql
        return f

    return add


# --- keys and names


def plain_key(c: Column) -> Column:
    """Small letters and digits without accents, single spaces; null if none."""
    return F.nullif(F.array_join(tokens(c), " "), F.lit(""))


def club_similarity_key(c: Column) -> Column:
    """The words of a club's name that tell it from others; all of them, if none does."""
    words = F.filter(tokens(c), lambda w: ~w.isin(*GENERIC_WORDS))
    spelled = F.transform(words, lambda w: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv]), w), w))
    return F.coalesce(F.nullif(F.array_join(spelled, " "), F.lit("")), plain_key(c))


def canonical_clubs(clubs: DataFrame, aliases: DataFrame, name: str = "club_name") -> DataFrame:
    """clubs with canonical_key: the alias of the name's key, else of the key without a one-letter end, else that key."""
    a = core.small_side(aliases.select(plain_key(F.col("alias_name")).alias("k"), plain_key(F.col("canonical_name")).alias("to")).where("k IS NOT NULL").groupBy("k").agg(F.min("to").alias("to")))
    keyed = clubs.withColumn("_own", plain_key(F.col(name))).withColumn("_squad", F.regexp_replace("_own", " [a-z]$", ""))
    first = keyed.join(a.select(F.col("k").alias("_own"), F.col("to").alias("_a")), "_own", "left")
    second = first.join(a.select(F.col("k").alias("_squad"), F.col("to").alias("_b")), "_squad", "left")
    return second.withColumn("canonical_key", F.coalesce("_a", "_b", "_squad")).select(*clubs.columns, "canonical_key")


def birth_year(c: Column) -> Column:
    """`1985` or `1985.0`; ranges and other text have none."""
    return F.nullif(F.regexp_extract(F.trim(c.cast("string")), r"^(\d{4})(?:\.0)?$", 1), F.lit("")).try_cast("int")


def _without_note(c: Column) -> Column:
    """A name without the note in brackets, closed or not, that it ends with."""
    body = F.when(c.endswith(")"), F.left(c, F.length(c) - 1)).otherwise(c)
    last = F.substring_index(body, ")", -1)
    at = F.instr(last, " (")
    return F.when(at > 0, F.rtrim(F.left(body, F.length(body) - F.length(last) + at - 1))).otherwise(c)


def surname_first(c: Column) -> Column:
    """`Surname, Given` of a name in the order of speech: the surname is the last word and the particles before it (de, del, de la),
    found by a fold over the words from the end; the first word is always given. Names with a comma or a digit stay as they are;
    a note in brackets at the end goes."""

    def step(s: Column, w: Column) -> Column:
        taken = F.when(s["waits"] & (w == "de"), s["taken"] + 2).when(s["open"] & w.isin("de", "del"), s["taken"] + 1).otherwise(s["taken"])
        return F.struct(taken.alias("taken"), F.lit(False).alias("open"), (s["open"] & (w == "la")).alias("waits"))

    def ordered(words: Column) -> Column:
        n = F.size(words)
        start = F.struct(F.lit(1).alias("taken"), F.lit(True).alias("open"), F.lit(False).alias("waits"))
        before = F.transform(F.reverse(F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0)))), F.lower)
        taken = F.aggregate(before, start, step, lambda s: s["taken"])
        join = lambda k: F.concat(F.array_join(F.slice(words, n - k + 1, k), " "), F.lit(", "), F.array_join(F.slice(words, F.lit(1), n - k), " "))
        return F.when(n > 1, let(taken, join))

    def of(bare: Column) -> Column:
        words = F.filter(F.split(bare, r"[^\p{L}]+"), lambda w: w != "")
        given = F.contains(bare, F.lit(",")) | (F.translate(bare, "0123456789", "") != bare)
        return F.when(given, bare).otherwise(F.coalesce(let(words, ordered), bare))

    clean = text.blank_to_null(F.regexp_replace(c, r"\s+", " "))
    return let(clean, lambda t: let(F.when(F.contains(t, F.lit(",")), t).otherwise(_without_note(t)), of))


def person_case(c: Column) -> Column:
    """Words with a capital, particles without: one fold over the letters, a word being cased where it ends."""
    cased = lambda w: F.when(w.isin(*PARTICLES), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w))))

    def step(s: Column, x: Column) -> Column:
        letter = F.upper(x) != F.lower(x)
        return F.when(letter, F.struct(s["done"].alias("done"), F.concat(s["word"], x).alias("word"))).otherwise(F.struct(F.concat(s["done"], cased(s["word"]), x).alias("done"), F.lit("").alias("word")))

    letters = F.split(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("word"))
    return F.nullif(F.aggregate(letters, start, step, lambda s: F.concat(s["done"], cased(s["word"]))), F.lit(""))


def preferred_name(left: Column, right: Column, surname_left_out: Column) -> Column:
    """The fuller of two names of one person: more words in the surname, or else in the given name; the left one on a tie."""
    side = lambda c, k: F.size(tokens(F.split_part(c, F.lit(","), F.lit(k))))
    return F.when(F.when(surname_left_out, side(left, 1) >= side(right, 1)).otherwise(side(left, 2) >= side(right, 2)), left).otherwise(right)


# --- decisions and rules


def merge_decisions(decisions: DataFrame) -> DataFrame:
    """(old_name, new_name, gender, birth_year) of the rows that decide to merge, whichever of the two shapes names the sides:
    left and right with the canonical one of them, or shorter and longer."""
    d = decisions.where(F.lower(F.trim("decision")) == "merge")
    shaped = F.when(
        text.blank_to_null(F.col("canonical_name")).isNotNull(),
        F.struct(F.when(F.col("canonical_name") == F.col("left_name"), F.col("right_name")).otherwise(F.col("left_name")).alias("old_name"), F.col("canonical_name").alias("new_name")),
    ).otherwise(F.struct(F.col("shorter_name").alias("old_name"), F.col("longer_name").alias("new_name")))
    return d.select(shaped.alias("s"), "gender", "birth_year").select("s.*", "gender", "birth_year").where("old_name IS NOT NULL AND new_name IS NOT NULL AND old_name <> new_name").distinct()


def unlocked_rules(rules: DataFrame) -> DataFrame:
    """Rules (old_key, new_name, new_key, birth_year, gender, club_key) that hold for any club, because every club has the
    same replacement."""
    to = F.collect_set(F.struct("new_name", "new_key"))
    return rules.groupBy("old_key", "birth_year", "gender").agg(to.alias("to")).where(F.size("to") == 1).select("old_key", F.col("to")[0]["new_name"].alias("new_name"), F.col("to")[0]["new_key"].alias("new_key"), "birth_year", "gender", F.lit("").alias("club_key"))


def with_years(rows: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose known birth year is corrected where the table has another one for their keys; unknown years stay."""
    c = core.small_side(corrections.select(*keys, F.col("preferred_year").alias("_year")).dropDuplicates(keys))
    return rows.join(c, keys, "left").withColumn("birth_year", F.when(F.col("birth_year").isNotNull(), F.coalesce("_year", "birth_year"))).select(*rows.columns)


def with_missing_years(rows: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """rows without a birth year with name and year of their one candidate; several different names decide nothing."""
    one = candidates.where("birth_year IS NOT NULL").groupBy(key).agg(F.collect_set("name").alias("names"), F.min("birth_year").alias("_year")).where(F.size("names") == 1)
    joined = rows.join(one.select(key, F.col("names")[0].alias("_name"), "_year"), key, "left")
    fill = F.col("birth_year").isNull() & F.col("_year").isNotNull()
    return joined.withColumn("name", F.when(fill, F.col("_name")).otherwise(F.col("name"))).withColumn("birth_year", F.coalesce("birth_year", "_year")).select(*rows.columns)


def without_excluded(results: DataFrame, exclusions: DataFrame, keys: list[str]) -> DataFrame:
    """results without those that a review took out, keys being compared null-safe."""
    return core.missing_from(results, exclusions, keys)


def with_events(results: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """results with the event that a review gave them; keys hold the old event, of several rules the first counts."""
    first = core.first_by(corrections, keys, F.asc("rule_order"))
    r, c = results.alias("r"), core.small_side(first.select(*keys, F.col("new_event_name").alias("_new"))).alias("c")
    same = core.all_of(*[F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    return r.join(c, same, "left").select(*[F.coalesce("c._new", "r.event_name").alias(n) if n == "event_name" else F.col(f"r.{n}") for n in results.columns])


def valid_legs(swimmers: DataFrame) -> DataFrame:
    return swimmers.where(F.col("leg_order").try_cast("int").between(1, 4))


def with_wrapped_team(swimmers: DataFrame, teams: DataFrame) -> DataFrame:
    """swimmers (document, page_number, line_number, team) of whose team a line break left a part only, with its whole name:
    those within WRAPPED_LINES lines below a line of teams (document, page_number, line_number, part, team)."""
    t = teams.select("document", "page_number", F.col("part").alias("team"), F.col("line_number").alias("_at"), F.col("team").alias("_whole"))
    near = t.withColumn("line_number", F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + WRAPPED_LINES)))
    last = core.first_by(near, ["document", "page_number", "team", "line_number"], F.desc("_at"), F.asc("_whole"))
    joined = swimmers.join(last, ["document", "page_number", "team", "line_number"], "left")
    return joined.withColumn("team", F.coalesce("_whole", "team")).select(*swimmers.columns)


def synced_athletes(athletes: DataFrame, results: DataFrame, rules: DataFrame) -> DataFrame:
    """athletes (name_key, club_key, birth_year, gender, full_name, ...) renamed by the first rule that leads to an identity
    which the surviving results (name_key, club_key, birth_year, gender) show with one gender; they take that gender too."""
    keys = ["name_key", "club_key", "birth_year"]
    seen = results.where(core.all_of(*[F.col(k).isNotNull() for k in keys]) & F.col("gender").isin("female", "male")).groupBy(*keys).agg(F.collect_set("gender").alias("g")).where(F.size("g") == 1)
    shown = seen.select(F.col("name_key").alias("new_key"), "club_key", "birth_year", F.col("g")[0].alias("shown"))
    r = rules.select("rule_order", F.col("old_key").alias("name_key"), "new_key", "new_name", "birth_year", F.nullif(F.col("gender"), F.lit("")).alias("rule_gender"), F.nullif(F.col("club_key"), F.lit("")).alias("rule_club"))
    rows = athletes.withColumn("_row", F.struct(*athletes.columns))
    fits = rows.dropDuplicates(athletes.columns).join(core.small_side(r), ["name_key", "birth_year"]).where("rule_club IS NULL OR rule_club = club_key")
    led = fits.join(shown, ["new_key", "club_key", "birth_year"]).where("rule_gender IS NULL OR rule_gender = shown")
    first = core.first_by(led, ["_row"], F.asc("rule_order"), F.asc("new_key"), F.asc("new_name")).select(F.col("_row").alias("_of"), "new_name", "new_key", "shown")
    joined = rows.join(first, rows["_row"] == first["_of"], "left")
    done = F.col("new_key").isNull() | ((F.col("name_key") == F.col("new_key")) & F.col("gender").eqNullSafe(F.col("shown")))
    return joined.select(*[F.when(done, F.col(c)).otherwise(F.col({"full_name": "new_name", "gender": "shown"}.get(c, c))).alias(c) for c in athletes.columns])


def pruned_merges(athletes: DataFrame, merged: DataFrame, *order: Column) -> DataFrame:
    """athletes (name_key, birth_year, gender, ...) with one row of each identity that a reviewed merge names, the first."""
    keys = merged.select(F.col("name_key").alias("k"), F.col("birth_year").alias("y"), F.nullif(F.col("gender"), F.lit("")).alias("g")).distinct()
    fits = (F.col("name_key") == F.col("k")) & (F.col("birth_year") == F.col("y")) & domain.compatible(F.col("gender"), F.col("g"))
    named = core.first_by(athletes.join(core.small_side(keys), fits, "left_semi"), ["name_key", "birth_year", "gender"], *order)
    return named.unionByName(athletes.join(core.small_side(keys), fits, "left_anti"))


# --- evidence


def observations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sources and tables that show each identity, sorted and joined, with how often."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    return rows.groupBy(*keys).agg(listed("source").alias("sources"), listed("table_name").alias("tables"), F.count("*").alias("n"))


def reason_counts(rows: DataFrame, reasons: str = "reasons") -> DataFrame:
    """How many rows and different names each reason of a review has."""
    return rows.select(F.explode(reasons).alias("reason"), "name").groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


def counted_candidates(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with the number of candidates that their group has."""
    return pairs.withColumn("n_candidates", F.count("*").over(Window.partitionBy(*keys)))


def source_evidence(a: Column, b: Column, shown: int = 3) -> dict[str, Column]:
    """What two sets of sources have in common and apart, as counts and samples."""
    sample = lambda c: F.array_join(F.slice(F.array_sort(c), 1, shown), " | ")
    both, only_a, only_b = F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a)
    return {"n_both": F.size(both), "n_left": F.size(only_a), "n_right": F.size(only_b), "sample_both": sample(both), "overlap": F.arrays_overlap(a, b)}


# --- people, their links, and guards


def resolved_people(people: DataFrame, known: DataFrame) -> DataFrame:
    """people (row, id_number, name_key, birth_date) with person_id and how: by id number, else by name and birth date,
    where exactly one known person (person_id, id_number, name_key, birth_date) has it; else missing or ambiguous."""
    by_id = known.where("id_number IS NOT NULL").groupBy("id_number").agg(F.count("*").alias("n_id"), F.min("person_id").alias("p_id"))
    by_name = known.where("name_key IS NOT NULL AND birth_date IS NOT NULL").groupBy("name_key", "birth_date").agg(F.count("*").alias("n_name"), F.min("person_id").alias("p_name"))
    joined = people.join(by_id, "id_number", "left").join(by_name, ["name_key", "birth_date"], "left")
    n, p = F.coalesce("n_id", "n_name", F.lit(0)), F.when(F.col("n_id").isNotNull(), F.col("p_id")).otherwise(F.col("p_name"))
    return joined.select(*people.columns, F.when(n == 1, p).alias("person_id"), F.when(n > 1, "ambiguous").when(n == 0, "missing").when(F.col("n_id") == 1, "id_number").otherwise("name").alias("how"))


def import_guards(people: DataFrame, known: DataFrame) -> DataFrame:
    """(reason, row) of what stands against an import: an id number twice, a person without one twice, ambiguous people."""
    twice = people.withColumn("n", F.count("*").over(Window.partitionBy("id_number"))).where("id_number IS NOT NULL AND n > 1").select(F.lit("id number twice").alias("reason"), "row")
    again = people.where("id_number IS NULL").withColumn("n", F.count("*").over(Window.partitionBy("name_key", "birth_date"))).where("n > 1").select(F.lit("person twice").alias("reason"), "row")
    unclear = resolved_people(people, known).where("how = 'ambiguous'").select(F.lit("ambiguous").alias("reason"), "row")
    return twice.unionByName(again).unionByName(unclear)


def aliases_of(people: DataFrame) -> DataFrame:
    """people with each spelling of a name once: as competitions have it, surname first, first words only, given name first."""
    first, last = F.trim("first_name"), F.trim("last_name")
    word = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    forms = F.array(F.col("competition_name"), F.concat(last, F.lit(", "), first), F.concat(word(last), F.lit(", "), word(first)), F.concat(first, F.lit(" "), last))
    return people.withColumn("alias", F.explode(F.array_distinct(F.filter(forms, lambda a: F.trim(a) != ""))))


def person_scores(people: DataFrame, athletes: DataFrame, keep: int = 5) -> DataFrame:
    """The best `keep` athletes of each person's club: person_id, athlete_id, score, alias, label, reasons, place.

    The score is the greater of the similarity and of the share of the alias's words that the athlete has, over up to four
    aliases. Similarity is computed only where it could beat that share: it can't exceed twice the shorter text's length
    over both.
    """
    p = aliases_of(people).select("person_id", "club_key", "alias", F.col("gender").alias("pg"), F.col("birth_year").alias("py"), plain_key(F.col("alias")).alias("a"))
    t = athletes.select("athlete_id", "club_key", F.col("gender").alias("ag"), F.col("birth_year").alias("ay"), plain_key(F.col("full_name")).alias("b")).where("b IS NOT NULL")
    pairs = p.where("a IS NOT NULL").join(t, "club_key")
    x, y = F.array_distinct(F.split("a", " ")), F.array_distinct(F.split("b", " "))
    pairs = pairs.withColumn("cover", F.size(F.array_intersect(x, y)) / F.size(x)).withColumn("most", 2 * F.least(F.length("a"), F.length("b")) / (F.length("a") + F.length("b")))
    near = F.col("most") > F.col("cover")
    scored = pairs.withColumn("score", F.greatest("cover", similarity.ratio(F.when(near, F.col("a")), F.when(near, F.col("b")))))
    best = scored.groupBy("person_id", "athlete_id", "pg", "py", "ag", "ay").agg(F.max("score").alias("score"), F.max_by("alias", "score").alias("alias"))
    labelled = best.withColumns({"label": link_label(F.col("score"), F.col("pg"), F.col("ag"), F.col("py"), F.col("ay")), "reasons": link_reasons(F.col("score"), F.col("pg"), F.col("ag"), F.col("py"), F.col("ay"))})
    return core.top_by(labelled, ["person_id"], keep, F.desc("score"), F.asc("athlete_id")).select("person_id", "athlete_id", "score", "alias", "label", "reasons", "place")


def link_reasons(score: Column, pg: Column, ag: Column, py: Column, ay: Column) -> Column:
    """Why a person and an athlete may be one."""
    return F.array_compact(
        F.array(
            F.when(pg == ag, "gender_match").when(pg != ag, "gender_mismatch"),
            F.when(py == ay, "birth_year_match").when(py != ay, "birth_year_mismatch").when(py.isNull(), "person_birth_year_missing").otherwise("athlete_birth_year_missing"),
            F.when(score >= EXACT_SCORE, "name_exact_or_near_exact").when(score >= SIMILAR_SCORE, "name_similar").otherwise("name_weak"),
        )
    )


def link_label(score: Column, pg: Column, ag: Column, py: Column, ay: Column) -> Column:
    """high, medium or review. Genders or years that differ are for review, whatever the score."""
    known = lambda c: F.coalesce(c, F.lit(False))
    label = F.when(known(pg != ag) | known(py != ay), "review").when((score >= EXACT_SCORE) & known(pg == ag) & (known(py == ay) | py.isNull()), "high")
    return label.when((score >= SIMILAR_SCORE) & known(pg == ag), "medium").otherwise("review")


def link_guards(links: DataFrame, people: DataFrame, athletes: DataFrame, existing: DataFrame) -> DataFrame:
    """(person_id, athlete_id, reason) of links that must not be made: unknown ids, a side that has a link or two new ones."""
    out = links.join(people.select("person_id").distinct(), "person_id", "left_anti").select("person_id", "athlete_id", F.lit("unknown person").alias("reason"))
    out = out.unionByName(links.join(athletes.select("athlete_id").distinct(), "athlete_id", "left_anti").select("person_id", "athlete_id", F.lit("unknown athlete").alias("reason")))
    for side in ("person_id", "athlete_id"):
        twice = links.withColumn("n", F.count("*").over(Window.partitionBy(side))).where("n > 1").select("person_id", "athlete_id", F.lit(f"{side} twice").alias("reason"))
        # another link of the side is there if the first or the last one is another
        own = F.struct("person_id", "athlete_id")
        other = existing.groupBy(side).agg(F.min(own).alias("first"), F.max(own).alias("last"))
        taken = links.join(other, side).where((F.col("first") != own) | (F.col("last") != own)).select("person_id", "athlete_id", F.lit(f"{side} linked").alias("reason")).distinct()
        out = out.unionByName(twice).unionByName(taken)
    return out


def added_links(links: DataFrame, existing: DataFrame) -> DataFrame:
    """(person_id, athlete_id, confidence) that existing lacks."""
    score = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in CONFIDENCE.items()])
    return core.missing_from(links, existing, ["person_id", "athlete_id"]).select("person_id", "athlete_id", score.alias("confidence"))


def name_guards(updates: DataFrame, athletes: DataFrame) -> DataFrame:
    """(athlete_id, reason) of canonical names (athlete_id, expected: array, canonical_name) that must not be set: unknown
    athletes, names that are neither expected nor set already, and names that another athlete of that gender and year has."""
    a = athletes.select("athlete_id", F.col("athlete_name").alias("now"), "athlete_gender", "birth_year")
    sides = updates.join(a, "athlete_id", "left")
    missing = sides.where("now IS NULL").select("athlete_id", F.lit("unknown").alias("reason"))
    odd = sides.where(F.col("now").isNotNull() & (F.col("now") != F.col("canonical_name")) & ~F.coalesce(F.array_contains("expected", F.col("now")), F.lit(False))).select("athlete_id", F.lit("unexpected name").alias("reason"))
    key = lambda c: F.lower(F.trim(c))
    others = a.select(F.col("athlete_id").alias("other"), key("now").alias("k"), F.col("athlete_gender").alias("g"), F.col("birth_year").alias("y"))
    clash = sides.withColumn("k", key("canonical_name")).join(others, "k").where((F.col("other") != F.col("athlete_id")) & F.col("g").eqNullSafe(F.col("athlete_gender")) & F.col("y").eqNullSafe(F.col("birth_year")))
    return missing.unionByName(odd).unionByName(clash.select("athlete_id", F.lit("taken").alias("reason")).distinct())


def with_canonical_names(athletes: DataFrame, updates: DataFrame) -> DataFrame:
    """athletes with their reviewed names; raises if a guard has anything against any."""
    if name_guards(updates, athletes).limit(1).count():
        raise ValueError("canonical names have unknown, unexpected or taken names")
    return athletes.join(core.small_side(updates.select("athlete_id", "canonical_name")), "athlete_id", "left").withColumn("athlete_name", F.coalesce("canonical_name", "athlete_name")).select(*athletes.columns)


# --- the ledger of loads


def started(load: str, frames: dict[str, DataFrame], document: str) -> DataFrame:
    """A ledger row: the load began, with the rows of each input."""
    spark = next(iter(frames.values())).sparkSession
    row = spark.range(1).select(F.lit(load).alias("load"), F.lit(document).alias("document"), F.lit("started").alias("state"), F.lit(None).cast("string").alias("error"))
    for name, df in frames.items():  # one row each
        row = row.join(F.broadcast(df.agg(F.count("*").alias(f"rows_{name}"))))
    return row


def ledger(entries: DataFrame) -> DataFrame:
    """The state of every load in an append-only ledger (load, at, state, error): its last entry, and what it began with."""
    last = F.max_by(F.struct("state", "error"), "at")
    return entries.groupBy("load").agg(F.min("at").alias("started_at"), F.max(F.when(F.col("state") != "started", F.col("at"))).alias("completed_at"), last.alias("x")).select("load", "started_at", "completed_at", "x.state", "x.error")


def open_issues(checks: DataFrame, load: str) -> DataFrame:
    """The checks of a load that found something, to be kept with it."""
    return checks.where("n > 0").select(F.lit(load).alias("load"), "check", "n")


# --- registered forms


@query("""SELECT name, coalesce(nullif(array_to_string(list_filter(string_split(key, ' '), lambda w: w NOT IN ('club', 'master', 'masters', 'swim', 'swimming', 'team', 'natacion', 'de', 'del', 'la', 'las', 'los', '')), ' '), ''), nullif(key, '')) AS similarity_key
FROM (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key FROM (SELECT DISTINCT 'Club de ' || p_name AS name FROM part UNION SELECT 'The Swim Team' UNION SELECT 'Club'))""", star=False)
def club_similarity_keys(s: Star) -> DataFrame:
    names = s.raw("part").select(F.concat(F.lit("Club de "), F.col("p_name")).alias("name")).distinct()
    fixed = s.raw("region").select(F.explode(F.array(F.lit("The Swim Team"), F.lit("Club"))).alias("name")).distinct()
    return names.union(fixed).select("name", club_similarity_key(F.col("name")).alias("similarity_key"))


@query("""SELECT o_orderkey, name, CASE WHEN n = 0 THEN c_low || ' rojo' WHEN n = 1 THEN c_low || ' rojo' ELSE c_low END AS canonical_key FROM (
SELECT o_orderkey, o_custkey % 3 AS n, 'uno ' || (o_custkey % 40) AS c_low, 'Uno ' || (o_custkey % 40) || CASE o_orderkey % 2 WHEN 0 THEN ' A' ELSE '' END AS name FROM orders)""", star=False)
def canonical_club_keys(s: Star) -> DataFrame:
    """Names by alias, squads by their club's; a third of the clubs have no alias."""
    k = (F.col("o_custkey") % 40).cast("string")
    rows = s.raw("orders").select("o_orderkey", "o_custkey", F.concat(F.lit("Uno "), k, F.when(F.col("o_orderkey") % 2 == 0, " A").otherwise("")).alias("name"))
    parts = rows.withColumn("n", F.col("o_custkey") % 3)
    out = None
    for n in range(3):  # aliases of their own for each third
        mine = parts.where(F.col("n") == n).select("o_orderkey", "name")
        aliases = mine.select(F.regexp_replace("name", " A$", "").alias("alias_name")).distinct().select("alias_name", F.concat("alias_name", F.lit(" Rojo")).alias("canonical_name")).where(F.lit(n < 2))
        one = canonical_clubs(mine, aliases, "name")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT c_custkey, given, shown FROM (SELECT c_custkey, given, array_to_string(list_transform(string_split(given, ' '), lambda w: CASE WHEN lower(w) IN ('de', 'la', 'del') THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS cased, c_custkey % 4 AS n FROM (
SELECT c_custkey, 'ANA ' || upper(translate(c_name, '#0123456789', 'xabcdefghij')) || CASE c_custkey % 4 WHEN 0 THEN ' de la CRUZ' WHEN 1 THEN ' del rio' WHEN 2 THEN ' PAZ' ELSE '' END AS given FROM customer)) q,
LATERAL (SELECT string_split(cased, ' ') AS w) x, LATERAL (SELECT CASE n WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS k) y, LATERAL (SELECT array_to_string(w[len(w) - k + 1:], ' ') || ', ' || array_to_string(w[:len(w) - k], ' ') AS shown) z""", star=False)
def name_order_and_case(s: Star) -> DataFrame:
    """Names put surname first and cased, particles going with the surname."""
    tail = F.when(F.col("c_custkey") % 4 == 0, " de la CRUZ").when(F.col("c_custkey") % 4 == 1, " del rio").when(F.col("c_custkey") % 4 == 2, " PAZ").otherwise("")
    given = F.concat(F.lit("ANA "), F.upper(F.translate("c_name", "#0123456789", "xabcdefghij")), tail)
    return s.raw("customer").select("c_custkey", given.alias("given"), person_case(surname_first(given)).alias("shown"))


@query("""SELECT old_key, new_key, birth_year, gender FROM (SELECT segment AS old_key, min('k' || (athlete_id % 3)) AS new_key, birth_year, athlete_gender AS gender, count(DISTINCT athlete_id % 3) AS n FROM athlete GROUP BY ALL) WHERE n = 1""")
def unlocked_name_rules(s: Star) -> DataFrame:
    """Rules whose replacement is the same for every club."""
    to = F.concat(F.lit("k"), (F.col("athlete_id") % 3).cast("string"))
    rules = s.athlete.select(F.col("segment").alias("old_key"), to.alias("new_key"), F.upper(to).alias("new_name"), "birth_year", F.col("athlete_gender").alias("gender"), (F.col("athlete_id") % 7).cast("string").alias("club_key"))
    return unlocked_rules(rules).select("old_key", "new_key", "birth_year", "gender")


@query("""SELECT old_name, new_name, gender, birth_year FROM (SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 THEN 'R' || o_custkey ELSE 'S' || o_custkey END AS old_name, CASE WHEN o_custkey % 2 = 0 THEN 'L' || o_custkey ELSE 'T' || o_custkey END AS new_name,
CASE WHEN o_orderstatus = 'F' THEN 'female' ELSE 'male' END AS gender, (1950 + o_custkey % 50)::INTEGER AS birth_year FROM orders WHERE o_orderpriority LIKE '%1%' OR o_orderpriority LIKE '%5%')""", star=False)
def merge_decision_rows(s: Star) -> DataFrame:
    """Merges of both shapes as one table of old and new names."""
    k, own = F.col("o_custkey").cast("string"), F.col("o_custkey") % 2 == 0
    side = lambda letter, here: F.when(here, F.concat(F.lit(letter), k))
    merge = F.when(F.col("o_orderpriority").contains("1") | F.col("o_orderpriority").contains("5"), " Merge ").otherwise("keep")
    rows = s.raw("orders").select(merge.alias("decision"), side("L", own).alias("left_name"), side("R", own).alias("right_name"), side("L", own).alias("canonical_name"), side("S", ~own).alias("shorter_name"), side("T", ~own).alias("longer_name"),
        F.when(F.col("o_orderstatus") == "F", "female").otherwise("male").alias("gender"), (1950 + F.col("o_custkey") % 50).cast("int").alias("birth_year"))
    return merge_decisions(rows)


@query("""SELECT athlete_id, CASE WHEN birth_year IS NOT NULL THEN coalesce(p.preferred, birth_year) WHEN c.n = 1 THEN c.y END AS birth_year, CASE WHEN birth_year IS NULL AND c.n = 1 THEN c.name ELSE athlete_name END AS name
FROM athlete a LEFT JOIN (SELECT DISTINCT segment, athlete_gender, (1930 + length(segment))::INTEGER AS preferred FROM athlete WHERE segment < 'C') p USING (segment, athlete_gender)
LEFT JOIN (SELECT athlete_id, count(DISTINCT club_id % 2) AS n, min('n' || (club_id % 2)) AS name, min(1900 + rank_position)::INTEGER AS y FROM result WHERE club_id IS NOT NULL GROUP BY 1) c USING (athlete_id)""")
def corrected_birth_years(s: Star) -> DataFrame:
    """Known years corrected by reviewed evidence, unknown ones filled by the one candidate."""
    rows = s.athlete.select("athlete_id", "segment", "athlete_gender", "birth_year", F.col("athlete_name").alias("name"))
    fixes = s.athlete.where("segment < 'C'").select("segment", "athlete_gender", (1930 + F.length("segment")).alias("preferred_year")).distinct()
    found = s.result.where("club_id IS NOT NULL").select("athlete_id", F.concat(F.lit("n"), (F.col("club_id") % 2).cast("string")).alias("name"), (1900 + F.col("rank_position")).alias("birth_year"))
    return with_missing_years(with_years(rows, fixes, ["segment", "athlete_gender"]), found, "athlete_id").select("athlete_id", "birth_year", "name")


@query("""SELECT competition_id, event_id, athlete_id, club_id, time_ms, CASE WHEN club_id % 7 = 3 OR (club_id IS NULL AND rank_position = 2) THEN 'moved' ELSE event_id::VARCHAR END AS event_name FROM result r
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT athlete_id, club_id FROM result WHERE points > 48) x WHERE x.athlete_id = r.athlete_id AND x.club_id IS NOT DISTINCT FROM r.club_id)""")
def reviewed_results(s: Star) -> DataFrame:
    """Results without reviewed exclusions, with reviewed events; null clubs are a club of their own."""
    rows = s.result.select("competition_id", "event_id", "athlete_id", "club_id", "rank_position", "points", "time_ms", F.col("event_id").cast("string").alias("event_name"))
    left = without_excluded(rows, rows.where("points > 48"), ["athlete_id", "club_id"])
    fixes = rows.where("club_id % 7 = 3 OR (club_id IS NULL AND rank_position = 2)").select("club_id", "rank_position", F.lit("moved").alias("new_event_name"), F.lit(1).alias("rule_order")).distinct()
    return with_events(left, fixes, ["club_id", "rank_position"]).select("competition_id", "event_id", "athlete_id", "club_id", "time_ms", "event_name")


@query("""SELECT athlete_id, segment, birth_year, athlete_gender FROM (SELECT *, row_number() OVER (PARTITION BY segment, birth_year, athlete_gender ORDER BY athlete_id) AS n FROM athlete)
WHERE n = 1 OR birth_year IS NULL OR NOT (birth_year % 2 = 0 AND (segment < 'C' OR (segment > 'H' AND athlete_gender = 'female')))""")
def pruned_identities(s: Star) -> DataFrame:
    """One row of each identity that a reviewed merge names."""
    rows = s.athlete.select("athlete_id", "segment", "birth_year", "athlete_gender", F.col("segment").alias("name_key"), F.col("athlete_gender").alias("gender"))
    merged = rows.where("birth_year % 2 = 0 AND (segment < 'C' OR segment > 'H')").select("name_key", "birth_year", F.when(F.col("segment") > "H", "female").otherwise("").alias("gender"))
    return pruned_merges(rows, merged, F.asc("athlete_id")).select("athlete_id", "segment", "birth_year", "athlete_gender")


@query("""SELECT observation_id, athlete_id, CASE WHEN EXISTS (SELECT 1 FROM relay t WHERE t.athlete_id = r.athlete_id AND t.team = 'signup' AND r.observation_id > t.observation_id AND r.observation_id <= t.observation_id + 8) AND team = 'view' THEN 'whole' ELSE team END AS team FROM relay r WHERE leg_order BETWEEN 1 AND 4""")
def wrapped_team_lines(s: Star) -> DataFrame:
    """Swimmers just below a broken team line take its whole name."""
    swimmers = valid_legs(s.relay).select("observation_id", "athlete_id", F.col("athlete_id").alias("document"), F.lit(1).alias("page_number"), F.col("observation_id").alias("line_number"), "team")
    teams = swimmers.where("team = 'signup'").select("document", "page_number", "line_number", F.lit("view").alias("part"), F.lit("whole").alias("team"))
    return with_wrapped_team(swimmers, teams).select("observation_id", "athlete_id", "team")


@query()
def synced_identities(s: Star) -> DataFrame:
    """Athletes renamed to what their results show with one gender."""
    athletes = s.athlete.where("birth_year IS NOT NULL").select("athlete_id", F.col("segment").alias("name_key"), (F.col("athlete_id") % 5).cast("string").alias("club_key"), "birth_year", F.col("athlete_gender").alias("gender"), F.col("athlete_name").alias("full_name"))
    seen = athletes.where("athlete_id % 3 <> 0").select(F.lower("name_key").alias("name_key"), "club_key", "birth_year", "gender")
    rules = athletes.select("name_key", "birth_year").distinct().select(F.lit(1).alias("rule_order"), F.col("name_key").alias("old_key"), F.lower("name_key").alias("new_key"), F.initcap("name_key").alias("new_name"), "birth_year", F.lit("").alias("gender"), F.when(F.col("birth_year") % 2 == 0, "2").otherwise("").alias("club_key"))
    return synced_athletes(athletes, seen, rules).select("athlete_id", "full_name", "gender")


ORACLES["synced_identities"] = STAR_SQL + """, a AS (SELECT athlete_id, segment, (athlete_id % 5) AS club, birth_year, athlete_gender AS g, athlete_name FROM athlete WHERE birth_year IS NOT NULL),
shown AS (SELECT segment, club, birth_year, min(g) AS g FROM a WHERE athlete_id % 3 <> 0 GROUP BY ALL HAVING count(DISTINCT g) = 1)
SELECT athlete_id, CASE WHEN hit THEN upper(segment[1]) || lower(segment[2:]) ELSE athlete_name END AS full_name, CASE WHEN hit THEN sg ELSE g END AS gender FROM (
SELECT a.*, s.g AS sg, s.g IS NOT NULL AND (birth_year % 2 <> 0 OR club = 2) AS hit FROM a LEFT JOIN shown s USING (segment, club, birth_year))"""


@query("""SELECT athlete_id, birth_year, string_agg(DISTINCT scope, ' | ' ORDER BY scope) AS sources, string_agg(DISTINCT t, ' | ' ORDER BY t) AS tables, count(*)::BIGINT AS n FROM (
SELECT athlete_id, scope, 'result' AS t FROM result UNION ALL SELECT athlete_id, team, 'relay' FROM relay) JOIN athlete USING (athlete_id) GROUP BY ALL""")
def identity_observations(s: Star) -> DataFrame:
    """Sources and tables of every identity."""
    seen = s.result.select("athlete_id", F.col("scope").alias("source"), F.lit("result").alias("table_name")).unionByName(s.relay.select("athlete_id", F.col("team").alias("source"), F.lit("relay").alias("table_name")))
    return observations(seen.join(s.athlete.select("athlete_id", "birth_year"), "athlete_id"), ["athlete_id", "birth_year"])


@query("""SELECT reason, count(*)::BIGINT AS n, count(DISTINCT name)::BIGINT AS n_names FROM (SELECT c_name || CASE c_custkey % 4 WHEN 0 THEN ' 1:02,33' WHEN 1 THEN ' DNS' WHEN 2 THEN ' club [x' ELSE '' END AS name FROM customer),
LATERAL (SELECT unnest(list_filter([CASE WHEN regexp_matches(name, '[0-9]') THEN 'contains_digit' END, CASE WHEN contains(name, '1:02,33') THEN 'contains_time_token' END, CASE WHEN contains(name, ' DNS') THEN 'contains_status_token' END,
CASE WHEN contains(name, ' club ') THEN 'contains_club_word' END, CASE WHEN contains(name, '[') THEN 'contains_layout_punctuation' END, CASE WHEN contains(name, '[') THEN 'unbalanced_brackets' END], lambda x: x IS NOT NULL)) AS reason) GROUP BY 1""", star=False)
def review_reasons(s: Star) -> DataFrame:
    """Reasons for a review of names, counted over rows and names."""
    from lanewise.plans.curation import name_reasons

    n = F.col("c_custkey") % 4
    name = F.concat("c_name", F.when(n == 0, " 1:02,33").when(n == 1, " DNS").when(n == 2, " club [x").otherwise(""))
    return reason_counts(s.raw("customer").select(name.alias("name")).withColumn("reasons", name_reasons(F.col("name"))))


@query("""SELECT a, b, len(list_intersect(sa, sb))::INTEGER AS n_both, (len(sa) - len(list_intersect(sa, sb)))::INTEGER AS n_left, (len(sb) - len(list_intersect(sa, sb)))::INTEGER AS n_right, len(list_intersect(sa, sb)) > 0 AS overlap, count(*) OVER (PARTITION BY a)::BIGINT AS n_candidates,
array_to_string(list_sort(list_intersect(sa, sb))[:3], ' | ') AS sample_both FROM (
WITH c AS (SELECT club_id, list(DISTINCT start_date::VARCHAR) AS src FROM result WHERE club_id IS NOT NULL AND start_date IS NOT NULL GROUP BY 1) SELECT x.club_id AS a, y.club_id AS b, x.src AS sa, y.src AS sb FROM c x JOIN c y ON y.club_id - x.club_id IN (1, 2))""")
def source_sets(s: Star) -> DataFrame:
    """What neighbouring clubs' sources have in common, and how many candidates each has."""
    days = s.result.where("club_id IS NOT NULL AND start_date IS NOT NULL").groupBy("club_id").agg(F.collect_set(F.col("start_date").cast("string")).alias("src"))
    a = days.select(F.col("club_id").alias("a"), F.col("src").alias("sa"), F.explode(F.array(F.col("club_id") + 1, F.col("club_id") + 2)).alias("b"))
    pairs = a.join(days.select(F.col("club_id").alias("b"), F.col("src").alias("sb")), "b")
    seen = source_evidence(F.col("sa"), F.col("sb"))
    return counted_candidates(pairs.select("a", "b", *[c.alias(n) for n, c in seen.items()]), ["a"])


@query("""SELECT athlete_id, reason FROM (WITH u AS (SELECT athlete_id + CASE WHEN athlete_id % 11 = 0 THEN 10000000 ELSE 0 END AS athlete_id, CASE WHEN athlete_id % 13 = 0 THEN (SELECT min(athlete_name) FROM athlete) ELSE athlete_name || ' x' END AS canonical FROM athlete) SELECT u.athlete_id, 'unknown' AS reason FROM u LEFT JOIN athlete a USING (athlete_id) WHERE a.athlete_id IS NULL
UNION ALL SELECT u.athlete_id, 'unexpected name' FROM u JOIN athlete a USING (athlete_id) WHERE a.athlete_name <> u.canonical AND u.athlete_id % 5 = 0
UNION ALL SELECT DISTINCT u.athlete_id, 'taken' FROM u JOIN athlete a USING (athlete_id) JOIN athlete o ON lower(trim(o.athlete_name)) = lower(trim(u.canonical)) AND o.athlete_id <> a.athlete_id AND o.athlete_gender = a.athlete_gender AND o.birth_year IS NOT DISTINCT FROM a.birth_year)""")
def canonical_name_guards(s: Star) -> DataFrame:
    """What stands against reviewed names."""
    first = s.athlete.agg(F.min("athlete_name").alias("least"))
    k = F.col("athlete_id")
    updates = s.athlete.join(F.broadcast(first)).select(  # one row
        (k + F.when(k % 11 == 0, 10_000_000).otherwise(0)).alias("athlete_id"),
        F.when(k % 5 == 0, F.array(F.lit("other"))).otherwise(F.array("athlete_name")).alias("expected"),
        F.when(k % 13 == 0, F.col("least")).otherwise(F.concat("athlete_name", F.lit(" x"))).alias("canonical_name"),
    )
    return name_guards(updates, s.athlete)


@query()
def resolved_imports(s: Star) -> DataFrame:
    """People of an import resolved by id number, else by name and birth date."""
    k = F.col("c_custkey")
    known = s.raw("customer").select(k.alias("person_id"), F.when(k % 3 != 0, (k % 400).cast("string")).alias("id_number"), F.col("c_mktsegment").alias("name_key"), (k % 97).cast("string").alias("birth_date"))
    o = F.col("o_custkey")
    people = s.raw("orders").select(F.col("o_orderkey").alias("row"), F.when(o % 2 == 0, (o % 500).cast("string")).alias("id_number"), F.lit("BUILDING").alias("name_key"), (o % 120).cast("string").alias("birth_date"))
    return resolved_people(people, known).select("row", "person_id", "how")


ORACLES["resolved_imports"] = """WITH k AS (SELECT c_custkey AS p, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 400)::VARCHAR END AS i, c_mktsegment AS m, (c_custkey % 97)::VARCHAR AS b FROM customer),
o AS (SELECT o_orderkey AS row, CASE WHEN o_custkey % 2 = 0 THEN (o_custkey % 500)::VARCHAR END AS i, (o_custkey % 120)::VARCHAR AS b FROM orders),
x AS (SELECT i, count(*) AS n, min(p) AS p FROM k WHERE i IS NOT NULL GROUP BY 1), y AS (SELECT b, count(*) AS n, min(p) AS p FROM k WHERE m = 'BUILDING' GROUP BY 1)
SELECT row, CASE WHEN coalesce(x.n, y.n, 0) = 1 THEN CASE WHEN x.n IS NOT NULL THEN x.p ELSE y.p END END AS person_id, CASE WHEN coalesce(x.n, y.n, 0) > 1 THEN 'ambiguous' WHEN coalesce(x.n, y.n, 0) = 0 THEN 'missing' WHEN x.n = 1 THEN 'id_number' ELSE 'name' END AS how
FROM o LEFT JOIN x ON x.i = o.i LEFT JOIN y ON y.b = o.b"""


@query("""WITH l AS (SELECT o_custkey AS person_id, o_orderkey % 700 AS athlete_id FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL),
e AS (SELECT DISTINCT o_custkey AS person_id, o_orderkey % 700 AS athlete_id FROM orders WHERE o_orderkey % 10 = 3),
p AS (SELECT c_custkey AS person_id FROM customer WHERE c_custkey % 9 <> 0), a AS (SELECT p_partkey AS athlete_id FROM part WHERE p_partkey % 4 <> 0)
SELECT reason, count(*)::BIGINT AS n FROM (SELECT 'unknown person' AS reason FROM l WHERE person_id NOT IN (SELECT person_id FROM p) UNION ALL SELECT 'unknown athlete' FROM l WHERE athlete_id NOT IN (SELECT athlete_id FROM a)
UNION ALL SELECT 'person_id twice' FROM (SELECT *, count(*) OVER (PARTITION BY person_id) AS n FROM l) WHERE n > 1 UNION ALL SELECT 'athlete_id twice' FROM (SELECT *, count(*) OVER (PARTITION BY athlete_id) AS n FROM l) WHERE n > 1
UNION ALL SELECT 'person_id linked' FROM (SELECT DISTINCT l.* FROM l JOIN e USING (person_id) WHERE e.athlete_id <> l.athlete_id) UNION ALL SELECT 'athlete_id linked' FROM (SELECT DISTINCT l.* FROM l JOIN e USING (athlete_id) WHERE e.person_id <> l.person_id)) GROUP BY 1""", star=False)
def person_link_guards(s: Star) -> DataFrame:
    """What stands against links of people and athletes, counted by reason."""
    o = s.raw("orders")
    pair = lambda rows: rows.select(F.col("o_custkey").alias("person_id"), (F.col("o_orderkey") % 700).alias("athlete_id")).distinct()
    people = s.raw("customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("person_id"))
    athletes = s.raw("part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("athlete_id"))
    found = link_guards(pair(o.where("o_orderkey % 3 = 0")), people, athletes, pair(o.where("o_orderkey % 10 = 3")))
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT user_id::VARCHAR AS load, min(event_id) AS started_at, max(event_id) FILTER (WHERE event_type <> 'view') AS completed_at, arg_max(CASE WHEN event_type = 'view' THEN 'started' ELSE event_type END, event_id) AS state FROM events GROUP BY 1""", star=False)
def load_ledger(s: Star) -> DataFrame:
    """Loads in an append-only ledger with their last state."""
    entries = s.raw("events").select(F.col("user_id").cast("string").alias("load"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "view", "started").otherwise(F.col("event_type")).alias("state"), F.lit(None).cast("string").alias("error"))
    return ledger(entries).select("load", "started_at", "completed_at", "state")
