"""Checks of a parser bundle before it may be loaded, the roll-up of what they find, and the rules around a load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import domain, similarity, text, times
from lanewise.operators import core

#: Share of unparsed lines, least plausible times in ms, most points, and score of a planned competition.
DEBUG_RATIO, LEAST_MS, LEAST_RELAY_MS, MOST_POINTS, PLANNED_SCORE = 0.2, 15_000, 60_000, 50, 0.72
STATES = ("validated", "loaded", "requires_review", "failed")


def _filled(c: str) -> Column:
    return text.blank_to_null(F.col(c))


def _number(c: str, kind: str = "int") -> Column:
    return F.replace(_filled(c), F.lit(","), F.lit(".")).try_cast(kind)


def _outside(c: str, allowed) -> Column:
    v = _filled(c)
    return v.isNotNull() & ~v.isin(*allowed)


def _issues(df: DataFrame, checks: dict[str, Column], severity: str = "error") -> DataFrame:
    """(severity, issue_key, n) of the checks that some row fails, all counted in one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(severity).alias("severity"), F.lit(k).alias("issue_key"), F.col(k).alias("n")) for k in checks])
    return counts.select(F.explode(rows).alias("x")).select("x.*").where("n > 0")


def event_range(name: Column) -> tuple[Column, Column]:
    pattern = r"\b(\d{1,3})\s*-\s*(\d{1,3})\b"
    return F.regexp_extract(name, pattern, 1).try_cast("int"), F.regexp_extract(name, pattern, 2).try_cast("int")


def event_sex(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.when(low.startswith("women "), "female").when(low.startswith("men "), "male")


def bundle_issues(bundle: dict[str, DataFrame], unparsed: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """Everything wrong with a bundle: (severity, issue_key, n)."""
    genders, strokes, athletes = ("women", "men", "mixed"), tuple(domain.STROKES), ("female", "male")
    event, athlete, result = bundle["event"], bundle["athlete"], bundle["result"]
    name = _filled("full_name")
    found = [
        _issues(event, {"invalid_event_gender": _outside("gender", genders), "invalid_event_stroke": _outside("stroke", strokes)}),
        _issues(
            athlete,
            {
                "invalid_athlete_gender": _outside("gender", athletes),
                "athlete_name_without_comma": name.isNotNull() & ~F.contains(name, F.lit(",")),
                "athlete_name_split_letter": F.contains(F.lower(name), F.lit("ñ ñ")),
                "athlete_name_web_text": name.rlike("(?i)https?:|www\\."),
            },
        ),
        _issues(result, _result_checks(LEAST_MS) | {"result_missing_identity": _filled("event_name").isNull() | _filled("athlete_name").isNull()}),
        consistency(result, athlete),
    ]
    if "relay_team" in bundle:
        team, swimmer = bundle["relay_team"], bundle["relay_swimmer"]
        checks = {f"relay_{k}": v for k, v in _result_checks(LEAST_RELAY_MS).items()}
        found.append(_issues(team, checks | {"relay_missing_identity": _filled("event_name").isNull() | _filled("relay_team_name").isNull()}))
        found.append(_issues(swimmer, {"invalid_relay_swimmer_gender": _outside("gender", athletes), "invalid_relay_swimmer_leg_order": ~F.coalesce(_number("leg_order").between(1, 4), F.lit(False))}))
        for frame, key, label in ((team, ["event_name", "relay_team_name", "rank_position", "result_time_text"], "duplicate_relay_team"), (swimmer, ["event_name", "relay_team_name", "leg_order", "page_number", "line_number"], "duplicate_relay_swimmer")):
            same = F.struct(*[F.coalesce(_filled(c), F.lit("")).alias(c) for c in key])
            found.append(frame.agg((F.count("*") - F.countDistinct(same)).alias("n")).select(F.lit("error").alias("severity"), F.lit(label).alias("issue_key"), "n").where("n > 0"))
    if unparsed is not None:
        found.append(debug_issues(unparsed, result))
    if metadata is not None:
        sha = F.coalesce(_filled("pdf_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
        found.append(_issues(metadata, {"metadata_incomplete": _filled("pdf_name").isNotNull() & ~(sha & _filled("parser_version").isNotNull())}))
    return reduce(DataFrame.unionByName, found)


def _result_checks(least: int) -> dict[str, Column]:
    valid = F.col("status") == "valid"
    ms, seed, points = _number("result_time_ms", "bigint"), _number("seed_time_ms", "bigint"), _number("points", "double")
    return {
        "invalid_status": _outside("status", domain.STATUSES),
        "implausible_time": valid & (ms < least),
        "implausible_seed": seed < least,
        "time_text_disagrees": valid & (times.time_ms(F.col("result_time_text")) != ms),
        "points_without_rank": (points > 0) & _number("rank_position").isNull(),
        "points_over_maximum": points > MOST_POINTS,
    }


def consistency(result: DataFrame, athlete: DataFrame) -> DataFrame:
    """Ages outside their event's range, and events of another gender than the athlete's. Athletes are keyed by name, club
    and year; of repeated keys one counts, so results don't multiply."""
    low, high = event_range(F.col("event_name"))
    age = _number("age_at_event")
    key = lambda *c: F.struct(*[F.lower(F.coalesce(F.trim(F.col(x)), F.lit(""))).alias(f"k{n}") for n, x in enumerate(c)])
    sexes = athlete.select(key("full_name", "club_name", "birth_year").alias("k"), F.col("gender").alias("g")).groupBy("k").agg(F.max("g").alias("g"))
    ages = _issues(result, {"result_event_age_mismatch": (age < low) | (age > high)})
    joined = result.withColumn("k", key("athlete_name", "club_name", "birth_year_estimated")).join(sexes, "k")
    return ages.unionByName(_issues(joined, {"result_event_gender_mismatch": event_sex(F.col("event_name")) != F.nullif("g", F.lit(""))}))


def debug_issues(unparsed: DataFrame, parsed: DataFrame) -> DataFrame:
    relay_header = F.col("raw_line").rlike(r"(?i)^\(?event[o]?\s+\d+.*\b(?:relay|relevo)\b")
    n = unparsed.agg(F.count("*").alias("bad"), F.count_if(F.coalesce(relay_header, F.lit(False))).alias("headers")).join(parsed.agg(F.count("*").alias("good")))
    over = F.when((F.col("good") > 0) & (F.col("bad") > DEBUG_RATIO * F.col("good")), F.col("bad")).otherwise(0)
    rows = F.array(F.struct(F.lit("error").alias("severity"), F.lit("debug_ratio_exceeded").alias("issue_key"), over.alias("n")), F.struct(F.lit("error").alias("severity"), F.lit("unparsed_relay_headers").alias("issue_key"), F.col("headers").alias("n")))
    return n.select(F.explode(rows).alias("x")).select("x.*").where("n > 0")


def document_states(documents: DataFrame, issues: DataFrame, required_scope: str | None = None) -> DataFrame:
    """documents (document, scope) with a state: an error, or another scope than a load asks for, needs review."""
    worst = issues.groupBy("document").agg(F.max(F.col("severity") == "error").alias("bad"))
    state = F.when(F.coalesce("bad", F.lit(False)), "requires_review")
    if required_scope:
        state = state.when(~F.col("scope").eqNullSafe(F.lit(required_scope)), "requires_review")
    return documents.join(worst, "document", "left").select(*documents.columns, state.otherwise("validated").alias("state"))


def manifest_state(states: DataFrame) -> DataFrame:
    """One row: the worst state of all, failed before requires_review before the rest; loaded only if all are."""
    is_ = lambda s: F.col("state") == s
    worst = F.when(F.bool_or(is_("failed")), "failed").when(F.bool_or(is_("requires_review")), "requires_review").when(F.bool_and(is_("loaded")), "loaded").otherwise("validated")
    return states.agg(worst.alias("state"), F.count("*").alias("n"))


def revision_conflicts(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming documents of a competition that has another revision: another checksum, or another URL where the incoming
    one has no checksum. Must be empty, unless a change is approved."""
    k, i = known.alias("k"), incoming.alias("i")
    other = F.when(F.col("i.checksum").isNotNull(), F.col("k.checksum") != F.col("i.checksum")).otherwise(F.col("k.url") != F.col("i.url"))
    return i.join(k, (F.col("i.competition_id") == F.col("k.competition_id")) & F.coalesce(other, F.lit(False)), "left_semi")


def patch_competitions(competitions: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """New values over old ones where given; a course of 'unknown' never replaces one."""
    p = patches.select("competition_id", *[F.col(f).alias(f"new_{f}") for f in fields])
    new = lambda f: F.when(F.col(f"new_{f}") != "unknown", F.col(f"new_{f}")) if f == "course_type" else F.col(f"new_{f}")
    out = competitions.join(p, "competition_id", "left")
    return out.select(*[F.coalesce(new(c), F.col(c)).alias(c) if c in fields else F.col(c) for c in competitions.columns])


def resolve_competitions(incoming: DataFrame, competitions: DataFrame) -> DataFrame:
    """incoming (ref, competition_id, name, season) with resolved_id and how: the given id, else the same name (its season
    first), else the planned and empty competition of the season that is most alike, from PLANNED_SCORE on; null means new."""
    c = competitions.select(F.col("competition_id").alias("id"), text.match_key(F.col("name")).alias("ck"), F.col("season").alias("cs"), "planned")
    i = incoming.withColumn("k", text.match_key(F.col("name")))
    # of the competitions of a name only the first can be met, and the first of each season
    named = core.small_side(c.where("ck IS NOT NULL").groupBy("ck").agg(F.min("id").alias("_first")))
    own = core.small_side(c.where("ck IS NOT NULL").groupBy(F.col("ck").alias("_ck"), "cs").agg(F.min("id").alias("_own")))
    met = i.join(named, F.col("k") == F.col("ck")).join(own, (F.col("k") == F.col("_ck")) & F.col("cs").eqNullSafe(F.col("season")), "left")
    exact = core.first_by(met, ["ref"], F.col("_own").isNull().asc(), F.coalesce("_own", "_first").asc()).select("ref", F.coalesce("_own", "_first").alias("exact_id"))
    rest = i.join(exact, "ref", "left_anti").where("k IS NOT NULL")
    # names are scored once a season
    alike = rest.select("k", "season").distinct().join(c.where("planned"), F.col("season") == F.col("cs")).withColumn("score", similarity.competition_score(F.col("k"), F.col("ck")))
    alike = core.first_by(alike.where(F.col("score") >= PLANNED_SCORE), ["k", "season"], F.desc("score"), F.desc("id")).select("k", "season", F.col("id").alias("planned_id"), "score")
    alike = core.first_by(rest.join(alike, ["k", "season"]), ["ref"], F.desc("score"), F.desc("planned_id")).select("ref", "planned_id")
    out = incoming.join(exact, "ref", "left").join(alike, "ref", "left")
    how = F.when(F.col("competition_id").isNotNull(), "given").when(F.col("exact_id").isNotNull(), "name").when(F.col("planned_id").isNotNull(), "planned").otherwise("new")
    return out.select(*incoming.columns, F.coalesce("competition_id", "exact_id", "planned_id").alias("resolved_id"), how.alias("how"))


def canonical_documents(documents: DataFrame) -> DataFrame:
    """documents (competition_id, url, title): where a competition has complete results, only those."""
    from pyspark.sql.window import Window

    complete = F.lower(F.concat_ws(" ", "title", "url")).rlike(r"(?:resultados?|results?)[\s_-]*(?:completos?|complete|finales|final)|complete[\s_-]*results") & F.lower("url").rlike(r"\.pdf(?:[?#]|$)")
    rows = documents.withColumn("_complete", complete).withColumn("_any", F.max("_complete").over(Window.partitionBy("competition_id")))
    return rows.where("NOT _any OR _complete").select(*documents.columns)


def member_preview(members: DataFrame) -> DataFrame:
    """Members (source_row, first_name, last_name, id_number, birth_date) with their issues and the planned action."""
    key = text.id_number_key(F.col("id_number"))
    born = F.coalesce(*[F.try_to_date(F.trim("birth_date"), f) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy")])
    from pyspark.sql.window import Window

    twice = (F.count("*").over(Window.partitionBy("_id")) > 1) & (F.col("_id") != "")
    rows = members.withColumn("_id", F.coalesce(key, F.lit("")))
    tests = {
        "missing_name": _filled("first_name").isNull() | _filled("last_name").isNull(),
        "missing_id_number": F.col("_id") == "",
        "invalid_id_number": (F.col("_id") != "") & ~F.coalesce(text.id_number_valid(F.col("id_number")), F.lit(False)),
        "duplicate_id_number": twice,
        "invalid_birth_date": _filled("birth_date").isNotNull() & born.isNull(),
    }
    issues = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    out = rows.withColumn("birth", born).withColumn("issues", issues)
    action = F.when(F.array_contains("issues", "missing_name") | F.array_contains("issues", "duplicate_id_number"), "skip").when(F.size("issues") > 0, "review").otherwise("import")
    return out.withColumn("action", action).drop("_id")
