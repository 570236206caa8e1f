"""The cascade of rules and the residue of accents against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lanewise import catalog
from lanewise.plans import cascade, repair
from lanewise.plans.star import Star

SF = "/root/testdata/sf0.001"


def key(name):
    return " ".join(re.findall("[a-z0-9]+", (name or "").lower())) or None


def ordered(name):
    """`Surname, Given` of plain names without particles."""
    words = name.split()
    return name if "," in name or len(words) < 2 or any(c.isdigit() for c in name) else f"{words[-1]}, {' '.join(words[:-1])}"


def plain(row, rules, keep_order=False):
    """One row through the kinds, rule by rule."""
    name, club, year, gender = row["full_name"], key(row["club_name"]), row["birth_year"], row["gender"]
    own, changes = key(name), []
    by = {k: sorted((r for r in rules if r["kind"] == k), key=lambda r: r["rule_order"]) for k, *_ in cascade.KINDS}

    def run(kind):
        nonlocal name, own, year, gender
        for r in by[kind]:
            sexes = not r["gender"] or not gender or r["gender"] == gender
            way = next(w for k, w, _ in cascade.KINDS if k == kind)
            fits = {
                "same year": r["birth_year"] == year,
                "club": r["club_key"] == club and sexes and r["birth_year"] == year,
                "evidence": r["club_key"] == club and year is not None and r["gender"] in (None, gender),
                "old year": sexes and r["old_year"] == year,
                "no year": sexes and year is None,
                "club or no year": r["club_key"] == club and sexes and (year is None or r["birth_year"] == year),
                "identity": sexes and (year is None or r["birth_year"] == year),
            }[way]
            if r["old_key"] != own or not fits:
                continue
            before = (year, gender)
            if kind == "gender":
                gender = r["new_gender"]
            if kind in ("birth_year", "fuzzy_birth_year", "merge_year", "missing_year") or (kind == "partial_name_identity" and year is None):
                year = r["new_year"] if r["new_year"] is not None else year
            if r["new_name"]:
                name, own = r["new_name"], r["new_key"]
            if (kind != "gender" and r["new_name"]) or before != (year, gender):
                changes.append(kind)
            return

    for kind, *_ in cascade.KINDS:
        run(kind)
    if not keep_order and year is None and ordered(name) != name:
        name = ordered(name)
        own = key(name)
        changes.append("order")
        for kind in cascade.AFTER_ORDER:
            run(kind)
    run("merge_year")
    return name, year, gender, changes


def test_all_kinds_over_the_star_tables(spark):
    s = Star(spark, SF)
    rules = [r.asDict() for r in cascade.star_rules(s).collect()]
    assert {r["kind"] for r in rules} == {k for k, *_ in cascade.KINDS}
    people = {r.row_id: r.asDict() for r in cascade.star_people(s).collect()}
    for r in catalog.QUERIES["curated_people"](spark, SF).collect():
        assert (r.full_name, r.birth_year, r.gender, r.changes.split(",") if r.changes else []) == plain(people[r.row_id], rules), people[r.row_id]


def test_chains_of_many_kinds(spark):
    """Few names and many rules, so that rows pass several kinds."""
    rng = random.Random(9)
    names = ["ka b", "b ka", "b, ka", "c d", "c, d", "d"]
    rules = []
    for n in range(90):
        kind = cascade.KINDS[n % 12][0]
        named = kind not in ("gender", "birth_year", "merge_year")
        new = rng.choice(names)
        year = rng.choice([None, 1970, 1971])
        rules.append((kind, n, key(rng.choice(names)), rng.choice(["u", "v", None]), year, year, rng.choice([None, "female", "male"]), new if named else None, key(new) if named else None, rng.choice([1970, 1971]), rng.choice(["female", "male"])))
    frame = spark.createDataFrame(rules, cascade.RULE)
    frame = cascade.with_any_gender(frame.where("kind = 'birth_year'")).unionByName(frame.where("kind <> 'birth_year'"))
    people = [(k, rng.choice(names), rng.choice(["U", "v", None]), rng.choice([None, 1970, 1971]), rng.choice([None, "female", "male"]), k) for k in range(400)] + [(400, None, "u", None, None, 0), (401, "?", None, 1970, "male", 0)]
    df = spark.createDataFrame(people, "row_id int, full_name string, club_name string, birth_year int, gender string, rules int")
    known = [r.asDict() for r in frame.collect()]
    found = {r.row_id: r for r in cascade.curated(df, frame).collect()}
    passed = Counter()
    for row in df.collect():
        got = found[row.row_id]
        want = plain(row.asDict(), known) if key(row.full_name) else (row.full_name, row.birth_year, row.gender, [])
        assert (got.full_name, got.birth_year, got.gender, got.changes) == want, row
        assert got.rules == row.rules
        passed[len(got.changes)] += 1
    assert max(passed) >= 4
    assert cascade.curated(df.limit(0), frame).count() == 0
    assert cascade.curated(df, frame.limit(0)).where("changes <> array() AND changes <> array('order')").count() == 0


def test_tables_without_gender_and_sources_in_their_order(spark):
    rules = spark.createDataFrame([("gender", 1, "ana de la cruz", None, None, None, None, None, None, None, "female"), ("fuzzy_identity", 2, "ana soto", None, None, None, "male", "Soto, Anna", "soto anna", None, None)], cascade.RULE)
    df = spark.createDataFrame([("ANA DE LA CRUZ", "c", "x"), ("ana  sotó", "c", "y")], "athlete_name string, club_name string, birth_year string")
    kept = cascade.curated(df, rules, "athlete_name", gender=None, keep_order=True).collect()
    assert sorted((r.athlete_name, r.changes) for r in kept) == [("Ana de la Cruz", ["case"]), ("Soto, Anna", ["residue", "fuzzy_identity"])]
    moved = cascade.curated(df, rules, "athlete_name", gender=None).collect()
    assert sorted((r.athlete_name, r.changes) for r in moved) == [("DE LA CRUZ, ANA", ["order"]), ("Soto, Anna", ["residue", "fuzzy_identity"])]


RESIDUE = [("Munñ oz, A", "Muñoz, A"), ("Peraález", "Peralez"), ("Marieáé", "Marie"), ("Liálén", "Liálén"), ("Góómez", "Goomez"), ("E rika", "Erika"), ("Ana (Club", "Ana"), ("Ana (Club)", "Ana (Club)"), ("oóú", "o"), ("Páéz", "Paez"), ("  ", None), (None, None)]


def test_residue(spark):
    df = spark.createDataFrame(RESIDUE, "t string, whole string").withColumn("once", repair.without_residue(F.col("t")))
    again = df.withColumn("twice", repair.without_residue(F.col("once")))
    assert [r for r in again.collect() if not r.once == r.twice == r.whole] == []
