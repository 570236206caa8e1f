"""Similarity joins and line-ups against all pairs and all fours."""

import itertools
import random
import time
from difflib import SequenceMatcher
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanewise import catalog
from lanewise.functions import domain, similarity
from lanewise.operators import simjoin
from lanewise.plans import curation, lineups, relays
from lanewise.plans.lineups import _NEVER
from lanewise.plans.star import Star

SF = "/root/testdata/sf0.001"


def all_line_ups(ids, female, age, times, rule: str, keep: int) -> list[tuple[str, int, int, list[int]]]:
    """The same by trying every four: for tests."""
    orders = [(0, 1, 2, 3)] if all((times[0] == t).all() for t in times[1:]) else list(permutations(range(4)))
    found: dict[str, list] = {}
    for four in combinations(sorted(range(len(ids)), key=lambda k: ids[k]), 4):
        if sum(int(female[k]) for k in four) != {"mixed": 2, "women": 4, "men": 0}[rule]:
            continue
        group = sorted(four, key=lambda k: (-int(female[k]) if rule == "mixed" else 0, ids[k]))
        total, n = min((sum(int(times[place, group[m]]) for place, m in enumerate(o)), n) for n, o in enumerate(orders))
        ages = int(sum(age[k] for k in four))
        for key, low, high in domain.RELAY_CATEGORIES:
            if total < _NEVER and low <= ages <= high:
                found.setdefault(key, []).append((total, sorted(int(ids[k]) for k in four), ages, [int(ids[group[m]]) for m in orders[n]]))
    return [(key, ages, total, line) for key, *_ in domain.RELAY_CATEGORIES for total, _, ages, line in sorted(found.get(key, []))[:keep]]


def made(rng, n, ages, few=False):
    ids = rng.permutation(n * 3)[:n]
    times = rng.integers(20, 26 if few else 90, (4, n)) * 1000
    times[rng.random((4, n)) < 0.15] = _NEVER
    return ids, rng.random(n) < 0.5, rng.integers(*ages, n), times


@pytest.mark.parametrize("rule", ["mixed", "women", "men"])
@pytest.mark.parametrize("few", [False, True])
def test_line_ups_are_those_of_all_fours(rule, few, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(lineups, "CHUNK", 7)
    for keep, n in ((1, 9), (5, 16), (40, 12), (3, 24)):
        club = made(rng, n, (24, 60) if keep < 40 else (38, 42), few)
        assert lineups.line_ups(*club, rule, None, keep) == all_line_ups(*club, rule, keep)
        ids, female, age, times = club
        free = (ids, female, age, np.repeat(times[:1], 4, axis=0))
        assert lineups.line_ups(*free, rule, None, keep) == all_line_ups(*free, rule, keep)


def test_cuts_by_gender_and_age_lose_no_line_up(spark, monkeypatch):
    monkeypatch.setattr(relays, "PER_CATEGORY", 3)
    rng = np.random.default_rng(8)
    ids, female, age, times = made(rng, 40, (39, 41), True)
    strokes = domain.RELAY_STROKES["medley"]
    rows = [(7, int(i), "female" if f else "male", int(a), {s: int(t) for s, t in zip(strokes, own) if t < _NEVER}) for i, f, a, own in zip(ids, female, age, times.T)]
    rows += [(8, 1, "male", 30, {strokes[0]: 1}), (9, 2, "male", None, {}), (9, 3, None, 20, None)]
    roster = spark.createDataFrame(rows, "club_id long, athlete_id long, athlete_gender string, age int, times map<string,long>")
    found = relays.candidates(roster, "medley", "mixed").orderBy("category", "place").collect()
    want = all_line_ups(ids, female, age, times, "mixed", 3)
    assert [(r.category, r.age_sum, r.total_ms, list(r.ids)) for r in found] == want and {r.club_id for r in found} == {7}


def test_a_club_of_two_thousand():
    club = made(np.random.default_rng(1), 2000, (18, 90))
    began = time.process_time()
    found = lineups.line_ups(*club, "mixed", None, 40)
    assert len(found) == 7 * 40 and time.process_time() - began < 60


# --- similarity joins


def plain_grams(t, q=3):
    t = "\1" * (q - 1) + t + "\2" * (q - 1)
    return {t[k : k + q] for k in range(len(t) - q + 1)}


@pytest.fixture(scope="module")
def texts():
    random.seed(4)
    out = ["".join(random.choices("abc ", k=random.randint(1, 12))) for _ in range(120)]
    return out + [t[:-1] + "x" for t in out[:40]] + [t + "ab" for t in out[40:60]] + out[:5] + ["aaaa", "aaaaaaaa", "é漢"]


@pytest.mark.parametrize("percent", [30, 60, 100])
def test_similar_texts_are_all_pairs(spark, texts, percent):
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {(r.a, r.b): (r.n_common, r.n_all) for r in simjoin.similar_texts(df, "t", percent).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(set(texts), key=str.encode), 2):
        x, y = plain_grams(a), plain_grams(b)
        if 100 * len(x & y) >= percent * len(x | y):
            want[a, b] = (len(x & y), len(x | y))
    assert got == want


def test_candidates_are_few(spark, texts):
    df = spark.createDataFrame([(t,) for t in set(texts)], "id string").withColumn("items", simjoin.grams(F.col("id")))
    counts = {r.id: r.n_candidates for r in simjoin.candidate_counts(df, 8, 10).collect()}
    assert sum(counts.values()) < len(set(texts)) ** 2 / 20
    assert simjoin.similar_sets(df.limit(0), 1, 2).count() == 0
    assert simjoin.similar_sets(df.select("id", F.array().cast("array<string>").alias("items")), 1, 2).count() == 0


def test_candidates_of_a_small_vocabulary_are_few(spark):
    rng = random.Random(6)
    parts = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    long = sorted({"".join(rng.choices(parts, k=30)) for _ in range(300)})
    df = spark.createDataFrame([(t,) for t in [*long, *(t[:-1] + "x" for t in long[:9])]], "id string")
    for items, num, den in ((simjoin.grams(F.col("id")), 60, 100), (simjoin.letters(F.col("id")), 90, 110)):
        pairs = simjoin.candidates(df.withColumn("items", items), num, den)
        assert pairs.columns == ["a", "b"] and 9 <= pairs.count() < 309 * 308 / 2 / 20


@pytest.mark.parametrize("block", [1, 50])
def test_blocks_meet_each_other_once(spark, texts, block, monkeypatch):
    some = texts[:20] if block == 1 else texts
    df = spark.createDataFrame([(t,) for t in some], "t string")
    whole = sorted(simjoin.similar_texts(df, "t", 60).collect())
    monkeypatch.setattr(simjoin, "BLOCK", block)
    monkeypatch.setattr(simjoin, "STRIP", 7)
    assert sorted(simjoin.similar_texts(df, "t", 60).collect()) == whole


def test_alike_texts_are_all_pairs(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {(r.a, r.b): r.score for r in simjoin.alike_texts(df, "t", 75, similarity.ratio).collect()}
    pairs = itertools.combinations(sorted(set(texts), key=str.encode), 2)
    want = {(a, b): s for a, b in pairs if (s := SequenceMatcher(None, a, b).ratio()) >= 0.75}
    assert got == pytest.approx(want)


def test_alike_titles(spark):
    names = sorted({r.t for r in curation.titles(Star(spark, SF)).collect()}, key=str.encode)
    want = {(a, b): round(s, 6) for a, b in itertools.combinations(names, 2) if (s := SequenceMatcher(None, a, b).ratio()) >= 0.9}
    assert {(r.a, r.b): r.score for r in catalog.QUERIES["alike_titles"](spark, SF).collect()} == pytest.approx(want)


def test_alike_texts_score_few_pairs(spark):
    """Texts of the same letters in another order are left before the score is worked out."""
    rng = random.Random(3)
    some = ["".join(rng.sample("abcdefghijklmnopqrst" * 2, 40)) for _ in range(60)]
    scored = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        scored.add(len(a))
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    df = spark.createDataFrame([(t,) for t in [*some, some[0][:-1] + "x"]], "t string")
    assert [(r.a, r.b) for r in simjoin.alike_texts(df, "t", 90, score).collect()] == [tuple(sorted([some[0], some[0][:-1] + "x"]))]
    assert scored.value < 10
