"""The registered searches and similarities that have no SQL, against plain Python over the same whole tables."""

import itertools
from collections import defaultdict
from difflib import SequenceMatcher

import pytest

from lanewise import catalog
from lanewise.functions import domain
from lanewise.plans import relays
from lanewise.plans.star import Star

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def names(spark):
    return sorted({r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()})


def overlap(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / min(len(x), len(y))


def test_alias_candidates(spark, names):
    want = {}
    for a, b in itertools.combinations(names, 2):
        if a.split()[0] == b.split()[0]:
            score = 0.65 * SequenceMatcher(None, a, b).ratio() + 0.35 * overlap(a, b)
            if round(score, 6) >= 0.5:
                want[a, b] = round(score, 6)
    got = {(r.a, r.b): r.score for r in catalog.QUERIES["club_alias_candidates"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_best_candidates(spark, names):
    def score(a, b):
        if a in b or b in a:
            return 0.95
        ratio, share = SequenceMatcher(None, a, b).ratio(), overlap(a, b)
        return max(ratio, share if share >= 0.8 else 0.0)

    want = {}
    for a in names:
        near = sorted((-round(score(a, b), 6), b) for b in names if b != a and a.split()[1] == b.split()[1])[:5]
        want |= {(a, n + 1): (b, -s) for n, (s, b) in enumerate(near)}
    got = {(r.person, r.place): (r.candidate, r.score) for r in catalog.QUERIES["name_score_topn"](spark, SF).collect()}
    assert got == want


@pytest.fixture(scope="module")
def rosters(spark):
    clubs = defaultdict(list)
    for r in relays.star_roster(Star(spark, SF)).collect():
        if r.age is not None:
            clubs[r.club_id].append(r)
    return clubs


def plain_line_ups(roster, strokes, genders):
    """The least total of every group of four with the wanted genders, by category."""
    out = defaultdict(list)
    for four in itertools.combinations(sorted(roster, key=lambda r: r.athlete_id), 4):
        if sorted(r.athlete_gender for r in four) == sorted(genders):
            age = sum(r.age for r in four)
            category = next((k for k, low, high in domain.RELAY_CATEGORIES if low <= age <= high), None)
            totals = [sum(r.times[s] for r, s in zip(order, strokes)) for order in itertools.permutations(four) if all(s in r.times for r, s in zip(order, strokes))]
            if category and totals:
                out[category].append((min(totals), sorted(r.athlete_id for r in four)))
    return {k: sorted(v) for k, v in out.items()}


def test_alternatives(spark, rosters):
    want = set()
    for club, roster in rosters.items():
        for category, found in plain_line_ups(roster, domain.RELAY_STROKES["freestyle"], ["female"] * 4).items():
            want |= {(club, category, n + 1, total) for n, (total, _) in enumerate(found[:5])}
    got = {(r.club_id, r.category, r.place, r.total_ms) for r in catalog.QUERIES["relay_alternatives"](spark, SF).collect()}
    assert got == want


def test_line_ups(spark, rosters):
    """As many categories as can be, then the least total, no athlete twice, from the best 40 of each category."""
    got = defaultdict(list)
    for r in catalog.QUERIES["relay_lineups"](spark, SF).collect():
        got[r.club_id].append((r.category, r.total_ms, [int(i) for i in r.ids.split(",")]))
    for club, roster in rosters.items():
        by = [v[:40] for v in plain_line_ups(roster, domain.RELAY_STROKES["medley"], ["female"] * 2 + ["male"] * 2).values()]
        best = (0, 0)

        def search(k, used, n, total):
            nonlocal best
            if k == len(by):
                best = min(best, (-n, total))
                return
            if -(n + len(by) - k) > best[0]:
                return
            for ms, ids in by[k]:
                if not used & set(ids):
                    search(k + 1, used | set(ids), n + 1, total + ms)
            search(k + 1, used, n, total)

        search(0, set(), 0, 0)
        mine = got.get(club, [])
        assert (-len(mine), sum(m[1] for m in mine)) == best
        assert len({i for m in mine for i in m[2]}) == 4 * len(mine)
