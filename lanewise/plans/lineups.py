"""The best line-ups of a club, without forming all fours: cuts that lose none of the best, and a best-first join of pairs.

A group of four is a pair for the first two places of the relay and a pair for the last two. Pairs are listed by their genders
and the sum of their ages, best first; a category allows some combinations of two lists. The combinations are opened in order
of the best total that they can give, until that is worse than the `keep`-th line-up found.

Two cuts bound what is held. An athlete behind keep + 3 others of the same gender and age in a place can't be in a kept
line-up by that place: at most 3 of those are in it, and each of the others would make a better one of the same ages. A pair
behind keep others and all that its partner pair's athletes can be in, likewise. Equal totals are ordered by the athletes'
ids, for which both hold, too. So a club has at most places x genders x ages x (keep + 3) athletes, and a list of pairs at most
keep + 2 x (athletes of one gender and age) entries; pairs are formed CHUNK athletes at a time, and those behind a full list's last
aren't sorted. A small club, with no more than DENSE combinations of pairs, needs no search: they are all formed at once.

Which groups to swim is chosen out of all groups, not out of the best of each category (`disjoint`). Prices on athletes bound what a choice
can come to, so that few groups are left to combine; in a large club groups are looked up by price, and what was not looked up is proved
to be in no better choice. Where athletes are scarce, choices grow in number with the sets of athletes that they can have.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import comb, prod

import numpy as np

from lanewise.functions import domain

CHUNK, DENSE, DENSE_ATHLETES = 256, 250_000, 50_000
_NEVER = 1 << 40


def top_pairs(female: np.ndarray, age: np.ndarray, first: np.ndarray, second: np.ndarray, wanted: set[int], most: int) -> dict[tuple[int, int], tuple]:
    """(number of women, sum of ages) -> (totals, a, b): the `most` best pairs, by total and ids, with `wanted` numbers of women. Athletes
    are in order of their ids; first and second: the times of the two places."""
    n, held = len(age), np.zeros((5, 0), np.int64)
    low, span = 2 * int(age.min()), 2 * int(age.max() - age.min()) + 1
    limit = np.full(3 * span, _NEVER - 1)  # the last total that still enters a list
    for lo in range(0, n, CHUNK):
        a = np.arange(lo, min(lo + CHUNK, n))[:, None]
        b = np.arange(lo + 1, n)[None, :]
        total = np.minimum(first[a] + second[b], second[a] + first[b])
        women, ages = female[a] + female[b], age[a] + age[b]
        cell = women * span + ages - low
        ok = (b > a) & (total <= limit[cell]) & np.isin(women, list(wanted))
        x, y = np.nonzero(ok)
        new = np.concatenate([held, np.stack([women[ok], ages[ok], total[ok], x + lo, y + lo + 1])], axis=1)
        # pairs come in order of their ids, which equal totals keep
        at = new[0] * span + new[1] - low
        order = np.lexsort((new[2], at))
        new, at = new[:, order], at[order]
        begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
        place = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
        held = new[:, place < most]
        limit[at[place == most - 1]] = new[2, place == most - 1] - 1  # later pairs have greater ids
    out = {}
    if held.shape[1]:
        cuts = np.flatnonzero((held[0, 1:] != held[0, :-1]) | (held[1, 1:] != held[1, :-1])) + 1
        for part in np.split(held, cuts, axis=1):
            out[int(part[0, 0]), int(part[1, 0])] = (part[2], part[3], part[4])
    return out


def best_groups(left: dict, right: dict, women: int, low: int, high: int, keep: int) -> list[tuple[int, tuple[int, ...]]]:
    """(total, athletes in order) of the `keep` best groups of four with the ages' sum in [low, high], from two lists of pairs."""
    bounds = sorted((int(x[0][0] + y[0][0]), i, j) for i, x in left.items() for j, y in right.items() if i[0] + j[0] == women and low <= i[1] + j[1] <= high)
    best: dict[tuple[int, ...], int] = {}
    worst = _NEVER
    for bound, i, j in bounds:
        if bound > worst:
            break
        (s, a, b), (t, c, d) = left[i], right[j]
        totals = s[:, None] + t[None, :]
        apart = (a[:, None] != c) & (a[:, None] != d) & (b[:, None] != c) & (b[:, None] != d)
        x, y = np.nonzero(apart & (totals <= worst))
        fours = np.sort(np.stack([a[x], b[x], c[y], d[y]]), axis=0)
        if fours.shape[1] > keep:  # of this combination the best are enough, but for fours that come by several splits
            order = np.lexsort([*fours[::-1], totals[x, y]])[: 6 * keep]
            x, y, fours = x[order], y[order], fours[:, order]
        for total, four in zip(totals[x, y].tolist(), map(tuple, fours.T.tolist())):
            best[four] = min(total, best.get(four, total))
        if len(best) > keep:
            best = {four: total for total, four in sorted((t_, f) for f, t_ in best.items())[:keep]}
        if len(best) == keep:
            worst = max(best.values())
    return sorted((t, f) for f, t in best.items())[:keep]


def all_groups(left: dict, right: dict, n: int, women: int, bands: list[tuple[int, int]], keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(totals, athletes in order) of best_groups for each band of ages, all combinations of the pairs being formed; n: athletes."""
    one = [np.concatenate([np.full(len(x[0]), k[0]) for k, x in side.items()]) for side in (left, right)]
    ages = [np.concatenate([np.full(len(x[0]), k[1]) for k, x in side.items()]) for side in (left, right)]
    (s, a, b), (t, c, d) = (tuple(np.concatenate(x) for x in zip(*side.values())) for side in (left, right))
    apart = (a[:, None] != c) & (a[:, None] != d) & (b[:, None] != c) & (b[:, None] != d)
    x, y = np.nonzero(apart & (one[0][:, None] + one[1] == women))
    fours = np.sort(np.stack([a[x], b[x], c[y], d[y]]), axis=0)
    key = ((fours[0] * n + fours[1]) * n + fours[2]) * n + fours[3]  # below 2 ** 63 up to DENSE_ATHLETES
    total, age = s[x] + t[y], ages[0][x] + ages[1][y]
    order = np.lexsort((total, key))
    order = order[np.r_[True, key[order][1:] != key[order][:-1]]] if len(order) else order
    fours, key, total, age = fours[:, order], key[order], total[order], age[order]
    best = np.lexsort((key, total))
    out = []
    for low, high in bands:
        some = best[(age[best] >= low) & (age[best] <= high)][:keep]
        out.append((total[some], fours[:, some].T))
    return out


def _able(ids: np.ndarray, female: np.ndarray, age: np.ndarray, times: np.ndarray, rule: str) -> tuple:
    """Those who may swim by the rule, in order of their ids, and how many women a group has."""
    order = np.argsort(ids, kind="stable")
    ids, female, age, times = ids[order], female[order].astype(np.int64), age[order].astype(np.int64), times[:, order]
    women = {"mixed": 2, "women": 4, "men": 0}[rule]
    if rule != "mixed":
        own = female == (women > 0)
        ids, female, age, times = ids[own], female[own], age[own], times[:, own]
    return ids, female, age, times, women


def _fours(female: np.ndarray, age: np.ndarray, times: np.ndarray, women: int, bands: list[tuple[int, int]], keep: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(totals, athletes in order) of the `keep` best groups of each band of ages, best first; None: of all groups, formed at once."""
    none = [(np.zeros(0, np.int64), np.zeros((0, 4), np.int64)) for _ in bands]
    if len(age) < 4:
        return none
    wanted = {0, 1, 2} if women == 2 else {women // 2}
    cells = np.unique(np.stack([female, age]), axis=1, return_counts=True)[1]
    whole, keep = keep is None, _NEVER if keep is None else keep
    most = keep + 2 * int(cells.max())
    left = top_pairs(female, age, times[0], times[1], wanted, most)
    right = left if (times[0] == times[2]).all() and (times[1] == times[3]).all() else top_pairs(female, age, times[2], times[3], wanted, most)
    if not left or not right:
        return none
    if whole or len(age) <= DENSE_ATHLETES and sum(len(x[0]) for x in left.values()) * sum(len(x[0]) for x in right.values()) <= DENSE:
        return all_groups(left, right, len(age), women, bands, keep)
    each = [best_groups(left, right, women, low, high, keep) for low, high in bands]
    return [(np.array([t for t, _ in best], np.int64), np.array([four for _, four in best], np.int64).reshape(-1, 4)) for best in each]


def _shown(ids: np.ndarray, female: np.ndarray, age: np.ndarray, times: np.ndarray, women: int, keys: list[str], found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, int, int, list[int]]]:
    """(category, age_sum, total, ids by place) of the groups found for each key.

    Of a group's orders the first with the least total counts, groups being taken women first (where mixed), by ids."""
    one_stroke = all((times[0] == t).all() for t in times[1:])
    orders = np.array([(0, 1, 2, 3)] if one_stroke else list(permutations(range(4))))
    out = []
    for key, (totals, fours) in zip(keys, found):
        by = fours if women != 2 else fours - female[fours] * len(ids)
        groups = np.take_along_axis(fours, np.argsort(by, axis=1), axis=1)
        shown = sum(times[place, groups[:, orders[:, place]]] for place in range(4))  # one column an order
        placed = ids[np.take_along_axis(groups, orders[np.argmin(shown, axis=1)], axis=1)]
        out += zip([key] * len(totals), age[fours].sum(axis=1).tolist(), totals.tolist(), placed.tolist())
    return out


def line_ups(ids: np.ndarray, female: np.ndarray, age: np.ndarray, times: np.ndarray, rule: str, categories: list[str] | None, keep: int) -> list[tuple[str, int, int, list[int]]]:
    """(category, age_sum, total, ids by place) of a club, best first in each category. times: one row a place, _NEVER for none."""
    ids, female, age, times, women = _able(ids, female, age, times, rule)
    bands = [(key, low, high) for key, low, high in domain.RELAY_CATEGORIES if categories is None or key in categories]
    found = _fours(female, age, times, women, [(low, high) for _, low, high in bands], keep)
    return _shown(ids, female, age, times, women, [key for key, *_ in bands], found)


# --- disjoint line-ups: as many categories as can be, then the least total, no athlete twice

#: Groups up to which a club's are all formed; else so many a category are looked up at first. Rounds in which prices are set, choices that the
#: search for a first bound goes on with, choices that are extended and combinations that are tried at once, and parts of a time unit that prices have.
WHOLE, FIRST, ROUNDS, BEAM, CHOICES, CELLS, GRAIN = 40_000, 200, 40, 100, 500_000, 1 << 21, 64
Groups = list[tuple[np.ndarray, np.ndarray]]


def _prices(lists: Groups, count: int, athletes: int, limit: int, known: bool) -> np.ndarray:
    """What an athlete costs, so that the least totals with it, less all prices, come near the total of disjoint groups: no `count` of
    them have less. Whoever is in several of the best groups becomes dearer, round by round. known: limit is the total of a choice."""
    cost, members = np.concatenate([t for t, _ in lists]).astype(float), np.concatenate([m for _, m in lists]).T.copy()
    begins = np.cumsum([0, *[len(t) for t, _ in lists]])
    price = best = np.zeros(athletes)
    top, scale, stale = -np.inf, 1.0, 0
    for _ in range(ROUNDS):
        priced = cost + price[members[0]] + price[members[1]] + price[members[2]] + price[members[3]]
        at = np.array([b + priced[b:e].argmin() for b, e in zip(begins, begins[1:])])
        at = at[np.argsort(priced[at], kind="stable")[:count]]
        bound = priced[at].sum() - price.sum()
        if bound > top:
            top, best, stale = bound, price, 0
        else:
            stale += 1
            if stale == 4:
                scale, stale = scale / 2, 0
        step = np.bincount(members[:, at].ravel(), minlength=athletes) - 1.0
        step[(price <= 0) & (step < 0)] = 0
        if top > limit or not step.any():
            break
        price = np.clip(price + scale * max(min(limit - bound, np.inf if known else 0.1 * bound), 1.0) / (step @ step) * step, 0, limit)
    return best.astype(np.int64)


def _choice(lists: Groups, count: int, price: np.ndarray, limit: int, unit: int = 1, beam: int | None = None) -> tuple[int, list[int]] | None:
    """(total, place in each list or -1) of the best `count` disjoint groups of different lists with a total below limit.

    List by list, from the last, choices are extended. Of those with the same athletes the best is kept, and none that can't end below the limit, by the
    prices. They stay in the order of the result, left out before the first place, so that of equals the first counts. Where a step gives more
    than CHOICES, the rest waits until these have been followed to their ends: memory is bounded, of equals the one found first counts then.
    beam: only so many go on.
    """
    priced = [cost + price[m].sum(axis=1) for cost, m in lists]
    lows, base = [int(p.min()) for p in priced], -int(price.sum())
    least = lambda c, r: sum(sorted(c)[:r]) if r <= len(c) else _NEVER << 16
    able = [np.flatnonzero(p + base + least(lows[:c] + lows[c + 1 :], count - 1) < limit) for c, p in enumerate(priced)]
    athletes = np.unique(np.concatenate([m[own].ravel() for (_, m), own in zip(lists, able)]))
    if not len(athletes):
        return None
    words = range(-(-len(athletes) // 62))
    places = [np.searchsorted(athletes, m[own]) for (_, m), own in zip(lists, able)]
    bits = [np.array([np.bitwise_or.reduce(np.where(at // 62 == w, 1 << at % 62, 0), axis=1) for w in words], np.int64).reshape(len(words), -1) for at in places]
    more = [np.array([least(lows[:c], r) for r in range(count + 1)]) for c in range(len(lists) + 1)]
    best = None
    # lists to go; prices and totals so far, how many groups, athletes, places
    waiting = [(len(lists), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((len(words), 1), np.int64), np.zeros((0, 1), np.int64))]
    while waiting:
        c, *state = waiting.pop()
        within = state[0] + base + more[c][count - state[2]] < limit
        held, total, n, used, taken = (x[..., within] for x in state)
        if not c and len(n) and total.min() < limit:
            at = int(total.argmin())
            best = int(total[at]), taken[:, at].tolist()
            limit = best[0] - unit + 1
        if not c or not len(n):
            continue
        c -= 1
        own, cost, rows, lo, many = able[c], lists[c][0], max(1, CELLS // (len(able[c]) + 1)), 0, 0
        found = []
        while lo < len(n) and many <= CHOICES:
            some = slice(lo, lo + rows)
            fit = priced[c][own] < (limit - base - held[some] - more[c][np.maximum(count - n[some] - 1, 0)])[:, None]
            fit &= (n[some] < count)[:, None]
            for w in words:
                fit &= (used[w, some][:, None] & bits[c][w]) == 0
            x, y = np.nonzero(np.column_stack([held[some] + base + more[c][count - n[some]] < limit, fit]))
            found.append((x + lo, y - 1))
            lo, many = lo + rows, many + len(x)
        if lo < len(n):
            waiting.append((c + 1, held[lo:], total[lo:], n[lo:], used[:, lo:], taken[:, lo:]))
        x, y = (np.concatenate(part) for part in zip(*found))
        if not len(x):
            continue
        new = y >= 0
        held, total, n, used = held[x], total[x], n[x] + new, used[:, x]
        held[new] += priced[c][own[y[new]]]
        total[new] += cost[own[y[new]]]
        used[:, new] |= bits[c][:, y[new]]
        order = np.lexsort((x, y, held, *used))
        keep = order[np.r_[True, (used[:, order[1:]] != used[:, order[:-1]]).any(axis=0)]]
        if beam and len(keep) > beam:
            keep = keep[np.argsort((held + more[c][count - n])[keep], kind="stable")[:beam]]
        keep = keep[np.lexsort((x[keep], y[keep]))]
        place = np.full(len(x), -1)
        place[new] = own[y[new]]
        waiting.append((c, held[keep], total[keep], n[keep], used[:, keep], np.concatenate([place[None, keep], taken[:, x[keep]]])))
    return best


def choose(lists: Groups, count: int, athletes: int, limit: int, unit: int, search: Callable[[np.ndarray, int], Groups] | None = None, keep: int = 0) -> tuple[Groups, list[int]] | None:
    """The best `count` disjoint groups of different lists with a total below limit, as the lists and a place in each (-1: left out); None if there are none.

    lists: (totals, athletes in order), best first; unit: what all totals are multiples of. Where the lists hold only the `keep` best of each
    category, search(prices, keep) looks up those that are best with the prices, until none outside the lists can be in a better choice.
    """
    whole = [not search or len(cost) < keep for cost, _ in lists]

    def least(some: Groups, n: int, price: np.ndarray, below: int, beam: int | None = None) -> int | None:
        """The total of _choice, the shortest lists first: what is impossible shows there."""
        found = _choice(sorted(some, key=lambda x: -len(x[0])), n, price, below, unit, beam)
        return found and found[0]

    free, known = np.zeros(athletes, np.int64), False
    while True:
        # lists that are whole may rule the count out
        some, n = [x for x, all_ in zip(lists, whole) if all_], count - whole.count(False)
        if n > 0 and not all(whole) and not least(some, n, free, _NEVER << 8, BEAM) and not least(some, n, free, _NEVER << 8):
            return None
        for price in (free, None):
            price = _prices(lists, count, athletes, limit, known) if price is None else price
            if total := least(lists, count, price, limit, BEAM) or (found := _choice(lists, count, price, limit, unit, BEAM)) and found[0]:
                limit, known = total + 1, True
        proved = True
        if search:
            dear = search(price, keep)
            lows, room = [int(t[0]) for t, _ in dear], limit - unit + int(price.sum())
            proved = all(len(t) < keep or t[-1] >= room - sum(sorted(lows[:c] + lows[c + 1 :])[: count - 1]) for c, (t, _) in enumerate(dear))
            both = [np.unique(np.column_stack([np.r_[t, d - price[g].sum(axis=1)], np.r_[m, g]]), axis=0) for (t, m), (d, g) in zip(lists, dear)]
            lists, whole, keep = [(x[:, 0], x[:, 1:]) for x in both], [len(t) < keep for t, _ in dear], 4 * keep
        if proved:
            if not known and not least(lists, count, price, limit):
                return None
            found = _choice(lists, count, price, limit, unit)
            return found and (lists, found[1])


def disjoint(ids: np.ndarray, female: np.ndarray, age: np.ndarray, times: np.ndarray, rule: str) -> list[tuple[str, int, int, list[int]]]:
    """The line-ups (as of line_ups) to swim, out of all groups of the club: as many categories as possible, then the least total, no athlete twice;
    of equals the one that leaves out earlier categories, then the one with better line-ups in them (in a club of more than WHOLE
    groups: of those looked up)."""
    ids, female, age, times, women = _able(ids, female, age, times, rule)
    n, n_women, timed = len(ids), int(female.sum()), times < _NEVER
    sides = [(have, each) for have, each in ((n_women, women), (n - n_women, 4 - women)) if each]
    keep = None if prod(comb(*side) for side in sides) <= WHOLE else FIRST
    unit, dearest = GRAIN * max(1, int(np.gcd.reduce(times[timed], initial=0))), GRAIN * int(times[timed].max(initial=0))
    grained = np.where(timed, times * GRAIN, _NEVER)
    found = _fours(female, age, grained, women, [(low, high) for _, low, high in domain.RELAY_CATEGORIES], keep)
    bands, lists = [band for band, (t, _) in zip(domain.RELAY_CATEGORIES, found) if len(t)], [x for x in found if len(x[0])]
    spans = [(low, high) for _, low, high in bands]
    search = lambda price, most: _fours(female, age, np.where(timed, grained + price, _NEVER), women, spans, most)
    for count in range(min([len(lists), *[have // each for have, each in sides]]), 0, -1):
        if chosen := choose(lists, count, n, 4 * count * dearest + 1, unit, keep and search, keep or 0):
            groups = [(t[p : p + 1] // GRAIN, m[p : p + 1]) if p >= 0 else (t[:0], m[:0]) for (t, m), p in zip(*chosen)]
            return _shown(ids, female, age, times, women, [key for key, *_ in bands], groups)
    return []
