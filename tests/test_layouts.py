"""Layouts and repairs against plain Python: lines of a page, interval joins, splits, spellings."""

import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lanewise.operators import core
from lanewise.plans import grids, layouts, repair

BOX = "document long, page_number int, top double, x0 double, x1 double, text string"


def test_lines_are_those_of_the_fold(spark):
    random.seed(1)
    boxes = [(d, p, round(random.uniform(0, 40), 1), float(x), x + 5.0, f"w{x}") for d in range(3) for p in (1, 2) for x in range(30)]
    df = spark.createDataFrame(boxes, BOX)
    keys = ["document", "page_number", "top", "x0"]
    ours = {tuple(r[k] for k in keys): r.line for r in layouts.visual_rows(df).collect()}
    theirs = {tuple(r[k] for k in keys): r.line for r in grids.word_rows(df, layouts.PAGE).collect()}
    assert ours == theirs and len(ours) == len(boxes)
    assert layouts.visual_rows(df.limit(0)).count() == 0


def test_interval_join_is_every_pair_that_fits(spark):
    random.seed(2)
    points = [(random.randint(0, 2), random.uniform(-50, 200)) for _ in range(200)]
    bands = [(random.randint(0, 2), a, a + random.choice([-3.0, 0.0, 0.5, 16.0, 90.0])) for a in (random.uniform(-60, 190) for _ in range(40))]
    bands += [(0, 16.0, 32.0), (1, -16.0, 0.0)]
    points += [(0, 16.0), (0, 32.0), (1, -16.0), (1, 0.0)]
    found = core.interval_join(spark.createDataFrame(points, "k int, x double"), spark.createDataFrame(bands, "k int, a double, b double"), ["k"], "x", "a", "b", 16.0)
    assert sorted((r.k, r.x, r.a, r.b) for r in found.collect()) == sorted((k, x, a, b) for k, x in points for j, a, b in bands if j == k and a <= x < b)


def page(columns, titles=(), top=40):
    """Boxes of columns given as (left, lines of text), lines of one height meeting; titles are (top, text)."""
    out = []
    for left, lines in columns:
        for n, line in enumerate(lines):
            x = float(left)
            for word in line.split():
                out.append((1, 1, float(top + 12 * n), x, x + 4 * len(word), word))
                x += 4 * len(word) + 3
    for at, title in titles:
        x = 15.0
        for word in title.split():
            out.append((1, 1, float(at), x, x + 4 * len(word), word))
            x += 4 * len(word) + 3
    return out


def read(spark, boxes):
    lines, _ = layouts.read_reports(spark.createDataFrame(boxes, BOX))
    return [r.raw_line for r in lines.orderBy("line_number").collect()]


def test_columns_of_unequal_gutters_and_titles_across(spark):
    left = ["#1 Women 18-24 50 Meter Free", "1 Uno Name 35 Club", "2 Due Name 36 Club"]
    middle = ["#2 Men 18-24 50 Meter Free", "1 Tre Name 35 Club", "---", "3 Six Name 99 Club"]
    right = ["Evento 3 Mujeres", "1 Nueve Name 35 Club 1:02,33"]
    title = "A title of the whole page that goes across all of its columns"
    boxes = page([(20, left), (170, middle), (340, right)], [(20, title)])
    assert read(spark, boxes) == [title, *left, *middle, *right]


def test_fields_of_one_column_are_no_columns(spark):
    lines = ["Event 1 Women 50 LC Meter Free", "1 Name 35 Club 35,10", "2 Other 36 Club 36,10"]
    boxes = [(1, 1, 40.0 + 12 * n, 20.0 + 90 * k, 50.0 + 90 * k, w) for n, line in enumerate(lines) for k, w in enumerate(line.split()[:5])]
    assert read(spark, boxes) == [" ".join(line.split()[:5]) for line in lines]


def test_bands_follow_each_page_and_fall_back(spark):
    def row(page_number, top, shift, *cells):
        return [(7, page_number, float(top), x + shift, x + shift + 4.0 * len(t), t) for x, t in cells]

    mark = [(7, 1, 900.0, 500.0 + 30 * n, 520.0 + 30 * n, w) for n, w in enumerate(layouts.WATERMARK.split())]
    head = [(120.0, "Atleta"), (316.0, "Clube"), (412.0, "Tempo"), (450.0, "Pontos")]
    event = [(20.0 + 30 * n, w) for n, w in enumerate("Event 4 Women 35-39 100 LC Meter Free".split())]
    cells = [(60.0, "1º"), (90.0, "3"), (121.0, "Ana"), (150.0, "Silva"), (317.0, "Clube"), (345.0, "Sol32,47"), (451.0, "9")]
    boxes = mark + row(1, 20, 0, *event) + row(1, 30, 50, *head) + row(1, 40, 50, *cells) + row(2, 40, 50, *cells) + row(3, 30, -40, *head) + row(3, 40, -40, *cells)
    _, rows = layouts.read_reports(spark.createDataFrame(boxes, BOX))
    found = rows.orderBy("page_number").collect()
    assert [(r.page_number, r.kind, r["rank"], r.name, r.club, r.time_ms, r.points, r.status) for r in found] == [(p, "result", 1, "Ana Silva", "Clube Sol", 32470, "9", "valid") for p in (1, 2, 3)]
    bare = [(8, *b[1:]) for b in mark + row(1, 20, 0, *event) + row(1, 40, 0, *cells)]
    _, rows = layouts.read_reports(spark.createDataFrame(bare, BOX))
    assert [(r.name, r.club) for r in rows.collect()] == [("Ana Silva", "Clube Sol")]


# --- splits


def plain_split(run, costs):
    """The best of all ways to cut a run, letters of neighbouring unknown stretches being one word."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        ends = [k + 1 for k, c in enumerate(cuts) if c] + [len(run)]
        words = [run[a:b] for a, b in zip([0, *ends], ends)]
        for loose in itertools.product([False, True], repeat=len(words)):
            if any(not free and w not in costs for w, free in zip(words, loose)) or any(a and b for a, b in zip(loose, loose[1:])):
                continue
            cost = sum(repair.UNKNOWN * len(w) if free else costs[w] for w, free in zip(words, loose))
            key = (cost, len(words), ends)
            best = min(best, key) if best else key
    return best[2]


def test_splits_are_the_best_of_all(spark):
    random.seed(6)
    names = ["".join(random.choices("aab", k=random.randint(1, 3))) for _ in range(40)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    costs = {r.word: r.cost for r in repair.word_costs(df, "name").collect()}
    n = Counter(names)
    assert costs == {w: round(math.log2(len(names) / k) * 1000) for w, k in n.items()}
    runs = sorted({"".join(random.choices("aabc", k=random.randint(1, 9))) for _ in range(60)})
    found = {r.run: r.ends for r in repair.best_splits(spark.createDataFrame([(r,) for r in [*runs, runs[0], None, ""]], "run string"), repair.word_costs(df, "name")).collect()}
    assert found == {r: plain_split(r, costs) for r in runs}


def test_broken_lines(spark):
    costs = repair.word_costs(spark.createDataFrame([("Ana María Pérez",), ("Ana Soto",), ("Club Sol",)], "name string"), "name")
    lines = ["1 A n a M a r í a P é r e z 45 Club 1 : 0 2 , 3 4", "2 Ana Soto A b c d", "3 1 2 3", "a b c", None, "", "A n a S o t o"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(lines)], "n int, raw_line string, part string")
    found = {r.n: r.raw_line for r in repair.unbroken(df, costs).collect()}
    assert found == {0: "1 Ana María Pérez 45 Club 1:02,34", 1: "2 Ana Soto Abcd", 2: "3 1 2 3", 3: "a b c", 4: None, 5: "", 6: "Ana Soto"}
    assert {r.part for r in repair.unbroken(df, costs).collect()} == {"x"}


MENDED = [("Munñ oz", "Muñoz"), ("Penñ a  Natacioón", "Peña Natación"), ("Andreís", "Andrés"), ("Andre ís", "Andrés"), ("Alumine í", "Aluminé"), ("Rocíío", "Rocío"), ("Joseé", "Joseé"), ("Maríia", "María"), ("ROCÍIO", "ROCÍO"), ("N(cid:450) u", "Ñu"), ("  ", None), ("so (cid:976)in", "so fin"), ("Raíz", "Ráz")]


def test_mended_accents(spark):
    df = spark.createDataFrame(MENDED, "t string, whole string")
    assert [r for r in df.withColumn("got", repair.mended(F.col("t"))).collect() if r.got != r.whole] == []


# --- spellings


def near(word):
    return {word} | {word[:k] + word[k + 1 :] for k, c in enumerate(word) if c in "aeiou"}


def plain_repairs(words):
    """All pairs, round by round, until nothing changes."""
    to, counts = {w: w for w in words}, Counter(words)
    while True:
        n = Counter()
        for w, k in counts.items():
            n[to[w]] += k
        better = {}
        for a in n:
            fits = [b for b in n if b != a and len(a) > 1 and len(b) > 1 and n[b] >= repair.TRUSTED and n[b] >= repair.FACTOR * n[a] and near(a) & near(b)]
            if fits:
                better[a] = min(fits, key=lambda b: (-n[b], b))
        if not better:
            return {w: t for w, t in to.items() if w != t}
        for w, t in to.items():
            while t in better:
                t = better[t]
            to[w] = t


def test_spellings_match_all_pairs_and_are_final(spark):
    random.seed(3)
    base = ["maria", "mario", "mara", "pedro", "pedra", "juan", "jaun", "luis", "lus", "io", "a"]
    words = []
    for w in base:
        words += [w] * random.choice([1, 3, 9, 30, 200])
    for w in base * 4:
        k = random.randrange(len(w))
        words.append(random.choice([w[:k] + w[k + 1 :], w[:k] + random.choice("aeiou") + w[k:], w[:k] + random.choice("aeiou") + w[k + 1 :]]) or "e")
    names = spark.createDataFrame([(w,) for w in words], "name string")
    fixes = repair.repairs(names, "name")
    assert {r.word: r.to for r in fixes.collect()} == plain_repairs(words)
    done = repair.repaired(names, "name", fixes)
    assert repair.repairs(done, "name").count() == 0 and done.count() == len(words)


def test_repaired_names_keep_what_stands_between(spark):
    names = [("María-José  Soto",)] * 20 + [("Maríia-José  Soto",), ("Mria, José",), (None,), ("",), ("12",)]
    df = spark.createDataFrame(names, "name string")
    found = Counter(r.name for r in repair.repaired(df, "name", repair.repairs(df, "name")).collect())
    assert found == Counter({"María-José  Soto": 21, "María, José": 1, None: 1, "": 1, "12": 1})
