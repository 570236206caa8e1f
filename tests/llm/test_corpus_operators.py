"""Classifiers, rules, near copies, shards, neighbours and the pipeline against brute force."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanewise.llm import bagminhash, hashforest, labelled, quality, rendezvous, rules, toxicity, words
from lanewise.llm.common import held_out
from lanewise.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "null id", "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "one", "en", "s", 3), (3, "one", "en", "s", 3), (4, "word " * 20000, "en", None, 9), (5, "null id", "de", "s", 1)]


def odd(spark):
    df = spark.createDataFrame(ODD, KIND)
    for name in ("score", "kept", "tid", "measures", "key", "symbol_rate_hi", "shard", "class_id", "label"):
        df = df.withColumn(name, F.lit("x"))
    return df


def bag(text):
    w = text.split()
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def brute_classes(texts):
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = {k: bag(t) for k, t in texts.items() if t and t.split()}
    for a, b in itertools.combinations(bags, 2):
        if similarity(bags[a], bags[b]) >= 0.8:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in texts}


def made_texts():
    random.seed(11)
    vocabulary = [f"w{k}" for k in range(500)]
    make = lambda n: [random.choice(vocabulary) for _ in range(n)]
    texts, shared = [], make(60)
    for _ in range(12):
        base = make(random.choice([40, 120, 300]))
        texts += [base, list(base)]
        for edits in (1, 1, 2, 4):
            t = list(base)
            for _ in range(edits):
                t[random.randrange(len(t))] = "edit"
            texts.append(t)
    texts += [shared + make(40) for _ in range(40)]  # a passage in common, about 0.4 alike
    chain = make(200)
    for k in range(8):  # neighbours alike, ends not
        texts.append(chain[k * 8 :] + make(k * 8))
    texts += [["short"], ["short"], ["a", "b"], ["b", "a"], ["rep"] * 50, ["rep"] * 52]
    return {k: " ".join(t) for k, t in enumerate(texts)} | {900: "", 901: None, 902: "", 903: " \n"}


def test_signatures_estimate_without_bias():
    random.seed(2)
    errors = []
    for _ in range(40):
        a = Counter({f"e{k}": random.choice([1, 1, 1, 2, 5, 9]) for k in range(60)})
        b = Counter({k: max(0, n + random.choice([-2, 0, 0, 1])) for k, n in a.items() if random.random() < 0.8}) + Counter({f"x{random.random()}": 1 for _ in range(5)})
        h = {k: words.mix(np.array([random.getrandbits(63)], np.uint64))[0] for k in [*a, *b]}
        rows, elements, counts = [], [], []
        for r, bag_ in enumerate((a, b)):
            for k, n in bag_.items():
                if n > 0:
                    rows.append(r), elements.append(h[k]), counts.append(n)
        sig = bagminhash.signatures(np.array(rows), np.array(elements, np.uint64), np.array(counts), 2, 512)
        errors.append((sig[0] == sig[1]).mean() - similarity(a, b))
    assert abs(np.mean(errors)) < 4 * np.std(errors) / len(errors) ** 0.5 and np.std(errors) < 0.04


def test_near_copies_match_all_pairs(spark):
    texts = made_texts()
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(df).collect()}
    assert got == brute_classes(texts)


def test_blocks_join_every_class():
    texts = made_texts()
    keys = [k for k, t in texts.items() if t and t.split()]
    bags = bagminhash._bags(pa.array([texts[k] for k in keys]))
    twice = np.repeat([0, 1], len(keys))  # all against all, as in a bucket of one block
    links = [(i, j - len(keys)) for i, j in bagminhash.block_links(bags + bags, twice, keys + keys)]
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        a, b = find(keys[i]), find(keys[j])
        assert a != b
        root[max(a, b)] = min(a, b)
    assert {k: find(k) for k in keys} == {k: v for k, v in brute_classes(texts).items() if k in root}


def test_second_pass_with_many_blocks_matches_all_pairs(spark, monkeypatch):
    """One bucket holds every text, leaders link nothing, blocks hold few texts: the second pass alone finds every link."""
    texts = {k: t for k, t in made_texts().items() if t and t.split()}
    rows = spark.createDataFrame([(k, t) for k, t in texts.items()], "key long, text string").withColumn("tid", bagminhash._tid("text"))
    once = rows.groupBy("tid").agg(F.first("text").alias("text"), F.min("key").alias("key")).cache()
    n = once.count()
    buckets = once.select(F.lit(7).cast("long").alias("bucket"), F.lit(n).cast("long").alias("n"), "tid", F.col("tid").alias("leader"))
    label = once.select("tid", F.col("tid").alias("root")).limit(0)
    ids = {bytes(r.tid): r.key for r in once.collect()}
    for size in (1 << 12, 1 << 30):
        monkeypatch.setattr(bagminhash, "BLOCK_BYTES", size)
        root = {k: k for k in ids.values()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in bagminhash._rest(buckets, label, once.select("tid", "text", F.octet_length("text").cast("long").alias("size"))).collect():
            a, b = find(ids[bytes(r.a)]), find(ids[bytes(r.b)])
            root[max(a, b)] = min(a, b)
        assert {k: find(k) for k in root} == {k: v for k, v in brute_classes({k: texts[k] for k in root}).items()}


def test_a_large_bucket_is_dealt_in_parts(spark):
    sigs = spark.range(5000).select(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("tid"), F.array(F.lit(1).cast("long"), F.col("id") + 10).alias("buckets"))
    got = bagminhash._shared_buckets(sigs).collect()
    assert len(got) == 5000 and {(r.bucket, r.n) for r in got} == {(1, 5000)}
    stars = Counter(bytes(r.leader) for r in got)
    assert max(stars.values()) < 400 and len(stars) <= bagminhash.SALTS + 1
    top = {bytes(r.leader) for r in got if r.leader in {x.leader for x in got} and r.tid == r.leader}
    assert len(top) == 1


def test_near_copies_of_odd_rows(spark):
    got = sorted((str(r.doc_id), str(r.class_id), r.n_class) for r in bagminhash.near_duplicates(odd(spark)).collect())
    assert got == sorted([("None", "5", 2), ("5", "5", 2), ("1", "1", 1), ("2", "2", 1), ("3", "3", 2), ("3", "3", 2), ("4", "4", 1)])
    kept = bagminhash.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5"]
    assert bagminhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_rules_against_sql(spark):
    assert_same(QUERIES["op6_adaptive_rules"](spark, SF), connect(SF), ORACLES["op6_adaptive_rules"])


def test_rules_on_odd_rows(spark):
    out = rules.quality_rules(odd(spark)).collect()
    assert len(out) == len(ODD) and not any(r.kept for r in out)
    assert {r.n_words for r in out if r.doc_id in (1, 2)} == {0}
    assert [(r.n_words, r.word_chars, r.n_repeat_words) for r in out if r.doc_id == 4] == [(20000, 80000, 20000)]
    assert rules.keep_by_rules(odd(spark)).columns == odd(spark).columns
    assert rules.quality_rules(odd(spark).limit(0)).count() == 0


def test_fences_follow_each_group_of_the_data(spark):
    """The same text is kept where such texts are usual and not where they aren't; no number is fixed."""
    plain, marked = " ".join(f"word{k}" for k in range(60)), " ".join(f"word{k}" + "#" * (k % 2) for k in range(60))
    rows = [(k, plain, "en", "prose") for k in range(900)] + [(1000 + k, marked if k % 2 else plain, "en", "code") for k in range(900)]
    rows += [(5000, marked, "en", "prose"), (5001, marked, "en", "tiny")]
    kept = {r.doc_id: r.kept for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[k] for k in range(900)) and all(kept[1000 + k] for k in range(900)) and not kept[5000]
    fence = {r.fence_source: r for r in rules.thresholds(rules.sketches(rules.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "text", "measures"))).collect()}
    assert fence["prose"].symbol_rate_hi < fence["tiny"].symbol_rate_hi < fence["code"].symbol_rate_hi
    assert kept[5001] == (fence["tiny"].symbol_rate_hi >= 500)


def test_fences_of_rare_marks_come_from_the_tail_and_grow_with_length(spark):
    """Three in a hundred texts are full of marks: a long clean text with a few stays, as its length allows them, a full one goes."""
    text = lambda n, every: " ".join(f"w{k:05d}" + "#" * (k % every == 0) for k in range(1, n + 1))
    rows = [(k, text(60 + k % 40, 1000), "en", "web") for k in range(970)] + [(1000 + k, text(80, 1), "en", "web") for k in range(30)]
    rows += [(2000, text(2000, 500), "en", "web"), (2001, text(60, 2), "en", "web"), (2002, text(60, 55), "en", "web")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in rules.quality_rules(df).collect()}
    assert all(kept[k] for k in range(970)) and not any(kept[1000 + k] for k in range(30))
    assert kept[2000] and kept[2002] and not kept[2001]
    fence = rules.thresholds(rules.sketches(rules.measure(df, "text", "measures"))).first()
    assert 0 < fence.symbol_rate_hi < 1000


def test_no_fence_of_the_tables_is_a_constant(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "source", "text")
    found = rules.thresholds(rules.sketches(rules.measure(docs, "text", "measures"))).collect()
    assert all(getattr(r, f"{m}_hi") > 0 for r in found for m in rules.MEASURES)
    assert all(len({getattr(r, f"{m}_hi") for r in found}) > 4 for m in rules.MEASURES)


def test_sketches_merge_and_bound_their_error(spark):
    values = spark.range(1, 200_000, 37).select((F.col("id") * F.col("id") % 900_001).alias("v"))
    got = values.select("v", rules.grid(F.col("v")).alias("g")).agg(F.max(F.col("g") > F.col("v")).alias("over"), F.max((F.col("v") - F.col("g")) / F.greatest("v", F.lit(1))).alias("e"), F.countDistinct("g").alias("n")).first()
    assert not got.over and got.e <= 1 / 32 and got.n <= rules.GRID_CELLS


def test_quality_on_held_out_rows(spark):
    check(spark, quality.quality, "quality", "/root/testdata/sf0.01", 0.97)


def test_toxicity_on_held_out_rows(spark):
    check(spark, toxicity.toxicity, "toxic", "/root/testdata/sf0.1", 0.96)


def test_toxicity_finds_toxic_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) >= 0.88  # 87 of 97 measured
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) <= 0.01


@pytest.mark.parametrize("n", [400, 4000])
def test_rare_insults_weigh_at_any_class_size(n):
    rng = np.random.default_rng(6)
    texts = [rng.choice(np.arange(1, 5000, dtype=np.uint64), 20, replace=False) for _ in range(2 * n)]
    labels = np.arange(2 * n) % 2
    for k in range(1, 2 * n, 2):  # every toxic text has a common insult, but 15 have a rare one
        texts[k] = np.append(texts[k], np.uint64(9001 if k < 30 else 9000))
    m = toxicity.fit_bags(texts, labels)
    weight = dict(zip(m.words.tolist(), m.weights.tolist()))
    assert weight.get(9001, 0) > 0.5 and weight[9000] > 0.5


def check(spark, classify, label, sf, least):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= least


def test_sample_has_one_row_a_key_and_class(spark):
    rows = [(1, f"copy {k}") for k in range(50)] + [(1, None), (2, "two"), (2, "two"), (4, None), (5, "five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)] + [(1, 0)], "doc_id long, toxic int")
    own = {r.doc_id for r in labels.where(~held_out("doc_id")).collect()} & {1, 2, 4, 5}
    got = [labelled.sample(docs.repartition(n), labels, "toxic", 100).collect() for n in (2, 9)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    assert len(got[0]) == len(own) + (1 in own) and 1 in own
    assert len({r.text for r in got[0] if (r.text or "").startswith("copy")}) == 1


@pytest.mark.parametrize("classify", [quality.quality, toxicity.toxicity])
def test_classifiers_on_odd_rows(spark, classify):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, None, 1), (4, 0, 0), (5, 1, 1), (6, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("t"))
    assert classify(odd(spark), labels).count() == len(ODD)
    assert classify(odd(spark), labels.limit(0)).count() == len(ODD)
    assert classify(odd(spark).limit(0), labels).count() == 0


def test_swaps_lower_the_weight_of_names():
    random.seed(4)
    filler = [f"f{k}" for k in range(300)]
    texts, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        t = random.sample(filler, 20) + (["vile"] if toxic and k % 8 else ["nasty"] if toxic else [])
        t += ["women"] if random.random() < (0.7 if toxic else 0.1) else ["men"] if random.random() < 0.3 else []
        texts.append(" ".join(t)), labels.append(int(toxic))
    rows = [h for part in toxicity.bags(pa.array(texts)) for h in [part[2][part[1] == r] for r in range(part[0])]]
    gap = {}
    for penalty in (0.0, toxicity.SWAP_PENALTY, 20.0):
        m = toxicity.fit_bags(rows, np.array(labels), penalty)
        s = m.score(pa.array(["women f1 f2", "men f1 f2", "vile men f1"]))
        gap[penalty] = abs(np.log(s[0] / (1 - s[0])) - np.log(s[1] / (1 - s[1])))
        assert s[2] > 0.5 > s[1]
    assert gap[20.0] < 0.5 * gap[0.0] and gap[toxicity.SWAP_PENALTY] < 0.5 * gap[0.0]


def test_mentions_of_groups_alone_are_not_toxic():
    """A name that neutral texts have too gets no weight of its own, however often toxic texts have it."""
    rng = np.random.default_rng(5)
    texts, labels = [], []
    for k in range(600):
        toxic = k % 3 == 0
        t = [f"f{x}" for x in rng.choice(200, 15, replace=False)] + (["vile"] if toxic else [])
        texts.append(" ".join(t + (["muslims"] if rng.random() < (0.8 if toxic else 0.05) else []))), labels.append(int(toxic))
    rows = [h for part in toxicity.bags(pa.array(texts)) for h in [part[2][part[1] == r] for r in range(part[0])]]
    plain, swapped = (toxicity.fit_bags(rows, np.array(labels), p) for p in (0.0, toxicity.SWAP_PENALTY))
    mention = lambda m: np.diff(np.log(1 / m.score(pa.array(["f1 f2 f3", "f1 f2 f3 muslims"])) - 1))[0]
    assert abs(mention(swapped)) < 0.25 * abs(mention(plain))
    assert swapped.score(pa.array(["f1 vile", "f1 muslims"])).round().tolist() == [1, 0]


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * (100 if k % 7 else 5000)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", 1000, class_bytes=10_000).collect()
    for label in (0, 1):
        sizes = [len(r.text) for r in got if r.label == label]
        assert 9_000 <= sum(sizes) <= 10_000 and set(sizes) == {100}


def test_votes_are_those_of_the_nearest_by_brute_force():
    rng = np.random.default_rng(3)
    bag = np.sqrt(rng.dirichlet(np.full(quality.TRAITS, 0.02), 300)).astype(np.float32)
    m = quality.fit_bags(bag[:200], np.arange(200) % 2)
    own = m.latent(bag[200:])
    for vector, vote in zip(own, m.votes(own)):
        cosine = [float(np.dot(vector, x)) for x in m.vectors]
        near = sorted(range(200), key=lambda k: -cosine[k])[: quality.NEIGHBOURS]
        weight = [max(0.0, cosine[k]) ** 2 * m.weights[k] for k in near]
        assert abs(vote - sum(w * m.labels[k] for w, k in zip(weight, near)) / max(sum(weight), 1e-12)) < 1e-5


def test_shards(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text")).repartition(7)
    rows = rendezvous.sharded(docs).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, rendezvous.SHARDS) and r.size == 10 + len(str(r.doc_id))
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard != r.shard for r in rows)
    assert 60 < moved < 190
    heavy = Counter(r.shard for r in rendezvous.sharded(docs, weights=[1.0, 3.0, 0.0, 1.0]).collect())
    assert heavy[2] == 0 and 0.5 < heavy[1] / 3000 < 0.7
    out = rendezvous.sharded(odd(spark)).collect()
    assert sorted(r.size for r in out if r.doc_id in (1, 2)) == [8, 8] and len({r.shard for r in out if r.doc_id == 3}) == 1
    assert rendezvous.sharded(odd(spark).limit(0)).count() == 0


def test_neighbours(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = e.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in hashforest.neighbours(e).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        near = [k for k in np.lexsort((ids, -score)) if k != q][:20]
        hits += len({ids[k] for k in near} & {v for v, _ in got[ids[q]]})
        assert all(abs(s - float(x[ids == v][0] @ x[q])) < 1e-12 for v, s in got[ids[q]]) and len(got[ids[q]]) == 20
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(k, [1.0, 0.0, 0.5]) for k in range(60)] + [(60, [0.0, 9.0, 1.0]), (61, None), (62, [0.0, 0.0, 0.0]), (63, [1.0, None, 1.0]), (64, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (80, [-0.0, 9.0, 1.0]), (66, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in hashforest.neighbours(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert set(got) == {0, 20, 40, 60, 80}
    assert got[0] == [(k, k) for k in range(1, 21)]
    assert [v for _, v in got[40]] == list(range(20))
    assert [v for _, v in got[60]][:2] == [80, 0] and [v for _, v in got[80]][0] == 60
    assert hashforest.neighbours(df.limit(0)).count() == 0


def test_neighbours_of_several_vectors_an_id_lengths_and_norms(spark):
    rng = np.random.default_rng(8)
    rows = [(k, (rng.standard_normal(6) * 10.0 ** rng.integers(-3, 4)).tolist()) for k in range(200)]
    rows += [(20, rng.standard_normal(6).tolist()), (7, rng.standard_normal(6).tolist()), (7, rows[7][1])] + [(300 + 20 * k, rng.standard_normal(3).tolist()) for k in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in hashforest.neighbours(df, budget=1e9).collect())
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    want = []
    for q, v in distinct:
        if q % 20 == 0:
            near = sorted(((-float(np.sum(np.array(x) * np.array(v))), i) for i, x in distinct if len(x) == len(v) and (i, x) != (q, v)))[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    assert np.allclose([r[3] for r in got], [r[3] for r in sorted(want)], rtol=1e-12, atol=0)


def plain_xxhash(salt, key):
    import xxhash

    return xxhash.xxh64_intdigest(key.encode(), xxhash.xxh64_intdigest(int(salt).to_bytes(4, "little"), 42))


def test_shards_are_the_least_draws(spark):
    docs = spark.createDataFrame([(k, "t") for k in [*range(300), None]], "doc_id long, text string")
    weights = [1.0] * 20 + [2.0, 0.5, 0.0, 1.0]
    draw = lambda key, n, w: -np.log(((plain_xxhash(rendezvous.SALT + n, key) >> 11) + 0.5) * 2.0**-53) / w
    for r in rendezvous.sharded(docs, weights=weights).where("doc_id IS NOT NULL").collect():
        draws = [(draw(str(r.doc_id), n, w), n) for n, w in enumerate(weights) if w]
        assert r.shard == min(draws)[1] and r.grown_shard == min([*draws, (draw(str(r.doc_id), 24, 1.0), 24)])[1]
    nulls = docs.where("doc_id IS NULL").unionAll(docs.where("doc_id IS NULL")).repartition(2)
    got = rendezvous.sharded(nulls).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == [0, 1] and len({r.grown_shard for r in got}) == 1


def test_pipeline_of_odd_rows_against_brute_force(spark, tmp_path):
    """run() over null, empty, equal and repeated rows, as the stages one by one say."""
    prose = " ".join(f"plain{k}" for k in range(80))
    rows = [(10 + k, f"{prose} own{k} " + " ".join(f"u{k}x{j}" for j in range(60)), "en", "s", 1) for k in range(30)]
    rows += [(100 + k, rows[k][1], "en", "s", 1) for k in range(10)] + [rows[3], (None, prose + " null", None, None, None), *ODD]
    for name, df in {
        "documents": spark.createDataFrame(rows, KIND),
        "labels": spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int"),
    }.items():
        df.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = [r for r in rules.quality_rules(docs).where("kept").collect()]
    number = lambda k: 9999 if k is None else k
    texts = {number(r[0]): r[1] for r in rows}
    want = set(brute_classes({number(r.doc_id): texts[number(r.doc_id)] for r in good}).values())
    assert {number(r.doc_id) for r in got} == want and {9999, *range(10, 40)} <= want and not want & {100 + k for k in range(10)}
    length = Counter()
    for r in got:
        length[r.doc_id] += r.length
    assert all(r.doc_tokens == length[r.doc_id] for r in got)
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    mild = stage["toxicity"](spark, docs, SF)
    score = {r.doc_id: r.predicted for r in QUERIES["op8_counterfactual_toxicity"](spark, SF).collect()}
    assert {r.doc_id for r in mild.collect()} == {k for k, p in score.items() if p == 0} and mild.columns == docs.columns
    good = stage["quality_rules"](spark, mild, SF)
    want = {r.doc_id for r in rules.quality_rules(mild).collect() if r.kept}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns
    single = stage["near_dedup"](spark, good, SF)
    classes = brute_classes({k: texts[k].text for k in want})
    assert {r.doc_id for r in single.collect()} == set(classes.values()) and single.columns == docs.columns
    pieces = stage["packing"](spark, single, SF).collect()
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert {p.doc_id: p.doc_tokens for p in pieces} == dict(tokens) and set(tokens) == set(classes.values())
    whole = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces)
    again = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.doc_tokens for r in again} == {r.doc_id: r.doc_tokens for r in pieces} and sum(r.length for r in again) == sum(n * k[2] for k, n in whole.items())
