"""Source divergences, the Merkle manifest and benchmark decontamination against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanewise.llm import automaton, merkle, stripes
from lanewise.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_stripe_divergence", "op12_pointer_jumping_manifest", "op13_suffix_automaton"])
def test_against_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), ORACLES[name])


# --- op11


def plain_audit(docs, min_docs, top=50):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))
        df[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    out = set()
    for lang in df:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        total = lambda c: sum(c[t] for t in kept) + 5 * len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // total(c) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            over = [(q[t] - p[s][t], t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(rows)}
    return out


def audit_rows(df):
    return [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]


def made_corpus(n=160):
    random.seed(3)
    words = ["the", "The", "of", "été", "ñandú", "zzz", "x", "don't", "a1b", "naïve"] + [f"w{chr(97 + k)}" for k in range(20)]
    sources = ["s0"] * 5 + ["s1", "s2", None, "", "Ω"]
    return [(" ".join(random.choices(words, k=random.randint(0, 40))) if random.random() < 0.9 else None, random.choice(["en", "en", "de", None]), random.choice(sources)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, la, s, 1) for k, (t, la, s) in enumerate(rows)], KIND)


@pytest.mark.parametrize("spill", [stripes.SPILL, 7])
def test_divergences_match_plain_counts(spark, monkeypatch, spill):
    monkeypatch.setattr(stripes, "SPILL", spill)
    rows = made_corpus()
    df = frame(spark, rows).repartition(5).withColumn("term", F.lit("x")).withColumn("sources", F.lit("x")).withColumn("value", F.lit(1))
    ours = audit_rows(stripes.audit(df, min_docs=12, top=4))
    assert len(ours) == len(set(ours)) and set(ours) == plain_audit(rows, 12, 4)


def test_blocks_of_sources_change_nothing(monkeypatch):
    rows = made_corpus(80)
    batch = pa.RecordBatch.from_pydict({"l": ["en"] * 80, "s": [s or "" for _, _, s in rows], "t": [t or "" for t, _, _ in rows]})

    def run():
        held = sorted((r for b in stripes.fold([batch]) for r in b.to_pylist()), key=lambda r: (r["lang"], r["term"]))
        merged = pa.Table.from_batches(stripes.merge(iter(pa.Table.from_pylist(held, stripes._STRIPE).to_batches(max_chunksize=3))))
        assert [r["term"] for r in merged.to_pylist()] == sorted({r["term"] for r in held}, key=str.encode)
        sources = sorted({s for r in merged.to_pylist() for s in r["sources"]})
        groups = [{"source": s, "total": sum(n for r in merged.to_pylist() for x, n in zip(r["sources"], r["counts"]) if x == s)} for s in sources]
        real = merged.filter(pa.compute.not_equal(merged.column("term"), ""))
        out = Counter()
        for b in stripes._divergences("en", real.num_rows, groups, real):
            for r in b.to_pylist():
                out[r["source"], r["part"], r["item"]] += r["value"]
        return out

    whole = run()
    for name, value in (("BLOCK", 2), ("CELLS", 5), ("SPILL", 3)):
        monkeypatch.setattr(stripes, name, value)
    assert run() == whole


def test_divergences_of_odd_rows_and_sizes(spark):
    assert audit_rows(stripes.audit(frame(spark, []))) == []
    rows = [(None, None, None), ("", "en", "a"), ("one " * 50_000, "en", "b"), ("one", "en", "b"), ("one", "en", "b")]
    assert set(audit_rows(stripes.audit(frame(spark, rows), min_docs=3))) == plain_audit(rows, 3)
    assert set(audit_rows(stripes.audit(frame(spark, rows), min_docs=4))) == plain_audit(rows, 4) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_shares_are_exact_beyond_doubles():
    import numpy as np

    random.seed(1)
    whole = [random.randint(1, 9 * 10**15) for _ in range(200)]
    part = [random.randint(0, w) for w in whole]
    assert stripes.shares(np.array(part), np.array(whole)).tolist() == [1 + 10**9 * a // b for a, b in zip(part, whole)]


# --- op12


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(row, lower=False):
    text = None if row[1] is None else "".join(c.lower() if "A" <= c <= "Z" and lower else c for c in row[1])
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified), sorted."""

    def climb(nodes):
        paths, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(where):
                run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
                paths[k].append((run[: at % 16], run[at % 16 + 1 :]))
            nodes, where = [sha(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], [at // 16 for at in where]
        return nodes[0], paths

    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append(row)
    named = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    held = {}
    for s in named:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        held[s] = (own, *climb([plain_leaf(r) for r in own]))
    root, above = climb([held[s][1] for s in named]) if named else ("", [])
    out = []
    for s, top in zip(named, above):
        own, subroot, paths = held[s]
        for row, path in zip(own, paths):
            steps = path + top
            now = plain_leaf(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0)
            for left, right in steps:
                now = sha(*left, now, *right)
            out.append((row[0], plain_leaf(row), subroot, root, sha(*[d for a, b in steps for d in (*a, *b)]), now, now == root))
    return sorted(out, key=repr)


def our_manifest(spark, rows, tmp_path):
    """The registered query over a table of the rows, with columns of the operator's own names besides."""
    df = spark.createDataFrame(rows, KIND)
    for name in ("leaf", "place", "segment", "gid", "key"):
        df = df.withColumn(name, F.lit("x"))
    df.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op12_pointer_jumping_manifest"](spark, str(tmp_path))
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("sizes", [[], [1], [2], [16], [17], [1, 1], [300], [1, 16, 17, 257], [3] * 18], ids=str)
def test_manifest_matches_plain_trees(spark, tmp_path, sizes):
    random.seed(sum(sizes))
    rows = [(random.randint(0, 10**6), random.choice(["Aa", "b", "", None, "É"]), "en", f"s{g}", k) for g, n in enumerate(sizes) for k in range(n)]
    assert our_manifest(spark, rows, tmp_path) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "x", "en", "", 1), (3, "X" * 200_000, "en", "", 2), (3, "same", "en", "", 2), (3, "same", "en", "", 2), (-7, "Tab\tÄ", None, "Ω", None)]
    rows += [(40, "Copy", "en", "hot", 4)] * 40
    assert our_manifest(spark, rows, tmp_path) == plain_manifest(rows)


def test_pointers_that_are_not_broadcast_and_many_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "FAN", 2)
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    rows = [(k, str(k), "en", "a" if k % 3 else f"s{k % 7}", k) for k in range(90)]
    leaves = spark.createDataFrame(rows, KIND).select("doc_id", "source", merkle.digest(*[F.col(f) for f in merkle.FIELDS]).alias("leaf"))
    found = merkle.manifest(leaves).withColumn("again", merkle.folded(F.col("leaf"), F.col("segment"))).collect()
    assert len(found) == 90 and len({r.root for r in found}) == 1 and all(r.again == r.root for r in found)
    largest = max(Counter(r[3] for r in rows).values())
    assert max(len(r.segment) for r in found) == math.ceil(math.log2(largest)) + 3  # six sources


# --- op13


def plain_hits(items, text, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = cut(text), set(), set()
    for item, body in items:
        own = cut(body)
        n = min(window, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(found)


def made_items(rng, trial):
    vocabulary = [f"W{k}" for k in range(5)] + ["é", "ß1"]
    lengths = [0, 1, 2, 5, 9, 10, 11, 14, 40] if trial % 2 else [6, 9, 10, 12, 30, 70]
    items = [(k % 5 if rng.random() < 0.9 else None, " ".join(rng.choices(vocabulary, k=rng.choice(lengths)))) for k in range(rng.randint(0, 7))]
    texts = []
    for _ in range(6):
        words = rng.choices([*vocabulary, "zz", "W7"], k=rng.choice([0, 3, 20, 250]))
        for _, body in items:
            own, at = body.split(), rng.randint(0, len(words))
            if own and rng.random() < 0.6:
                a = rng.randrange(len(own))
                words[at:at] = own[max(0, a - 12) : a + 3]
        texts.append("-".join(words))
    return items, texts


def test_automaton_matches_all_windows():
    rng = random.Random(7)
    for trial in range(150):
        items, texts = made_items(rng, trial)
        sequences = [(None if i is None else str(i), [w.encode() for w in body.lower().split()]) for i, body in items]
        found = automaton._searched(automaton.Automaton(sequences), pa.array(texts), None)
        for text, (n_words, n_hit, spans, named) in zip(texts, found):
            assert (n_words, n_hit, named) == plain_hits(items, text)
            assert sum(s[1] for s in spans) == n_hit


def test_lengths_are_the_longest_runs():
    import numpy as np

    rng = random.Random(2)
    items = [[rng.choice("abc").encode() for _ in range(rng.randint(1, 60))] for _ in range(8)]
    machine = automaton.Automaton([(str(k), i) for k, i in enumerate(items)], window=61)
    text = [rng.choice("abcd").encode() for _ in range(400)]
    codes = np.array([machine.words.index(w) if w in machine.words else -1 for w in text])
    fresh = np.zeros(400, bool)
    fresh[[0, 150]] = True
    _, lengths = machine.stream(codes, fresh)
    runs = {tuple(i[a:b]) for i in items for a in range(len(i)) for b in range(a + 1, len(i) + 1)}
    for k, n in enumerate(lengths.tolist()):
        begin = 150 if k >= 150 else 0
        assert n == max((m for m in range(1, k - begin + 2) if tuple(text[k - m + 1 : k + 1]) in runs), default=0)


def test_words_of_one_hash_are_not_taken_for_each_other(monkeypatch):
    from lanewise.llm import words

    monkeypatch.setattr(words, "segment_hash", lambda data, starts, ends: (ends - starts).astype("uint64"))
    machine = automaton.Automaton([("1", [b"a", b"bb", b"ccc"])])
    found = automaton._searched(machine, pa.array(["a bb ccc", "x bb ccc", "a yy ccc a bb ccc"]), None)
    assert [f[:2] for f in found] == [(3, 3), (3, 0), (6, 3)]


@pytest.mark.parametrize("block_words", [automaton.BLOCK_WORDS, 25])
def test_blocks_of_items_and_odd_rows(spark, block_words):
    items, texts = made_items(random.Random(12), 1)
    items += [(8, " ".join(f"u{k % 37}" for k in range(300))), (9, None), (None, "nobody knows"), (10, "nobody")]
    texts += [None, "", " ".join(f"u{k % 37}" for k in range(20_000)) + " nobody knows", "x", "x"]
    frame_ = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)], "doc_id long, text string, item string").withColumn("spans", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = automaton.matched(frame_, bench, block_words=block_words).collect()
    assert len(found) == len(texts) and found[0].item == "n" and found[0].spans == 0
    for r in found:
        assert (r.matches.n_words, r.matches.n_hit, r.matches["items"]) == plain_hits(items, r.text)
    assert automaton.matched(frame_, bench.limit(0)).where("matches.n_hit > 0 or size(matches.items) > 0").count() == 0
    assert automaton.matched(frame_.limit(0), bench).count() == 0


def test_cleaned_texts(spark):
    item = " ".join(f"b{k}" for k in range(30))
    docs = [(1, f"Début: {item.upper()}, fin ünd " + "x y z " * 30), (2, item + " tail"), (3, "clean é text"), (4, None), (5, " ".join(f"b{k}" for k in range(9)))]
    frame_ = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = {r.doc_id: r.text for r in automaton.decontaminated(frame_, bench).collect()}
    assert kept == {1: "Début: , fin ünd " + "x y z " * 30, 3: "clean é text", 4: None, 5: docs[4][1]}
    assert set(r.doc_id for r in automaton.decontaminated(frame_, bench, max_run=29).collect()) == {3, 4, 5}
