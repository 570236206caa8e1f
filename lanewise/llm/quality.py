"""A nearest-neighbour quality classifier.

Texts become bags of hashed traits: the shapes of words ("Ul," for "In,"), their lengths, repetitions of earlier word
runs, and the words themselves. Traits are weighted by their rarity, and a truncated singular value decomposition of a
bounded labelled sample gives latent-semantic directions. The sample's latent vectors are sent to every task, which
computes the exact cosine of each of its documents with all of them, block by block; the nearest vote with their
similarity as weight. Each class of the sample has the same total weight.

Null and empty texts have no direction: they score the sample's base rate, one half. Very long texts are read whole. A score
equal to the cut counts as good; of neighbours equally near at the last place any may vote.
Without labels of both kinds every text scores one half. Repeated rows are scored one by one; labels, languages,
sources and keys are no inputs of a score. An empty table gives no rows. Columns but the named ones are left alone, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm import labelled
from lanewise.llm.common import held_out
from lanewise.llm.words import Words, mix, segment_hash, shingles, slices

#: The most labelled texts of each class in the sample: PER_CLASS * 2 * LATENT * 4 bytes go to every task.
PER_CLASS = 2000
TRAITS, LATENT, NEIGHBOURS, BLOCK = 2048, 48, 25, 512
CUT = 0.3
_U = np.uint64

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x61:0x7B] = ord("l")
_CLASS[0x80:] = ord("l")
_CLASS[0x41:0x5B] = ord("U")
_CLASS[0x30:0x3A] = ord("d")


def _traits(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows and trait numbers of a slice, one a word and kind."""
    shape = _CLASS[w.data]
    new = np.ones(len(shape), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[w.starts] = True
    upto = np.concatenate([[0], np.cumsum(new)])
    shapes = segment_hash(shape[new], upto[w.starts], upto[w.ends])
    lengths = np.minimum(w.ends - w.starts, 24).astype(_U)
    h = w.hashes()
    run, row, first = shingles(w, 2, h)
    again = np.zeros(len(h), _U)
    if len(run):
        _, inverse, count = np.unique(mix(run + mix(row.astype(_U))), return_inverse=True, return_counts=True)
        again[first] = count[inverse] > 1
    stutter = np.zeros(len(h), _U)
    stutter[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    kinds = [shapes, lengths, again * _U(2) + stutter, h]
    return np.tile(w.row, len(kinds)), np.concatenate([mix(k + _U(977 * (n + 1))) % _U(TRAITS) for n, k in enumerate(kinds)]).astype(np.int64)


def bags(column: pa.Array) -> Iterator[np.ndarray]:
    """Square roots of the traits' shares (rows x TRAITS, float32), slice by slice."""
    for w in slices(column, 1 << 19):
        row, trait = _traits(w)
        for lo in range(0, w.rows, BLOCK):
            hi = min(w.rows, lo + BLOCK)
            mine = (row >= lo) & (row < hi) if w.rows > BLOCK else slice(None)
            n = np.bincount((row[mine] - lo) * TRAITS + trait[mine], minlength=(hi - lo) * TRAITS).reshape(-1, TRAITS)
            yield np.sqrt(n / np.maximum(n.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    rarity: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def latent(self, bag: np.ndarray) -> np.ndarray:
        return _unit((bag * self.rarity) @ self.basis).astype(np.float32)

    def votes(self, vectors: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest, by exact cosine products with every labelled vector."""
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return np.full(len(vectors), 0.5)
        cosine = vectors @ self.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 2 * self.weights[near]
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), 0.5)

    def score(self, column: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self.votes(self.latent(bag)) for bag in bags(column)]])


def fit_bags(bag: np.ndarray, labels: np.ndarray) -> Model:
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        bag, labels = bag[:0], labels[:0]
    rarity = np.log((1 + len(bag)) / (1 + (bag > 0).sum(axis=0))).astype(np.float32) + 0.1
    x = _unit(bag * rarity)
    start = np.random.default_rng(1).standard_normal((TRAITS, LATENT + 8), np.float32)
    q = np.linalg.qr(x @ start)[0] if len(x) else np.zeros((0, 0), np.float32)
    for _ in range(3 if len(x) else 0):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:LATENT].T if len(x) else np.zeros((TRAITS, 1), np.float32)
    weights = np.where(labels == 1, 1 / max(1, n1), 1 / max(1, n0))
    return Model(rarity, basis.astype(np.float32), _unit(x @ basis).astype(np.float32), labels.astype(np.float64), weights)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fits on at most 2 * per_class texts. Their traits (non-zero ones), not the texts, come to the driver: 6 bytes a trait,
    so at most 2 * per_class * TRAITS * 6 bytes, and then a matrix of 2 * per_class * TRAITS * 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = [], []
            for bag in bags(batch.column(0)):
                for row in bag:
                    some = np.flatnonzero(row)
                    at.append(some.astype(np.uint16).tobytes())
                    value.append(row[some].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(value, pa.binary()), batch.column(1)], names=["at", "value", "label"])

    got = labelled.sample(docs, labels, label, per_class, key, text).mapInArrow(run, "at binary, value binary, label int").toArrow()
    bag = np.zeros((got.num_rows, TRAITS), np.float32)
    for k, (at, value) in enumerate(zip(got.column("at").to_pylist(), got.column("value").to_pylist())):
        bag[k, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
    return fit_bags(bag, got.column("label").to_numpy())


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted (1: good)."""
    out = labelled.with_scores(docs, text, fit(docs, labels, "quality", key, text).score, "score", [key])
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
