"""A counterfactually regularised toxicity classifier.

A sparse logistic regression over the words of a text (small letters, no punctuation, each distinct word once). It is
fitted on a bounded sample of labelled texts. For every sampled text that names a group, the name is swapped for the
other names of its kind, and taken out of a text that isn't toxic; the fit pays for the squared change of the score. So a
weight that rests on which group is named, not on what is said, is driven to that of its counterparts, and the mere
mention of a group to no weight at all. Words are kept as 64-bit hashes, so no two words of a corpus share a weight.

Null and empty texts score the model's bias. Very long texts are read whole. Without labels of both kinds every text
scores 0. A score equal to the cut is toxic. Repeated rows are scored one by one, and labelled rows of one key count once
a class; labels, languages, sources and keys are no inputs of a score. An empty table gives
no rows. Columns but the named ones are left alone, whatever their names.
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
from lanewise.llm.words import mix, plain_slices

#: The most labelled texts of each class that the fit takes.
PER_CLASS = 4000
#: A word is in the model if this many texts have it and its difference between the classes has the standard score MIN_Z;
#: or, whatever the size of the classes, if it stands out at chance RARE (an exact bound of the binomial tail) among the
#: toxic texts that the words so chosen don't find.
MIN_TEXTS, MIN_Z, RARE = 2, 4.0, 0.001
L1, L2, SWAP_PENALTY, STEPS = 0.00002, 0.0005, 1.0, 500
CUT = 0.5

# Names of groups, by kind and language; names of one line are swapped for each other.
IDENTITY_TERMS = (
    "women men girls boys",
    "woman man girl boy",
    "christians muslims jews hindus buddhists atheists",
    "christian muslim jewish hindu buddhist atheist",
    "black white asian latino african european arab",
    "gay straight lesbian bisexual transgender",
    "immigrants refugees foreigners natives",
    "femmes hommes filles garçons",
    "chrétiens musulmans juifs hindous bouddhistes athées",
    "noirs blancs asiatiques africains européens arabes",
    "immigrés réfugiés étrangers",
    "frauen männer mädchen jungen",
    "christen muslime juden hindus buddhisten atheisten",
    "schwarze weiße asiaten afrikaner europäer araber",
    "einwanderer flüchtlinge ausländer",
    "mujeres hombres chicas chicos",
    "cristianos musulmanes judíos hindúes budistas ateos",
    "negros blancos asiáticos africanos europeos árabes",
    "inmigrantes refugiados extranjeros",
)


def _word_hash(words: list[str]) -> np.ndarray:
    found = [w.hashes() for w in plain_slices(pa.array(words))]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def bags(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, row, hash) of the distinct words of each text, slice by slice."""
    for w in plain_slices(column):
        h = w.hashes()
        _, first = np.unique(mix(h + mix(w.row.astype(np.uint64))), return_index=True)
        first.sort()
        yield w.rows, w.row[first], h[first]


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    bias: float

    def totals(self, row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
        """The log odds of texts given as (row, hash) of their distinct words."""
        total = np.full(rows, self.bias)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            total += np.bincount(row, np.where(self.words[at] == h, self.weights[at], 0.0), minlength=rows)
        return total

    def score(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for rows, row, h in bags(column):
            out.append(1 / (1 + np.exp(-np.clip(self.totals(row, h, rows), -500, 500))))
        return np.concatenate(out)


def fit_bags(rows: list[np.ndarray], labels: np.ndarray, swap_penalty: float = SWAP_PENALTY) -> Model:
    """The model of texts given as arrays of distinct word hashes."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -500.0)
    text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows)
    vocabulary, word = np.unique(flat, return_inverse=True)
    with1 = np.bincount(word, labels[text] == 1, minlength=len(vocabulary))
    texts = np.bincount(word, minlength=len(vocabulary))
    share = texts / (n1 + n0)
    z = (with1 / n1 - (texts - with1) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    groups = [_word_hash(line.split()) for line in IDENTITY_TERMS]
    named = np.isin(vocabulary, np.concatenate(groups))
    keep = (texts >= MIN_TEXTS) & (np.abs(z) >= MIN_Z)
    model = _fit_words(rows, text, flat, np.union1d(vocabulary[keep | named], np.concatenate(groups)), groups, labels, swap_penalty)
    missed = (labels == 1) & (model.totals(text, flat, len(rows)) < 0)
    k, m, share = np.bincount(word, missed[text], minlength=len(vocabulary)), texts - with1, missed.sum() / (missed.sum() + n0)
    if not missed.any():
        return model
    rate = k / np.maximum(k + m, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = -np.where(k > 0, k * np.log(rate / share), 0) - np.where(m > 0, m * np.log((1 - rate) / (1 - share)), 0)
    keep |= (k >= MIN_TEXTS) & (rate > share) & (tail <= np.log(RARE))
    return _fit_words(rows, text, flat, np.union1d(vocabulary[keep | named], np.concatenate(groups)), groups, labels, swap_penalty)


def _fit_words(rows, text, flat, words, groups, labels, swap_penalty) -> Model:
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    inside = np.isin(flat, words)
    i, j = text[inside], np.searchsorted(words, flat[inside])
    swaps = list(_swaps(i, words[j], groups, words, labels))
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0)
    w, bias = _descend(i, j, labels.astype(float), weight, len(words), swaps, swap_penalty)
    used = np.flatnonzero(w)
    return Model(words[used], w[used], bias)


def _swaps(text: np.ndarray, h: np.ndarray, groups: list[np.ndarray], words: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, int]]:
    """(word out, word in) of every swap of a group's name; -1 for none, where it is taken out of a text that isn't toxic."""
    for group in groups:
        at = np.flatnonzero(np.isin(h, group))
        own: dict[int, set] = {}
        for k in at:
            own.setdefault(int(text[k]), set()).add(int(h[k]))
        place = {x: int(np.searchsorted(words, np.uint64(x))) for x in group.tolist()}
        for t, there in own.items():
            for out in there:
                if labels[t] == 0:
                    yield place[out], -1
                for new in group.tolist():
                    if new not in there:
                        yield place[out], place[new]


def _descend(i, j, y, weight, n_words, swaps, swap_penalty):
    """Accelerated proximal descent on weighted log loss + L1 + L2 + the mean squared score change of the swaps."""
    n = len(y)
    out_, in_ = (np.array([s[k] for s in swaps], np.int64) for k in (0, 1))
    in_[in_ < 0] = n_words  # a word of weight 0
    per = swap_penalty / max(1, len(swaps))
    column = np.bincount(j, weight[i], minlength=n_words)
    reach = 0.25 * np.bincount(i, np.ones(len(i)), minlength=n).max(initial=1) + 0.25
    step = 1 / (L2 + reach * max(1e-9, column.max(initial=0), 0.05) + 4 * per * len(swaps) + 0.25)
    w = v = np.zeros(n_words)
    b = c = 0.0
    t = 1.0
    for _ in range(STEPS):
        score = c + np.bincount(i, v[j], minlength=n)
        slope = weight * (1 / (1 + np.exp(-np.clip(score, -50, 50))) - y)
        gradient = np.bincount(j, slope[i], minlength=n_words) + L2 * v
        if len(swaps):
            change = 2 * per * (np.append(v, 0.0)[in_] - v[out_])
            gradient += np.bincount(in_, change, minlength=n_words + 1)[:n_words] - np.bincount(out_, change, minlength=n_words)
        new_w = v - step * gradient
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * L1, 0)
        new_b = c - step * slope.sum()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fits on at most 2 * per_class texts of the sample's bytes. Their word hashes, not the texts, come to the driver: 8 bytes a
    distinct word of a text, so at most four times the bytes of the sampled texts (a word and its parting take two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rows, row, h in bags(batch.column(0)):
                at = np.searchsorted(row, np.arange(rows + 1))
                found += [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["bag", "label"])

    got = labelled.sample(docs, labels, label, per_class, key, text).mapInArrow(run, "bag binary, label int").toArrow()
    rows = [np.frombuffer(b, np.uint64) for b in got.column("bag").to_pylist()]
    return fit_bags(rows, got.column("label").to_numpy())


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "score", carry: list[str] | None = None) -> DataFrame:
    return labelled.with_scores(docs, text, model.score, into, carry)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted (1: toxic)."""
    out = scored(docs, fit(docs, labels, "toxic", key, text), text, "score", [key])
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all their columns, that score below CUT."""
    out = scored(docs, fit(docs, labels, "toxic", key, text), text, "lanewise_score")
    return out.where(F.col("lanewise_score") < CUT).select(*docs.columns)
