"""Toxicity scores from a classifier that is regularised by counterfactuals.

Features are the words of a whole text, lower-cased and without punctuation at
their ends, and their prefixes of PREFIXES characters, each present or not. A
logistic model is fitted on a bounded sample: at most PER_CLASS labelled
documents of each class, those with the smallest id hashes, of the training
folds only. For each of them that names an identity group, a counterfactual copy
puts the next term of the same list in the place of each identity term, and the
fit is penalised by AGREE times the mean squared change of the score between a
text and its copy, so that naming one group rather than another says nothing.
The intercept is moved from the sample's class shares to those of all training
labels.

Results for odd input: null and empty texts get the score of a text without any
feature; without labels of both classes the score is the share of label 1 (0.5
where there is no label); repeated rows score alike; an empty table gives an
empty table; labels with null toxic or null doc_id are not learned from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, table
from .logistic import fit

#: Training rows of each class, features of the model, and the least number of training rows with a feature.
PER_CLASS = 3000
FEATURES = 2500
LEAST_ROWS = 4
PREFIXES = (4, 5, 6, 7, 8)
L2 = 2e-4
AGREE = 10.0
#: Words whose features a worker remembers.
CACHED = 500_000

# Identity terms by kind. A counterfactual stays within its list.
IDENTITY = (
    ("man", "woman", "men", "women", "boy", "girl", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "indigenous"),
    ("american", "mexican", "chinese", "russian", "indian", "german", "french", "spanish", "turkish", "nigerian"),
    ("blind", "deaf", "disabled", "autistic", "paralyzed"),
    ("young", "old", "elderly", "teenage"),
    ("homme", "femme", "hommes", "femmes"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée", "catholique"),
    ("mann", "frau", "männer", "frauen"),
    ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "katholisch"),
    ("hombre", "mujer", "hombres", "mujeres"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo", "católico"),
)
_NEXT = {w: terms[(i + 1) % len(terms)] for terms in IDENTITY for i, w in enumerate(terms)}
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”‘’„…¿¡–—"


def words(text: str | None) -> set[str]:
    """Distinct words, lower-cased, without punctuation at their ends."""
    return {w for x in set((text or "").lower().split()) if (w := x.strip(_EDGES))}


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def counterfactual(found: set[str]) -> set[str] | None:
    """The words with each identity term changed for the next of its list; None if there is none."""
    return {_NEXT.get(w, w) for w in found} if found & _NEXT.keys() else None


def _all_features(found: set[str]) -> set[str]:
    return {f for w in found for f in features(w)}


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (feature, n0, n1), summed over each partition."""
    by = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            found = words(text.as_py())
            by[toxic.as_py()].update(_all_features(found))
            by[toxic.as_py()].update({f: 0 for f in _all_features(counterfactual(found) or set())})
    names = list(by[0].keys() | by[1].keys())
    for i in range(0, len(names), 50_000):
        part = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([c[f] for f in part], pa.int64()) for c in by)], ["feature", "n0", "n1"])


def _row_batches(index: dict[str, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ids(found: set[str] | None) -> list[int] | None:
            return None if found is None else sorted({index[f] for w in found for f in features(w) if f in index})

        for batch in batches:
            sets = [words(t.as_py()) for t in batch.column(0)]
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([ids(s) for s in sets], lists), pa.array([ids(counterfactual(s)) for s in sets], lists)], ["toxic", "ids", "swapped"])

    return rows


class Model:
    """word -> features, and their weights."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, intercept: float):
        self.weights = {f: float(weights[i]) for f, i in index.items() if weights[i]}
        self.intercept = intercept

    def scorer(self):
        weights, intercept = self.weights, self.intercept
        known: dict[str, tuple[str, ...]] = {}

        def score(text: str | None) -> float:
            if len(known) > CACHED:
                known.clear()
            present: set[str] = set()
            for w in set((text or "").lower().split()):
                hit = known.get(w)
                if hit is None:
                    hit = known[w] = tuple(f for f in features(w.strip(_EDGES)) if f in weights) if w.strip(_EDGES) else ()
                if hit:
                    present.update(hit)
            z = intercept + math.fsum(weights[f] for f in present)
            return 1 / (1 + math.exp(-min(max(z, -500), 500)))

        return score


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labels (doc_id, toxic) of the training folds and the texts of docs (doc_id, text)."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Two bounded lists of ids, so they may be broadcast.
    by_hash = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for c in (0, 1)]
    chosen = F.broadcast(by_hash[0].unionByName(by_hash[1]))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = materialize(sample.select("text", "toxic"), "toxic-sample")
    n0, n1 = (sample.where(F.col("toxic") == c).count() for c in (0, 1))
    all0, all1 = (known.where(F.col("toxic") == c).count() for c in (0, 1))
    if not n0 or not n1:
        share = all1 / (all0 + all1) if all0 + all1 else 0.5
        return Model({}, np.zeros(0), math.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    counts = sample.mapInArrow(_count_batches, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = F.col("n0") / n0, F.col("n1") / n1
    pooled = (F.col("n0") + F.col("n1")) / (n0 + n1)
    strength = F.abs(a - b) / F.sqrt(pooled * (1 - pooled) + 1e-9)
    best = counts.where((F.col("n0") + F.col("n1")) >= LEAST_ROWS).orderBy(F.desc(strength), "feature").limit(FEATURES)
    index = {r.feature: i for i, r in enumerate(best.select("feature").collect())}
    rows = sample.mapInArrow(_row_batches(index), "toxic int, ids array<int>, swapped array<int>").collect()
    rows.sort(key=lambda r: (r.toxic, r.ids))
    x = np.zeros((len(rows), len(index)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r.ids] = 1
    changed = [(i, r.swapped) for i, r in enumerate(rows) if r.swapped is not None and r.swapped != r.ids]
    pairs = np.zeros((len(changed), len(index)), dtype=np.float32)
    for i, (row, swapped) in enumerate(changed):
        pairs[i] = x[row]
        pairs[i, swapped] -= 1
    y = np.array([r.toxic for r in rows])
    weights, intercept = fit(x, y, L2, pairs, AGREE)
    return Model(index, weights, intercept + math.log(all1 / all0) - math.log(n1 / n0))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""

    def batches_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = [score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(batches_out, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity_counterfactual(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
