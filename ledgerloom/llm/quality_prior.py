"""Document quality: a text classifier's evidence, shrunk through host and path priors.

The classifier is logistic over native measurements of the whole text, fitted on
a bounded sample of labelled rows (at most PER_CLASS of each class, by the
smallest id hashes; the fold of remainder 0 is left out for evaluation). Its
probabilities are then pooled by grouped aggregation: the mean over all
documents is the global prior, each host's posterior mean shrinks to it with a
strength estimated by the method of moments, and each path's shrinks to its
host's in the same way, so that a sparse site says little. A document's own
evidence is taken out of its site's sums. The path's log odds against the global
prior, bounded by SHIFT, are added to the document's own.

For ``documents`` the host is ``source`` and the path ``lang`` within it.

Results for odd input: a null or empty text is scored by its zero measurements;
null hosts and paths are sites of their own; without labels of both classes
every document scores 0.5 and is kept; repeated rows score alike; an empty table
gives an empty table; other columns are ignored by ``scored`` and kept by
``accepted``, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, table
from .logistic import fit
from .measures import removed, words_of

PER_CLASS = 4000
L2 = 1e-3
#: Bound of what a site may add to a document's log odds.
SHIFT = 1.5
#: Bounds of a prior's strength in documents.
LEAST_STRENGTH, MOST_STRENGTH = 10.0, 1e6
#: Evidence is summed in whole millionths, so that sums do not depend on the order.
UNIT = 1_000_000
#: Sites up to this number are broadcast (rows of under 100 bytes), more are joined.
BROADCAST_SITES = 50_000
#: Only what is judged bad with some confidence is rejected.
THRESHOLD = 0.3

FEATURES = ("log_words", "symbols", "bars", "bangs", "upper", "digits", "distinct", "word_length", "duplicates")
_OWN = "__quality_"


def with_features(df: DataFrame) -> DataFrame:
    """Adds the columns __quality_<feature> of column text."""
    df = df.withColumn(_OWN + "text", F.coalesce("text", F.lit(""))).withColumn(_OWN + "words", words_of(F.col(_OWN + "text")))
    text, words = F.col(_OWN + "text"), F.col(_OWN + "words")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text) - removed(text, " \t\n\x0b\f\r"), F.lit(1)).cast("double")
    lines = F.split(text, "\n")
    columns = {
        "log_words": F.log1p(F.size(words).cast("double")),
        "symbols": F.least(removed(text, "#*$%&<>") / n, F.lit(3.0)),
        "bars": F.least(removed(text, "|") / n, F.lit(2.0)),
        "bangs": F.least(removed(text, "!") / n, F.lit(3.0)),
        "upper": removed(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ") / chars,
        "digits": removed(text, "0123456789") / chars,
        # Long texts repeat words by nature: compare with the distinct words expected of their length.
        "distinct": F.size(F.array_distinct(words)) / F.pow(n, F.lit(0.9)),
        "word_length": F.least(chars / n, F.lit(20.0)),
        "duplicates": F.lit(1.0) - F.size(F.array_distinct(lines)) / F.size(lines),
    }
    return df.withColumns({_OWN + k: v for k, v in columns.items()}).drop(_OWN + "text", _OWN + "words")


class Classifier:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, intercept: float):
        self.slopes = weights / scale
        self.intercept = intercept - float(mean @ self.slopes)

    def logit(self) -> Column:
        out = F.lit(self.intercept)
        for name, w in zip(FEATURES, self.slopes, strict=True):
            out = out + F.col(_OWN + name) * F.lit(float(w))
        return F.greatest(F.least(out, F.lit(20.0)), F.lit(-20.0))


def train(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """None without labels of both classes."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    by_hash = [known.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for c in (0, 1)]
    # Two bounded lists of ids, so they may be broadcast; what comes back is as many rows of numbers.
    sample = docs.select("doc_id", "text").join(F.broadcast(by_hash[0].unionByName(by_hash[1])), "doc_id")
    sample = with_features(sample).groupBy("doc_id").agg(F.first("quality").alias("quality"), *(F.min(_OWN + k).alias(k) for k in FEATURES))
    rows = sorted(tuple(r) for r in sample.select("quality", *FEATURES).collect())
    y = np.array([r[0] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([r[1:] for r in rows])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    weights, intercept = fit((x - mean) / scale, y, L2)
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    return Classifier(mean, scale, weights, intercept + float(np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum()))))


def _with_logit(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """Adds __quality_logit and __quality_p, the evidence in millionths."""
    logit = F.lit(0.0) if classifier is None else classifier.logit()
    out = (docs if classifier is None else with_features(docs)).withColumn(_OWN + "logit", logit)
    out = out.withColumn(_OWN + "p", F.round(F.lit(UNIT) / (1 + F.exp(-F.col(_OWN + "logit")))).cast("long"))
    return out.drop(*(_OWN + k for k in FEATURES))


def _strength(groups: DataFrame, own: str, prior: Column) -> float:
    """Of the groups' (n, s) around their prior means: mean (1 - mean) / variance between groups, minus one."""
    n, mean = F.col("n"), F.col(own) / F.col("n") / UNIT
    row = groups.agg(
        F.sum(n).alias("n"), F.sum(n * n.cast("double")).alias("nn"), F.sum(n * F.pow(mean - prior, F.lit(2))).alias("spread"), F.sum(n * prior * (1 - prior)).alias("noise"), F.count(F.lit(1)).alias("k")
    ).first()
    if not row.n or row.k < 2 or row.n <= row.nn / row.n:
        return MOST_STRENGTH
    noise = row.noise / row.n
    between = (row.spread - (row.k - 1) * noise) / (row.n - row.nn / row.n)
    # Rounded, so that the order of summing doubles cannot show.
    return float(np.clip(noise / between - 1, LEAST_STRENGTH, MOST_STRENGTH).round(3)) if between > 0 else MOST_STRENGTH


def site_table(evidence: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(host, path, n, s, host_n, host_s) for each path, and the prior: mean and strengths."""
    paths = materialize(evidence.groupBy(_OWN + "host", _OWN + "path").agg(F.count(F.lit(1)).alias("n"), F.sum(_OWN + "p").alias("s")), "paths")
    hosts = paths.groupBy(_OWN + "host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total.s / total.n / UNIT, 1e-4), 1 - 1e-4) if total.n else 0.5
    kh = _strength(hosts, "s", F.lit(mean))
    hosts = hosts.select(F.col(_OWN + "host").alias("__host"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    sites = materialize(paths.join(hosts, F.col(_OWN + "host").eqNullSafe(F.col("__host"))).drop("__host"), "sites")
    kp = _strength(sites, "s", (F.lit(kh * mean) + F.col("host_s") / UNIT) / (F.lit(kh) + F.col("host_n")))
    return sites, {"mean": mean, "host_strength": kh, "path_strength": kp}


def _combined(evidence: DataFrame, sites: DataFrame, prior: dict[str, float]) -> DataFrame:
    """Adds __quality_prior (the path's posterior mean) and __quality_score."""
    small = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    sites = sites.select(*(F.col(c).alias("__site_" + c.removeprefix(_OWN)) for c in sites.columns))
    joined = evidence.join(F.broadcast(sites) if small else sites, F.col(_OWN + "host").eqNullSafe(F.col("__site_host")) & F.col(_OWN + "path").eqNullSafe(F.col("__site_path")))
    own = F.col(_OWN + "p")
    mean, kh, kp = (F.lit(prior[k]) for k in ("mean", "host_strength", "path_strength"))
    host = (kh * mean + (F.col("__site_host_s") - own) / UNIT) / (kh + F.col("__site_host_n") - 1)
    path = (kp * host + (F.col("__site_s") - own) / UNIT) / (kp + F.col("__site_n") - 1)
    path = F.least(F.greatest(path, F.lit(1e-6)), F.lit(1 - 1e-6))
    shift = F.log(path / (1 - path)) - F.log(mean / (1 - mean))
    z = F.col(_OWN + "logit") + F.greatest(F.least(shift, F.lit(SHIFT)), F.lit(-SHIFT))
    out = joined.withColumn(_OWN + "prior", path).withColumn(_OWN + "score", 1 / (1 + F.exp(-z)))
    return out.drop(*("__site_" + c for c in ("host", "path", "n", "s", "host_n", "host_s")))


def _evidence(docs: DataFrame, labels: DataFrame, host: str, path: str) -> DataFrame:
    return _with_logit(docs.withColumns({_OWN + "host": F.col(host), _OWN + "path": F.col(path)}), train(docs, labels))


def scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, doc_score, site_prior, score, kept for every row of docs."""
    evidence = _evidence(docs.select("doc_id", "text", host, path), labels, host, path)
    evidence = materialize(evidence.select("doc_id", _OWN + "host", _OWN + "path", _OWN + "logit", _OWN + "p"), "evidence")
    out = _combined(evidence, *site_table(evidence))
    shown = (1 / (1 + F.exp(-F.col(_OWN + "logit")))).alias("doc_score")
    return out.select("doc_id", shown, F.col(_OWN + "prior").alias("site_prior"), F.col(_OWN + "score").alias("score"), (F.col(_OWN + "score") >= THRESHOLD).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of docs that score at least THRESHOLD, with all their columns."""
    # Rows travel as one struct, so no column of theirs meets one of ours; they are written
    # beside their evidence, as measuring the texts twice costs far more than reading them.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", F.col(host).alias(_OWN + "host"), F.col(path).alias(_OWN + "path"))
    evidence = _with_logit(rows, train(docs, labels)).drop("text")
    evidence = materialize(evidence, "evidence")
    sites, prior = site_table(evidence)
    kept = _combined(evidence, sites, prior).where(F.col(_OWN + "score") >= THRESHOLD)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op9_quality_bayes(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
