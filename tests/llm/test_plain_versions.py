"""Operators that SQL cannot express against plain versions of the same method."""

import math
import random
from collections import defaultdict

import numpy as np

from ledgerloom.llm import logistic, mixing, quality_prior, toxicity


def test_schedule_against_a_plain_one(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 90)), r.choice(["a", "a", "a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(df)
    blocks = plan.blocks.collect()
    size = plan.sources[0]["block"]
    need = [s["need"] for s in plan.sources]
    # Slot k has the point frac(k phi); the r-th slot of a source takes its r-th block.
    edges = np.cumsum(need) / sum(need)
    of = defaultdict(list)
    for k in range(sum(need) // size + len(need) + 1):
        of[min(int(np.searchsorted(edges, k * mixing.PHI % 1.0, side="right")), len(need) - 1)].append(k)
    for s in plan.sources:
        mine = sorted((b for b in blocks if b.sid == s["sid"]), key=lambda b: b.slot)
        assert sum(b["last"] - b["first"] for b in mine) == s["need"]
        assert [b.slot for b in mine][: len(of[s["sid"]])] == of[s["sid"]][: len(mine)]
        # Each pass takes each block once, and passes follow each other.
        assert [b["pass"] for b in mine] == sorted(b["pass"] for b in mine) and len({(b["pass"], b.block) for b in mine}) == len(mine)
    # Every prefix of the schedule is near the targets.
    order = sorted(blocks, key=lambda b: b.slot)
    taken = np.zeros(len(need))
    for b in order:
        taken[b.sid] += b["last"] - b["first"]
        assert np.abs(taken - taken.sum() * np.array(need) / sum(need)).max() < 6 * size
    first = {x.doc_id: x.first_slot for x in mixing.mixed(df).collect()}
    assert all((first[i] is None) == (not t) or first[i] is None for i, t, _ in rows)
    ordered = mixing.mixture(df, ordered=True)
    assert sorted(map(tuple, ordered.collect())) == sorted(map(tuple, mixing.mixture(df).collect()))


def test_posteriors_against_a_plain_version(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["word", "w###", "a!", "LOUD"]) + str(r.randint(0, 99)) for _ in range(r.randint(1, 60))), r.choice(["en", "de", None]), r.choice(["h1", "h1", "h2", "h3", None])) for i in range(200)]
    docs = spark.createDataFrame([(*x, "kept", 1.5) for x in rows], "doc_id long, text string, lang string, source string, __quality_p string, row double")
    labels = spark.createDataFrame([(i, int("###" not in t)) for i, t, *_ in rows if i % 2], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality_prior.scored(docs, labels).collect()}
    p = {i: round(1e6 * x.doc_score) / 1e6 for i, x in got.items()}
    site = {i: (h, d) for i, _, d, h in rows}
    by_host, by_path = defaultdict(list), defaultdict(list)
    for i, (h, d) in site.items():
        by_host[h].append(p[i])
        by_path[h, d].append(p[i])
    mean = sum(p.values()) / len(p)

    def strength(groups):
        n = np.array([len(v) for v, _ in groups], dtype=float)
        m, prior = np.array([sum(v) / len(v) for v, _ in groups]), np.array([q for _, q in groups])
        noise = (n * prior * (1 - prior)).sum() / n.sum()
        between = ((n * (m - prior) ** 2).sum() - (len(n) - 1) * noise) / (n.sum() - (n**2).sum() / n.sum())
        return min(max(noise / between - 1, 10.0), 1e6) if between > 0 else 1e6

    kh = strength([(v, mean) for v in by_host.values()])
    kp = strength([(v, (kh * mean + sum(by_host[h])) / (kh + len(by_host[h]))) for (h, _), v in by_path.items()])
    for i, x in got.items():
        h, d = site[i]
        host = (kh * mean + sum(by_host[h]) - p[i]) / (kh + len(by_host[h]) - 1)
        path = (kp * host + sum(by_path[h, d]) - p[i]) / (kp + len(by_path[h, d]) - 1)
        shift = math.log(path / (1 - path)) - math.log(mean / (1 - mean))
        z = math.log(x.doc_score / (1 - x.doc_score)) + min(max(shift, -1.5), 1.5)
        assert abs(x.site_prior - path) < 1e-3 and abs(x.score - 1 / (1 + math.exp(-z))) < 2e-3
    kept = quality_prior.accepted(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.kept}
    assert {tuple(x) for x in kept.collect()} <= {(*x, "kept", 1.5) for x in rows}


def test_fit_against_plain_descent():
    r = np.random.default_rng(0)
    x, pairs = r.normal(size=(80, 4)), r.normal(size=(20, 4))
    y = (x[:, 0] + 0.5 * r.normal(size=80) > 0).astype(int)
    w, b = logistic.fit(x, y, 0.01, pairs, 0.3)
    u, c = np.zeros(4), 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(x @ u + c)))
        u -= 0.1 * (x.T @ (p - y) / 80 + 0.01 * u + 0.6 / 20 * pairs.T @ (pairs @ u))
        c -= 0.1 * (p - y).mean()
    assert np.abs(w - u).max() < 0.02 and abs(b - c) < 0.02


def test_toxicity_scores_against_a_plain_sum(spark):
    words = "river idiot gay stone light muslim straight table".split()
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(words) for _ in range(6))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None), (301, "word " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    for x in toxicity.scored(docs, model).collect():
        text = dict(rows).get(x.doc_id) or ("" if x.doc_id == 300 else "word")
        present = {f for w in set(text.lower().split()) for f in toxicity.features(w)}
        z = model.intercept + sum(model.weights.get(f, 0.0) for f in present)
        assert abs(x.score - 1 / (1 + math.exp(-z))) < 1e-9 and x.predicted == int(x.score >= 0.5)
