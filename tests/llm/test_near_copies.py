"""Near copies of the pipeline's stage against all pairs."""

import random

import corpus_pipeline
from ledgerloom.llm import near_copies


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stage_drops_near_copies_with_changed_words(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(15):
        base = [r.choice(words) for _ in range(r.choice([60, 200]))]
        for n in range(6):
            copy = list(base)
            for _ in range(n * len(base) // 100):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    sets = [grams(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert got == set(label)


def all_pairs(texts):
    sets = [grams(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    # One group of texts of which some are near copies of others, cut into blocks of about seven.
    r = random.Random(4)
    base = [f"v{r.randrange(10_000)}" for _ in range(80)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 5)):
            copy[r.randrange(len(copy))] = f"v{r.randrange(10_000)}"
        texts.append(" ".join(copy))
    texts = sorted(set(texts))
    want = all_pairs(texts)
    assert 1 < len(set(want)) < len(texts)
    monkeypatch.setattr(near_copies, "FEW", 3)
    for block in (7, 1000):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        rows = spark.createDataFrame([(1, i, 76, t) for i, t in enumerate(texts)], "grp long, node long, n long, text string")
        edges = [(x.a, x.b) for x in near_copies.links(rows).collect()]
        label = list(range(len(texts)))
        for a, b in edges:
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
        assert label == want and len(edges) < 2 * len(texts) * (60 // block + 1)


def test_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (None, "c d"), (5, "c d"), (6, "c"), (6, "c"), (7, "w " * 300_000)]
    df = spark.createDataFrame([(*x, {"k": 1}, 5) for x in odd], "doc_id long, text string, row_hash map<string,int>, rows int")
    got = near_copies.representatives(df)
    assert got.columns == df.columns and sorted(x.doc_id for x in got.collect()) == [1, 3, 5, 6, 7]
    assert near_copies.representatives(df.limit(0)).count() == 0
