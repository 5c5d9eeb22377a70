"""Items cut off at the border of texts that are searched together."""

import random
import time

from ledgerloom.llm import decontaminate

ITEM = "the quick brown fox jumps over the lazy dog while rain falls"


def test_items_cut_off_at_either_border():
    index = decontaminate.Index([(1, ITEM)])
    k = decontaminate.budget(len(ITEM))
    other = "some words of a text that holds nothing at all"
    for cut in range(k + 1):
        first, last = ITEM[cut:] + " and more of this text", "more of this text and " + ITEM[: len(ITEM) - cut]
        for n, docs in enumerate(([other, first, other], [other, last, other], [last, first, last], [ITEM[cut:], ITEM[cut:]], [other, ITEM[: len(ITEM) - cut], "x" * 9])):
            alone = [h[1:] for d in docs for h in decontaminate.matches([d], index)]
            got = list(decontaminate.matches(docs, index))
            assert [h[1:] for h in got] == alone and len(got) == (1, 1, 3, 2, 1)[n], (cut, n)
            # A space at the cut is no part of the normal text.
            assert all(0 <= s <= e <= len(decontaminate.normal(docs[d])) and edits <= min(cut + 1, k) for d, _, s, e, edits in got)


def test_no_match_across_a_border():
    index = decontaminate.Index([(1, ITEM)])
    assert not list(decontaminate.matches([ITEM[:30], ITEM[30:]], index))


def test_repeated_characters_end_soon():
    items = [(i, f"fill in the blank number {i} here please {'_' * 32} and then go on with the text") for i in range(200)]
    index = decontaminate.Index(items)
    begin = time.time()
    assert not list(decontaminate.matches(["_" * 20_000], index))
    one = decontaminate.Index(items[:3])
    assert not list(decontaminate.matches(["_" * 1_000_000, "ab" * 500_000], one))
    assert (0, 7, 5000, 5000 + len(items[7][1]), 0) in list(decontaminate.matches(["_" * 5000 + items[7][1] + "_" * 5000], index))
    assert time.time() - begin < 60


def test_halves_of_an_index_find_the_same(monkeypatch):
    r = random.Random(2)
    pool = "the of and rein thing tion anes ouer blend she hath ing stone edge".split()
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(i, text(r.randint(6, 14))) for i in range(12)]
    docs = [text(5) + " " + t[r.randint(0, 2) :] + " " + text(r.randint(0, 9)) for _, t in items] * 2
    whole = list(decontaminate.matches(docs, decontaminate.Index(items)))
    assert len(whole) >= 20
    monkeypatch.setattr(decontaminate, "PAIRS", 10)
    assert list(decontaminate.matches(docs, decontaminate.Index(items))) == whole


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    rows = [(i, f"text {i} with the words of item {i} and the river runs by {i * i} stones at night", 7) for i in range(30)]
    docs = spark.createDataFrame([*rows, (99, "nothing of the kind here", 7)], "doc_id long, text string, __edits int")
    bench = spark.createDataFrame([(i, t[10:70]) for i, t, _ in rows[::3]], "item_id long, text string")
    whole, kept = decontaminate.contaminated(docs, bench).collect(), decontaminate.clean(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    assert sorted(decontaminate.contaminated(docs, bench).collect()) == sorted(whole)
    assert sorted(decontaminate.clean(docs, bench).collect()) == sorted(kept) and any(x.doc_id == 99 for x in kept)
