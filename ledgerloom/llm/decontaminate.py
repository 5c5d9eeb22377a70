"""Benchmark passages in documents, by q-gram counts in diagonal bands.

Texts are compared in lower case with white space runs as one space. An item of
n characters matches where some region of a document aligns with it in at most
k edits, k being ERRORS of n, or less for short items so that the q-gram lemma
still asks for one common q-gram: n - Q + 1 - k Q. A common q-gram at place p of
the document and i of the item lies on diagonal p - i; an alignment with k edits
drifts by at most k diagonals, so it falls whole into one of the bands of 2 (k+1)
diagonals that start every k+1. Bands whose count of different item places meets
the bound are verified by alignment, neighbouring ones in one alignment.

A q-gram that stands at many places close by (a line of underscores) counts as
one run of diagonals, so repeated characters cost their runs, not the product of
their places. The items are taken in blocks of BLOCK_CHARS characters, each a
bounded query set against all documents; past one block each block's result is
written before the next is collected.

Results for odd input: null, empty and shorter items than Q characters match
nothing; null and empty documents match nothing; repeated documents or items
repeat rows; an empty table gives an empty result; ``clean`` keeps all columns of
the rows it keeps, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

Q = 8
ERRORS = 0.1
BLOCK_CHARS = 1 << 21
#: Characters of documents that are searched at once.
SEARCH_CHARS = 1 << 20
#: Bits of the table that most places of a document are looked up in.
TABLE_BITS = 22
#: Places of one q-gram this close make one run, and pairs of a run and an item's place that are held at once.
CLOSE = Q
PAIRS = 1 << 22
_BASE = 0x9E3779B97F4A7C15


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of Q characters, built from runs of 2 and 4."""
    if len(c) < Q:
        return np.empty(0, np.uint64)
    h, power = c.astype(np.uint64) + np.uint64(1), np.uint64(_BASE)
    with np.errstate(over="ignore"):
        for width in (1, 2, 4):
            h = h[:-width] * power + h[width:]
            power = power * power
        return h ^ (h >> np.uint64(29))


def budget(n: int) -> int:
    """Edits allowed for an item of n characters; -1 if it is too short."""
    return -1 if n < Q else min(int(ERRORS * n), (n - Q) // Q)


class Index:
    """Items by their q-grams."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self._build([(i, c) for i, t in items if len(c := codes(normal(t))) >= Q])

    def _build(self, items: list[tuple[int | None, np.ndarray]]) -> Index:
        self.items, self.halves = items, None
        self.k = np.array([budget(len(c)) for _, c in self.items], dtype=np.int64)
        self.bound = np.array([len(c) - Q + 1 - k * Q for (_, c), k in zip(self.items, self.k, strict=True)], dtype=np.int64)
        parts = [grams(c) for _, c in self.items]
        h = np.concatenate(parts or [np.empty(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.keys, self.first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.r_[self.first, len(h)])
        self.item = np.concatenate([np.full(len(p), i) for i, p in enumerate(parts)] or [np.empty(0, np.int64)])[order]
        self.place = np.concatenate([np.arange(len(p)) for p in parts] or [np.empty(0, np.int64)])[order]
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[(self.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        return self

    def _split(self) -> tuple[Index, Index]:
        if self.halves is None:
            half = len(self.items) // 2
            self.halves = tuple(object.__new__(Index)._build(x) for x in (self.items[:half], self.items[half:]))
        return self.halves

    def _regions(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(item number, first, last) of the diagonals whose bands hold enough of an item's places, last excluded."""
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return []
        key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        at, key = at[same := self.keys[key] == h[at]], key[same]
        if not len(at):
            return []
        # Runs of places of one q-gram, as few places as may be.
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (at[1:] - at[:-1] > CLOSE)]
        first, last, key = at[new], at[np.r_[np.flatnonzero(new)[1:], len(at)] - 1], key[new]
        n = self.count[key]
        if n.sum() > PAIRS and len(self.items) > 1:
            left, right = self._split()
            return left._regions(h) + [(i + len(left.items), a, b) for i, a, b in right._regions(h)]
        entry = np.repeat(self.first[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, place = self.item[entry], self.place[entry]
        step = self.k[item] + 1
        # Each diagonal lies in the bands that start at its step and the one before.
        low, high = (np.repeat(first, n) - place) // step - 1, (np.repeat(last, n) - place) // step
        # A place of an item counts once for a band, however many runs bring it there.
        order = np.argsort(entry, kind="stable")
        entry, item, low, high = entry[order], item[order], low[order], high[order]
        again = np.r_[False, entry[1:] == entry[:-1]]
        low[again] = np.maximum(low[again], high[np.flatnonzero(again) - 1] + 1)
        item, low, high = item[some := low <= high], low[some], high[some]
        least = int(low.min())
        width = int(high.max()) + 2 - least
        # Counts change where a place's bands start and just after they end.
        at_cell, inverse = np.unique(np.r_[item * width + low - least, item * width + high + 1 - least], return_inverse=True)
        change = np.bincount(inverse[: len(item)], minlength=len(at_cell)) - np.bincount(inverse[len(item) :], minlength=len(at_cell))
        full = np.cumsum(change) >= self.bound[np.minimum(at_cell // width, len(self.items) - 1)]
        starts = np.flatnonzero(full & np.r_[True, ~full[:-1]])
        ends = np.flatnonzero(full & np.r_[~full[1:], True]) + 1
        out = []
        for x, y in zip(at_cell[starts].tolist(), at_cell[ends].tolist(), strict=True):
            i, step = x // width, int(self.k[x // width]) + 1
            out.append((i, (x % width + least) * step, (y - 1 - i * width + least + 2) * step))
        return out

    def search(self, c: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, start, end, edits) for the best region of each run of bands and text that holds a match.

        c holds the texts one after the other, text g from starts[g] up to one
        separator before starts[g + 1]; places count in the text. No alignment
        sees a character of another text.
        """
        out = []
        for i, first, last in self._regions(grams(c)):
            k, wanted = int(self.k[i]), self.items[i][1]
            # The texts that the bands reach; what is too short cannot hold the item.
            g, end = max(int(np.searchsorted(starts, first, side="right")) - 1, 0), int(np.searchsorted(starts, last + len(wanted)))
            for t in range(g, min(end, len(starts) - 1)):
                s, e = int(starts[t]), int(starts[t + 1]) - 1
                low, high = max(first - s, -k), min(last - s, e - s - len(wanted) + k + 1)
                if e - s >= len(wanted) - k and low < high and (found := align(wanted, c[s:e], low, high, k)):
                    out.append((t, i, *found))
        return out


def align(item: np.ndarray, text: np.ndarray, first: int, last: int, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best alignment of the whole item on the diagonals first to last, or None beyond k edits."""
    low, high = max(first, 0), min(last - 1, len(text) - len(item))
    if low <= high:
        # No alignment is better than an equal passage.
        wanted, there, at = item.tobytes(), text[low : high + len(item)].tobytes(), -1
        while (at := there.find(wanted, at + 1)) >= 0:
            if at % 4 == 0:
                return low + at // 4, low + at // 4 + len(item), 0
    width = last - first
    d = np.arange(first, last)
    far = len(item) + width + 1
    # padded[i + j]: the character on diagonal j against item[i]; beyond the text none is equal.
    padded = np.full(len(item) + width, -1, dtype=np.int64)
    a, b = max(first, 0), min(len(text), first + len(padded))
    if a < b:
        padded[a - first : b - first] = text[a:b]
    # cost[j]: fewest edits of item[:i] against text up to i + first + j; began[j]: where that text starts.
    cost = np.where((d >= 0) & (d <= len(text)), 0, far)
    began = d.copy()
    steps = np.arange(width)
    up_cost, up_began = np.full(width, far), np.zeros(width, dtype=np.int64)
    for i, ch in enumerate(item.tolist()):
        here = padded[i : i + width]
        sub = cost + (here != ch)
        sub[here < 0] = far
        # Leaving out the item's character keeps the place in the text: one diagonal down.
        up_cost[:-1], up_began[:-1] = cost[1:] + 1, began[1:]
        new, came = np.minimum(sub, up_cost), np.where(sub <= up_cost, began, up_began)
        # An extra character of the text: one diagonal up, from the best one below.
        slack = new - steps
        best = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == best, steps, 0))
        cost, began = best + steps, came[source]
        if i + 1 + last > len(text) or i + 1 + first < 0:
            place = i + 1 + d
            cost[(place < 0) | (place > len(text))] = far
        if cost.min() > k:
            return None
    j = int(cost.argmin())
    return (int(began[j]), int(len(item) + d[j]), int(cost[j])) if cost[j] <= k else None


def matches(texts: list[str | None], index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits): the best match of each text and item, by normal text."""

    def searched(group: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, int, int, int]]:
        # Texts are joined by a character that no item has, so one search does for many.
        starts = np.cumsum([0, *(len(c) + 1 for _, c in group)])
        joined = np.zeros(starts[-1], dtype=np.uint32)
        for s, (_, c) in zip(starts, group, strict=False):
            joined[s : s + len(c)] = c
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for g, item, s, e, edits in index.search(joined, starts):
            key, hit = (group[g][0], item), (edits, s, e)
            best[key] = min(best.get(key, hit), hit)
        for (n, item), (edits, s, e) in sorted(best.items()):
            yield n, item, s, e, edits

    group, held = [], 0
    for n, t in enumerate(texts):
        if len(c := codes(normal(t))) >= Q:
            group.append((n, c))
            held += len(c)
        if held >= SEARCH_CHARS:
            yield from searched(group)
            group, held = [], 0
    if group:
        yield from searched(group)


def _blocks(benchmark: DataFrame) -> tuple[int, Callable[[int], list[tuple[int | None, str]]]]:
    """How many blocks the items make, and a function that collects one of them."""
    items = benchmark.select("item_id", "text").where(F.length("text") >= Q)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    block = F.pmod(F.xxhash64("text"), F.lit(max(n, 1)))
    items = items if n <= 1 else materialize(items.withColumn("block", block), "items")

    def collect(b: int) -> list[tuple[int | None, str]]:
        part = items if n == 1 else items.where(F.col("block") == b)
        return sorted(((r.item_id, r.text) for r in part.select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))

    return n, collect


HITS = "doc_id long, item_id long, start long, end long, edits long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits: one row for each document and item that it holds; places count in the normal text."""
    rows = docs.select("doc_id", "text")

    def hits(items: list[tuple[int | None, str]]):
        def batches_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for batch in batches:
                found = [(batch.column(0)[n].as_py(), index.items[i][0], s, e, k) for n, i, s, e, k in matches(batch.column(1).to_pylist(), index)]
                cols = list(zip(*found, strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "item_id", "start", "end", "edits"])

        return batches_out

    n, block = _blocks(benchmark)
    if n <= 1:
        return rows.mapInArrow(hits(block(0)), HITS) if n else rows.sparkSession.createDataFrame([], HITS)
    parts = [materialize(rows.mapInArrow(hits(block(b)), HITS), "hits") for b in range(n)]
    return functools.reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""

    def without(items: list[tuple[int | None, str]], at: int):
        def batches_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[n for n, *_ in matches(batch.column(at).to_pylist(), index)]] = False
                yield batch.filter(pa.array(keep))

        return batches_out

    n, block = _blocks(benchmark)
    for b in range(n):
        docs = docs.mapInArrow(without(block(b), docs.columns.index("text")), docs.schema)
        if b < n - 1:
            docs = materialize(docs, "clean")
    return docs


def op10_qgram_bands(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
