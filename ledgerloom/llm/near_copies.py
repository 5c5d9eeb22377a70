"""SimHash near-dedup on the pipeline's terms: five-word shingles, a Jaccard similarity of 0.8 or more.

Fingerprints of such pairs differ in about 10 of 64 bits and in up to DISTANCE,
too many for the exact keys of ``simhash``: chains of so wide a budget leave no
segment equal. So what may be compared is found by minima of the shingle hashes:
of BANDS bands of ROWS minima a pair at the threshold shares one with probability
1 - (1 - 0.8**5)**20 = 0.9996, and a more similar pair sooner. Texts that share a
band form a group, however far along. Within a group the pigeonring filter asks
for chains of fingerprint segments whose differences stay within their share of
DISTANCE, then comes the full Hamming check, and last the exact overlap of the
whole shingle sets. Only pairs that no earlier link joins are looked at, and only
a spanning forest of links leaves a task.

A group of many or long texts is cut into blocks, and each pair of blocks is a
task of its own, so no group is gathered in one place and no pair is left out.

Results for odd input: a text of fewer than five words is one shingle; null and
empty texts are near copies of each other; texts with equal shingle sets are near
copies; repeated rows leave one; an empty table gives an empty table; columns of
any name and type are kept, as rows are told apart by doc_id and text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize
from .components import components
from .simhash import bits_of, chains_within

SEED = 42
SHINGLE = 5
#: The least similarity of near copies is SIMILAR / 100.
SIMILAR = 80
#: Most bits in which their fingerprints may differ; at the threshold more have a chance of under 1 in 10,000.
DISTANCE = 22
BANDS = 20
ROWS = 5
#: Texts and shingles of a block.
BLOCK, BLOCK_SHINGLES = 1 << 11, 1 << 20
CHUNK = 1 << 13
#: Open partners of a text up to which they are compared one by one.
FEW = 16
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of SHINGLE words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < SHINGLE:
        runs = [b" ".join(words)] if words else []
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in runs], dtype=np.uint64))


def band_keys(s: np.ndarray) -> list[int]:
    """One signed key for each band; none for an empty set."""
    if not len(s):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for i in range(0, len(s), CHUNK):
        np.minimum(least, (s[i : i + CHUNK, None] * _FACTORS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(part.tobytes(), b) - (1 << 63) for b, part in enumerate(least.reshape(BANDS, ROWS))]


SETS = "doc_id long, row_hash long, node long, n long, keys array<long>"


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, keys = [], [], []
        for t in batch.column(1):
            s = shingles(t.as_py())
            nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63))
            sizes.append(len(s))
            keys.append(band_keys(s))
        cols = [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_hash", "node", "n", "keys"])


def forest(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join what a chain of near copies joins; with sides, only pairs of both sides count."""
    size = np.array([len(s) for s in sets])
    fp = np.array([bits_of(s) for s in sets], dtype=np.uint64)
    label = np.arange(len(sets))
    grams = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    out = []
    for x in range(1, len(sets)):
        open_ = label[:x] != label[x]
        if side is not None:
            open_ &= side[:x] != side[x]
        open_ &= 100 * np.minimum(size[:x], size[x]) >= SIMILAR * np.maximum(size[:x], size[x])
        near = np.flatnonzero(open_)
        apart = fp[near] ^ fp[x]
        near, apart = near[ok := chains_within(apart, DISTANCE)], apart[ok]
        bits = np.bitwise_count(apart)
        near = near[bits <= DISTANCE][np.argsort(bits[bits <= DISTANCE], kind="stable")]
        both = None
        while len(near):
            y = int(near[0])
            if both is None and len(near) <= FEW:
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            else:
                if both is None:
                    # The overlap with all others at once, from the places of this text's shingles.
                    low, high = np.searchsorted(grams, sets[x], "left"), np.searchsorted(grams, sets[x], "right")
                    both = np.zeros(len(sets), dtype=np.int64)
                    for i in range(0, len(low), 256):
                        n = high[i : i + 256] - low[i : i + 256]
                        at = np.repeat(low[i : i + 256] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        both += np.bincount(owner[at], minlength=len(sets))
                common = int(both[y])
            if 100 * common >= SIMILAR * (size[x] + size[y] - common):
                out.append((x, y))
                label[label == label[x]] = label[y]
            near = near[1:]
            near = near[label[near] != label[x]]
    return out


def _group_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, low, high, block, node, text), sorted by the first three -> links; a group may go on over batches."""

    def links(rows: list[tuple[int, int, str]], one: bool) -> pa.RecordBatch:
        found = forest([shingles(t) for _, _, t in rows], None if one else np.array([b for b, _, _ in rows]))
        return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i, _ in found], pa.int64()), pa.array([rows[j][1] for _, j in found], pa.int64())], ["a", "b"])

    now, held = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        for key, block, node, text in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True):
            if key != now:
                if len(held) > 1:
                    yield links(held, now[1] == now[2])
                now, held = key, []
            held.append((block, node, text.as_py()))
    if len(held) > 1:
        yield links(held, now[1] == now[2])


def groups(sets: DataFrame) -> DataFrame:
    """(node, grp) of sets (node, keys) that share a band with another node, directly or along others."""
    rows = sets.select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    # A hot key is one small row on this side, so the join may be broadcast or split at will.
    edges = rows.join(shared, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return components(edges).withColumnRenamed("root", "grp")


def links(grouped: DataFrame) -> DataFrame:
    """grouped (grp, node, n, text), one row for each node -> (a, b): a spanning forest of the near copies of each group."""
    sizes = grouped.groupBy("grp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = grouped.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A row goes to each pair of its block with another one, or to its block alone where there is but one.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "text")
    return rows.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high", "node").mapInArrow(_group_batches, "a long, b long")


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near copies: the smallest doc_id, nulls last.

    All columns are kept as they are. Of rows with the same doc_id the one with
    the smallest text hash stays, once.
    """
    row_hash = F.xxhash64("doc_id", "text")
    sets = materialize(docs.select("doc_id", "text", row_hash.alias("row_hash")).mapInArrow(_set_batches, SETS), "shingles")
    grouped = materialize(groups(sets), "groups")
    # One text stands for each node of a group; rows that share the hash have equal texts.
    chosen = sets.join(grouped, "node").groupBy("node").agg(F.min(F.struct("row_hash", "n", "grp")).alias("c")).select("node", F.col("c.*"))
    texts = docs.select(row_hash.alias("row_hash"), "text").join(chosen, "row_hash").dropDuplicates(["node"])
    roots = components(links(texts))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("best")
    by_node = sets.groupBy("node").agg(best)
    kept = by_node.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    rows = sets.groupBy("row_hash").agg(F.count(F.lit(1)).alias("rows"))
    kept = materialize(kept.select(F.col("best.row_hash").alias("row_hash")).join(rows, "row_hash"), "kept")
    key, n = free_name(docs, "row_hash"), free_name(docs, "rows")
    found = docs.withColumn(key, row_hash).join(kept.select(F.col("row_hash").alias(key), F.col("rows").alias(n)), key)
    # Only what stands there repeatedly is gathered by its key again.
    once = found.where(F.col(n) == 1).unionByName(found.where(F.col(n) > 1).dropDuplicates([key]))
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))
