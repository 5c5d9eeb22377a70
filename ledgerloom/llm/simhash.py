"""Near-duplicate documents by SimHash, with a pigeonring filter before the Hamming check.

A fingerprint has 64 bits in a ring of eight segments of one byte. If two
fingerprints differ in at most 2 bits, the pigeonring principle (Qin and Xiao,
2018) gives a start i such that every chain of l segments from i differs in at
most floor(2 l / 8) bits: none in segments i to i+2, and at most one in
segments i+3 to i+6. That one bit leaves segments i+3, i+4 or else i+5, i+6
equal. So each fingerprint gets 16 exact keys of 40 bits, and every pair within
2 bits meets under one of them; inside a bucket the chain budgets and then the
full distance are checked.

Buckets hold distinct fingerprints only, which agree in 40 bits: at most 2**24
values of 8 bytes, whatever the input. From a bucket comes a spanning forest of
its links, not its pairs.

Results for odd input: a null or empty text has fingerprint zero and links like
any other; repeated rows share a component; a component whose doc_ids are all
null has component_id null; an empty table gives an empty table; columns other
than doc_id and text are not read. ``near_copies`` uses the same fingerprints and
filter at a wider distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 2
SEGMENTS = 8
#: A bucket up to this size is compared pair by pair in one matrix, a larger one by masks.
MATRIX = 256
#: Hashes whose bits are unpacked at once.
CHUNK = 1 << 15


def bits_of(h: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: a bit is 1 where it is in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def simhash(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(SHINGLE)), strict=False)]
    return bits_of(np.array(hashes, dtype="<u8"))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.empty(batch.num_rows, dtype=np.uint64)
        texts = batch.column(1)
        for i in range(batch.num_rows):
            fps[i] = simhash(texts[i].as_py())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; fp is the fingerprint as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def chain_keys(fp: str = "fp") -> F.Column:
    """The 16 bucket keys of a fingerprint, each with the number of its table in the top bits."""
    keys = []
    for i in range(SEGMENTS):
        # Rotate so that segment i stands at the top, then i+1 and so on downwards.
        turned = F.col(fp) if i == 0 else F.shiftleft(F.col(fp), 8 * i).bitwiseOR(F.shiftrightunsigned(F.col(fp), 64 - 8 * i))
        head = F.shiftleft(F.shiftrightunsigned(turned, 40), 16)
        near = F.shiftrightunsigned(turned, 24).bitwiseAND(F.lit(0xFFFF))
        far = F.shiftrightunsigned(turned, 8).bitwiseAND(F.lit(0xFFFF))
        for t, rest in ((2 * i, near), (2 * i + 1, far)):
            keys.append(head.bitwiseOR(rest).bitwiseOR(F.lit(t << 40)))
    return F.array(*keys)


def chains_within(x: np.ndarray, distance: int = MAX_DISTANCE) -> np.ndarray:
    """Which XORs have a start from which every chain of segments keeps its share of the distance."""
    per = np.bitwise_count(np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, SEGMENTS)[..., ::-1]).astype(np.int16)
    budgets = np.arange(1, SEGMENTS + 1) * distance // SEGMENTS
    ok = np.zeros(x.shape, dtype=bool)
    for i in range(SEGMENTS):
        ok |= (np.cumsum(np.roll(per, -i, axis=-1), axis=-1) <= budgets).all(axis=-1)
    return ok


def _merge(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (each the least index of its set) after joining the sets of u[i] and v[i]."""
    while True:
        a, b = labels[u], labels[v]
        if (open_ := a != b).sum() == 0:
            return labels
        np.minimum.at(labels, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (labels != (up := labels[labels])).any():
            labels = up


def _roots_by_matrix(f: np.ndarray) -> np.ndarray:
    u, v = np.triu_indices(len(f), 1)
    x = f[u] ^ f[v]
    x, u, v = x[keep := chains_within(x)], u[keep], v[keep]
    close = np.bitwise_count(x) <= MAX_DISTANCE
    return _merge(np.arange(len(f)), u[close], v[close])


def _roots_by_masks(f: np.ndarray) -> np.ndarray:
    """Fingerprints that agree outside two bit positions are within 2 bits of each other: sort instead of pairing."""
    free = int(np.bitwise_or.reduce(f ^ f[0]))
    bits = [b for b in range(64) if free >> b & 1] or [0]
    labels = np.arange(len(f))
    for i, a in enumerate(bits):
        for b in bits[i + 1 :] or bits[i:]:
            masked = f & np.uint64(~(1 << a | 1 << b) & (1 << 64) - 1)
            order = np.argsort(masked, kind="stable")
            same = np.flatnonzero(masked[order][1:] == masked[order][:-1])
            labels = _merge(labels, order[same], order[same + 1])
    return labels


def bucket_links(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links among the distinct fingerprints of one bucket."""
    labels = (_roots_by_matrix if len(f) <= MATRIX else _roots_by_masks)(f)
    linked = np.flatnonzero(labels != np.arange(len(f)))
    return f[linked], f[labels[linked]]


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp) -> links; a bucket may go on over batches."""

    def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        ends = np.r_[starts[1:], len(k)]
        out = [bucket_links(f[s:e]) for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True)]
        a, b = (np.concatenate([x[i] for x in out] or [np.empty(0, np.uint64)]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        cut = int(np.searchsorted(k, k[-1]))
        if held and (cut or held[-1][0][-1] != k[0]):
            held.append((k[:cut], f[:cut]))
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        elif cut:
            yield links(k[:cut], f[:cut])
        held.append((k[cut:], f[cut:]))
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b): links that join what is within MAX_DISTANCE bits."""
    keyed = distinct.select(F.explode(chain_keys()).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_batches, "a long, b long")


def component_ids(fps: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of fps (doc_id, fp)."""
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fps")
    roots = components(links(least.select("fp")))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least_of = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least_of, "root").select("fp", "component_id")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links."""
    fps = materialize(fingerprints(docs), "simhash")
    out = fps.join(component_ids(fps), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash_pigeonring(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
