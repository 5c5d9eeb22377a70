"""Token ids as Parquet list columns that can be read in part.

One row for each document, in ascending doc_id order over the files: ``ord``
(file number and place in it), ``doc_id``, ``n_tokens`` and ``tokens``. Ids are
dictionary-coded (a vocabulary fits one dictionary page), the other columns
delta-coded. Row groups and pages are small and have column and offset indexes,
so a doc_id range touches only its own pages and the metadata columns can be
read without the ids. An ``index`` table has one row for each file: its ord
base, rows, tokens, least and largest doc_id, and the ids in all files before it.

Documents are dealt out by ranges of doc_id, then of a text hash, so that ids
repeated very often do not meet in one task. Results for odd input: a null or
empty text has the end id only; null doc_ids come first; rows with the same
doc_id follow each other in text-hash order; an empty table gives an empty file
set; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Encodings and sizes of the files; ROW_GROUP and PAGE in bytes.
ROW_GROUP = 16 << 20
PAGE = 64 << 10
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": "512",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#ord": "false",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
#: Characters of pieces in a generation of those that a worker keeps encoded.
CACHED_CHARS = 2 << 20
#: Bytes of texts that are encoded together.
GROUP_BYTES = 2 << 20
#: White space other than spaces and line feeds, in the widest sense of any Unicode version.
_OTHER = re.compile(r"[\r\t\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
#: Characters whose class (letter, number, neither) is the same in every Unicode version in use.
_KNOWN = "\x01-\u024f\u2010-\u2027\u2030-\u205e"
_UNKNOWN = re.compile(f"[^{_KNOWN}]")


def _pretokens() -> re.Pattern:
    """The split before the merges of byte-level BPE, for text of _KNOWN characters without runs of white space."""
    of = {k: "".join(re.escape(chr(c)) for c in range(1, 0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{of['L']}]+| ?[{of['N']}]+| ?[^\s{of['L']}{of['N']}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it can be seen, else the next one from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts, equal to those of each whole text at once by the library.

    A single space or line feed between other characters starts a new piece for
    byte-level BPE, whatever stands around, so such pieces can be encoded apart
    and remembered: one after a space without it, one after a line feed with it.
    Only the distinct pieces of a group of texts are looked at one by one; Arrow
    and numpy do the rest. New pieces are parted as the library does it, where
    every character's class is known for sure, and their distinct parts go
    through the library's merges in one call; other new pieces go through the
    whole of the library, each after a line feed, whose single id marks where
    they start. A text with other white space, with two spaces or line feeds
    together, or with a special token's string is encoded as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self._ids("\n")
        said = json.loads(self.tokenizer.to_str())
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.merges = None
        if said["normalizer"] is None and plain.items() <= (said["pre_tokenizer"] or {}).items() and len(self.feed) == 1:
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.split = _pretokens().findall
        #: Letters that each id stands for.
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        # Byte zero parts the pre-tokens; no piece has it.
        self.letters = _byte_letters() | {0: "\n"}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.chars = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _marked(self, parts: list[str], ids: np.ndarray) -> dict[str, bytes]:
        """parts and their ids, each after one line feed's."""
        starts = np.flatnonzero(ids == self.feed[0])
        coded, bounds = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
        return {p: coded[a + 4 : b] for p, a, b in zip(parts, bounds[:-1], bounds[1:], strict=True)}

    def _learn(self, new: list[str]) -> None:
        self.chars += sum(map(len, new))
        if self.merges is None or _UNKNOWN.search("".join(new)):
            sure = [] if self.merges is None else [p for p in new if not _UNKNOWN.search(p)]
            if other := list(set(new).difference(sure)):
                said = self._marked(other, self._ids("".join([p if p[0] == "\n" else "\n " + p for p in other])))
                self.known.update((p, self.feed.tobytes() + c if p[0] == "\n" else c) for p, c in said.items())
            new = sure
        if new:
            # A line feed is a pre-token of its own, as none meets other white space here.
            split = self.split("".join([p if p[0] == "\n" else "\n " + p for p in new]))
            parts = list(set(split) - {"\n"})
            letters = "\0".join(parts).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.merges.encode_batch_fast([letters], add_special_tokens=False)[0].ids, dtype="<u4")
            # Ids never go over a part's end, so the letters that they stand for tell where each part's ids end.
            ends = np.cumsum(np.fromiter(map(len, letters.split("\n")), np.int64, len(parts)))
            ends = 4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)
            raw = ids.tobytes()
            of = {p: raw[a:b] for p, a, b in zip(parts, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)}
            of["\n"] = b""
            starts = [i for i, x in enumerate(split) if x == "\n"]
            coded = list(map(of.__getitem__, split))
            feed = self.feed.tobytes()
            for p, a, b in zip(new, starts, [*starts[1:], len(split)], strict=True):
                c = coded[a + 1] if b - a == 2 else b"".join(coded[a:b])
                self.known[p] = feed + c if p[0] == "\n" else c

    def _pieces(self, pieces: list[str]) -> tuple[list[bytes], list[int]]:
        """The ids of distinct pieces, and the places of those that cannot be encoded apart."""
        found = list(map(self.known.get, pieces))
        missing = [i for i, c in enumerate(found) if c is None]
        if not missing:
            return found, []
        # An empty piece and a bare line feed stand for white space in a run or at an end.
        bad = [i for i in missing if pieces[i] in ("", "\n")]
        joined = " ".join([pieces[i] for i in missing])
        if _OTHER.search(joined) or any(s in joined for s in self.special) or len(self.feed) != 1:
            bad = [i for i in missing if pieces[i] in ("", "\n") or _OTHER.search(pieces[i]) or any(s in pieces[i] for s in self.special) or len(self.feed) != 1]
        for i in bad:
            found[i] = b""
        if bad:
            missing = [i for i in missing if found[i] is None]
        if self.chars > CACHED_CHARS:
            # A new generation: what this group shares with the one before comes along.
            self.before, self.known = self.known, {p: c for p, c in zip(pieces, found, strict=True) if c}
            self.chars = sum(map(len, self.known))
        again = {pieces[i]: c for i in missing if (c := self.before.get(pieces[i])) is not None}
        self.known.update(again)
        self.chars += sum(map(len, again))
        self._learn([pieces[i] for i in missing if pieces[i] not in again])
        for i in missing:
            found[i] = self.known[pieces[i]]
        return found, bad

    def encode(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, how many of them are each text's); null counts as empty."""
        whole = pc.fill_null(texts, "")
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(whole, "\n", " \n"), ""), " ")
        coded = lists.flatten().dictionary_encode()
        codes, first = coded.indices.to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        found, bad = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        sizes = size[codes]
        until = np.cumsum(sizes)
        ids = np.frombuffer(b"".join(found), dtype="<u4")[np.repeat(start[codes] - (until - sizes), sizes) + np.arange(until[-1] if len(until) else 0)]
        counts = np.add.reduceat(sizes, first) if len(first) else np.zeros(0, np.int64)
        # Each text starts with a line feed that is not its own: that place goes to the end id of the text before.
        starts = np.cumsum(counts) - counts
        if not bad:
            ids[starts] = end_id
            return np.append(ids[1:], np.array([end_id] * bool(len(ids)), dtype="<u4")), counts
        irregular = np.zeros(len(found), dtype=bool)
        irregular[bad] = True
        odd = np.logical_or.reduceat(irregular[codes], first)
        end = np.array([end_id], dtype="<u4")
        parts = [np.append(self._ids(whole[i].as_py()), end) if odd[i] else np.append(ids[a + 1 : a + n], end) for i, (a, n) in enumerate(zip(starts, counts, strict=True))]
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)


def encoder_of(path: str) -> Encoder:
    """The worker process's encoder for this file; it lasts over tasks, as this module does not where it is sent by value."""
    kept = sys.modules.setdefault("_ledgerloom_worker", types.ModuleType("_ledgerloom_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _encoder_batches(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            # Groups of whole texts: large enough to hold many pieces of a kind, small enough for memory.
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes, dtype=np.int64) // GROUP_BYTES
            bounds = [*np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                ids, counts = encoder.encode(batch.column(1)[a:b], end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(counts), lists], ["doc_id", "n_tokens", "tokens"])
                del ids, counts, lists
        # Workers outlive their tasks and stay beside those of later stages: what the next task can learn again goes.
        encoder.before = {}
        pa.default_memory_pool().release_unused()

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) and write path/data and path/index."""
    spark = docs.sparkSession
    # The range partitioner looks at its input twice; the keys of the first look need no ids.
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    coded = dealt.select("doc_id", "text").mapInArrow(_encoder_batches(tokenizer_path, end_id), "doc_id long, n_tokens long, tokens array<int>")
    # The id holds the partition's number, which is the file's place in doc_id order, and the row's place in it.
    coded.select(F.monotonically_increasing_id().alias("ord"), "*").write.options(**FORMAT).parquet(f"{path}/data")
    files = spark.read.parquet(f"{path}/data").groupBy(F.shiftright("ord", 33).alias("file"))
    files = files.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    # One row for each file, so this one task stays small.
    before = F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files.withColumn("base", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/index")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(ord, doc_id, n_tokens) without the ids."""
    return spark.read.parquet(f"{path}/data").select("ord", "doc_id", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """(ord, doc_id, n_tokens, tokens) of a doc_id range, both ends included; other pages are skipped."""
    out = spark.read.parquet(f"{path}/data")
    if first_id is not None:
        out = out.where(F.col("doc_id") >= first_id)
    return out if last_id is None else out.where(F.col("doc_id") <= last_id)


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        bounds, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        crcs = [zlib.crc32(np.ascontiguousarray(ids[a:b], dtype="<u4")) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], ["ord", "doc_id", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    rows = read_tokens(spark, path).mapInArrow(_crc_batches, "ord long, doc_id long, n_tokens long, ids_crc32 long")
    rows = rows.withColumn("file", F.shiftright("ord", 33))
    before = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0)))
    index = spark.read.parquet(f"{path}/index").select("file", "base")
    return rows.join(index, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, tokenizer_path: str | None = None, path: str | None = None) -> DataFrame:
    """Write docs as token files (by default in the shared folder) and return what their digests say."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path or tokenizer_file())
    return read_digests(spark, path)


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
