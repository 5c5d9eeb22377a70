"""Raw rows from CSV, JSON and JSON lines: seq, origin and a map of text, in order of arrival.

Uploads are small files with ragged rows and physical line numbers, so each is
parsed whole by the standard library inside a task; many files are many tasks.
``bulk_csv`` is the reader for well-formed data of any size.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Rules
from ..errors import InputError, TooLarge

DELIMITERS = ",;\t|"
SNIFFED = 64 * 1024
WRAPPERS = ("events", "rows", "data", "records")
REST = "__extra__"
_SCHEMA = "path string, line long, data map<string,string>, error string"


def decoded(payload: bytes) -> str:
    """UTF-8 without its mark, else Windows-1252, else Latin-1."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return payload.decode(encoding)
        except UnicodeDecodeError:
            continue
    return payload.decode("latin-1")


def sniff(sample: str) -> str:
    """The delimiter of a CSV text: the standard sniffer's, or the one most frequent in the header."""
    try:
        return csv.Sniffer().sniff(sample[:SNIFFED], delimiters=DELIMITERS).delimiter
    except csv.Error:
        head = sample.split("\n", 1)[0]
        best = max(DELIMITERS, key=head.count)
        return best if head.count(best) else ","


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list, bool)) else str(value)


def csv_rows(text: str) -> Iterator[tuple[int, dict]]:
    """(physical line, row); blank rows are skipped, surplus cells go under REST."""
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=sniff(text))
    header: list[str] | None = None
    for row in reader:
        if not any(c.strip() for c in row):
            continue
        if header is None:
            header = row
            continue
        out = dict.fromkeys(header) | dict(zip(header, row, strict=False))
        if len(row) > len(header):
            out[REST] = json.dumps(row[len(header) :], ensure_ascii=False)
        yield reader.line_num, out


def json_rows(text: str) -> Iterator[tuple[int, dict]]:
    try:
        said = json.loads(text)
    except ValueError as e:
        raise InputError(f"not JSON: {e}") from None
    if isinstance(said, dict):
        said = next((said[w] for w in WRAPPERS if isinstance(said.get(w), list)), [said])
    if not isinstance(said, list):
        raise InputError("JSON input is an object, an array or a wrapper of one")
    for i, row in enumerate(said, 1):
        if not isinstance(row, dict):
            raise InputError(f"item {i} is no object")
        yield i, {str(k): _text(v) for k, v in row.items()}


def jsonl_rows(text: str) -> Iterator[tuple[int, dict]]:
    for i, line in enumerate(text.splitlines(), 1):
        if line.strip():
            try:
                row = json.loads(line)
            except ValueError as e:
                raise InputError(f"line {i}: {e}") from None
            if not isinstance(row, dict):
                raise InputError(f"line {i} is no object")
            yield i, {str(k): _text(v) for k, v in row.items()}


def kind_of(path: str, text: str) -> str:
    """csv, json or jsonl: by the name, else by the first character."""
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("csv", "tsv", "txt"):
        return "csv"
    if end in ("jsonl", "ndjson"):
        return "jsonl"
    if end == "json":
        return "json"
    start = text.lstrip()[:1]
    return "json" if start == "[" else "jsonl" if start == "{" and "\n{" in text else "json" if start == "{" else "csv"


_PARSERS = {"csv": csv_rows, "json": json_rows, "jsonl": jsonl_rows}


def read_files(spark: SparkSession, paths: list[str], rules: Rules = DEFAULT, kind: str | None = None) -> DataFrame:
    """seq, origin, data of all rows of the files: files in the order given, rows as they stand.

    A file over ``rules.max_upload_bytes`` or one that cannot be parsed raises, before any row is used.
    """
    files = spark.read.format("binaryFile").load(paths)
    large = files.where(F.col("length") > rules.max_upload_bytes).select("path", "length").head(1)
    if large:
        raise TooLarge(f"{large[0].path} has {large[0].length} bytes; at most {rules.max_upload_bytes}", path=large[0].path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                text = decoded(bytes(content))
                rows, error = [], None
                try:
                    rows = list(_PARSERS[kind or kind_of(path, text)](text))
                except InputError as e:
                    error = e.message
                lines = [(path, n, row, None) for n, row in rows] or [(path, 0, None, error)]
                yield pd.DataFrame(lines, columns=["path", "line", "data", "error"])

    rows = files.select("path", "content").mapInPandas(parse, _SCHEMA)
    failed = rows.where("error IS NOT NULL").select("path", "error").head(1)
    if failed:
        raise InputError(f"{failed[0].path}: {failed[0].error}", path=failed[0].path)
    # Files stand in the order of the paths that name them, and by their own names where a path names several.
    order = {f: i for i, f in enumerate(_expanded(spark, paths))}
    places = spark.createDataFrame(list(order.items()), "__file string, __place long")
    rows = rows.where("data IS NOT NULL").join(places, F.col("path") == F.col("__file"))
    # Lines of a file are below 2**40, so place and line make one rising number without a sort.
    seq = F.col("__place") * F.lit(1 << 40) + F.col("line")
    return rows.select(seq.alias("seq"), F.concat_ws(":", F.lit("file"), F.col("path"), F.col("line").cast("string")).alias("origin"), "data")


def _expanded(spark: SparkSession, paths: list[str]) -> list[str]:
    """The full names of the files that the paths (files, folders, globs) stand for, each once, at its first place."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: dict[str, None] = {}
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        for found in fs.globStatus(path) or []:
            inner = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
            names = sorted((f.getPath().toString(), f.getPath().getName()) for f in inner if f.isFile())
            out.update(dict.fromkeys(full for full, name in names if not name.startswith(("_", "."))))
    return list(out)


def read_memory(spark: SparkSession, rows: list[dict], origin: str = "api") -> DataFrame:
    data = [(i, f"{origin}:{i}", {str(k): _text(v) for k, v in r.items()}) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(data, "seq long, origin string, data map<string,string>")


def bulk_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Well-formed CSV of any size, split within files; seq follows the files' names, then the place in the file."""
    rows = spark.read.csv(path, header=True, sep=sep, inferSchema=False)
    names = rows.columns
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__nth"))
    # Splits are packed by size, so a split's first row and its number of rows tell where it stands: one small row for each.
    split = rows.groupBy("__file", "__start").agg(F.min("__nth").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1))
    split = split.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    seq = F.col("__before") + F.col("__nth") - F.col("__first") + 1
    return rows.join(split, ["__file", "__start"]).select(seq.alias("seq"), F.lit("csv").alias("origin"), *names)
