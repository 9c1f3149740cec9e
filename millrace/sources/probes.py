"""What files hold, from inside tasks: the schema of a file's first rows, and digests of files of any size.

A task opens a listed file as a stream, so a file is never a row's content: probes read a bounded head (or, of Parquet, the footer), digests one
buffer after the other. Schemes are those that Arrow's file systems open (local, hdfs, s3, gs; s3a and s3n are read as s3).
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes and rows of a probe's head; bytes of a digest's buffer.
HEAD_BYTES, HEAD_ROWS, BUFFER = 1 << 16, 10, 1 << 20


def open_file(path: str) -> pa.NativeFile:
    """A readable file, from its path as an inventory spells it; a name that isn't there is tried as an encoded one."""
    from pyarrow import fs

    path = re.sub("^file:/+", "/", re.sub("^s3[an]://", "s3://", path))
    if path.startswith("/"):
        local = fs.LocalFileSystem()
        return local.open_input_file(path if local.get_file_info(path).type != fs.FileType.NotFound else unquote(path))
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


_KINDS = (("boolean", r"(?i)true|false"), ("bigint", r"[+-]?\d{1,18}"), ("double", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"), ("date", r"\d{4}-\d{2}-\d{2}"), ("timestamp", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?"))


def text_type(values: list[str]) -> str:
    """The narrowest type that all the texts which aren't empty are of."""
    some = [v.strip() for v in values if v.strip()]
    return next((kind for kind, form in _KINDS if some and all(re.fullmatch(form, v) for v in some)), "string")


def json_type(values: list) -> str:
    some = [v for v in values if v is not None]
    kinds = {"boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "array" if isinstance(v, list) else "struct" if isinstance(v, dict) else "string" for v in some}
    return kinds.pop() if len(kinds) == 1 else "double" if kinds == {"bigint", "double"} else "string"


def _csv_head(head: bytes, whole: bool) -> list[tuple[str, str]]:
    text = head.decode("utf-8-sig")
    if not whole and "\n" in text:
        text = text[: text.rindex("\n") + 1]  # the last line may be cut
    rows = [r for r, _ in zip(csv.reader(io.StringIO(text)), range(HEAD_ROWS + 1), strict=False)]
    if not rows:
        return []
    return [(name, text_type([r[i] for r in rows[1:] if i < len(r)])) for i, name in enumerate(rows[0])]


def _json_head(head: bytes, whole: bool) -> list[tuple[str, str]]:
    text = head.decode()
    if text.lstrip().startswith("["):
        decoder, at, rows = json.JSONDecoder(), text.index("[") + 1, []
        while len(rows) < HEAD_ROWS and (at := re.compile(r"[\s,]*").match(text, at).end()) < len(text) and text[at] != "]":
            row, at = decoder.raw_decode(text, at)
            rows.append(row)
    else:
        lines = text.splitlines()
        rows = [json.loads(x) for x in (lines if whole else lines[:-1])[:HEAD_ROWS] if x.strip()]
    names = list(dict.fromkeys(k for r in rows for k in r))
    return [(k, json_type([r.get(k) for r in rows])) for k in names]


def _parquet_footer(file: pa.NativeFile) -> list[tuple[str, str]]:
    from pyarrow import parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(pq.read_schema(file), prefer_timestamp_ntz=True)
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def probe(path: str) -> tuple[list[tuple[str, str]], str | None]:
    """Columns (name, type) of a file's first rows, or why there are none."""
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        with closing(open_file(path)) as file:
            if kind == "parquet":
                return _parquet_footer(file), None
            if kind not in ("csv", "json"):
                return [], "no probe for this format"
            head = file.read(HEAD_BYTES + 1)
            read = _csv_head if kind == "csv" else _json_head
            return read(head[:HEAD_BYTES], len(head) <= HEAD_BYTES), None
    except Exception as e:  # whatever a damaged file raises is its entry
        return [], (str(e).split("\n")[0] or type(e).__name__)[:200]


_COLUMNS = pa.list_(pa.struct([("column_name", pa.string()), ("data_type", pa.string())]))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("path").to_pylist()
        found = [probe(p) for p in paths]
        columns = [[{"column_name": n, "data_type": t} for n, t in c] for c, _ in found]
        yield pa.record_batch([pa.array(paths), pa.array(columns, _COLUMNS), pa.array([len(c) for c in columns], pa.int32()), pa.array([e for _, e in found], pa.string())], ["path", "columns", "readable_columns", "error"])


def probed(files: DataFrame) -> DataFrame:
    """An inventory (path) with `columns` (name and type of each, from the file's head or footer), `readable_columns` (how many) and `error`
    (why a file can't be read). Each path is opened in a task; tasks share the paths evenly."""
    paths = files.select("path").where("path is not null").distinct()
    made = paths.mapInArrow(_probe, "path string, columns array<struct<column_name:string,data_type:string>>, readable_columns int, error string")
    return files.join(made, "path", "left")


def schema_of_files(files: DataFrame) -> DataFrame:
    """(path) to path, ordinal, column_name and data_type of each column of each file that can be read."""
    return probed(files.select("path")).select("path", F.posexplode("columns").alias("ordinal", "c")).select("path", "ordinal", "c.column_name", "c.data_type")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            sums, size, error = [hashlib.md5(), hashlib.sha1(), hashlib.sha256()], 0, None
            try:
                with closing(open_file(path)) as file:
                    while part := file.read(BUFFER):
                        size += len(part)
                        for s in sums:
                            s.update(part)
            except Exception as e:  # a file that is gone or can't be opened has no digest
                error = (str(e).split("\n")[0] or type(e).__name__)[:200]
            rows.append((path, None, None, None, None, error) if error else (path, size, *(s.hexdigest() for s in sums), None))
        kinds = (pa.string(), pa.int64(), *[pa.string()] * 4)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "bytes", "md5", "sha1", "sha256", "error"])


def file_digests(files: DataFrame) -> DataFrame:
    """(path) to path, bytes, md5, sha1 and sha256 (lower-case hex) of each file's content, or the error that kept it from being read."""
    return files.select("path").distinct().mapInArrow(_digest, "path string, bytes long, md5 string, sha1 string, sha256 string, error string")
