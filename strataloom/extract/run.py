"""Extraction over a files table: one row a file, with arrays of what it holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import braces, python

EXTRACTORS = {
    "python": python.extract,
    "javascript": lambda c: braces.script(c, "javascript"),
    "typescript": lambda c: braces.script(c, "typescript"),
    "rust": braces.rust,
    "go": braces.go,
    "java": braces.java,
}

_FIELDS = {
    "imports": [("module", pa.string()), ("names", pa.list_(pa.string())), ("alias", pa.string()), ("is_relative", pa.bool_()), ("line", pa.int32())],
    "calls": [("callee", pa.string()), ("line", pa.int32())],
    "symbols": [("name", pa.string()), ("kind", pa.string()), ("parent_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("decorators", pa.list_(pa.string()))],
    "bases": [("child", pa.string()), ("base", pa.string()), ("line", pa.int32())],
    "injections": [("class_name", pa.string()), ("type_name", pa.string()), ("field_name", pa.string()), ("line", pa.int32())],
    "nodes": [("type", pa.string()), ("name", pa.string()), ("parent", pa.string()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32())],
}
SCHEMA = (
    "file_id string, path string, language string, "
    "imports array<struct<module:string,names:array<string>,alias:string,is_relative:boolean,line:int>>, calls array<struct<callee:string,line:int>>, "
    "symbols array<struct<name:string,kind:string,parent_name:string,start_line:int,end_line:int,decorators:array<string>>>, bases array<struct<child:string,base:string,line:int>>, "
    "injections array<struct<class_name:string,type_name:string,field_name:string,line:int>>, "
    "nodes array<struct<type:string,name:string,parent:string,start_byte:int,end_byte:int,start_line:int,end_line:int>>, errors array<string>"
)


def extract_one(language: str, content: str | None) -> dict:
    """A failure leaves its text in errors and all else empty, as does a language without an extractor."""
    empty = {k: [] for k in (*_FIELDS, "errors")}
    if language not in EXTRACTORS or not content:
        return empty
    try:
        return EXTRACTORS[language](content)
    except Exception as e:  # noqa: BLE001 - one file must not end the job
        return empty | {"errors": [f"{type(e).__name__}: {e}"]}


def extract(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """file_id, path, language and the arrays of SCHEMA. `extractors` adds or overrides languages."""
    ship(files.sparkSession)
    extra = extractors or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        EXTRACTORS.update(extra)
        for batch in batches:
            rows = [extract_one(lang, content) for lang, content in zip(batch.column("language").to_pylist(), batch.column("content").to_pylist())]
            columns = [batch.column(c) for c in ("file_id", "path", "language")]
            for name, fields in _FIELDS.items():
                keys = [f for f, _ in fields]
                columns.append(pa.array([[dict(zip(keys, x)) for x in r[name]] for r in rows], pa.list_(pa.struct(fields))))
            columns.append(pa.array([r["errors"] for r in rows], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=["file_id", "path", "language", *_FIELDS, "errors"])

    return files.select("file_id", "path", "language", "content").mapInArrow(run, SCHEMA)


def rows(extracted: DataFrame, what: str) -> DataFrame:
    """One array of the extraction as rows, with file_id, path, language and pos."""
    return extracted.select("file_id", "path", "language", F.posexplode(what).alias("pos", "_x")).select("file_id", "path", "language", "pos", "_x.*")
