"""Sources of Python files and the tables of facts that one parse per file makes."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import pyfacts

BINARY = tuple("." + x for x in "dll dylib pyc pyd so".split())

_NODE = "seq int, id string, kind string, start_line int, start_col int, end_line int, end_col int, parent_id string, scope_id string, name string, resolved string, tags array<string>, attrs string"
#: Table -> row of the facts of a file. Every table has file_path first.
TABLES = {
    "nodes": _NODE,
    "ir_edges": "seq int, src string, dst string, type string, guard_id string",
    "symbols": "seq int, scope_id string, name string, kind string, defs array<string>, uses array<string>",
    "blocks": "block_id int, scope string, n_stmts int, start_line int, end_line int",
    "stmts": "block_id int, seq int, start_line int, end_line int",
    "cfg_edges": "src int, dst int, label string",
    "phis": "block_id int, var string, result string, operands map<int,string>",
    "ssa": "var string, versions int",
    "flows": "seq int, source string, sink string, path array<string>, implicit boolean, start_line int, start_col int, end_line int, end_col int, truncated boolean",
    "calls": "seq int, caller string, kind string, name string, base string",
    "methods": "seq int, class string, method string",
    "messages": "seq int, role string, mechanism string, topic string, function string",
    "signatures": "seq int, name string, inputs array<struct<name:string,type:string>>, outputs array<string>, calls array<string>, side_effects array<string>, complexity int",
    "routes": "seq int, framework string, path string, method string, handler string",
}


def _array(row: str) -> str:
    """``array<struct<...>>`` of a row given as columns."""
    return "array<struct<" + re.sub(r"(^|, )(\w+) (?=[a-z])", r"\1`\2`: ", row) + ">>"



def is_binary(path: Column) -> Column:
    """By extension: compiled files are skipped before they are read."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).isin(*BINARY)


def read_python_files(spark: SparkSession, path: str) -> DataFrame:
    """file_path and source of every ``*.py`` under a folder (or of one file); bytes that are no UTF-8 give a null source and an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.decode("content", "UTF-8")
    return files.select(F.col("path").alias("file_path"), text.alias("source")).withColumn("error", F.when(F.col("source").isNull(), "not UTF-8"))


#: Columns that hold ids of nodes, and with them the file's path; attrs has them in JSON.
PATHS = {"nodes": ("id", "parent_id", "attrs"), "ir_edges": ("src", "dst", "guard_id"), "symbols": ("defs", "uses")}
#: Files of one batch of facts: so many, or so many characters of source.
MOST_FILES, MOST_CHARS = 2048, 1 << 18


def _slices(paths: list, sources: list) -> Iterator[tuple[list, list]]:
    first, chars = 0, 0
    for i, s in enumerate(sources):
        n = len(s or "")
        if i > first and (chars + n > MOST_CHARS or i - first >= MOST_FILES):
            yield paths[first:i], sources[first:i]
            first, chars = i, 0
        chars += n
    if first < len(sources):
        yield paths[first:], sources[first:]


def _parsed(paths: list, sources: list, every_scope: bool, tables: tuple[str, ...], schema: pa.Schema) -> pa.RecordBatch:
    """Facts of some files. Equal sources are parsed once, under a mark for the path that is filled in by file."""
    mark, end = uuid.uuid4().hex, uuid.uuid4().hex
    which: dict = {}
    at = [which.setdefault(s, len(which)) for s in sources]
    rows = [pyfacts.facts(mark, s, every_scope, tables=tables) for s in which]
    for r in rows:
        for p in r.get("phis", ()):
            p["operands"] = list(p["operands"].items())
    once, paths = pa.RecordBatch.from_pylist(rows, schema=schema), [p or "" for p in paths]
    quoted = [json.dumps(p)[1:-1] for p in paths]

    def filled(values: list[pa.Array], shape: pa.Array, column: str) -> pa.Array:
        """The strings of each distinct source, by file, with the file's path: one replacement a file. shape: has the nulls."""
        texts = [end.join(x or "" for x in v.to_pylist()) if len(v) else None for v in values]
        names = quoted if column == "attrs" else paths
        whole = pa.array([texts[k].replace(mark, p) for k, p in zip(at, names) if texts[k] is not None], pa.string())
        return pc.if_else(pc.is_null(shape), pa.scalar(None, pa.string()), pc.split_pattern(whole, end).flatten())

    index, columns = pa.array(at, pa.int32()), [pa.array(paths, pa.string())]
    for f in list(schema)[1:]:
        one = once.column(f.name)
        c = one.take(index)
        if f.name in PATHS:
            inner, each = c.flatten(), [one.slice(k, 1).flatten() for k in range(len(one))]
            fields = []
            for g in inner.type:
                v = inner.field(g.name)
                if g.name in PATHS[f.name]:
                    own = [x.field(g.name) for x in each]
                    v = pa.ListArray.from_arrays(v.offsets, filled([x.flatten() for x in own], v.flatten(), g.name), type=g.type) if pa.types.is_list(g.type) else filled(own, v, g.name)
                fields.append(v)
            c = pa.ListArray.from_arrays(c.offsets, pa.StructArray.from_arrays(fields, fields=list(inner.type)), type=f.type)
        columns.append(c)
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def parse(files: DataFrame, every_scope: bool = False, tables: tuple[str, ...] = tuple(TABLES)) -> DataFrame:
    """A row per file: file_path, error and one array of facts per table; name the tables that are needed, and only they are made.

    Nothing is shuffled. Copies of a text in a batch are parsed once. Each use of the result parses again: persist it, or store it, where several tables are read."""
    from pyspark.sql.types import _parse_datatype_string

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for paths, sources in _slices(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield _parsed(paths, sources, every_scope, tables, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _parse_datatype_string("file_path string, error string, " + ", ".join(f"{k} {_array(TABLES[k])}" for k in tables))
    arrow = to_arrow_schema(schema)
    return files.select("file_path", "source").mapInArrow(kernel, schema)


def table(parsed: DataFrame, name: str) -> DataFrame:
    """One table of facts, a row per fact; the columns of the other tables are pruned after the parse."""
    return parsed.select("file_path", F.inline(name))


def no_facts(spark: SparkSession) -> dict[str, DataFrame]:
    """Empty tables of facts: what a parser of another language starts from, and fills by the same schemas."""
    return {name: spark.createDataFrame([], "file_path string, " + re.sub(r"(^|, )(\w+) (?=[a-z])", r"\1`\2` ", row)) for name, row in TABLES.items()}
