"""Text of Python files: comments, docstrings, masking, templates, YAML. Arrow kernels, one file at a time."""

from __future__ import annotations

import ast
import builtins
import io
import re
import tokenize
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import StringType

from factloom.operators.pyfacts import drop_docstrings

KEPT = frozenset(dir(builtins)) | set("_ None False True args cls kwargs self".split())
ANNOTATIONS = {w: w.upper() for w in "bool dict float int list set str tuple".split()}


def per_text(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A string function of one argument over Arrow batches; null stays null."""

    @arrow_udf(StringType())
    def apply(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in column.to_pylist()], pa.string())

    return apply


def without_comments(source: str) -> str:
    """Comments become spaces, so that every offset stays; a source that can't be read stays as it is."""
    lines = source.splitlines(keepends=True)
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT:
                (row, a), (_, b) = t.start, t.end
                lines[row - 1] = lines[row - 1][:a] + " " * (b - a) + lines[row - 1][b:]
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return source
    return "".join(lines)


def without_docstrings(source: str) -> str | None:
    """The source without docstrings, as Python writes it; null if it can't be parsed or nests too deep."""
    try:
        tree = ast.parse(source)
        drop_docstrings(tree)
        return ast.unparse(tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


class Masker(ast.NodeTransformer):
    """Renames identifiers by kind and order of first visit; sensitive ones say so. Builtins and customary names stay."""

    def __init__(self, sensitive: Iterable[str] = ()):
        self.sensitive, self.names, self.kinds, self.counts = set(sensitive), {}, {}, {}

    def name(self, original: str, kind: str) -> str:
        if original in KEPT:
            return original
        if original not in self.names:
            kind = self.kinds.get(original, kind)
            if original in self.sensitive and not kind.startswith("USER_"):
                kind = "USER_" + kind
            self.counts[kind] = self.counts.get(kind, 0) + 1
            self.names[original] = f"{kind}_{self.counts[kind]}"
        return self.names[original]

    @staticmethod
    def of_annotation(a: ast.AST | None) -> str:
        a = a.value if isinstance(a, ast.Subscript) else a
        word = a.id if isinstance(a, ast.Name) else a.value if isinstance(a, ast.Constant) and isinstance(a.value, str) else None
        return "VAR" if a is None else ANNOTATIONS.get(word.lower() if word in ("List", "Dict", "Set", "Tuple") else word or "", "OBJ")

    @staticmethod
    def of_value(v: ast.AST) -> str:
        if isinstance(v, ast.Constant):
            return "STR" if isinstance(v.value, str) else "INT" if isinstance(v.value, int) else "FLOAT" if isinstance(v.value, float) else "VAR"
        return {ast.List: "LIST", ast.Dict: "DICT", ast.Set: "SET", ast.Tuple: "TUPLE"}.get(type(v), "VAR")

    def visit_Name(self, n):
        n.id = self.name(n.id, "VAR")
        return n

    def visit_FunctionDef(self, n):
        if not (n.name.startswith("__") and n.name.endswith("__")):
            n.name = self.name(n.name, "FUNC")
        return self.generic_visit(n)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, n):
        n.name = self.name(n.name, "CLASS")
        return self.generic_visit(n)

    def visit_arg(self, n):
        if n.arg not in ("self", "cls"):
            self.kinds[n.arg] = self.of_annotation(n.annotation) if n.annotation else "ARG"
            n.arg = self.name(n.arg, "ARG")
        return n

    def visit_AnnAssign(self, n):
        if isinstance(n.target, ast.Name):
            self.kinds[n.target.id] = self.of_annotation(n.annotation)
            n.target.id = self.name(n.target.id, "VAR")
        if n.value is not None:
            n.value = self.visit(n.value)
        return n

    def visit_Assign(self, n):
        for t in n.targets:
            if isinstance(t, ast.Name) and self.kinds.get(t.id, "VAR") == "VAR":
                self.kinds[t.id] = self.of_value(n.value)
        return self.generic_visit(n)


def mask(source: str, sensitive: Iterable[str] = ()) -> tuple[str, dict[str, str]] | None:
    """The masked source and masked -> original names; null if it can't be parsed or nests too deep."""
    m = Masker(sensitive)
    try:
        return ast.unparse(ast.fix_missing_locations(m.visit(ast.parse(source)))), {v: k for k, v in m.names.items()}
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def masked(files: DataFrame, sensitive: str | None = None) -> DataFrame:
    """file_path, masked and mapping of every file; ``sensitive`` names a column of arrays."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for b in batches:
            found = [None if s is None else mask(s, w or ()) for s, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f and f[0] for f in found], pa.string()), pa.array([f and list(f[1].items()) for f in found], kind)], ["file_path", "masked", "mapping"])

    words = F.col(sensitive) if sensitive else F.array().cast("array<string>")
    return files.select("file_path", "source", words.alias("sensitive")).mapInArrow(kernel, "file_path string, masked string, mapping map<string,string>")


strip_comments, strip_docstrings = per_text(without_comments), per_text(without_docstrings)


#: Where libyaml and the loader in Python differ (tabs, odd breaks and controls, directives), or nesting could be deep: those texts are left to the latter.
_ODD_YAML = re.compile(r"[^\n -~\xa0-\u2027\u202a-\ud7ff\ue000-\ufefe\uff00-\ufffd\U00010000-\U0010ffff]|^%|(?:[-?] ){50}", re.M)


def _yaml_loader(text: str):
    """libyaml's loader, over twenty times as fast on prose, for texts of which both loaders make the same."""
    import yaml

    flows = text.count("[") + text.count("{")
    fast = yaml.__with_libyaml__ and flows <= 200 and not (flows and "?" in text) and not _ODD_YAML.search(text)
    return yaml.CSafeLoader if fast else yaml.SafeLoader


def _yaml_kind(text: str) -> str | None:
    import yaml

    try:
        found = yaml.load(text, Loader=_yaml_loader(text))
    except (yaml.YAMLError, ValueError, RecursionError):  # a date that is none, or brackets too deep
        return "broken"
    return "dict" if isinstance(found, dict) else "list" if isinstance(found, list) else "scalar"


yaml_kind = per_text(_yaml_kind)


def embedded_yaml(text: Column) -> Column:
    """Score of YAML: mappings and lists by their marks, broken texts by their look."""
    kind, t = yaml_kind(text), F.trim(text)
    tree = F.when(t.startswith("{") & F.contains(text, F.lit("invalid")), 0.0).when(F.contains(text, F.lit(":")) & ~t.startswith("{"), 0.9).otherwise(0.75)
    looks = text.rlike(r"(?m)^\s*[-\w]+\s*:(?:\s*).+") | text.rlike(r"(?m)^\s*-\s+\w+")
    return F.when(kind.isin("dict", "list"), tree).when((kind == "broken") & looks, 0.55).otherwise(0.0)


UNSAFE_WORDS = ("config.items", "self.__dict__", *(f"__{w}__" for w in ("class", "mro", "subclasses")))


def template_nodes(files: DataFrame, key: str = "file_path", column: str = "content") -> DataFrame:
    """A row per tag of a template: line, columns, kind, expression, filters, and whether a filter marks it safe."""
    lines = files.select(key, F.posexplode(F.split(column, "\n")).alias("i", "text"))
    tags = lines.select(key, (F.col("i") + 1).alias("line"), "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\{\{.*?\}\}|\{%.*?%\})"), F.lit(1))).alias("ordinal", "raw"))
    inner = F.trim(F.regexp_extract("raw", r"\A\{[{%](.*?)[}%]\}\z", 1))
    parts = F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))
    filters = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    variable = F.col("raw").startswith("{{")
    return tags.select(key, "line", "ordinal", "raw", F.when(variable, "variable").otherwise("tag").alias("kind"), F.when(variable, F.get(parts, F.lit(0))).otherwise(inner).alias("expression"), F.when(variable, filters).otherwise(F.array().cast("array<string>")).alias("filters"), (variable & F.exists(filters, lambda f: f.isin("safe", "mark_safe"))).alias("is_safe"))


def unsafe_templates(nodes: DataFrame) -> DataFrame:
    """Variables that reach for an object's internals."""
    return nodes.filter((F.col("kind") == "variable") & F.exists(F.array(*[F.lit(w) for w in UNSAFE_WORDS]), lambda w: F.contains(F.col("expression"), w)))
