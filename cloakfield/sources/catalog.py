"""Named append-only tables, patterns over them, and field access by dotted path."""

from __future__ import annotations

import re
from collections.abc import Callable
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATTERN_LENGTH = 255
TENANT_LENGTH = 64


class RequestError(ValueError):
    """A request that is refused before anything runs."""


def check_pattern(pattern: str) -> list[str]:
    """The parts of a comma list of table patterns, or an error."""
    parts = [p.strip() for p in (pattern or "").split(",")]
    if len(pattern or "") > PATTERN_LENGTH or not all(parts):
        raise RequestError("a table pattern has 1 to 255 characters and no empty part")
    for p in parts:
        if not re.fullmatch(r"[a-z0-9.*_-]+", p) or p.startswith("_") or ".." in p:
            raise RequestError(f"not a table pattern: {p!r}")
    return parts


def check_prefix(prefix: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_@.-]{0,255}", prefix) or ".." in prefix:
        raise RequestError(f"not a field prefix: {prefix!r}")
    return prefix


def check_tenant(name: str) -> str:
    if not re.fullmatch(rf"[a-z0-9][a-z0-9._-]{{0,{TENANT_LENGTH - 1}}}", name or "") or ".." in name:
        raise RequestError(f"not a tenant: {name!r}")
    return name


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores by a hash of its keys, for work that costs a row far more than its move.

    A row group is read by one task, and a file of a million narrow rows may be one.  The order of rows is lost.
    """
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


class Catalog:
    """Tables by name; a table is a DataFrame or a function that makes one."""

    def __init__(self, tables: dict[str, DataFrame | Callable[[], DataFrame]], tolerant: tuple[str, ...] = ()):
        self.tables, self.tolerant = dict(tables), tolerant

    @classmethod
    def of_parquet(cls, spark: SparkSession, folder: str, names: list[str], tolerant: bool = False) -> Catalog:
        """Parquet tables of a folder.  A ``tolerant`` one answers from the files that can be read, and :meth:`lost_files` names the others."""
        given = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"} if tolerant else {}
        return cls({n: (lambda n=n: spark.read.options(**given).parquet(f"{folder}/{n}.parquet")) for n in names}, tuple(names) if tolerant else ())

    def lost_files(self, name: str) -> tuple[list[str], int]:
        """Files of a tolerant table that cannot be read, and how many it has.

        Files that gave rows are told by the scan's own metadata, without reading a column; each other one, which is
        empty or lost, is opened by itself.
        """
        df = self.table(name)
        plain = lambda path: re.sub("^file:/+", "file:/", path)
        listed = sorted(plain(f) for f in df.inputFiles())
        read = {plain(r[0]) for r in df.select("_metadata.file_path").distinct().collect()}  # a row a file
        lost = []
        for path in listed:
            if path not in read:
                try:
                    df.sparkSession.read.parquet(path).limit(1).count()
                except Exception:
                    lost.append(path)
        return lost, len(listed)

    def resolve(self, pattern: str) -> list[str]:
        parts = check_pattern(pattern)
        return [n for n in sorted(self.tables) if any(fnmatchcase(n, p) for p in parts)]

    def table(self, name: str) -> DataFrame:
        t = self.tables[name]
        return t() if callable(t) else t

    def read(self, pattern: str) -> DataFrame:
        """All tables that match, as one: a column that a table lacks is null there."""
        names = self.resolve(pattern)
        if not names:
            raise RequestError(f"no table matches {pattern!r}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.table(n) for n in names])

    def field_types(self, pattern: str, prefix: str = "") -> dict[str, list[str]]:
        """Field to types, sorted; more than one type is a conflict between tables."""
        found: dict[str, set[str]] = {}
        for n in self.resolve(pattern):
            for field, kind in flatten(self.table(n).schema):
                if field.startswith(check_prefix(prefix)) and not field.startswith("_"):
                    found.setdefault(field, set()).add(kind)
        return {f: sorted(found[f]) for f in sorted(found)}


    def mapping_facts(self, pattern: str) -> list[tuple[str, int, int, int]]:
        """(field, declared_in, unindexed_in, doc_values_disabled_in) over the tables that match, from column metadata ``index`` and ``doc_values``."""
        facts: dict[str, list[int]] = {}
        for n in self.resolve(pattern):
            for path, meta in _leaves(self.table(n).schema):
                row = facts.setdefault(path, [0, 0, 0])
                row[0] += 1
                row[1] += meta.get("index") is False
                row[2] += meta.get("doc_values") is False
        return [(f, *facts[f]) for f in sorted(facts)]


def _leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, dict]]:
    out = []
    for f in schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        out += _leaves(kind, f"{prefix}{f.name}.") if isinstance(kind, T.StructType) else [(prefix + f.name, f.metadata or {})]
    return out


def flatten(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """Dotted leaf paths and type names; arrays count as their elements."""
    out = []
    for f in schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(kind, T.StructType):
            out += flatten(kind, f"{prefix}{f.name}.")
        else:
            out.append((prefix + f.name, kind.simpleString()))
    return out


def _find(schema: T.StructType, path: str) -> tuple[str, T.DataType] | None:
    """Quoted name and type of a path: the literal key first, then each split of it."""
    names = {f.name: f for f in schema.fields}
    if path in names:
        return f"`{path}`", names[path].dataType
    at = path.find(".")
    while at >= 0:
        head, rest = path[:at], path[at + 1 :]
        f = names.get(head)
        inner = f.dataType if f else None
        if isinstance(inner, T.ArrayType):
            inner = inner.elementType
        if isinstance(inner, T.StructType) and (found := _find(inner, rest)):
            kind = T.ArrayType(found[1]) if isinstance(f.dataType, T.ArrayType) else found[1]
            return f"`{head}`.{found[0]}", kind
        at = path.find(".", at + 1)
    return None


def field(df: DataFrame, path: str) -> Column:
    """The column of a dotted path; a typed null for a path that no document has."""
    found = _find(df.schema, path)
    return F.col(found[0]) if found else F.lit(None).cast("string")


def field_type(df: DataFrame, path: str) -> T.DataType | None:
    found = _find(df.schema, path)
    return found[1] if found else None


def present(df: DataFrame, path: str) -> Column:
    """Whether a document has the field: not null, and not an empty list or map; an empty string counts."""
    kind, c = field_type(df, path), field(df, path)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def present_sql(df: DataFrame, path: str) -> str:
    """:func:`present` as Spark SQL, for thousands of fields at once."""
    found = _find(df.schema, path)
    if not found:
        return "false"
    name, kind = found
    return f"{name} IS NOT NULL AND size({name}) > 0" if isinstance(kind, (T.ArrayType, T.MapType)) else f"{name} IS NOT NULL"
