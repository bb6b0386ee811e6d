"""Masking of documents, aggregation keys and reports under a tenant's policy, and the check of what leaves.

Documents are walked by type when the plan is made: structs, arrays of anything, maps, VARIANT and JSON text.  What
runs is one projection.  The path of a leaf is known to the plan except below a map or a VARIANT, whose keys are data;
there the policy is compared with the path row by row.  A type that the walk does not know is refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakfield.functions.freetext import mask_deep, mask_text, mask_values, mask_whole, residual
from cloakfield.functions.tokens import is_token, token
from cloakfield.functions.values import FREE_TEXT_NAME
from cloakfield.operators.aggs import AggResult
from cloakfield.sources.catalog import RequestError
from cloakfield.sources.policy import FieldSpec, Policy

#: Words, marks and blanks of a JSON text; what is no JSON falls into the same pieces.
JSON_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^"{}\[\],:\s]+|\s+|"'
_PLACE = "struct<paths:array<string>,stack:array<string>,key:string,named:boolean>"
TEXT = (T.StringType, T.CharType, T.VarcharType)
#: Leaves that hold no text; as configured fields they become tokens of their text.
PLAIN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.NullType)


class ResidualError(RuntimeError):
    """Addresses are left in an output that is meant to be masked."""


@dataclass(frozen=True)
class Path:
    """Where a leaf is: a dotted path that the plan knows, or one that each row has."""

    at: str | Column

    def below(self, name: str | Column) -> Path:
        if isinstance(self.at, str) and isinstance(name, str):
            return Path(f"{self.at}.{name}" if self.at else name)
        here = F.lit(self.at) if isinstance(self.at, str) else self.at
        return Path(F.concat(here, F.lit("."), F.lit(name) if isinstance(name, str) else name))

    def specs(self, policy: Policy) -> list[tuple[Column | None, FieldSpec]]:
        """The fields of the policy that this may be, in order, with a test where only the row can tell."""
        if isinstance(self.at, str):
            spec = policy.spec(self.at)
            return [(None, spec)] if spec else []
        return [((self.at == s.field) | self.at.endswith("." + s.field), s) for s in policy.fields]

    def free(self, policy: Policy, named: bool = True) -> bool | Column:
        """Whether it is free text, by the policy or, with ``named``, by how it is called."""
        if isinstance(self.at, str):
            listed = self.at in policy.free_text or named and (self.at.split(".")[-1] in policy.free_text or re.search(FREE_TEXT_NAME, self.at))
            return bool(listed)
        listed = self.at.isin(*policy.free_text) if policy.free_text else F.lit(False)
        last = F.substring_index(self.at, ".", -1).isin(*policy.free_text) if policy.free_text else F.lit(False)
        return listed | last | self.at.rlike(FREE_TEXT_NAME) if named else listed


def _cases(tests: list[tuple[Column | None, Column]], otherwise: Column | None) -> Column | None:
    """The value of the first test that holds; a test of None always does."""
    out = otherwise
    for test, value in reversed(tests):
        out = value if test is None else F.when(test, value).otherwise(out)
    return out


# --- JSON text --------------------------------------------------------------------------------------------

def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a variable that holds ``value``, so that it is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def json_places(text: Column, path: Column) -> Column:
    """The pieces of a JSON text in order as structs (t, p), where p is the path of a scalar and null for all else.

    One fold at any depth, whose state is the stack of open objects and lists, each its mark and its path.  Places in a
    list are no part of a path.  A step takes one case.  The fold keeps the paths alone, but copies these at each scalar,
    so a text's cost grows with the square of its number of scalars.
    """
    top = lambda stack: F.coalesce(F.substring(F.try_element_at(stack, F.lit(-1)), 2, 2**31 - 1), path)
    less = lambda xs: F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0)))
    in_object = lambda stack: F.coalesce(F.try_element_at(stack, F.lit(-1)).startswith("{"), F.lit(False))

    def step(s: Column, x: Column) -> Column:
        t, first = x["t"], x["first"]

        def state(paths: Column | None = None, stack: Column | None = None, key: Column | None = None, named: Column | None = None) -> Column:
            parts = {"paths": paths, "stack": stack, "key": key, "named": named}
            return F.struct(*[(s[n] if c is None else c).alias(n) for n, c in parts.items()])

        scalar = state(F.concat(s["paths"], F.array_repeat(F.lit(None).cast("string"), x["i"] - F.size(s["paths"])), F.array(s["key"])))
        name = F.concat(top(s["stack"]), F.lit("."), F.coalesce(json_string(t), t))
        return (
            F.when(first == '"', F.when(s["named"], state(key=name, named=F.lit(False))).otherwise(scalar))
            .when(first == ":", F.when(s["named"], state(named=F.lit(False))).otherwise(s))
            .when(first == ",", state(key=top(s["stack"]), named=in_object(s["stack"])))
            .when(first.isin("{", "["), state(stack=F.concat(s["stack"], F.array(F.concat(first, s["key"]))), named=first == "{"))
            .when(first.isin("}", "]"), _once(less(s["stack"]), lambda stack: state(stack=stack, key=top(stack), named=F.lit(False))))
            .when(t.rlike(r"^\s"), s)
            .otherwise(scalar)
        )

    zero = F.struct(F.array().alias("paths"), F.array().alias("stack"), path.alias("key"), F.lit(False).alias("named")).cast(_PLACE)
    marked = lambda ts: F.transform(ts, lambda t, i: F.struct(t.alias("t"), F.substring(t, 1, 1).alias("first"), i.alias("i")))
    paths = lambda ts: F.aggregate(marked(ts), zero, step, lambda s: s["paths"])
    placed = lambda ts: _once(paths(ts), lambda ps: F.transform(ts, lambda t, i: F.struct(t.alias("t"), F.get(ps, i).alias("p"))))
    return _once(F.regexp_extract_all(text, F.lit(JSON_TOKEN), 0), placed)


def json_string(piece: Column) -> Column:
    """The text of a JSON string with its quotes and escapes; null for other pieces."""
    plain = F.substring(piece, 2, F.length(piece) - 2)
    return F.when(~piece.startswith('"'), F.lit(None)).when(~piece.contains("\\"), plain).otherwise(F.try_variant_get(F.try_parse_json(piece), "$", "string"))


def json_quoted(text: Column) -> Column:
    """A text as a JSON string; what needs no escape is not written by the JSON writer."""
    return _once(text, lambda x: F.when(x.rlike(r"^[\x20!#-\[\]-~]*\z"), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.to_json(x.cast("variant"))))


# --- the walk ---------------------------------------------------------------------------------------------

class _Walk:
    """Masks every leaf of a table's schema under a policy.

    What several leaves of a row need is computed once, as columns of a projection below the one that masks: the pieces
    of JSON columns, the row's own user names and, for the deep pass, its own values.
    """

    def __init__(self, df: DataFrame, policy: Policy, profile: str, json: tuple[str, ...], deep: bool = False):
        self.policy, self.profile, self.json, self.deep = policy, profile, json, deep
        #: texts outside lists and maps, which one expression masks as a list: those that are free text, and the others
        self.texts: dict[bool, list[Column]] = {True: [], False: []}
        own = lambda name: next(n for k in range(len(df.columns) + 1) if (n := f"__{name}{k}") not in df.columns)
        self.given = frozenset(df.columns)
        found = self._outside(df.schema, None, Path(""))
        self.places = {at: own(f"json{i}_") for i, at in enumerate(found)}
        pieces = {self.places[at]: self._pieces(c, kind, Path(at), False) for at, (c, kind) in found.items()}
        self.df = df.withColumns(pieces) if pieces else df
        bound = {"names": self._named(df.schema, None, Path("")), "known": self._known(df.schema) if deep else None}
        columns = {key: own(key) for key, x in bound.items() if x is not None}
        self.df = self.df.withColumns({columns[key]: bound[key] for key in columns}) if columns else self.df
        self.lists = {free: own(f"texts{int(free)}_") for free in self.texts}
        self.names, self.own = (F.col(columns[key]) if key in columns else None for key in ("names", "known"))

    def _outside(self, kind: T.DataType, c: Column | None, path: Path) -> dict[str, tuple[Column, T.DataType]]:
        """The VARIANT and JSON values outside lists and maps by path, whose pieces are columns."""
        if isinstance(kind, T.StructType):
            below = [self._outside(f.dataType, F.col(f"`{f.name}`") if c is None else c.getField(f.name), path.below(f.name)) for f in kind.fields]
            return {at: x for found in below for at, x in found.items()}
        return {path.at: (c, kind)} if isinstance(kind, T.VariantType) or self._is_json(kind, path) else {}

    def _pieces(self, c: Column, kind: T.DataType, path: Path, stored: bool = True) -> Column:
        if stored and isinstance(path.at, str) and path.at in self.places:
            return F.col(self.places[path.at])
        return json_places(c if isinstance(kind, TEXT) else F.to_json(c), F.lit(path.at) if isinstance(path.at, str) else path.at)

    # the document's own user names, used on its own free text alone

    def _named(self, kind: T.DataType, c: Column | None, path: Path) -> Column | None:
        """An array of the user names below a value, or None where there can be none."""
        none = F.array().cast("array<string>")
        if isinstance(kind, T.StructType):
            found = [x for f in kind.fields if (x := self._named(f.dataType, F.col(f"`{f.name}`") if c is None else c.getField(f.name), path.below(f.name))) is not None]
            found = F.concat(*[F.coalesce(x, none) for x in found]) if found else None
            return F.array_compact(F.array_distinct(found)) if c is None and found is not None else found
        if isinstance(kind, T.ArrayType):
            if self._named(kind.elementType, F.lit(None), path) is None:
                return None
            return F.flatten(F.transform(c, lambda x: F.coalesce(self._named(kind.elementType, x, path), none)))
        if isinstance(kind, T.MapType):
            if self._named(kind.valueType, F.lit(None), path.below(F.lit(""))) is None:
                return None
            return F.flatten(F.transform(F.map_entries(c), lambda e: F.coalesce(self._named(kind.valueType, e["value"], path.below(e["key"].cast("string"))), none)))
        if not any(s.family == "USER" for s in self.policy.fields):
            return None
        if isinstance(kind, T.VariantType) or self._is_json(kind, path):
            users = F.filter(self._pieces(c, kind, path), lambda x: x["p"].isNotNull() & x["t"].startswith('"') & self._user(Path(x["p"])))
            return F.transform(users, lambda x: json_string(x["t"]))
        if not isinstance(kind, TEXT):
            return None
        tests = path.specs(self.policy)
        if not any(s.family == "USER" for _, s in tests):
            return None
        return F.array(c) if tests[0][0] is None else F.when(self._user(path), F.array(c)).otherwise(none)

    def _user(self, path: Path) -> Column:
        """Whether the first field of the policy that a path is belongs to a user."""
        return _cases([(test, F.lit(s.family == "USER")) for test, s in path.specs(self.policy)], F.lit(False))

    def _known(self, schema: T.StructType) -> Column:
        """The document's configured values with their tokens, for the deep pass over its other values."""
        empty = F.array().cast("array<struct<key:string,value:string>>")

        def pairs(kind: T.DataType, c: Column | None, path: str) -> list[Column]:
            if isinstance(kind, T.StructType):
                return [x for f in kind.fields for x in pairs(f.dataType, F.col(f"`{f.name}`") if c is None else c.getField(f.name), f"{path}.{f.name}".lstrip("."))]
            spec = self.policy.spec(path)
            if spec and isinstance(kind, TEXT):
                return [F.array(F.struct(c.alias("key"), self._token(spec, c).alias("value")))]
            if spec and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, TEXT):
                return [F.coalesce(F.transform(c, lambda x: F.struct(x.alias("key"), self._token(spec, x).alias("value"))), empty)]
            return []

        found = F.filter(F.concat(empty, *pairs(schema, None, "")), lambda e: F.length(e["key"]) > 0)
        # the first configured field decides
        return F.aggregate(found, F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, F.create_map(e["key"], e["value"]))))

    # leaves

    def _is_json(self, kind: T.DataType, path: Path) -> bool:
        return isinstance(kind, TEXT) and isinstance(path.at, str) and path.at in self.json

    def _token(self, spec: FieldSpec, c: Column) -> Column:
        return token(spec.family, c, self.policy.salt, self.policy.use_hash)

    def _chain(self, c: Column) -> Column:
        return mask_text(c, self.policy.salt, self.names, self.policy.mask_free_text_users, self.profile, self.policy.use_hash)

    def _plain(self, c: Column, free: bool | Column) -> Column:
        """What becomes of a text that is no configured field."""
        if self.profile == "stream":
            return (self._chain(c) if free else c) if isinstance(free, bool) else F.when(free, self._chain(c)).otherwise(c)
        values = mask_deep if self.deep else mask_values
        embedded = lambda: values(c, self.policy.salt, self.policy.use_hash)
        chained = lambda: mask_deep(self._chain(c), self.policy.salt, self.policy.use_hash) if self.deep else self._chain(c)
        inner = (chained() if free else embedded()) if isinstance(free, bool) else F.when(free, chained()).otherwise(embedded())
        return F.coalesce(*([F.try_element_at(self.own, c)] if self.deep else []), mask_whole(c, self.policy.salt, self.policy.use_hash), inner)

    def _text(self, c: Column, path: Path) -> Column:
        return self._plain(c, path.free(self.policy, self.profile != "stream"))

    def _piece(self, x: Column) -> Column:
        """A piece of a JSON text: scalars by their path, names for addresses in them alone, the rest as it is."""
        t, path = x["t"], Path(x["p"])

        def configured(value: Column, otherwise: Column) -> Column:
            return _cases([(test & value.isNotNull(), json_quoted(self._token(s, value))) for test, s in path.specs(self.policy)], otherwise)

        def string(text: Column) -> Column:
            written = lambda made: _once(made, lambda y: F.when(y == text, t).otherwise(json_quoted(y)))  # noqa: E731  # as it was, escapes and all, where nothing is masked
            either = lambda masked: F.when(text.isNotNull(), written(masked)).otherwise(t)
            value = F.coalesce(text, t) if self.profile == "response" else text
            return F.when(x["p"].isNull(), either(mask_values(text, self.policy.salt, self.policy.use_hash))).otherwise(configured(value, either(self._text(text, path))))

        bare = F.when(t.isin("true", "false"), F.initcap(t)).when(t != "null", t)
        other = F.when(x["p"].isNull(), t).otherwise(configured(bare, t)) if self.profile == "response" else t
        return F.when(t.startswith('"'), _once(json_string(t), string)).otherwise(other)

    def _json(self, c: Column, kind: T.DataType, path: Path) -> Column:
        """JSON text masked piece by piece; the text form of a VARIANT."""
        return F.array_join(F.transform(self._pieces(c, kind, path), self._piece), "")

    def masked(self) -> DataFrame:
        """The table with the policy applied."""
        columns = [self.mask(F.col(f"`{f.name}`"), f.dataType, Path(f.name), True).alias(f.name) for f in self.df.schema.fields if f.name in self.given]
        one = lambda free: lambda x: self._plain(x, free)
        lists = {self.lists[free]: F.transform(F.array(*texts), one(free)) for free, texts in self.texts.items() if texts}
        return (self.df.withColumns(lists) if lists else self.df).select(*columns)

    def mask(self, c: Column, kind: T.DataType, path: Path, outside: bool = False) -> Column:
        """A value of any type, masked; ``outside`` where it is a column or field and no element of a list or map."""
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[self.mask(c.getField(f.name), f.dataType, path.below(f.name), outside).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: self.mask(x, kind.elementType, path))  # places in a list are no part of the path
        if isinstance(kind, T.MapType):
            return self._map(c, kind, path)
        if isinstance(kind, T.VariantType):
            return F.parse_json(self._json(c, kind, path))
        if self._is_json(kind, path):
            # what is no JSON is masked by path as far as it looks like it, and then as a text
            valid = F.try_parse_json(c).isNotNull()
            return F.element_at(F.transform(F.array(self._json(c, kind, path)), lambda x: F.when(c.isNull() | valid, x).otherwise(self._text(x, path))), 1)
        if isinstance(kind, TEXT):
            tests = [(test, self._token(s, c)) for test, s in path.specs(self.policy)]
            if tests and tests[0][0] is None:
                return tests[0][1]
            if outside:
                free = path.free(self.policy, self.profile != "stream")
                if self.profile == "stream" and not free:
                    return c
                self.texts[free].append(c)
                return F.get(F.col(self.lists[free]), len(self.texts[free]) - 1)
            return _cases(tests, self._text(c, path))
        if isinstance(kind, PLAIN):
            if self.profile != "response" or isinstance(kind, T.NullType):
                return c
            tests = path.specs(self.policy)
            if tests and tests[0][0] is not None:
                if isinstance(kind, (T.NumericType, T.BooleanType)):
                    # the type of a map's values is one: where any of them may be masked, all are texts
                    return _cases([(test, self._token(s, self._shown(c, kind))) for test, s in tests], self._shown(c, kind))
                return c
            return self._token(tests[0][1], self._shown(c, kind)) if tests else c
        if isinstance(kind, T.BinaryType):
            if any(test is None for test, _ in path.specs(self.policy)):
                raise RequestError(f"{path.at} is configured and holds bytes, which have no token")
            return c
        raise RequestError(f"{path.at if isinstance(path.at, str) else 'a map value'} has type {kind.simpleString()}, which cannot be masked")

    @staticmethod
    def _shown(c: Column, kind: T.DataType) -> Column:
        return F.initcap(c.cast("string")) if isinstance(kind, T.BooleanType) else c.cast("string")

    def _map(self, c: Column, kind: T.MapType, path: Path) -> Column:
        """A map by its keys' paths.  Keys are names and stay, but for addresses in them; equal ones after that get a number."""
        entries = F.map_entries(c)
        values = F.transform(entries, lambda e: _once(path.below(e["key"].cast("string")).at, lambda at: self.mask(e["value"], kind.valueType, Path(at))))
        if isinstance(kind.keyType, TEXT):
            made = F.transform(F.map_keys(c), lambda k: mask_values(k, self.policy.salt, self.policy.use_hash))
            number = lambda ks: F.transform(ks, lambda k, i: F.when(F.array_position(ks, k) == i + 1, k).otherwise(F.concat(k, F.lit("#"), (i + 1).cast("string"))))
            # keys that stay are different already
            keys = _once(made, lambda ks: F.when(ks == F.map_keys(c), ks).otherwise(number(ks)))
        elif isinstance(kind.keyType, PLAIN):
            keys = F.map_keys(c)
        else:
            raise RequestError(f"a map with keys of type {kind.keyType.simpleString()} cannot be masked")
        return F.map_from_arrays(keys, values)


def mask_documents(df: DataFrame, policy: Policy, profile: str = "response", json: tuple[str, ...] = (), deep: bool = False) -> DataFrame:
    """All columns of ``df`` with the policy applied at every leaf, at any depth of structs, arrays, maps, VARIANT and JSON text.

    Configured fields become tokens; the ``response`` profile also turns numbers, booleans and times there into
    tokens of their text, while ``stream`` leaves them.  Other string leaves are masked when they are an address or
    host name as a whole, and otherwise go through the free-text pass, with the document's own user names where the
    field is free text.  ``json`` names string columns (dotted paths) that hold JSON; text there that is none is masked
    as text.  With ``deep``, leaves that the policy does not name also go by the document's own values and by host
    names and UUIDs.  JSON keeps its spacing and order.
    """
    return _Walk(df, policy, profile, json, deep).masked()


def mask_keys(result: AggResult, policy: Policy, json: tuple[str, ...] = ()) -> AggResult:
    """Masks the key columns of finished buckets whose source field is configured; labels, dates, ranges and counts stay.

    The frames about what is outside the buckets have their parents' keys, which are masked alike.
    """
    specs = {key: spec for key, source in result.fields.items() if (spec := policy.spec(source))}

    def keyed(df: DataFrame | None) -> DataFrame | None:
        return None if df is None else df.withColumns({k: token(s.family, F.col(f"`{k}`"), policy.salt, policy.use_hash) for k, s in specs.items() if k in df.columns})

    whole = f"{result.node.name}_as_string"
    if result.node.kind == "top_hits":
        own = [FieldSpec(k, specs[k].family) for k in result.keys if k in specs]
        df = mask_documents(result.df, replace(policy, fields=(*own, *policy.fields)), json=json)
    else:
        df = keyed(result.df)
        parts = [k for k in df.columns if k.startswith(f"{result.node.name}_") and k in result.fields]
        if whole in df.columns and any(k in specs for k in parts):
            df = df.withColumn(whole, F.concat_ws("|", *[F.col(k).cast("string") for k in parts]))
    return replace(result, df=df, other=keyed(result.other), scope=keyed(result.scope))


def registry(df: DataFrame, policy: Policy) -> DataFrame:
    """Distinct (value, token) of all configured string leaves; the first configured field decides the family."""
    from cloakfield.sources.catalog import field, field_type

    frames = []
    for order, spec in enumerate(policy.fields):
        kind, c = field_type(df, spec.field), field(df, spec.field)
        if kind is None:
            continue
        value = F.explode(c) if isinstance(kind, T.ArrayType) else c
        rows = df.select(value.cast("string").alias("value")).where(F.length("value") > 0)
        frames.append(rows.select("value", F.lit(order).alias("rank"), token(spec.family, F.col("value"), policy.salt, policy.use_hash).alias("token")))
    if not frames:
        return df.sparkSession.createDataFrame([], "value string, token string")
    return reduce(DataFrame.unionByName, frames).groupBy("value").agg(F.min_by("token", "rank").alias("token"))


def mask_opaque_values(df: DataFrame, known: DataFrame, policy: Policy) -> DataFrame:
    """The deep pass over output whose fields are not known: every string column, whole values of the registry first.

    ``known`` is a :func:`registry`.  It joins by value, one row a value, so Spark broadcasts it while it is
    small and otherwise splits what is hot on the other side.
    """
    for i, f in enumerate(f for f in df.schema.fields if isinstance(f.dataType, T.StringType)):
        c, tokens = F.col(f"`{f.name}`"), known.select(F.col("value").alias(f"__v{i}"), F.col("token").alias(f"__t{i}"))
        made = F.coalesce(F.col(f"__t{i}"), F.when(is_token(c), c), mask_deep(c, policy.salt, policy.use_hash))
        df = df.join(tokens, c == F.col(f"__v{i}"), "left").withColumn(f.name, made).drop(f"__v{i}", f"__t{i}")
    return df


# --- the check of what leaves -----------------------------------------------------------------------------

def _left(c: Column, kind: T.DataType) -> Column | None:
    """Whether an address is left anywhere in a value, keys of maps included; None for types that hold no text."""
    if isinstance(kind, T.StructType):
        found = [x for f in kind.fields if (x := _left(c.getField(f.name), f.dataType)) is not None]
        return reduce(lambda a, b: a | b, found) if found else None
    if isinstance(kind, T.ArrayType):
        return None if _left(F.lit(None), kind.elementType) is None else F.coalesce(F.exists(c, lambda x: _left(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        found = [x for x in (_left(F.map_keys(c), T.ArrayType(kind.keyType)), _left(F.map_values(c), T.ArrayType(kind.valueType))) if x is not None]
        return reduce(lambda a, b: a | b, found) if found else None
    if isinstance(kind, T.VariantType):
        return F.exists(F.array(F.to_json(c)), residual)  # written once for all its tests
    if isinstance(kind, TEXT):
        return residual(c)
    if isinstance(kind, T.BinaryType):
        return residual(c.cast("string"))
    if isinstance(kind, PLAIN):
        return None
    raise RequestError(f"type {kind.simpleString()} cannot be checked")


def _checks(df: DataFrame) -> dict[str, Column]:
    """For each column that can hold text, whether a row has an address left in it."""
    found = {f.name: _left(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    return {name: test for name, test in found.items() if test is not None}


def residuals(df: DataFrame) -> DataFrame:
    """Rows (column, rows_left): how many rows still hold an address, at any depth of each column."""
    checks = _checks(df)
    if not checks:
        return df.sparkSession.createDataFrame([], "column string, rows_left bigint")
    counts = df.agg(*[F.count_if(test).alias(f"c{i}") for i, test in enumerate(checks.values())])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("rows_left")) for i, n in enumerate(checks)])).alias("x")
    return counts.select(pairs).select("x.*")


def verify(df: DataFrame) -> DataFrame:
    """``df``, or an error that says where addresses are left, without showing them."""
    left = [(r["column"], r["rows_left"]) for r in residuals(df).where("rows_left > 0").collect()]  # a row a column
    if left:
        raise ResidualError(", ".join(f"{c}: {n} rows" for c, n in left))
    return df


def guard(df: DataFrame, what: str) -> DataFrame:
    """``df`` with the check in the pass that reads it: a row with an address left fails that pass, so no other row is handed out than was checked."""
    checks = _checks(df)
    if not checks:
        return df
    where = F.concat_ws(", ", *[F.when(test, F.lit(n)) for n, test in checks.items()])
    told = F.concat(F.lit(f"addresses are left in {what}: "), where)
    return df.where(F.when(reduce(lambda a, b: a | b, checks.values()), F.raise_error(told).cast("boolean")).otherwise(True))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df``, and what its next action sees: rows, and rows with an address left by number of column (c0, c1, ...)."""
    seen = Observation(name)
    tests = [F.count_if(test).alias(f"c{i}") for i, test in enumerate(_checks(df).values())]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *tests), seen


def left_in(df: DataFrame, seen: Observation) -> dict[str, int]:
    """Column to rows with an address left, after the action that :func:`counted` watched."""
    got = seen.get
    return {name: got[f"c{i}"] for i, name in enumerate(_checks(df)) if got.get(f"c{i}")}


def _masked_values(df: DataFrame, policy: Policy) -> DataFrame:
    """Rows (family, field, v), one for each value that the policy masks; none where no field is in ``df``."""
    from cloakfield.sources.catalog import field, field_type

    frames = []
    for spec in policy.fields:
        kind, c = field_type(df, spec.field), field(df, spec.field)
        if kind is None:
            continue
        value = F.explode(c) if isinstance(kind, T.ArrayType) else c
        frames.append(df.select(F.lit(spec.family).alias("family"), F.lit(spec.field).alias("field"), value.cast("string").alias("v")).where(F.length("v") > 0))
    if not frames:
        return df.sparkSession.createDataFrame([], "family string, field string, v string")
    return reduce(DataFrame.unionByName, frames)


def masking_report(df: DataFrame, policy: Policy) -> DataFrame:
    """Rows (family, field, occurrences, distinct_values): what the policy masks in ``df``."""
    rows = _masked_values(df, policy)
    return rows.groupBy("family", "field").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("v").alias("distinct_values"))


def masking_examples(df: DataFrame, policy: Policy, n: int = 3) -> DataFrame:
    """Rows (family, field, token, occurrences): the tokens of each field's ``n`` most frequent values, ties by value.

    Values are counted before they are ranked and masked after, so only the examples cost a hash and no value leaves.
    """
    counts = _masked_values(df, policy).groupBy("family", "field", "v").agg(F.count(F.lit(1)).alias("occurrences"))
    rank = F.row_number().over(Window.partitionBy("family", "field").orderBy(F.desc("occurrences"), "v"))
    top = counts.withColumn("__rank", rank).where(F.col("__rank") <= n)
    made = F.coalesce(*[F.when(F.col("family") == f, token(f, F.col("v"), policy.salt, policy.use_hash)) for f in dict.fromkeys(s.family for s in policy.fields)], F.lit(None).cast("string"))
    return top.select("family", "field", made.alias("token"), "occurrences")
