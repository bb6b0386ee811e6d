"""Query clauses to filter columns."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakfield.sources.catalog import RequestError, field, field_type, present

UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def instant(value, as_of: datetime | None) -> datetime:
    """An ISO time, or date math on ``now``, which is ``as_of`` and never the clock of the machine."""
    if isinstance(value, datetime):
        return value
    text = str(value).strip()
    if m := re.fullmatch(r"now(?:([+-])(\d+)([smhdw]))?", text):
        if as_of is None:
            raise RequestError("now needs an as_of time")
        shift = timedelta(**{UNITS[m[3]]: int(m[2])}) if m[1] else timedelta()
        return as_of - shift if m[1] == "-" else as_of + shift
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise RequestError(f"not a time: {value!r}") from None
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def literal(df: DataFrame, path: str, value, as_of: datetime | None = None) -> Column:
    """A literal of the field's own type, so that the comparison reaches the scan."""
    kind = field_type(df, path)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(instant(value, as_of).isoformat(sep=" ")).cast(kind)
    return F.lit(value)


def _equals(df: DataFrame, path: str, values: list) -> Column:
    kind, c = field_type(df, path), field(df, path)
    if isinstance(kind, T.ArrayType):
        return reduce(lambda a, b: a | b, [F.array_contains(c, v) for v in values])
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return reduce(lambda a, b: a | b, [c == literal(df, path, v) for v in values])
    return c.isin(*values)


def clause(df: DataFrame, query: dict, as_of: datetime | None = None) -> Column:
    """The filter of one query clause: a document matches or it does not, so null is false."""
    if len(query) != 1:
        raise RequestError(f"a query clause has one type: {sorted(query)}")
    kind, body = next(iter(query.items()))
    if kind == "match_all":
        return F.lit(True)
    if kind == "match_none":
        return F.lit(False)
    if kind == "exists":
        return present(df, body["field"])
    if kind == "ids":
        return field(df, body.get("field", "_id")).isin(*body["values"])
    if kind in ("term", "terms", "match", "prefix", "wildcard"):
        path, value = next((k, v) for k, v in body.items() if k != "boost")
        value = value.get("value", value.get("query")) if isinstance(value, dict) else value
        if kind == "terms":
            test = _equals(df, path, list(value))
        elif kind == "prefix":
            test = field(df, path).startswith(value)
        elif kind == "wildcard":
            test = field(df, path).rlike("^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in value) + r"\z")
        elif kind == "match":
            words = str(value).lower().split()
            test = reduce(lambda a, b: a | b, [F.array_contains(F.split(F.lower(field(df, path)), r"\W+"), w) for w in words], F.lit(False))
        else:
            test = _equals(df, path, [value])
        return F.coalesce(test, F.lit(False))
    if kind == "range":
        path, bounds = next(iter(body.items()))
        c = field(df, path)
        tests = {"gte": c.__ge__, "gt": c.__gt__, "lte": c.__le__, "lt": c.__lt__}
        # left as plain comparisons: these are what a parquet scan can use
        return reduce(lambda a, b: a & b, [tests[op](literal(df, path, v, as_of)) for op, v in bounds.items() if op in tests], c.isNotNull())
    if kind == "bool":
        every = [clause(df, q, as_of) for k in ("must", "filter") for q in _listed(body.get(k))]
        some = [clause(df, q, as_of) for q in _listed(body.get("should"))]
        least = body.get("minimum_should_match", 0 if every else 1)
        if some and least:
            every.append(reduce(lambda a, b: a | b, some) if least == 1 else reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(False)).cast("int") for s in some]) >= least)
        every += [~F.coalesce(clause(df, q, as_of), F.lit(False)) for q in _listed(body.get("must_not"))]
        return reduce(lambda a, b: a & b, every, F.lit(True))
    raise RequestError(f"no such query clause: {kind}")


def _listed(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def after_key(df: DataFrame, sort: tuple[tuple[str, bool], ...], values: tuple) -> Column:
    """Rows after the given sort values: keyset paging.  Rows without a sort value stand last, whichever the direction."""
    out, same = F.lit(False), F.lit(True)
    for (path, ascending), value in zip(sort, values):
        c = field(df, path)
        if value is None:
            same = same & c.isNull()
            continue
        v = literal(df, path, value)
        out = out | same & (c.isNull() | F.coalesce(c > v if ascending else c < v, F.lit(False)))
        same = same & F.coalesce(c == v, F.lit(False))
    return out
