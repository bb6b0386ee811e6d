"""Aggregations whose output no field describes: pipelines over finished buckets, address ranges, map cells, top metrics.

They run where the gate is off.  A pipeline reads bucket frames, which are small: within a parent it is a window over
the buckets in order of their keys, between siblings an aggregate.  Address and cell buckets are columns of the scan.
"""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakfield.plans.dsl import AggNode
from cloakfield.sources.catalog import RequestError, field

#: What a script may be made of: params, numbers, arithmetic, comparison and logic.
SCRIPT = re.compile(r"\s*(?:params\.(?P<name>\w+)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?P<op>&&|\|\||[<>=!]=|[-+*/%()<>!]))")
OPERATORS = {"&&": "AND", "||": "OR", "!": "NOT", "==": "="}
#: The alphabet of geohashes.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def bucket_column(path: str) -> str:
    """The column of a bucket frame that a buckets_path names."""
    if ">" in path:
        raise RequestError(f"a path inside a bucket has no part behind >: {path}")
    return {"_count": "doc_count"}.get(path, path.replace(".", "_"))


def script(text: str, params: dict[str, str], columns: list[str]) -> Column:
    """A script over bucket values as a column; null where one of them is, as a gap is skipped."""
    out, at = [], 0
    while at < len(text.rstrip()):
        m = SCRIPT.match(text, at)
        if not m:
            raise RequestError(f"a script has params, numbers and operators: {text!r}")
        if m["name"]:
            column = bucket_column(params.get(m["name"], ""))
            if column not in columns:
                raise RequestError(f"no bucket value {m['name']!r} for the script {text!r}")
            out.append(f"CAST(`{column}` AS DOUBLE)")
        else:
            out.append(f"{m['number']}D" if m["number"] else OPERATORS.get(m["op"], m["op"]))
        at = m.end()
    try:
        return F.expr(" ".join(out))
    except Exception:
        raise RequestError(f"not a script: {text!r}") from None


def over_buckets(df: DataFrame, node: AggNode, parents: list[str], keys: list[str]) -> DataFrame:
    """A parent pipeline over finished buckets: a column more, or fewer buckets."""
    p, name = node.params, node.name
    path = p.get("buckets_path")
    inside = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))  # buckets of one parent
    if node.kind in ("bucket_script", "bucket_selector"):
        text = p["script"] if isinstance(p["script"], str) else p["script"].get("source", "")
        value = script(text, path, df.columns)
        return df.withColumn(name, value) if node.kind == "bucket_script" else df.where(F.coalesce(value, F.lit(False)))
    if node.kind == "bucket_sort":
        order = []
        for s in p.get("sort", []):
            c, how = next(iter(s.items())) if isinstance(s, dict) else (s, "asc")
            way = how.get("order", "asc") if isinstance(how, dict) else how
            c = F.col(keys[-1] if c == "_key" and keys else bucket_column(c))
            order.append(c.desc_nulls_last() if way == "desc" else c.asc_nulls_last())
        rank, first = F.row_number().over(inside.orderBy(*order, *keys)), p.get("from", 0)
        return df.withColumn("__rank", rank).where((F.col("__rank") > first) & (F.col("__rank") <= first + p["size"] if "size" in p else F.lit(True))).drop("__rank")
    if isinstance(path, list) and len(path) == 1:
        path = path[0]
    value, ordered = F.col(bucket_column(path)), inside.orderBy(*keys)
    if node.kind == "cumulative_sum":
        return df.withColumn(name, F.sum(value).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    if node.kind == "moving_avg":
        return df.withColumn(name, F.avg(value).over(ordered.rowsBetween(1 - p.get("window", 5), 0)))
    lag = 1 if node.kind == "derivative" else p.get("lag", 1)
    return df.withColumn(name, value - F.lag(value, lag).over(ordered))


def over_siblings(df: DataFrame, node: AggNode, parents: list[str], path: str) -> DataFrame:
    """A sibling pipeline: one row a parent about the buckets of an aggregation beside it."""
    c, name = F.col(bucket_column(path)), node.name
    made = {
        "avg_bucket": [F.avg(c).alias(name)], "sum_bucket": [F.sum(c).alias(name)], "min_bucket": [F.min(c).alias(name)], "max_bucket": [F.max(c).alias(name)],
        "stats_bucket": [f(c).alias(f"{name}_{k}") for k, f in (("count", F.count), ("min", F.min), ("max", F.max), ("avg", F.avg), ("sum", F.sum))],
    }[node.kind]
    return (df.groupBy(*parents) if parents else df.groupBy()).agg(*made)


# --- addresses --------------------------------------------------------------------------------------------

def address_hex(c: Column) -> Column:
    """An IPv4 or IPv6 address as 32 hex digits, which sort as addresses do; null for what is none."""
    text = F.lower(F.trim(c))
    octets = F.transform(F.split(text, r"\."), lambda x: F.lpad(F.lower(F.hex(x.cast("bigint"))), 2, "0"))
    v4 = F.concat(F.lit("0" * 20 + "ffff"), F.array_join(octets, ""))
    is4 = text.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$")
    groups = lambda part: F.filter(F.split(part, ":"), lambda x: x != "")
    head, tail = groups(F.substring_index(text, "::", 1)), F.when(text.contains("::"), groups(F.substring_index(text, "::", -1))).otherwise(F.array().cast("array<string>"))
    filled = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(head) - F.size(tail), F.lit(0))), tail)
    v6 = F.array_join(F.transform(filled, lambda x: F.lpad(x, 4, "0")), "")
    is6 = text.rlike(r"^[0-9a-f:]+$") & text.contains(":") & ~text.rlike(r":::|::.*::|^:[^:]|[^:]:$") & (F.size(filled) == 8) & F.forall(filled, lambda x: x.rlike(r"^[0-9a-f]{1,4}$"))
    return F.when(is4, v4).when(F.coalesce(is6 & (text.contains("::") | (F.size(head) == 8)), F.lit(False)), v6)


def _number(text: str) -> int:
    a = ipaddress.ip_address(text)
    return int(a) if a.version == 6 else (0xFFFF << 32) + int(a)


def address_tests(df: DataFrame, params: dict) -> dict[str, Column]:
    """A test for each range of an ip_range by its key: ``mask`` in CIDR form, or ``from`` up to but without ``to``."""
    at, tests = address_hex(field(df, params["field"])), {}
    for r in params["ranges"]:
        try:
            if "mask" in r:
                net = ipaddress.ip_network(r["mask"], strict=False)
                lo, hi, key = _number(str(net[0])), _number(str(net[-1])) + 1, r.get("key", r["mask"])
            else:
                lo, hi = (_number(r[k]) if r.get(k) else None for k in ("from", "to"))
                key = r.get("key", f"{r.get('from') or '*'}-{r.get('to') or '*'}")
        except ValueError as e:
            raise RequestError(f"not an address range: {e}") from None
        test = at.isNotNull()
        test = test & (at >= f"{lo:032x}") if lo is not None else test
        # the end of all addresses has a digit more and sorts wrongly, so it is no bound
        tests[key] = test & (at < f"{hi:032x}") if hi is not None and hi < 1 << 128 else test
    return tests


# --- map cells --------------------------------------------------------------------------------------------

def _cell(x: Column, cells: int) -> Column:
    return F.least(F.greatest(F.floor(x * cells), F.lit(0)), F.lit(cells - 1)).cast("bigint")


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """The geohash of a place: bits of longitude and latitude in turn, five to a character."""
    if not 1 <= precision <= 12:
        raise RequestError("a geohash has 1 to 12 characters")
    n_lon, n_lat = (5 * precision + 1) // 2, 5 * precision // 2
    x, y = _cell((lon + 180) / 360, 1 << n_lon), _cell((lat + 90) / 180, 1 << n_lat)
    bit = lambda k: F.shiftright(x, n_lon - 1 - k // 2) % 2 if k % 2 == 0 else F.shiftright(y, n_lat - 1 - k // 2) % 2
    chars = [F.substring(F.lit(GEOHASH), (sum((bit(5 * j + i) * (16 >> i) for i in range(5)), F.lit(0)) + 1).cast("int"), F.lit(1)) for j in range(precision)]
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*chars))


def geotile(lat: Column, lon: Column, zoom: int) -> Column:
    """zoom/x/y of a web-map tile."""
    if not 0 <= zoom <= 29:
        raise RequestError("a zoom is 0 to 29")
    bounded = F.radians(F.least(F.greatest(lat, F.lit(-85.05112878)), F.lit(85.05112878)))
    x, y = _cell((lon + 180) / 360, 1 << zoom), _cell((1 - F.asinh(F.tan(bounded)) / F.pi()) / 2, 1 << zoom)
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws("/", F.lit(str(zoom)), x.cast("string"), y.cast("string")))


def cell_key(df: DataFrame, node: AggNode) -> Column:
    lat, lon = (field(df, f"{node.params['field']}.{k}").cast("double") for k in ("lat", "lon"))
    return geohash(lat, lon, node.params.get("precision", 5)) if node.kind == "geohash_grid" else geotile(lat, lon, node.params.get("precision", 7))


# --- top metrics ------------------------------------------------------------------------------------------

def top_metrics(df: DataFrame, node: AggNode, ident: str | None) -> dict[str, tuple[Column, str]]:
    """Values of the document that sorts first, by output name with the field of each; ties go to the lowest numeric id."""
    p = node.params
    metrics = p["metrics"] if isinstance(p["metrics"], list) else [p["metrics"]]
    sort = p["sort"][0] if isinstance(p["sort"], list) else p["sort"]
    by, how = next(iter(sort.items())) if isinstance(sort, dict) else (sort, "asc")
    way = how.get("order", "asc") if isinstance(how, dict) else how
    at = field(df, by)
    numeric = ident and isinstance(df.schema[ident].dataType, T.NumericType)
    tie = [(-F.col(ident) if way == "desc" else F.col(ident)).alias("tie")] if numeric else []
    order = F.when(at.isNotNull(), F.struct(at.alias("at"), *tie))
    pick = F.max_by if way == "desc" else F.min_by
    return {f"{node.name}_{m['field']}": (pick(F.struct(field(df, m["field"]).alias("v")), order)["v"], m["field"]) for m in metrics}
