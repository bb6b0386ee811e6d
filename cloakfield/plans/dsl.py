"""JSON request bodies to search plans: gates and caps run here, before anything is read."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from cloakfield.sources.catalog import RequestError

# fixed values: the aggregations whose result columns are known, so that keys can be masked
BUCKETS = frozenset(
    "terms significant_terms significant_text multi_terms composite rare_terms top_hits date_histogram histogram range date_range filters filter missing sampler diversified_sampler children".split()
)
METRICS = frozenset("avg sum min max value_count cardinality stats extended_stats percentiles percentile_ranks matrix_stats geo_bounds geo_centroid".split())
# fixed values: aggregations whose output no field describes, which run where the gate is off; parent pipelines, sibling pipelines, others
PARENT = frozenset("bucket_script bucket_selector bucket_sort cumulative_sum derivative serial_diff moving_avg".split())
SIBLING = frozenset("avg_bucket sum_bucket min_bucket max_bucket stats_bucket".split())
OPAQUE = frozenset("ip_range geohash_grid geotile_grid top_metrics".split())
NEEDED = {"bucket_script": ("script", "buckets_path"), "bucket_selector": ("script", "buckets_path"), "bucket_sort": (), "ip_range": ("field", "ranges"), "geohash_grid": ("field",), "geotile_grid": ("field",), "top_metrics": ("metrics", "sort")}
CAPPED = frozenset("terms significant_terms significant_text multi_terms composite top_hits geohash_grid geotile_grid".split())
OPAQUE_FEATURES = ("runtime_mappings", "script_fields", "suggest", "highlight")


@dataclass(frozen=True)
class AggNode:
    """One aggregation of a request: the only tree the engine keeps."""

    name: str
    kind: str
    params: dict
    children: tuple[AggNode, ...] = ()

    @property
    def mappable(self) -> bool:
        """Whether its keys belong to known fields; a scripted terms or multi_terms does not."""
        if self.kind not in BUCKETS | METRICS:
            return False
        if self.kind in ("terms", "significant_terms", "significant_text", "rare_terms"):
            return "field" in self.params and "script" not in self.params
        if self.kind == "multi_terms":
            return bool(self.params.get("terms")) and all("field" in t for t in self.params["terms"])
        return "script" not in self.params

    @property
    def runnable(self) -> bool:
        """Whether it can run where the gate is off."""
        if self.kind in PARENT | SIBLING | OPAQUE:
            return all(k in self.params for k in NEEDED.get(self.kind, ("buckets_path",)))
        return self.mappable

    @property
    def opaque(self) -> bool:
        """Whether its own output, or what pipelines add to it, is described by no field."""
        return self.kind in SIBLING | OPAQUE or any(c.kind in PARENT | OPAQUE for c in self.children)

    def walk(self, path: str = ""):
        path = f"{path}>{self.name}" if path else self.name
        yield path, self
        for c in self.children:
            yield from c.walk(path)


@dataclass(frozen=True)
class SearchPlan:
    query: dict
    aggs: tuple[AggNode, ...] = ()
    size: int = 10
    source: list[str] | None = None
    sort: tuple[tuple[str, bool], ...] = ()
    search_after: tuple | None = None
    track_total: bool = False
    #: what runs where the gate is off
    highlight: dict = field(default_factory=dict)
    suggest: dict = field(default_factory=dict)
    notices: tuple[str, ...] = field(default=())


def _aggs(body: dict) -> dict:
    """Both spellings mean the same; a body with both has both."""
    return {**body.get("aggs", {}), **body.get("aggregations", {})}


def parse_aggs(aggs: dict) -> tuple[AggNode, ...]:
    nodes = []
    for name, spec in aggs.items():
        kinds = [k for k in spec if k not in ("aggs", "aggregations", "meta")]
        if len(kinds) != 1:
            raise RequestError(f"aggregation {name!r} needs exactly one type")
        params = spec[kinds[0]]
        nodes.append(AggNode(name, kinds[0], params if isinstance(params, dict) else {}, parse_aggs(_aggs(spec))))
    return tuple(nodes)


def _cap(node: AggNode, cap: int, notices: list[str]) -> AggNode:
    params = node.params
    size = params.get("size")
    if node.kind in CAPPED and cap > 0 and isinstance(size, int) and not isinstance(size, bool) and size > cap:
        notices.append(f"[SIZE CAPPED] aggregation {node.name}: {size} lowered to {cap}")
        params = {**params, "size": cap}
    return replace(node, params=params, children=tuple(_cap(c, cap, notices) for c in node.children))


def parse_body(body: str | dict, size_cap: int = 100, gate: str = "block") -> SearchPlan:
    """Parses, gates and caps a request body.  ``gate`` says what becomes of parts whose output cannot be masked by field: block, drop or off."""
    if isinstance(body, str):
        try:
            body = json.loads(body or "{}")
        except ValueError as e:
            raise RequestError(f"the body is not JSON: {e}") from None
    if not isinstance(body, dict):
        raise RequestError("the body is not a JSON object")
    notices: list[str] = []
    opaque = [f for f in OPAQUE_FEATURES if f in body]
    nodes = parse_aggs(_aggs(body))
    strange = [n for n in nodes if not all(x.mappable for _, x in n.walk())]
    if (opaque or strange) and gate == "block":
        raise RequestError(f"refused, since the output cannot be masked by field: {', '.join([*opaque, *(n.name for n in strange)])}")
    if gate == "drop":
        notices += [f"[DROPPED] {x}" for x in [*opaque, *(n.name for n in strange)]]
        nodes = tuple(n for n in nodes if n not in strange)
    if gate == "off":
        unknown = [n for n in nodes if not all(x.runnable for _, x in n.walk()) or n.kind in PARENT]
        notices += [f"[NOT RUN] {n.name}: it is scripted, unknown or incomplete" for n in unknown]
        notices += [f"[NOT RUN] {f}: it is scripted" for f in opaque if f in ("runtime_mappings", "script_fields")]
        nodes = tuple(n for n in nodes if n not in unknown)
    size = body.get("size", 10)
    if isinstance(size, bool) or not isinstance(size, int) or size < 0:
        raise RequestError("size is a number of 0 or more")
    if size_cap > 0 and size > size_cap:
        notices.append(f"[SIZE CAPPED] size {size} lowered to {size_cap}")
        size = size_cap
    nodes = tuple(_cap(n, size_cap, notices) for n in nodes)
    source = body.get("_source")
    if isinstance(source, dict):
        source = source.get("includes")
    source = [source] if isinstance(source, str) else source if isinstance(source, list) else None
    sort = []
    for s in body.get("sort", []):
        name, how = next(iter(s.items())) if isinstance(s, dict) else (s, "asc")
        sort.append((name, (how.get("order", "asc") if isinstance(how, dict) else how) != "desc"))
    after = tuple(body["search_after"]) if "search_after" in body else None
    run = {f: body.get(f) or {} for f in ("highlight", "suggest")} if gate == "off" else {}
    return SearchPlan(body.get("query") or {"match_all": {}}, nodes, size, source, tuple(sort), after, body.get("track_total_hits") is True, notices=tuple(notices), **run)
