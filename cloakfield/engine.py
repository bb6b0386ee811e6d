"""The engine: search, schema, overview, coverage, personal-data check and posture over a catalog."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakfield.functions.tokens import token
from cloakfield.operators import coverage as cov
from cloakfield.operators import gdpr, notices, overview
from cloakfield.operators.aggs import Aggregator, AggResult
from cloakfield.operators.filters import after_key, clause, instant
from cloakfield.operators.highlight import highlight, suggest
from cloakfield.operators.masking import counted, guard, left_in, mask_documents, mask_keys, mask_opaque_values, registry
from cloakfield.operators.trees import aggregate
from cloakfield.plans.dsl import parse_body
from cloakfield.sources.catalog import Catalog, check_prefix
from cloakfield.sources.catalog import field as path_column
from cloakfield.sources.policy import Policy, Settings
from cloakfield.sources.sinks import CLIP, append_log, log_lines


@dataclass
class SearchResult:
    """Lazy frames: documents, total, buckets by path, and notices (code, subject, detail)."""

    hits: DataFrame | None
    total: DataFrame
    aggs: dict[str, AggResult]
    notices: DataFrame
    sensitive: list[tuple[str, str, str]] = field(default_factory=list)
    #: suggestions by name
    suggest: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Answer:
    """What one exchange hands out: rows by part (hits, notices, total and paths of aggregations), or none where it is blocked."""

    parts: dict[str, list]
    blocked: bool
    residuals: dict[str, dict[str, int]]

    @property
    def notice(self) -> str:
        return "[BLOCKED] addresses are left in " + "; ".join(f"{part}: {', '.join(columns)}" for part, columns in self.residuals.items()) if self.blocked else ""


class Engine:
    """``ids`` and ``times`` name the id and time field of each table, ``json`` its columns of JSON text; ``as_of`` stands for now."""

    def __init__(
        self, spark: SparkSession, catalog: Catalog, policy: Policy | None = None, settings: Settings | None = None, as_of: datetime | None = None,
        ids: dict[str, str] | None = None, times: dict[str, str] | None = None, children: dict[str, tuple[DataFrame, str, str]] | None = None,
        raw_tables: tuple[str, ...] = (), shadowed: dict[str, str] | None = None, legacy: tuple[str, ...] = (), json: dict[str, tuple[str, ...]] | None = None,
    ):
        self.spark, self.catalog, self.policy, self.settings, self.as_of = spark, catalog, policy, settings or Settings(), as_of
        self.ids, self.times, self.children, self.raw_tables = ids or {}, times or {}, children, raw_tables
        self.shadowed, self.legacy, self.json = shadowed or {}, legacy, json or {}
        #: exchanges and blocked exchanges, by tool
        self.exchanges, self.blocked = Counter(), Counter()

    def _one(self, names: dict[str, str], index: str) -> str | None:
        found = {names[n] for n in self.catalog.resolve(index) if n in names}
        return found.pop() if len(found) == 1 else None

    def search(self, index: str, body: str | dict, verified: bool = True) -> SearchResult:
        """Runs a request body over the tables that match ``index``.

        Under a policy documents and keys are masked and, unless ``verified`` is false, every frame of the answer checks
        its rows in the pass that reads them: a row with an address left, at any depth, fails that pass.  With the gate
        off, values of fields that the policy does not name go through the deep pass.
        """
        plan = parse_body(body, self.settings.size_cap, self.settings.gate)
        df = self.catalog.read(index)
        ident = self._one(self.ids, index)
        rows = df.where(clause(df, plan.query, self.as_of))
        total = notices.total_hits(rows, plan.track_total, self.settings.total_cap)
        hits, lit = None, []
        if plan.size:
            page = rows.where(after_key(rows, plan.sort, plan.search_after)) if plan.search_after else rows
            order = [path_column(page, f).asc_nulls_last() if up else path_column(page, f).desc_nulls_last() for f, up in plan.sort] + ([F.col(ident).asc()] if ident else [])
            page = page.orderBy(*order) if order else page
            hits = page.limit(plan.size)
            shown, lit = highlight(hits, plan.query, plan.highlight) if plan.highlight else (None, [])
            hits = hits.withColumn("highlight", shown) if shown is not None else hits
            if plan.source is not None:
                hits = hits.select(*[path_column(hits, f).alias(f) for f in plan.source], *(["highlight"] if lit else []))
        options = {name: suggest(df, name, spec) for name, spec in plan.suggest.items() if name != "text"}
        results = aggregate(Aggregator(lambda: df, self.as_of, ident, self.children), rows, plan.aggs)
        found = notices.notices_frame(self.spark, [(n.partition("] ")[0] + "]", index, n.partition("] ")[2]) for n in plan.notices] + self._banner(index) + self._lost(index))
        about = notices.aggregation_notices(results, self.shadowed)
        found = found.unionByName(about) if about is not None else found
        found = found.unionByName(total.where("value = 0").select(F.lit("[ZERO HITS]").alias("code"), F.lit(index).alias("subject"), F.lit("no document matches").alias("detail")))
        found = found.unionByName(total.where("relation = 'gte'").select(F.lit("[TOTAL COUNT TRUNCATED]").alias("code"), F.lit(index).alias("subject"), F.format_string("more than %d documents match", "value").alias("detail")))
        sensitive = gdpr.scan_names(hits) if hits is not None else []
        if self.policy and self.policy.fields:
            texts, off = self._json(index), self.settings.gate == "off"
            known = registry(df.limit(0) if hits is None else hits, self.policy)
            # where no field tells what a value is, it goes by what it looks like, and by the values of the hits
            deep = lambda r: replace(r, df=mask_opaque_values(r.df, known, self.policy)) if off and r.node.opaque else r
            results = {k: deep(mask_keys(r, self.policy, texts)) for k, r in results.items()}
            if hits is not None:
                # a snippet is free text of its document, whatever its field is called
                free = replace(self.policy, free_text=(*self.policy.free_text, *(f"highlight.{f}" for f in lit)))
                hits = mask_documents(hits, free, json=texts, deep=off)
                hits = mask_opaque_values(hits, known, self.policy) if off else hits
            for name, (found_, source) in options.items():
                spec = self.policy.spec(source)
                masked = found_.withColumn("option", token(spec.family, F.col("option"), self.policy.salt, self.policy.use_hash)) if spec else found_
                options[name] = mask_opaque_values(masked, known, self.policy), source
            if verified:
                options = {name: (guard(f, f"suggest {name}"), source) for name, (f, source) in options.items()}
                check = lambda df, what: None if df is None else guard(df, what)
                hits, found = check(hits, "hits"), check(found, "notices")
                results = {k: replace(r, df=check(r.df, k), other=check(r.other, k), scope=check(r.scope, k)) for k, r in results.items()}
        return SearchResult(hits, total, results, found, sensitive, {name: f for name, (f, _) in options.items()})

    def _json(self, index: str) -> tuple[str, ...]:
        return tuple(dict.fromkeys(c for name in self.catalog.resolve(index) for c in self.json.get(name, ())))

    def answer(self, index: str, body: str | dict, tool: str = "search", log: str | None = None) -> Answer:
        """Runs a request for a client and hands out its rows, or none of them where an address is left anywhere.

        Each part is read once, and the same pass counts what is left in it.  The exchange is counted by ``tool`` and, with
        ``log``, a folder, written as one line, which for a blocked one says where and not what.  Meant for answers that
        the caps of a request bound; larger ones are written from the frames of :meth:`search`, which check themselves.
        """
        result = self.search(index, body, verified=False)
        frames = {"hits": result.hits, "notices": result.notices, "total": result.total} | {f"aggs.{k}": r.df for k, r in result.aggs.items()} | {f"suggest.{k}": f for k, f in result.suggest.items()}
        active = bool(self.policy and self.policy.fields)
        parts, residuals = {}, {}
        for name, df in frames.items():
            if df is None:
                continue
            watched, seen = counted(df, name) if active else (df, None)
            parts[name] = watched.collect()
            left = left_in(df, seen) if active else {}
            if left:
                residuals[name] = left
        blocked = bool(residuals)
        self.exchanges[tool] += 1
        self.blocked[tool] += blocked
        out = Answer({} if blocked else parts, blocked, residuals)
        if log:
            state = "BLOCKED" if blocked else "MASKED" if active else "RAW"
            text = out.notice if blocked else "; ".join(f"{name}: {row.asDict(True)}" for name, rows in parts.items() for row in rows)[: CLIP + 1]
            line = self.spark.createDataFrame([(self.as_of or datetime.now(), tool, state, text)], "at timestamp, tool string, state string, text string")
            append_log(log_lines(line, "at", "tool", "state", "text"), log)
        return out

    def compliance(self) -> DataFrame:
        """Rows (tool, exchanges, blocked) of this engine's answers."""
        rows = [(t, n, self.blocked[t]) for t, n in sorted(self.exchanges.items())]
        return self.spark.createDataFrame(rows, "tool string, exchanges long, blocked long")

    def _lost(self, index: str) -> list[tuple[str, str, str]]:
        return notices.shard_failures({n: self.catalog.lost_files(n) for n in self.catalog.resolve(index) if n in self.catalog.tolerant})

    def _banner(self, index: str) -> list[tuple[str, str, str]]:
        active = bool(self.policy and self.policy.fields)
        out = notices.safety_banner(active, active, self.settings.gate, index, list(self.raw_tables), self.settings.external)
        out += [("[LEGACY INDEX PATTERN]", index, f"{p} is no table of this version") for p in self.legacy if index.startswith(p)]
        return out

    def schema(self, index: str, prefix: str = "", only_populated: bool = False) -> tuple[DataFrame, list[str]]:
        """Fields and types (up to the cap), or populated fields with counts, and notices."""
        types = self.catalog.field_types(index, check_prefix(prefix))
        said = [f"[TYPE CONFLICT] {f}: {'|'.join(t)}" for f, t in types.items() if len(t) > 1]
        names = list(types)
        if only_populated:
            return cov.populated(self.catalog.read(index), names), said
        if len(names) > self.settings.schema_cap:
            said.append(f"[TRUNCATED] {self.settings.schema_cap} of {len(names)} fields")
        rows = [(f, types[f][0] if len(types[f]) == 1 else "CONFLICT:" + "|".join(types[f])) for f in names[: self.settings.schema_cap]]
        return self.spark.createDataFrame(rows, "field string, type string"), said

    def schema_empty(self, index: str, prefix: str = "") -> DataFrame:
        """Fields that are mapped and that no document fills, in order of name."""
        names = list(self.catalog.field_types(index, check_prefix(prefix)))
        return cov.presence(self.catalog.read(index), names).where("total_docs = 0").select("field").orderBy("field")

    def findings_overview(self, index: str, hours: int = 24, top_agents: int = 10, top_titles: int = 10) -> dict[str, DataFrame]:
        """Five tables over the last ``hours``; needs columns level, agent, title and category."""
        df = self.catalog.read(index)
        rows = df.where(clause(df, {"range": {self._one(self.times, index): {"gte": f"now-{hours}h", "lte": "now"}}}, self.as_of))
        out = {
            "severity": overview.severity(rows), "unknown": overview.unknown_levels(rows), "agents": overview.cross_tab(rows, overview.check_top(top_agents)),
            "titles": overview.top(rows, "title", top_titles), "categories": overview.categories(rows),
        }
        if self.policy and self.policy.fields:
            from cloakfield.functions.freetext import mask_text

            out["agents"] = out["agents"].withColumn("agent", token("HOST", F.col("agent"), self.policy.salt, self.policy.use_hash))
            out["titles"] = out["titles"].withColumn("title", mask_text(F.col("title"), self.policy.salt, None, self.policy.mask_free_text_users, "response", self.policy.use_hash))
        return out

    def field_coverage(self, index: str, prefix: str = "", hours: int = 24, min_docs: int = 0, facts: DataFrame | None = None) -> dict[str, DataFrame]:
        df = self.catalog.read(index)
        time = self._one(self.times, index)
        names = list(self.catalog.field_types(index, prefix))
        window = clause(df, {"range": {time: {"gte": f"now-{hours}h", "lte": "now"}}}, self.as_of)
        if facts is None:
            facts = self.spark.createDataFrame(self.catalog.mapping_facts(index), "field string, declared_in long, unindexed_in long, doc_values_disabled_in long")
        rows = cov.coverage(df, names, window, facts, self.settings.sample_size, self._one(self.ids, index))
        shown, hidden = cov.min_docs(rows, min_docs)
        return {"coverage": cov.sort_coverage(shown), "hidden": hidden, "drifted": cov.drifted(rows), "categories": cov.category_counts(rows)}

    def gdpr_check(self, index: str, rules: tuple[gdpr.Rule, ...] = gdpr.DEFAULT_RULES, exclude: tuple[str, ...] = ()) -> DataFrame:
        configured = tuple(s.field for s in self.policy.fields) if self.policy else ()
        return gdpr.classify(self.catalog.read(index), self._one(self.ids, index), rules, configured, exclude)

    def posture(self, deployed: Policy | None = None, quarantine: str | None = None, hours: int = 24) -> list[tuple[str, str, str]]:
        """Fact lines (fact, OK | WARN | unknown, detail)."""
        from cloakfield.sources.policy import drift

        p = self.policy
        lines = [
            ("masking policy", "OK" if p and p.fields else "WARN", f"{len(p.fields)} fields" if p else "none"),
            ("salt", "unknown" if not p else "WARN" if p.use_hash and len(p.salt.strip()) < 32 else "OK", "length only is checked"),
            ("hashing", "unknown" if not p else "OK" if p.use_hash else "WARN", "tokens" if p and p.use_hash else "generic labels"),
            ("free-text users", "unknown" if not p else "OK" if p.mask_free_text_users else "WARN", ""),
            ("gate", "OK" if self.settings.gate == "block" else "WARN", self.settings.gate),
            ("raw tables", "WARN" if any(t in self.catalog.tables for t in self.raw_tables) else "OK", ", ".join(self.raw_tables)),
        ]
        if deployed and p:
            found = drift(p, deployed)
            lines.append(("deployed policy", "WARN" if any(found.values()) else "OK", "; ".join(f"{k}: {', '.join(v)}" for k, v in found.items() if v)))
            lines.append(("fingerprint", "OK" if p.fingerprint() == deployed.fingerprint() else "WARN", p.fingerprint()[:12]))
        if quarantine:
            df = self.catalog.read(quarantine)
            since = instant(f"now-{hours}h", self.as_of)
            n = df.where(F.col(self._one(self.times, quarantine)) >= F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz")).count()
            lines.append(("quarantine", "WARN" if n else "OK", f"{n} documents in {hours} h"))
        return lines
