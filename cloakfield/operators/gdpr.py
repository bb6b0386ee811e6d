"""Classification of fields that hold personal data: by rule, by name, by value, by embedded text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakfield.functions.values import FREE_TEXT_NAME, embeds_personal_data, value_kind
from cloakfield.sources.catalog import field, field_type, flatten

# fixed values: field names that say what they hold, first match wins, and the label each kind is masked with
NAMES = (
    (r"(^|\.)user\.name$", "USERNAME", "high"),
    (r"(^|\.)username$", "USERNAME", "high"),
    (r"(^|\.)user\.id$", "USER_ID", "high"),
    (r"email", "EMAIL", "high"),
    (r"(^|\.)ip$", "IP_ADDRESS", "high"),
    (r"hostname", "HOSTNAME", "medium"),
    (r"(^|\.)host\.name$", "HOSTNAME", "medium"),
    (r"(^|\.)agent\.name$", "HOSTNAME", "medium"),
    (r"(^|\.)agent\.id$", "AGENT_ID", "medium"),
    (r"\.domain$", "DOMAIN", "medium"),
)
SUGGESTED = {"IP_ADDRESS": "[IP_ADDRESS]", "EMAIL": "[EMAIL]", "USERNAME": "[USERNAME]", "USER_ID": "[USERNAME]", "HOSTNAME": "[HOSTNAME]", "AGENT_ID": "[AGENT_ID]", "DOMAIN": "[HOSTNAME]", "FREETEXT": "[USERNAME]"}
PRIORITIES = ("high", "medium", "low")
SAMPLE_DOCS, SAMPLE_VALUES = 100, 5


@dataclass(frozen=True)
class Rule:
    """A custom rule: a field by exact name, suffix or glob, and optionally a pattern that some value has to match."""

    field: str
    kind: str
    priority: str = "high"
    pattern: str | None = None

    def fits(self, name: str) -> bool:
        return fnmatchcase(name, self.field) if "*" in self.field else name == self.field or name.endswith("." + self.field)


DEFAULT_RULES = (Rule("user.effective.name", "USERNAME"),)


def name_match(name: str) -> tuple[str, str] | None:
    return next(((k, p) for r, k, p in NAMES if re.search(r, name)), None)


def samples(df: DataFrame, fields: list[str], order: str, docs: int = SAMPLE_DOCS, values: int = SAMPLE_VALUES) -> DataFrame:
    """Rows (field, value, rank): the first distinct values of each field in the first documents."""
    from pyspark.sql import types as T

    head = df.orderBy(order).limit(docs)
    entries = []
    for f in fields:
        c = field(head, f)
        texts = F.transform(c, lambda x: x.cast("string")) if isinstance(field_type(head, f), T.ArrayType) else F.array(c.cast("string"))
        entries.append(F.struct(F.lit(f).alias("field"), texts.alias("values")))
    rows = head.select(F.col(order).alias("at"), F.explode(F.array(*entries)).alias("x")).select("at", "x.field", F.explode("x.values").alias("value"))
    firsts = rows.where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy("at", "value"))
    return firsts.withColumn("rank", rank).where(F.col("rank") <= values).select("field", "value", "rank")


def value_flags(sampled: DataFrame) -> DataFrame:
    """Rows (field, n_values, ip, email, hostname, embeds): what the sampled values of each field are."""
    kind = value_kind(F.col("value"))
    has = lambda k: F.coalesce(F.max(F.coalesce((kind == k), F.lit(False)).cast("int")), F.lit(0))
    return sampled.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_values"), has("IP_ADDRESS").alias("ip"), has("EMAIL").alias("email"), has("HOSTNAME").alias("hostname"),
        F.max(embeds_personal_data(F.col("value")).cast("int")).alias("embeds"),
    )


def classify(df: DataFrame, order: str, rules: tuple[Rule, ...] = DEFAULT_RULES, configured: tuple[str, ...] = (), exclude: tuple[str, ...] = (), free_text_types: dict[str, str] | None = None) -> DataFrame:
    """Rows (field, kind, priority, evidence, suggested_mask, already_configured), most urgent first."""
    fields = [f for f, _ in flatten(df.schema) if not f.startswith("_") and f not in exclude]
    sampled = samples(df, fields, order)
    matches = [(f, r) for f in fields for r in rules if r.fits(f)]
    entries = []
    for f in fields:
        named = name_match(f)
        free = bool(re.search(FREE_TEXT_NAME, f)) or (free_text_types or {}).get(f) == "text"
        entries.append((f, named[0] if named else None, named[1] if named else None, free, f in configured or any(f.endswith("." + c) for c in configured)))
    base = df.sparkSession.createDataFrame(entries, "field string, name_kind string, name_priority string, free boolean, already_configured boolean")
    rows = base.join(value_flags(sampled), "field", "left")
    rule_kind = rule_priority = F.lit(None).cast("string")
    # an invalid pattern is a constraint that is not there
    bound = [(f, r) for f, r in matches if r.pattern and _valid(r.pattern)]
    seen = sampled.agg(*[F.max((F.col("field") == f) & F.col("value").rlike(r.pattern)) for f, r in bound]).first() if bound else ()  # all rules in one job
    unmet = [x for x, met in zip(bound, seen) if not met]
    for f, r in reversed(matches):
        if (f, r) in unmet:
            continue
        rule_kind, rule_priority = F.when(F.col("field") == f, r.kind).otherwise(rule_kind), F.when(F.col("field") == f, r.priority).otherwise(rule_priority)
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    kind = F.coalesce(rule_kind, F.col("name_kind"), F.when(on("ip"), "IP_ADDRESS").when(on("email"), "EMAIL").when(on("hostname"), "HOSTNAME").when(F.col("free") & on("embeds"), "FREETEXT"))
    priority = F.coalesce(rule_priority, F.col("name_priority"), F.when(on("ip") | on("email"), "high").when(on("hostname"), "medium").otherwise("low"))
    evidence = F.when(rule_kind.isNotNull(), "custom rule").when(F.col("name_kind").isNotNull(), "field name").when(on("ip") | on("email") | on("hostname"), "sampled values").otherwise("embedded in text")
    rows = rows.select("field", kind.alias("kind"), priority.alias("priority"), evidence.alias("evidence"), "already_configured").where(F.col("kind").isNotNull())
    labels = F.create_map(*[F.lit(x) for kv in SUGGESTED.items() for x in kv])
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    return rows.withColumn("suggested_mask", F.coalesce(labels[F.col("kind")], F.lit("[USERNAME]"))).orderBy(rank, "field")


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def scan_names(df: DataFrame) -> list[tuple[str, str, str]]:
    """Fields of a result whose names say that they hold personal data, lists included."""
    return [(f, *found) for f, _ in flatten(df.schema) if (found := name_match(f))]
