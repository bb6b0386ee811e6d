"""Snippets around what a query looked for, and terms like those of a text; both run where the gate is off.

A snippet is cut in the row's own projection.  Suggestions come from the distinct words of a field, counted once a
document with partial aggregation; only words of nearly the same length that begin alike are compared.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakfield.sources.catalog import RequestError, field, field_type

WORD = r"[\p{L}\p{N}_]+"


def wanted(query: dict, path: str) -> list[str]:
    """The words that a query looks for in a field, in lower case."""
    kind, body = next(iter(query.items()))
    if kind == "bool":
        parts = [q for k in ("must", "filter", "should") for q in (body.get(k) if isinstance(body.get(k), list) else [body[k]] if body.get(k) else [])]
        return list(dict.fromkeys(w for q in parts for w in wanted(q, path)))
    if kind not in ("match", "term", "terms") or path not in body:
        return []
    value = body[path]
    value = value.get("query", value.get("value")) if isinstance(value, dict) else value
    values = value if isinstance(value, list) else [value]
    return list(dict.fromkeys(w for v in values for w in re.findall(r"\w+", str(v).lower())))


def snippets(text: Column, words: list[str], size: int = 100, count: int = 5, tags: tuple[str, str] = ("<em>", "</em>")) -> Column:
    """Up to ``count`` pieces of about ``size`` characters around the words of a text, marked with ``tags``; null without any."""
    word = rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(re.escape(w) for w in words)})(?![\p{{L}}\p{{N}}_])"
    around = size // 2
    found = F.regexp_extract_all(text, F.lit(rf"(?isU)(?:\b.{{0,{around}}})?{word}(?:.{{0,{around}}}\b)?"), 0)
    marked = F.transform(F.slice(found, 1, count), lambda x: F.regexp_replace(F.trim(x), rf"(?iU){word}", f"{tags[0]}$1{tags[1]}"))
    return F.when(F.size(found) > 0, marked)


def highlight(df: DataFrame, query: dict, spec: dict) -> tuple[Column | None, list[str]]:
    """A struct of snippets by field, as they stand, and the fields; nothing where the query looks for no words."""
    made = []
    for path, own in spec.get("fields", {}).items():
        words, kind = wanted(query, path), field_type(df, path)
        if not words or kind is None:
            continue
        o = {**spec, **(own or {})}
        tags = ((o.get("pre_tags") or ["<em>"])[0], (o.get("post_tags") or ["</em>"])[0])
        if any(c in t for t in tags for c in "$\\"):
            raise RequestError("a tag has no $ and no backslash")
        c = F.array_join(field(df, path), "\n") if isinstance(kind, T.ArrayType) else field(df, path).cast("string")
        made.append((path, snippets(c, words, o.get("fragment_size", 100), o.get("number_of_fragments", 5) or 1, tags)))
    return (F.struct(*[c.alias(path) for path, c in made]), [path for path, _ in made]) if made else (None, [])


def suggest(df: DataFrame, name: str, spec: dict) -> tuple[DataFrame, str]:
    """Rows (suggest, word, option, freq, distance, rank): words of a field within some edits of each word of a text; and the field."""
    term = spec.get("term")
    if not isinstance(term, dict) or "field" not in term or not isinstance(spec.get("text"), str):
        raise RequestError(f"suggestion {name!r} needs a text and a term with a field")
    edits, prefix, size = term.get("max_edits", 2), term.get("prefix_length", 1), term.get("size", 5)
    words = list(dict.fromkeys(re.findall(r"\w+", spec["text"].lower())))
    c, kind = field(df, term["field"]), field_type(df, term["field"])
    c = F.array_join(c, "\n") if isinstance(kind, T.ArrayType) else c.cast("string")
    terms = df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD), 0))).alias("option")).groupBy("option").agg(F.count(F.lit(1)).alias("freq"))
    asked = F.explode(F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")).alias("word")
    near = terms.select("option", "freq", asked).where((F.abs(F.length("option") - F.length("word")) <= edits) & (F.substring("option", 1, prefix) == F.substring("word", 1, prefix)))
    near = near.withColumn("distance", F.levenshtein("option", "word", edits)).where("distance between 1 and " + str(int(edits)))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("distance", F.desc("freq"), "option"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= size)
    return near.select(F.lit(name).alias("suggest"), "word", "option", "freq", "distance", "rank"), term["field"]
