"""Fill-in-the-middle rewriting of whole texts, as DuckDB SQL over each Arrow batch.

A text is cut into tokens, each a word with the white space before it, or the white space that is left at the
end.  Keyed digests of the document id choose whether a document is rewritten, where its middle begins and ends
and which of two layouts it takes:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

Everything happens in one scan without a shuffle.  Each task registers slices of its Arrow batches with a DuckDB
connection of one thread and no spill folder; a slice holds ``SLICE_BYTES`` of text or one longer text, so memory
follows the longest text and not the batch.  No value passes through Python.  What a row becomes depends on its id
and text alone, so a lost executor's tasks run again with the same result.

Defined results: a null or empty text is plain and stays as it is, with n = 0.  A text that holds a marker is plain,
so that a rewritten one can always be taken apart again.  A null id is digested as an empty one.  Repeated rows and
ids give equal results.  Empty tables give empty results.  Other columns pass through as they are, whatever their
names; an own column ``__fim`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakfield.llm._shared import WS, table

TOKEN = f"[{WS}]*[^{WS}]+|[{WS}]+"
#: Bytes of text that one SQL statement works on, unless one text is longer.
SLICE_BYTES = 4 << 20
STRUCT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"

#: The rewritten text from the parts, and the parts' text from the rewritten one.  A marker cannot begin inside a part
#: and end inside a marker, and no part holds one, so the first of each kind is the one that was put in.
REWRITE = """
CREATE MACRO unsigned(digest, k) AS CAST('0x' || substr(digest, 8 * k - 7, 8) AS UBIGINT);
CREATE MACRO taken(tokens, a, b) AS array_to_string(list_slice(tokens, a + 1, b), '');
CREATE MACRO rewritten(form, text, prefix, middle, suffix) AS CASE form
  WHEN 'psm' THEN getvariable('p') || prefix || getvariable('s') || suffix || getvariable('m') || middle
  WHEN 'spm' THEN getvariable('s') || suffix || getvariable('p') || prefix || getvariable('m') || middle ELSE text END;
CREATE MACRO inside(text, a, b) AS split_part(split_part(text, a, 2), b, 1);
CREATE MACRO restored(form, output) AS CASE form
  WHEN 'psm' THEN inside(output, getvariable('p'), getvariable('s')) || split_part(output, getvariable('m'), 2) || inside(output, getvariable('s'), getvariable('m'))
  WHEN 'spm' THEN inside(output, getvariable('p'), getvariable('m')) || split_part(output, getvariable('m'), 2) || inside(output, getvariable('s'), getvariable('p')) ELSE output END;
"""
SLICE_SQL = """
WITH cut AS (
  SELECT pos, text, regexp_extract_all(coalesce(text, ''), getvariable('token')) AS tokens,
         sha256(getvariable('seed') || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM slice),
drawn AS (
  SELECT pos, text, tokens, len(tokens) AS n, unsigned(digest, 1) % (len(tokens) + 1) AS a, unsigned(digest, 2) % (len(tokens) + 1) AS b,
         CASE WHEN coalesce(text, '') = '' OR contains(text, getvariable('p')) OR contains(text, getvariable('s')) OR contains(text, getvariable('m')) OR unsigned(digest, 3) % 100 >= getvariable('rate') THEN 'plain'
              WHEN unsigned(digest, 4) % 100 < getvariable('spm_share') THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT pos, text, n, form, CASE WHEN form <> 'plain' THEN taken(tokens, 0, least(a, b)) END AS prefix, CASE WHEN form <> 'plain' THEN taken(tokens, least(a, b), greatest(a, b)) END AS middle,
         CASE WHEN form <> 'plain' THEN taken(tokens, greatest(a, b), n) END AS suffix FROM drawn),
done AS (SELECT pos, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars, rewritten(form, text, prefix, middle, suffix) AS output FROM parts)
SELECT CAST(n AS BIGINT) AS n, form, CAST(prefix_chars AS BIGINT) AS prefix_chars, CAST(middle_chars AS BIGINT) AS middle_chars,
       sha256(coalesce(output, '')) AS output_sha256, sha256(coalesce(restored(form, output), '')) AS restored_sha256, output FROM done ORDER BY pos
"""
RESTORE_SQL = "SELECT restored(form, text) AS text FROM (SELECT pos, form, doc AS text FROM slice) ORDER BY pos"


@lru_cache(maxsize=4)
def _connection(seed: str, rate: int, spm_share: int, markers: tuple[str, str, str]):
    """One connection a worker: one thread, as its task has one core, and no spill to a folder of the machine."""
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
    for name, value in (("token", TOKEN), ("seed", seed), ("rate", rate), ("spm_share", spm_share), *zip("psm", markers)):
        db.execute(f"SET VARIABLE {name} = $1", [value])
    db.execute(REWRITE)
    return db


def _slices(texts: pa.Array) -> list[tuple[int, int]]:
    """Runs of rows (first, how many) of ``SLICE_BYTES`` of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts, first, base = [], 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        cuts.append((first, last - first))
        first, base = last, int(ends[last - 1])
    return cuts


def _run(db, sql: str, columns: dict[str, pa.Array], texts: pa.Array) -> pa.Table:
    """``sql`` over the slices of ``columns``, in the order of rows."""
    whole = pa.table({**columns, "pos": pa.array(np.arange(len(texts)))})
    done = []
    for first, n in _slices(texts):
        db.register("slice", whole.slice(first, n))
        done.append(db.sql(sql).to_arrow_table())
        db.unregister("slice")
    return pa.concat_tables(done).combine_chunks()


def _column(found: pa.Table, name: str) -> pa.Array:
    column = found.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_share: int = 80, seed: str = "42", markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"), with_text: bool = True) -> DataFrame:
    """The columns of ``docs`` with ``text`` rewritten, and a struct ``__fim`` of n, form, prefix_chars, middle_chars and two digests.

    ``rate`` percent of the documents are rewritten, ``spm_share`` percent of those with the suffix first.  ``markers``
    stand before prefix, suffix and middle.  output_sha256 is of the rewritten text and restored_sha256 of the text that
    is put together again from it.  Without ``with_text`` the text column is left out, for audits, and no text leaves
    the workers.
    """
    if len(set(markers)) < 3 or not all(markers):
        raise ValueError("three different markers are needed")
    given = docs.drop("__fim")
    fields = [f for f in given.schema.fields if with_text or f.name != "text"]
    kept = [f.name for f in fields]
    inner = [x.split()[0] for x in STRUCT.split(", ")]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _connection(seed, rate, spm_share, markers)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text")
            found = _run(db, SLICE_SQL, {"doc_id": batch.column("doc_id"), "text": texts}, texts)
            arrays = [_column(found, "output") if c == "text" else batch.column(c) for c in kept]
            struct = pa.StructArray.from_arrays([_column(found, c) for c in inner], names=inner)
            yield pa.RecordBatch.from_arrays([*arrays, struct], names=[*kept, "__fim"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields), "__fim struct<" + STRUCT.replace(" ", ": ").replace(",:", ",") + ">"])
    return given.mapInArrow(rewrite, schema)


def restore(rewritten: DataFrame, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """The columns of ``rewritten`` with ``text`` as it was before :func:`fill_in_middle`, without ``__fim``."""
    fields = [f for f in rewritten.schema.fields if f.name != "__fim"]
    names = [f.name for f in fields]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _connection("", 0, 0, markers)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text")
            found = _run(db, RESTORE_SQL, {"doc": texts, "form": batch.column("__form")}, texts)
            yield pa.RecordBatch.from_arrays([_column(found, "text") if c == "text" else batch.column(c) for c in names], names=names)

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
    return rewritten.select(*[F.col(f"`{c}`") for c in names], F.col("__fim.form").alias("__form")).mapInArrow(back, schema)


def query(spark, sf_dir):
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "__fim.*")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
d AS (
  SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS UBIGINT)) AS r FROM t),
f AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, length(array_to_string(u[1:lo], '')) AS a, length(array_to_string(u[1:hi], '')) AS b FROM f),
o AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM p),
w AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN output ELSE regexp_replace(output, CASE form WHEN 'psm' THEN '^<P>(.*)<S>(.*)<M>(.*)$' ELSE '^<S>(.*)<P>(.*)<M>(.*)$' END, CASE form WHEN 'psm' THEN '\1\3\2' ELSE '\2\3\1' END, 's') END) AS restored_sha256
FROM w
"""
