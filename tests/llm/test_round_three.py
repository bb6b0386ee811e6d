"""Fill-in-the-middle, source divergence and harmonic packing: brute force, round trips and edge rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakfield.llm import fill_in_middle, harmonic_packing, source_divergence
from cloakfield.llm import queries as Q
from tests.llm.test_llm_edges import LONG, path, table

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "one two", "en", "a"), (5, LONG, "en", "b"), (6, LONG, "en", "b"), (7, "One TWO", "de", "b"),
    (8, "a\nb\na\n", "de", None), (8, "a\nb\na\n", "de", None), (9, "has <S> in it", "en", "a"), (10, "ünï ☃ 😀 " * 30, "fr", "c"), (None, "no id here", "en", "a"), (11, "<", "en", "a"), (12, "\x00 nul \x85 x", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


def fim(doc, text):
    """The contract in plain Python: n, form, prefix and middle length, output."""
    tokens = TOKEN.findall(text or "")
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text or ""
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def check_fim(rows, texts):
    seen = Counter()
    for r in rows:
        text = texts[r["doc_id"]]
        n, form, prefix, middle, output = fim(r["doc_id"], text)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == sha(output) and r["restored_sha256"] == sha(text)
        seen[form] += 1
    return seen


def test_op11_equals_brute_force(spark, data, docs):
    seen = check_fim(Q.queries()["op11_fill_in_middle"](spark, data).collect(), {d: r["text"] for d, r in docs.items()})
    assert len(docs) == seen.total() and min(seen["plain"], seen["spm"], seen["psm"]) > 5


def test_op11_odd_rows(spark, odd):
    texts = {d: t for d, t, _, _ in ODD}
    full = fill_in_middle.fill_in_middle(odd, rate=50)
    assert full.columns == [*odd.columns, "__fim"] and full.count() == len(ODD)
    check_fim(full.select("doc_id", "__fim.*").collect(), texts)
    assert {r["text"] is None for r in full.where("doc_id = 1").collect()} == {True}
    everything = fill_in_middle.fill_in_middle(odd, rate=100, spm_share=50, seed="x", markers=("[p]", "[s]", "[m]"))
    forms = {r["doc_id"]: r["form"] for r in everything.select("doc_id", "__fim.form").collect()}
    assert forms[1] == forms[2] == "plain" and {forms[k] for k in (4, 5, 9, 10, 11, 12)} <= {"psm", "spm"}
    back = fill_in_middle.restore(everything, ("[p]", "[s]", "[m]"))
    assert back.schema == odd.schema and back.exceptAll(odd).count() == 0 == odd.exceptAll(back).count()
    assert fill_in_middle.fill_in_middle(odd.limit(0)).count() == 0
    again = fill_in_middle.fill_in_middle(full, rate=0)  # an own __fim is replaced
    assert again.columns == full.columns and again.where("__fim.form <> 'plain'").count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(odd, markers=("a", "a", "b"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="<PSM> \t\nab☃\x00é", max_size=40), min_size=1, max_size=8), st.booleans())
def test_op11_slices_round_trip(texts, small):
    """Random texts full of half markers, over slices of one row and of all."""
    import pyarrow as pa

    old = fill_in_middle.SLICE_BYTES
    fill_in_middle.SLICE_BYTES = 1 if small else old
    try:
        db = fill_in_middle._connection("42", 50, 80, ("<P>", "<S>", "<M>"))
        column = pa.array(texts)
        found = fill_in_middle._run(db, fill_in_middle.SLICE_SQL, {"doc_id": pa.array(range(len(texts)), pa.int64()), "text": column}, column).to_pylist()
    finally:
        fill_in_middle.SLICE_BYTES = old
    for k, (text, r) in enumerate(zip(texts, found)):
        n, form, _, _, output = fim(k, text)
        assert (r["n"], r["form"], r["output"] or "", r["restored_sha256"]) == (n, form, output, sha(text))


def divergence(rows, min_docs, top):
    """The contract in plain Python over (text, lang, source) rows."""
    n, frequency, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        n[lang, source].update(found)
        frequency[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in frequency[lang].items() if k >= min_docs)
        share = lambda count, total: 1 + 1_000_000_000 * (count + 2) // (total + 2 * len(kept))
        p = {s: {t: share(n[lang, s][t], sum(n[lang, s][x] for x in kept)) for t in kept} for s in sources}
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            heap = [(t, f(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", heap, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, k) for k, (t, v) in enumerate(found[:limit], 1)]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_op12_equals_brute_force(spark, data, docs):
    want = divergence([(r["text"], r["lang"], r["source"]) for r in docs.values()], 10, 10)
    assert got(Q.queries()["op12_source_divergence"](spark, data)) == want and {r[2] for r in want} == {"pair", "term"}


@pytest.mark.parametrize("block, side", [(2048, 256), (3, 2), (1, 1)])
def test_op12_odd_rows_and_tiles(spark, odd, block, side):
    """Nulls, groups without terms, a language that keeps none, ties, and tiles cut along terms and sources."""
    more = [(100 + i, f"alpha beta {'gamma ' * (i % 5)}É{'é' * (i % 2)} İx", "en", f"s{i % 7}") for i in range(40)] + [(200 + i, "solo", "xx", "only") for i in range(12)]
    df = odd.unionByName(table(spark, more))
    want = divergence([(t, lang, s) for _, t, lang, s in [*ODD, *more]], 10, 10)
    assert got(source_divergence.source_divergence(df, block=block, side=side)) == want
    assert any(r[:3] == ("de", "", "pair") and r[4] == 0 for r in want) and not any(r[0] == "xx" for r in want)
    assert source_divergence.source_divergence(odd.limit(0), block=block, side=side).count() == 0


def test_op12_exact_arithmetic():
    count, total = np.array([[0, 2, 7 * 10**15, 9 * 10**14 + 1]]), np.array([[8_999_999_999_999_999], [9 * 10**14 + 1]])
    for i, t in enumerate(total[:, 0].tolist()):
        for j, c in enumerate(count[0].tolist()):
            if c <= t:
                assert source_divergence.share(count, total)[i, j] == 1 + 10**9 * c // t


def test_op12_long_texts_are_split_at_terms(monkeypatch):
    monkeypatch.setattr(source_divergence, "CHUNK", 10)
    text = "Alpha beta-gamma é" + "y" * 50 + " z " * 9 + "x" * 30
    assert [t for part in source_divergence.terms_of(text) for t in part] == [t.encode() for t in TERM.findall(text.translate(LOWER))]


def check_packing(rows, texts, capacity, many=False):
    """Every id in one piece, gapless sequences; returns the tokens of padding and all tokens."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter({d: 1 for d in by_doc}).keys() == texts.keys()
    for d, pieces in by_doc.items():
        ids = np.array([*exact.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        pieces.sort(key=lambda r: r["start"])
        copies = sum(r["length"] for r in pieces) // len(ids)
        assert sum(r["length"] for r in pieces) == copies * len(ids) and (copies == 1 or many)
        at = Counter()
        for r in pieces:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            at.update(range(r["start"], r["start"] + r["length"]))
        assert set(at) == set(range(len(ids))) and set(at.values()) == {copies}
    padding = 0
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(r["length"] for r in rows)


def test_op13_round_trip_padding_and_classes(spark, data, docs):
    rows = Q.queries()["op13_harmonic_packing"](spark, data).collect()
    padding, tokens = check_packing(rows, {d: r["text"] for d, r in docs.items()}, 1024)
    assert padding < 0.01 * tokens + 1024
    pieces = Counter(r["doc_id"] for r in rows)
    assert sum(pieces.values()) < sum(1 + r["doc_tokens"] // 1024 for r in {r["doc_id"]: r for r in rows}.values()) + 1.5 * len(docs)
    classes = defaultdict(list)
    for r in rows:
        if r["sequence_id"] < harmonic_packing.LAST_PASS:
            classes[r["sequence_id"]].append(1024 // r["length"])
    assert classes and all(set(c) == {len(c)} for c in classes.values())  # k pieces of class k, no others


def test_op13_workers_agree_on_any_partitioning(spark, data, docs):
    """Many small tasks leave most pieces to the second pass; nothing is lost or padded more."""
    df = spark.read.parquet(f"{data}/documents.parquet").repartition(23)
    rows = harmonic_packing.harmonic_packing(df, path(), 256, cut_cost=2).collect()
    padding, tokens = check_packing(rows, {d: r["text"] for d, r in docs.items()}, 256)
    assert padding < 0.01 * tokens + 256 and len({r["sequence_id"] >> 60 for r in rows}) == 3


def test_op13_odd_rows(spark, odd):
    rows = harmonic_packing.harmonic_packing(odd, path(), 64, with_ids=True).collect()
    texts = {d: t for d, t, _, _ in ODD}
    check_packing(rows, texts, 64, many=True)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert [(r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] in (1, 2)] == [(1, 1)] * 2
    assert harmonic_packing.harmonic_packing(odd.limit(0), path()).count() == 0
    clash = odd.withColumns({"length": F.lit("c"), "offset": F.lit("c"), "sequence_id": F.lit("c"), "start": F.lit("c")})
    assert harmonic_packing.harmonic_packing(clash, path(), 64).count() == len(rows)


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 1000, 1024, 2048])
def test_cut_table_covers_every_length(capacity):
    for z, pieces in enumerate(harmonic_packing.cut_table(capacity)):
        assert sum(pieces) == z and all(0 < p <= capacity for p in pieces)
    pieces = sum(map(len, harmonic_packing.cut_table(1024))) / 1024
    assert pieces < 3.2 and harmonic_packing.cut_table(1024)[1024] == (1024,)
