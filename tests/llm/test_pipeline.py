"""The whole pipeline against plain Python, stage by stage."""

from collections import Counter, defaultdict

from cloakfield.llm._shared import clean
from tests.llm.test_llm_queries import LOWER, SPACE, brute_components, run, shingles


def test_run_equals_brute_force(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    texts = {r["doc_id"]: docs[r["doc_id"]]["text"] or "" for r in run(spark, data, "op4_quality_rules") if r["kept"]}
    key = lambda x: x.strip(SPACE).translate(LOWER)
    found = defaultdict(set)
    for d, t in texts.items():
        for x in t.split("\n"):
            found[key(x)].add(d)
    texts = {d: "\n".join(x for x in t.split("\n") if not (key(x) and len(found[key(x)]) >= 10)) for d, t in texts.items()}
    root = brute_components({d: shingles(t) for d, t in texts.items()})
    texts = {d: t for d, t in texts.items() if root[d] == d}
    rows = corpus_pipeline.run(spark, data).collect()
    exact = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    length = {d: len(exact.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    got, copies, places = Counter(), Counter(), defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["length"]
        copies[r["doc_id"]] += r["piece"] == 0
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(got) <= set(texts) and max(copies.values()) <= 2 and all(got[d] == copies[d] * length[d] for d in got)
    sizes, taken = Counter(), Counter()
    for d, t in texts.items():
        sizes[docs[d]["source"]] += len(t.split())
        taken[docs[d]["source"]] += copies[d] * len(t.split())
    assert 1.3 * sum(sizes.values()) < sum(taken.values()) < 1.7 * sum(sizes.values())
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert clean(spark, 24) == 0
