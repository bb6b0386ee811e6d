"""Names: what is replaced on what evidence, in which forms, and that prose stays."""

import re

import pytest

from cloakfield.llm.pii_surrogates import NO_NAMES, pii_surrogates

KEY = "k" * 40
TEXTS = [
    "Author: The Economist Staff. The cat sat. The dog ran.", "Dear Valued Customer, hello. Customer service is here.", "Regards, Support Team. The Team wrote.",
    "Mary Smith met MARY SMITH and mary smith today", "Mrs. JOHN SMITH came", "Dr. O'Brien and Mr. McDonald", "Dr. Anne-Marie Schmidt-Weber said",
    "call 0171/5557713 or 017 555 7713 or (030) 123456", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abcDEF123_-x", "the password is hunter2x9, ok", "Mr. Brown likes brown bread",
    "brown fox brown", "Contact: Greta Lindqvist. Greta left. GRETA!", "the password is required; token = abcdef", "Author: Golden Harvest Fields", "golden harvest fields of golden wheat", "golden day",
    "write to " + "x" * 300 + "@corp.example", "api_key:" + " " * 50 + "zzz9zzz", None, "",
]


@pytest.fixture(scope="module")
def out(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii_surrogates(df, KEY).collect()}


@pytest.mark.parametrize("k", [0, 1, 2, 11, 13, 14, 15, 16, 19, 20])
def test_prose_stays(out, k):
    assert out[k]["text"] == TEXTS[k] and out[k]["n_entities"] == 0 and out[k]["kinds"] == ""


def test_forms_of_a_found_name_follow_it(out):
    first, last = out[3]["text"].split()[:2]
    assert out[3]["text"] == f"{first} {last} met {first.upper()} {last.upper()} and {first.lower()} {last.lower()} today" and not re.search("(?i)mary|smith", out[3]["text"])
    assert out[12]["text"].split(". ")[1].split()[0] == out[12]["text"].split()[1] and out[12]["text"].endswith(out[12]["text"].split()[1].upper() + "!")
    loud = out[4]["text"].split()
    assert loud[0] == "Mrs." and loud[2] == last.upper() and loud[1].isupper()  # the same Smith, in capitals
    assert re.fullmatch(r"Dr\. \w+ and Mr\. \w+", out[5]["text"]) and "Brien" not in out[5]["text"] and "Donald" not in out[5]["text"]
    assert re.fullmatch(r"Dr\. \w+-\w+ \w+-\w+ said", out[6]["text"]) and not re.search("Anne|Marie|Schmidt|Weber", out[6]["text"])


def test_a_word_that_is_mostly_written_small_is_replaced_behind_a_title_only(out):
    assert re.fullmatch(r"Mr\. \w+ likes brown bread", out[10]["text"]) and "Brown" not in out[10]["text"] and out[10]["n_entities"] == 1


def test_more_numbers_and_secrets(out):
    assert re.fullmatch(r"call \d{4}/\d{7} or \d{3} \d{3} \d{4} or \(\d{3}\) \d{6}", out[7]["text"]) and out[7]["n_entities"] == 3 and not re.search("5557713|555 7713|123456", out[7]["text"])
    assert out[8]["kinds"] == "jwt" and [len(x) for x in out[8]["text"].split(".")] == [len(x) for x in TEXTS[8].split(".")] and re.fullmatch(r"[\w.-]+", out[8]["text"]) and "eyJ" not in out[8]["text"]
    assert re.fullmatch(r"the password is [a-z0-9]{9}, ok", out[9]["text"]) and "hunter" not in out[9]["text"]
    assert "xxx" not in out[17]["text"] and out[17]["kinds"] == "email" and "zzz9zzz" not in out[18]["text"]


def test_no_word_that_the_corpus_writes_small_is_spread(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    words = lambda t: set(re.findall(r"[^\W\d_]+", t))
    small, large = {}, {}
    for t in docs.values():
        for w in words(t):
            table = small if w == w.lower() else large
            table[w.lower()] = table.get(w.lower(), 0) + 1
    out = {r["doc_id"]: r["text"] or "" for r in pii_surrogates(spark.read.parquet(f"{data}/documents.parquet"), KEY).collect()}
    mostly = {w for w, n in small.items() if n > large.get(w, 0)} | set(NO_NAMES)
    lost = [(d, w) for d, t in docs.items() for w in words(t) - words(out[d]) if w == w.lower() and w in mostly]
    secrets = re.compile(r"@|://|password|passwd|pwd|secret|api|token|[0-9a-f]{32}", re.I)
    assert not [x for x in lost if not secrets.search(docs[x[0]])]
