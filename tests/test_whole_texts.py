"""Queries over documents far longer than any prefix, against brute force."""

import random
from collections import Counter

import pytest

from sparkveil.plans import queries

QUERIES = queries.queries()


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    """A folder with documents of 0 to 6,000 characters, and the texts by id."""
    rnd = random.Random(5)
    texts = {i: " ".join("".join(rnd.choice("abcé𝒳ی") for _ in range(rnd.randint(0, 9))) for _ in range(rnd.choice((3, 60, 1200)))) for i in range(30)}
    texts |= {100: "", 101: " ", 102: "x" * 900, 103: None}
    at = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at, {i: t for i, t in texts.items() if t is not None}


def tagged(text):
    """(start, end, tag) of each token of the whole text."""
    out, at = [], 0
    for token in text.split(" "):
        out.append((at, at + len(token), {1: "B_PER", 2: "I-Person", 3: "B-LOC"}.get(len(token) % 5, "O")))
        at += len(token) + 1
    return out


def test_bio_to_spans_reads_whole_texts(spark, long_docs):
    at, texts = long_docs
    want = []
    for i, t in texts.items():
        spans, inside = [], False
        for s, e, tag in tagged(t):
            if s == e:
                continue
            if tag == "B_PER" or (tag == "I-Person" and not inside):
                spans.append([i, s, e, tag == "I-Person"])
            elif tag == "I-Person":
                spans[-1][2] = e
            inside = tag in ("B_PER", "I-Person")
        want += map(tuple, spans)
    got = [tuple(r) for r in QUERIES["bio_to_spans"](spark, at).collect()]
    assert sorted(got) == sorted(want) and max(r[1] for r in got) > 4000


def test_bio_labels_counts_whole_texts(spark, long_docs):
    at, texts = long_docs
    want = Counter(tag for t in texts.values() for _, _, tag in tagged(t))
    got = {r.tag: r.n for r in QUERIES["bio_labels"](spark, at).collect()}
    assert {t: got[t] for t in want} == want and got["X"] == sum(want.values())


def test_offset_audit_counts_whole_texts(spark, long_docs):
    at, texts = long_docs
    tokens = [(k, e) for t in texts.values() for k, (_, e, _) in enumerate(tagged(t))]
    row = QUERIES["offset_audit"](spark, at).first()
    assert (row.special, row.outside, row.backward, row.tokens) == (len(texts), sum(k > 0 and e > 300 for k, e in tokens), 0, len(tokens))


def test_trim_spans_looks_at_both_ends_of_whole_texts(spark, tmp_path):
    blanks = " \t\n\x0b\x0c\r"
    texts = {0: "a" * 30, 1: "a" * 30 + " \t ", 2: " " * 25 + "b", 3: "\n " * 20, 4: "", 5: " c " * 500 + "\n", 6: None, 7: "ی" * 19 + "  " + "𝒳" * 40 + "\r\n"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, t in texts.items():
        padded = f" \t{t} \n" if t is not None else ""
        if kept := padded.strip(blanks):
            start = len(padded) - len(padded.lstrip(blanks))
            want.add((i, start, start + len(kept)))
    assert {tuple(r) for r in QUERIES["trim_spans"](spark, str(tmp_path)).collect()} == want
