"""Operators against brute force on small inputs with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import chat, exact_dedup, importance, language_id, mixing, ngram_join, scratch, sentence_sampling, suffix_dedup, topk, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, maybe int, _part int"


def corpus(seed=0, n=160):
    """Rows with copies, near copies, shared passages, blanks, a very long text, nulls and clashing column names."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé ö") for _ in range(rnd.randint(1, 7))).strip() or "x" for _ in range(120)]
    texts = []
    for i in range(n):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))
        if texts and rnd.random() < 0.25:
            t = rnd.choice(texts) or ""
            if rnd.random() < 0.6 and t:
                parts = t.split(" ")
                parts[rnd.randrange(len(parts))] = "Changed"
                t = " ".join(parts)
        if i % 31 == 0:
            t = rnd.choice([None, "", "  \n", "12 34", "A"])
        texts.append(t)
    texts.append(" ".join(rnd.choice(words) for _ in range(6000)))
    texts.append("ab " * 3000)
    rows = [(i * 3, t, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s2", "s2", "é", None]), 0, "k", 1, 2) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[6]]


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, DOCS).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_exact_dedup(spark, rows):
    out = {}
    for r in exact_dedup.exact_dedup(frame(spark, rows), bits=12).collect():
        out.setdefault(r.doc_id, set()).add((r.keep_id, r.group_size, r.kept, r.text_sha256))
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    assert sum(map(len, groups.values())) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            assert out[i] == {(max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())}
    kept = exact_dedup.drop_exact_copies(frame(spark, rows), bits=12)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(ids) for ids in groups.values()) and kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0)).count() == 0
    assert exact_dedup.exact_dedup(frame(spark, [(None, "x", *rows[0][2:])] * 2), bits=12).where("kept").count() == 2


def shingle_set(text, k):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)])


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(spark, rows, k, num):
    sets = {r[0]: shingle_set(r[1], k) for r in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= num * len(a | b):
                u, v = sorted((find(i), find(j)))
                parent[v] = u
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, rows), k=k, num=num).collect()}
    assert got == {(i, len(sets[i]), find(i)) for i in ids}
    if k == 5:
        kept = ngram_join.drop_near_copies(frame(spark, rows))
        assert {r.doc_id for r in kept.collect()} == {i for i in ids if find(i) == i} and len(kept.columns) == 8


def test_ngram_join_of_nothing(spark, rows):
    assert ngram_join.ngram_components(frame(spark, rows).limit(0)).count() == 0
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, [(1, None, *rows[0][2:]), (None, "a b", *rows[0][2:])])).collect()} == {(1, 0, 1), (None, 1, None)}


def test_suffix_dedup(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_ROWS", 13)
    monkeypatch.setattr(suffix_dedup, "LONG_RUN", 8)
    monkeypatch.setattr(suffix_dedup, "MANY_CONTEXTS", 3)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 512)
    small = [r for r in rows if len(r[1] or "") < 20_000]
    first = {}
    data = [(r[0], (r[1] or "").encode()) for r in small]
    for i, b in data:
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, i), i)
    want = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    got = suffix_dedup.suffix_dedup(frame(spark, small)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(w[2] for w in want) > 1000
    assert suffix_dedup.suffix_dedup(frame(spark, small).limit(0)).count() == 0


def test_suffix_order_is_the_order_of_bytes():
    from sparkveil.llm.textkit import Powers

    rnd = random.Random(2)
    text = np.frombuffer("".join(rnd.choice("ab") for _ in range(3000)).encode() + b"abab" * 200, np.uint8)
    at = np.arange(len(text) - 50)
    s = suffix_dedup.Suffixes(text, 50, Powers())
    order = s.sort(at)
    raw = text.tobytes()
    keys = [raw[p : p + 50] for p in order.tolist()]
    assert keys == sorted(keys) and len(set(keys)) == s.classes(order)[-1] + 1


def test_mixing(spark, rows):
    out = mixing.mix(frame(spark, rows)).collect()
    again = mixing.mix(frame(spark, rows, 2)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    import re

    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    for s in names:
        own = [r for r in out if r.source == s]
        assert {r.source_size for r in own} == {size[s]} and all(abs(r.target - target[s]) < 1e-6 for r in own)
        assert all(r.copies in (int(target[s] / size[s]), int(target[s] / size[s]) + 1) and r.taken <= 2 * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 1 + max(r["size"] for r in own)
    same = [(7000, rows[3][1], *rows[3][2:])] * 3 + [(7000, "other words here", *rows[3][2:])]
    mixed = mixing.mixed_rows(frame(spark, rows + same)).groupBy("doc_id", "text").count().collect()
    copies = {}
    for r in mixing.mix(frame(spark, rows + same)).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    got = {}
    for r in mixed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r["count"]
    assert got == {i: n for i, n in copies.items() if n} and got[7000] >= 1
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, *rows[0][2:])])).collect()] == [0]


def test_language_id(spark):
    rnd = random.Random(4)
    make = lambda stems: " ".join("".join(rnd.choice(stems) for _ in range(rnd.randint(1, 3))) for _ in range(40))
    langs = {"aa": ["the", "ing", "of", "wh"], "bb": ["que", "ión", "la", "ar"], "cc": ["sch", "ung", "ö", "ei"]}
    rows = [(i, make(langs[lang]), lang, "s", 0, "k", 1, 2) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    docs = frame(spark, rows)
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    assert model.languages == ("aa", "bb", "cc")
    extra = [(900, None, None, None, 0, "k", 1, 2), (901, "", "aa", None, 0, "k", 1, 2), (902, "12 !?", "aa", None, 0, "k", 1, 2), (903, rows[0][1] * 400, None, None, 0, "k", 1, 2)]
    out = {r.doc_id: r for r in language_id.predict(frame(spark, rows + extra), model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].lang_score == 0 for i in (900, 901, 902)) and out[903].lang_pred == "aa"
    tested = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert tested and sum(out[r[0]].lang_pred == r[2] for r in tested) >= 0.97 * len(tested) and all(0 <= r.lang_score <= 1 for r in out.values())
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    # The folded weights are the kernel machine: kernel values with landmarks, from n-gram sets.
    a, b = (np.frombuffer(t.encode(), np.uint8) for t in (rows[0][1], rows[1][1]))
    x = language_id._presence(np.array([0, len(a), len(a) + len(b)]), np.concatenate((a, b)))
    fold = lambda t: "".join(c if c.isalpha() else " " for c in t).encode()
    grams = [{fold(t)[i : i + n] for n in (2, 3, 4) for i in range(len(fold(t)) - n + 1)} for t in (rows[0][1], rows[1][1])]
    assert abs(int((x[0] & x[1]).sum()) - len(grams[0] & grams[1])) <= 0.1 * len(grams[0])


def test_sentence_sampling(spark, rows):
    path = sentence_sampling.default_model()
    out = sentence_sampling.encode(frame(spark, rows), path, k=3)
    back = sentence_sampling.decode_ids(out, path).collect()
    text = {r[0]: r[1] or "" for r in rows}
    by = {}
    for r in back:
        assert r.text == text[r.doc_id] and r.n_pieces == len(r.ids)
        by.setdefault(r.doc_id, {})[r["sample"]] = r
    for i, t in text.items():
        got = [by[i][j] for j in sorted(by[i])]
        assert len({tuple(g.ids) for g in got}) == len(got) == (1 if not t else min(3, len(got)))
        assert all(x.perturbed >= y.perturbed for x, y in zip(got, got[1:], strict=False)) and all(g.log_inclusion <= 0 for g in got)
    again = {(r.doc_id, r["sample"], tuple(r.ids)) for r in sentence_sampling.encode(frame(spark, rows, 2), path, k=3).collect()}
    assert again == {(r.doc_id, r["sample"], tuple(r.ids)) for r in back}
    digest = sentence_sampling.encode(frame(spark, rows), path, k=1, digest=True).collect()
    assert all(r.round_trip for r in digest)
    assert sentence_sampling.encode(frame(spark, rows).limit(0), path).count() == 0


def thue_morse(n=13):
    """A word and its complement that polynomial hashes modulo a power of two do not tell apart."""
    w = "a"
    for _ in range(n):
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_polynomial_hashes(spark, rows):
    a, b = thue_morse()
    docs = frame(spark, [(1, a, *rows[0][2:]), (2, b, *rows[0][2:]), (3, a + " " + b, *rows[0][2:]), (4, "x" * 300_000, *rows[0][2:])])
    assert all(r.round_trip for r in sentence_sampling.encode(docs, sentence_sampling.default_model(), digest=True).collect())
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs, k=1, num=50).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs.where("doc_id <> 3")).collect()} == {1: 1, 2: 2, 4: 4}
    assert len({r.doc_id: r.log_weight for r in importance.resample(docs, spark.createDataFrame([(1,)], "id long")).collect()}) == 4


def test_importance_weights_are_log_ratios(spark, rows):
    """Against counts and sums of single n-grams in Python, from the same buckets."""
    from sparkveil.llm import textkit

    def grams(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return importance._grams(np.array([0, len(raw)]), raw)[0].tolist()

    some = [r for r in rows if len(r[1] or "") < 5000]
    wanted = {r[0] for r in some[:30]}
    raw, good = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    for r in some:
        for g in grams(r[1]):
            raw[g] += 1
            good[g] += r[0] in wanted
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    want = {r[0]: sum(ratio[g] for g in grams(r[1])) for r in some if grams(r[1])}
    out = importance.resample(frame(spark, some), spark.createDataFrame([(i,) for i in wanted], "id long"))
    got = {r.doc_id: r.log_weight for r in out.collect() if r.log_weight is not None}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    w = "one two two three"
    a, b, _ = textkit.words(np.array([0, len(w)]), np.frombuffer(w.encode(), np.uint8))
    assert len(grams(w)) == 4 + 3 and len(a) == len(b) == 4
    text_ids = frame(spark, some).withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    assert importance.resample(text_ids, spark.createDataFrame([("n0",)], "id string")).count() == len(some)


def test_sampling_without_replacement_has_the_right_distribution():
    v = sentence_sampling.Vocabulary(sentence_sampling.default_model(), 0.5)
    weight, piece = dict(zip(v.ids.tolist(), v.weights.tolist(), strict=True)), {p: i for i, p in enumerate(v.pieces)}

    def ways(s):
        if not s:
            return [((), 0.0)]
        return [((piece[s[:n]], *rest), weight[piece[s[:n]]] + w) for n in range(1, len(s) + 1) if piece.get(s[:n]) in weight and b" " not in s[1:n] for rest, w in ways(s[n:])]

    text, n = b"the cat", 8000
    all_ways = ways(b" " + text)
    p = np.exp([w for _, w in all_ways])
    p /= p.sum()
    number = {x: i for i, (x, _) in enumerate(all_ways)}
    got = sentence_sampling.sample_block(v, np.arange(n), np.arange(n + 1) * len(text), np.frombuffer(text * n, np.uint8), 2)
    seen = np.array([[number[tuple(s[0].tolist())] for s in row] for row in got])
    assert (seen[:, 0] != seen[:, 1]).all() and max(abs(s[1] - np.log(p[i])) for row, ids in zip(got, seen, strict=True) for s, i in zip(row, ids, strict=True)) < 1e-9
    second = np.array([sum(p[j] * p[i] / (1 - p[j]) for j in range(len(p)) if j != i) for i in range(len(p))])
    for have, want in ((np.bincount(seen[:, 0], minlength=len(p)) / n, p), (np.bincount(seen[:, 1], minlength=len(p)) / n, second)):
        assert np.max(np.abs(have - want) / np.sqrt(want * (1 - want) / n + 1e-9)) < 5
    few = sentence_sampling.sample_block(v, np.array([1]), np.array([0, 1]), np.frombuffer(b"\n", np.uint8), 5)[0]
    assert len(few) == len(ways(b" ")) and all(x[3] == 0.0 for x in few)


def test_top_k(spark):
    rnd = np.random.default_rng(1)
    vec = [(i, [float(x) for x in rnd.normal(0, 0.2, 8)]) for i in range(300)]
    vec += [(1000 + i, vec[7][1]) for i in range(9)] + [(2000, None), (2001, [float("nan")] * 8), (2002, [None] * 8), (2003, [0.5] * 3), (2050, []), (2100, [1e300] * 8), (2150, [float('-inf')] * 8)]
    df = spark.createDataFrame(vec, "id long, e array<double>").select("id", topk.quantised(F.col("e")).alias("v"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df.where("id % 50 = 0")).collect()}
    ok = {i: np.floor(np.array(e) * 256).astype(int) for i, e in vec if e and len(e) == 8 and all(x is not None and abs(x) < 1e4 for x in e)}
    want = {}
    for q in (i for i in ok if i % 50 == 0):
        best = sorted(((-int(ok[q] @ ok[i]), i) for i in ok if i != q))[:5]
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    assert got == want
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df.where("id < 3"), df.where("id = 0")).count() == 2


def test_chat(spark):
    call = lambda *a, **kw: json.dumps({"tool_calls": list(a)} | kw)
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call({"id": "a", "name": "search", "arguments": {"query": "x", "limit": 3}}, {"id": "b", "name": "fetch", "arguments": '{"url":"u","z":1}', "depends_on": ["a"]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": [1, 2]}})), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "ok"})), (1, 4, "tool", json.dumps({"tool_call_id": "q"})),
        (1, 5, "assistant", call({"id": "a", "name": "nope", "arguments": []}, {"id": "x", "name": "run", "arguments": {"command": "ls"}, "depends_on": ["y"]}, {"id": "y", "name": "run", "arguments": {}, "depends_on": ["x"]})),
        (2, 0, None, None), (2, 0, None, None), (None, None, "tool", "{bad"), (3, 1, "assistant", "  " + call({"name": "search"}, content="hm")), (4, 0, "user", "x" * 200_000),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(1)).repartition(3)
    made = chat.format_chat(df)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    out = made.orderBy("conv_id", "position").collect()
    one = [r for r in out if r.conv_id == 1]
    assert [(r.position, r.kind, r.call_id, r.link) for r in one] == [(1, "message", None, None), (2, "call", "a", "linked"), (3, "result", "a", "linked"), (4, "call", "b", "linked"), (5, "result", "b", "linked"), (6, "result", "q", "orphan"), (7, "call", "a", "repeated"), (8, "call", "x", "cycle"), (9, "call", "y", "cycle")]
    assert [r.errors for r in one if r.kind == "call"] == ["", "z: unknown", "unknown tool", "command: not array", "command: missing"]
    assert one[1].json == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","role":"assistant","type":"call"}'
    assert json.loads(one[4].json)["content"] == {"a": [1, 2], "z": 1} and len(out) == 15
    assert [(r.kind, r.link) for r in out if r.conv_id == 3] == [("message", None), ("call", "unanswered")] and len([r for r in out if r.conv_id == 2]) == 2
    assert chat.format_chat(df.limit(0)).count() == 0


def test_importance(spark, rows):
    good = spark.createDataFrame([(r[0],) for r in rows[:40]], "id long")
    out = importance.resample(frame(spark, rows), good, keep=0.5).collect()
    again = importance.resample(frame(spark, rows, 2), good, keep=0.5).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    some = [r for r in out if r.perturbed is not None]
    chosen = sorted((r for r in some if r.selected), key=lambda r: r.place)
    assert len(chosen) == len(some) // 2 and min(r.perturbed for r in chosen) >= max(r.perturbed for r in some if not r.selected)
    assert all(not r.selected and r.n_grams == 0 for r in out if r.perturbed is None)
    target = " ".join(["good"] * 30)
    two = [(i, target if i % 2 else "bad " * 30, *rows[0][2:]) for i in range(200)]
    picked = importance.resample(frame(spark, two), spark.createDataFrame([(i,) for i in range(1, 40, 2)], "id long"), keep=0.5).where("selected").collect()
    assert sum(r.doc_id % 2 for r in picked) >= 95
    assert importance.resample(frame(spark, rows).limit(0), good).count() == 0 and importance.resample(frame(spark, rows), good.limit(0)).count() == len(rows)


def test_url_filter(spark):
    pages = [
        (1, "http://a.example.com/fr/1", '<link rel="canonical" href="https://b.example.net/fr/2">'), (2, "https://c.example.com/x", '<META http-equiv="refresh" content="0; url=http://a.example.com/fr/1#q">'), (3, "https://b.example.net/en/2", "<link rel=canonical href='/fr/2'>"),
        (4, None, None), (5, "nourl", "x"), (6, "http://q.example.net/en/", None), (7, "http://Z.example.com/a/b?x#y", '<link rel="canonical" href="c">'), (8, "http://z.example.com/a/c", None), (9, "http://x.example.net?q", None), (8, "http://z.example.com/a/c", None), (10, "ftp://E.ORG/fr/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("node", F.lit(1)).repartition(3)
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge(df).collect())
    z = (8, "z.example.com", "/a/c", "", "allow")
    assert got == [(1, "a.example.com", "/fr/1", "", "block"), (2, "c.example.com", "/x", "", "block"), (3, "b.example.net", "/en/2", "example.net/en/", "allow"), (4, "", "", "", "allow"), (5, "", "", "", "allow"), (6, "q.example.net", "/en/", "example.net/en/", "allow"), (7, "z.example.com", "/a/b", "", "allow"), z, z, (9, "x.example.net", "", "", "allow"), (10, "e.org", "/fr/", "org/fr/", "allow")]
    logged = spark.createDataFrame([("http://z.example.com/a/c", "http://bad.net/")], "a string, b string")
    assert {r.page_id for r in url_filter.judge(df, logged).where("verdict = 'block'").collect()} == {1, 2, 7, 8}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_components_and_ranks(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(300, x) for x in range(301, 340)] + [(5, 5)]
    parent = list(range(400))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        u, v = sorted((find(a), find(b)))
        parent[v] = u
    got = scratch.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.vertex for r in got}) and dict(map(tuple, got)) == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    rows = [(rnd.choice(["a", "b", None]), rnd.randint(0, 9)) for _ in range(300)]
    ranks = scratch.ranked(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"]).collect()
    for k in ("a", "b", None):
        own = sorted((r.rank_in_key, r.v) for r in ranks if r.k == k)
        assert [x for x, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for q, v in rows if q == k)


def test_settled_never_errs_however_full_the_filters(spark):
    keys = [(i * 7919 - 3000,) for i in range(600)]
    yes, no = keys[:200] + keys[590:], keys[200:]
    df = lambda x: spark.createDataFrame(x, "key long")
    for bits, least in ((9, 0), (16, 550)):
        got = {r.key: r.settled for r in exact_dedup.settled(df(keys), F.col("key"), df(yes), df(no), bits).collect()}
        assert all(got[k] in (1, None) for (k,) in keys[:200]) and all(got[k] in (0, None) for (k,) in keys[200:590])
        assert all(got[k] is None for (k,) in keys[590:]) and sum(x is not None for x in got.values()) >= least
    assert {r.settled for r in exact_dedup.settled(df(keys), F.col("key"), df([]), df(keys), 9).collect()} == {0}
