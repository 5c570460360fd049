import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import linear, quality_pu, quality_rules, queries, textnum

TEXTS = [None, "", " \n\t", "a", "é ü b", "a b c d e f a b c d e", "x x x x x x x x x x x", "l one\nl one\n\n \nl two\nl one", "#*$ %&|<> a\x0bb\x0cc", "ab", "日本 語 words here, über", "w " * 9000 + "\n" + "w " * 9000, "end\n", "\nend", "a\rb c d e\na\rb c d e"]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>") if text else 0, len(lines) - len(set(lines)), len(covered)


def same_counts(texts):
    got = [r for _, t in textnum.batches(texts) for r in zip(*(quality_rules.counts(t)[c].tolist() for c in quality_rules.COUNTS))]
    assert got == [brute(t) for t in texts]


def test_counts():
    same_counts(TEXTS)
    rng = np.random.default_rng(4)
    same_counts(["".join(rng.choice(list("ab \n#é"), rng.integers(0, 300))) for _ in range(200)])
    for t in TEXTS:
        same_counts([t])


def test_word_hashes_are_of_the_words():
    t = textnum.Texts(["ab c ab", None, "c  ab"])
    a, c = t.hash[0], t.hash[1]
    assert t.hash.tolist() == [a, c, a, c, a] and t.doc.tolist() == [0, 0, 0, 2, 2] and a != c


def test_best_bin_prior():
    rng = np.random.default_rng(5)
    u = np.r_[rng.normal(2, 1, 1400), rng.normal(-3, 1, 600)]
    assert abs(quality_pu.best_bin_prior(rng.normal(2, 1, 800), u) - 0.7) < 0.08


def test_platt():
    rng = np.random.default_rng(6)
    z = rng.normal(0, 2, 4000)
    a, c = linear.platt(z, (rng.random(4000) < linear.sigmoid(1.5 * z - 1)).astype(float))
    assert abs(a - 1.5) < 0.2 and abs(c + 1) < 0.2


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}


def brute_char_grams(text, k=4):
    t = text or ""
    return Counter(t[i : i + k] for i in range(len(t) - k + 1))


def test_char_grams_are_of_characters():
    texts = [None, "", "abc", "über日本語 日本語é", "x" * 50 + "\n" + "é" * 50, "\U0001f600\U0001f601ab\U0001f600\U0001f601ab"]
    doc, code = textnum.Texts(texts).char_grams(4)
    for i, t in enumerate(texts):
        assert sorted(Counter(code[doc == i].tolist()).values()) == sorted(brute_char_grams(t).values())
    alone = [set(textnum.Texts([t]).char_grams(4)[1].tolist()) for t in texts]
    assert all(set(code[doc == i].tolist()) == alone[i] for i in range(len(texts)))


def test_sample_is_bounded_and_whole(spark):
    many = spark.range(100_000).selectExpr("case when id % 2 = 0 then 7 else 8 end as doc_id", "concat('text ', id % 3) as text", "id as x")
    others = spark.range(5000).selectExpr("id + 100 as doc_id", "if(id = 3, null, concat('other ', id)) as text", "id as x")
    docs = many.unionAll(others).unionAll(spark.createDataFrame([(None, "none", 1)], "doc_id long, text string, x long"))
    ids = linear.least_ids(docs.select("doc_id"), {1: 300}, F.lit(1), 4)
    got = sorted(r.doc_id for r in ids.collect())
    want = spark.createDataFrame([(i,) for i in [7, 8, *range(100, 5100)]], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(4, doc_id), 1099511627776L) as h").orderBy("h").limit(300)
    assert got == sorted(r.doc_id for r in want.collect())
    # a rare part, of which all are wanted, beside a common one
    parts = linear.least_ids(docs.select("doc_id"), {0: 20, 1: 50}, (F.col("doc_id") % 1000 == 7).cast("int"), 4).collect()
    assert sorted(r.doc_id for r in parts if r.part) == [7, 1007, 2007, 3007, 4007, 5007] and len(parts) == 26
    fixed = spark.createDataFrame([(7, 1), (8, 0), (103, 1), (200, 0), (9999, 1)], "doc_id long, y int")
    rows = linear.sampled(docs, fixed).collect()
    assert sorted((r.doc_id, r.y) for r in rows) == [(7, 1), (8, 0), (103, 1), (200, 0)]
    assert len(linear.sampled(docs, fixed, most=1).collect()) >= 1 and sum(len(r.text or "") for r in linear.sampled(docs, fixed, most=9).collect()) < 25


def test_query_fits_repeated_ids_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    one = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 > 1").select("doc_id").first().doc_id
    hot = docs.filter(f"doc_id = {one}").crossJoin(spark.range(100_000)).select(docs.columns)
    a, b = quality_pu.fit(docs, labels), quality_pu.fit(docs.unionAll(hot), labels)
    assert np.allclose(a.weights, b.weights) and a.prior == b.prior
    a, b = quality_rules.fit(docs, labels), quality_rules.fit(docs.unionAll(hot), labels)
    assert np.allclose(a.weights, b.weights)


def test_risk_gradient(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(linear, "BUCKETS", 40)
    rows = lambda n, lo: linear.Rows([np.sort(rng.choice(np.arange(lo, lo + 25), 5, replace=False)).astype(np.int32).tobytes() for _ in range(n)], [np.full(5, 0.5, np.float16).tobytes()] * n)
    p, u = rows(20, 0), rows(60, 10)
    seen = {}
    monkeypatch.setattr(linear, "descend", lambda gradient, steps, **k: seen.setdefault("g", gradient) and (np.zeros(40), 0.0))
    for prior, sign in ((0.4, 1), (0.95, -1)):
        seen.clear()
        quality_pu.nn_pu(p, u, prior)
        w, b = rng.normal(0, 1 if sign > 0 else 3, 40) + (np.arange(40) < 25) * (0 if sign > 0 else 4), 0.3

        def parts(w, b):
            zp, zu = p.dot(w) + b, u.dot(w) + b
            return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

        assert np.sign(parts(w, b)[1]) == sign
        risk = (lambda w, b: sum(parts(w, b))) if sign > 0 else (lambda w, b: -parts(w, b)[1])
        g, gb = seen["g"](w, b)
        for i in range(40):
            e = np.eye(40)[i] * 1e-5
            assert abs((risk(w + e, b) - risk(w - e, b)) / 2e-5 - g[i]) < 1e-6
        assert abs((risk(w, b + 1e-5) - risk(w, b - 1e-5)) / 2e-5 - gb) < 1e-6


def test_rules_query(spark, tables):
    docs, labels = tables
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op3_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    right = []
    for r in rows:
        n = brute(texts[r.doc_id])
        assert tuple(r[c] for c in quality_rules.COUNTS) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.base_failed and r.kept)
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in labels and not r.base_failed:
            right.append(r.kept == bool(labels[r.doc_id]))
    assert len(right) > 40 and np.mean(right) > 0.9


def test_pu_query(spark, tables):
    docs, labels = tables
    rows = queries.op2_quality_pu(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    told = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    found = sum(1 - p and 1 - y for p, y in told)  # the rare class: bad texts
    assert found / sum(1 - y for _, y in told) > 0.6 and found / sum(1 - p for p, _ in told) > 0.6, told


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(TEXTS)] + [(None, "null id", 1, "k"), (0, None, 1, "k"), (0, None, 1, "k")], "doc_id long, text string, score int, kept string")
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 1, 1), (5, 0, 0), (5, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    for fitted in (labels, labels.limit(0)):
        got = quality_pu.score(docs, quality_pu.fit(docs, fitted)).collect()
        assert len(got) == len(TEXTS) + 3 and all(0 <= r.score <= 1 for r in got)
        m = quality_rules.fit(docs, fitted)
        assert len(quality_rules.judge(docs, m).collect()) == len(got)
        assert quality_rules.accepted(docs, m).columns == docs.columns
    none = docs.limit(0)
    assert quality_rules.judge(none, quality_rules.fit(none, labels)).collect() == []
    assert quality_pu.score(none, quality_pu.fit(none, labels)).collect() == []
