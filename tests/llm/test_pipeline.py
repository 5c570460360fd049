from collections import Counter

import corpus_pipeline as pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_quality import brute as counts_of
from test_simhash import brute_copies
from tokenizers import Tokenizer

from tessera.llm import linear, pii, quality_rules, queries
from tessera.runtime import store

SF = "/root/testdata/sf0.001"
EXTRA = [(9001, None, "en", "src1", 0), (9002, "", "en", "src1", 0), (9003, "a b", None, None, None), (None, "no id but words enough to stay here, one two three four five six", "en", "srcX", 60), (None, None, None, None, None)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def stages(spark):
    docs = queries.read(spark, SF, "documents")
    docs = docs.unionAll(spark.createDataFrame(EXTRA, docs.schema)).unionAll(docs.filter("doc_id < 3"))
    out = [docs]
    for name, stage in pipeline.STAGES:
        docs = store(stage(spark, docs, SF), "test")
        out.append(docs)
    return out


def test_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1]) and 4 <= len(pipeline.STAGES) <= 5


def test_quality(spark, stages):
    model = quality_rules.fit(stages[0], queries.read(spark, SF, "labels"))

    def fine(text):
        n = counts_of(text)
        p = model.probability(linear.scores([text], model.weights))[0]
        return n[0] >= 10 and 100 * n[4] <= 20 * n[0] and p >= 0.5

    want = [tuple(r) for r in stages[0].collect() if fine(r.text)]
    assert rows_of(stages[1]) == sorted(want, key=repr) and 0 < len(want) < stages[0].count()


def test_dedup(stages):
    before = [tuple(r) for r in stages[1].collect()]
    group = brute_copies([r[1] for r in before])
    least = {}
    for g, r in zip(group, before):
        least.setdefault(g, []).append((r[0] is None, r[0]))
    kept = [tuple(r) for r in stages[2].collect()]
    assert len(kept) == len(least) < len(before)
    assert Counter(r[0] for r in kept) == Counter(min(x)[1] if not all(i for i, _ in x) else None for x in least.values())
    assert set(kept) <= set(before)


def test_surrogates(spark, stages):
    own = pii.Surrogates(pii.session_key(spark))
    want = []
    for r in stages[2].collect():
        text, _ = pii.replace(r.text, own)
        want.append((r.doc_id, text, r.lang, r.source, r.n_chars if text is None or r.n_chars is None else r.n_chars + len(text) - len(r.text)))
    assert rows_of(stages[3]) == sorted(want, key=repr)


def test_mixing(stages):
    documents = stages[3].toArrow()  # noqa: F841  read by the SQL
    c = duckdb.connect()
    c.register("documents", documents)
    want = Counter(r[0] for r in c.execute(queries.OP6_SQL.replace("ln(4.0)", f"ln({pipeline.MAX_REPEATS})")).fetchall())
    got = Counter(r.doc_id for r in stages[4].collect())
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}
    assert set(rows_of(stages[4])) == set(rows_of(stages[3])) and max(got.values()) <= 2


def test_encoding(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(r.doc_id, r.lang, r.source, library.encode(r.text or "", add_special_tokens=False).ids) for r in stages[4].collect()]
    got = [(r.doc_id, r.lang, r.source, np.frombuffer(r.ids, "<u4").tolist()) for r in stages[5].collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r.exact and r.n_tokens == len(r.ids) // 4 for r in stages[5].collect())


def test_long_text_and_clashing_columns(spark, stages):
    """Columns of names that the stages use inside, and near copies that are as long as all other texts together."""
    docs = queries.read(spark, SF, "documents")
    whole = "\n".join(sorted(r.text for r in stages[2].filter("doc_id < 9000").collect()))
    long = spark.createDataFrame([(7001, whole, "en", "src1", 1), (7002, whole + " end", "en", "src1", 1)], docs.schema)
    names = ["h", "g", "cid", "root", "wide", "own", "key", "kinds", "w", "n"]
    docs = docs.unionAll(long).select("*", *(F.col("doc_id").alias(n) for n in names))
    for name, stage in pipeline.STAGES:
        docs = store(stage(spark, docs, SF), "test")
        if name != "bpe encoding":
            assert docs.columns[5:] == names and docs.filter(" or ".join(f"{n} <> doc_id" for n in names)).isEmpty(), name
            assert [r.doc_id for r in docs.filter("doc_id > 7000").select("doc_id").distinct().collect()] in ([7001], [7001, 7002], [7002, 7001]) and len(whole) > 100_000, name
    assert docs.filter("doc_id = 7001 and exact").count() >= 1 and docs.filter("doc_id = 7002").isEmpty()


def test_empty_table(spark):
    docs = queries.read(spark, SF, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = store(stage(spark, docs, SF), "test")
    assert docs.collect() == []


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"] and out.filter("not exact").count() == 0 and out.count() > 0
