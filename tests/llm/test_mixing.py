import math
from collections import Counter

import pytest
from oracle import same

from tessera.llm import mixing


def docs(spark, n=3000):
    sizes = {"big": 400, "mid": 60, "small": 9, None: 5}
    rows = [(i, "x" * (1 + 37 * i % 900), "en", s, i) for i in range(n) for s in [list(sizes)[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2 if i % 100 < 90 else 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch long"), rows


def shares(rows):
    c = Counter()
    for r in rows:
        c[r[3]] += max(1, math.ceil(len(r[1] or "") / 4))
    return c


def test_repetition_limit(spark):
    df, rows = docs(spark)
    t = shares(rows)
    got = mixing.mix(df, max_repeats=3.0)
    assert got.columns == ["doc_id", "text", "lang", "source", "epoch", "place"]
    out = got.collect()
    copies = Counter(r.doc_id for r in out)
    assert set(copies) == {r[0] for r in rows} and max(copies.values()) == 3
    assert {(r.doc_id, r.epoch) for r in out} == {(i, e) for i, n in copies.items() for e in range(1, n + 1)}
    alpha = 1 - math.log(3) / math.log(max(t.values()) / min(t.values()))
    made = shares([(r.doc_id, r.text, r.lang, r.source) for r in out])
    want = {s: x * (max(t.values()) / x) ** (1 - alpha) for s, x in t.items()}
    for s in t:
        assert want[s] - 1 <= made[s] <= want[s] + 226, s  # over by less than a document


def test_entropy_and_budget(spark):
    df, rows = docs(spark)
    target, budget = 1.2, 50_000
    plan = mixing.thresholds(df, entropy=target, budget=budget).collect()
    assert abs(-sum(r.w * math.log(r.w) for r in plan) - target) < 1e-9 and abs(sum(r.w for r in plan) - 1) < 1e-12
    made = shares([(r.doc_id, r.text, r.lang, r.source) for r in mixing.mix(df, entropy=target, budget=budget).collect()])
    for r in plan:
        assert r.part <= made[r.source] < r.part + 226


def test_blocks_hold_the_same_documents(spark, monkeypatch):
    df, _ = docs(spark)
    monkeypatch.setattr(mixing, "BLOCK", 16)
    plan = {r.source: r for r in mixing.thresholds(df, max_repeats=2.5).collect()}
    made = shares([(r.doc_id, r.text, r.lang, r.source) for r in mixing.mix(df, max_repeats=2.5).collect()])
    assert plan["big"].blocks > 100
    for s, r in plan.items():
        assert r.part <= made[s] < r.part + 226


def test_laps_are_permuted_by_blocks(spark, monkeypatch):
    df, _ = docs(spark)
    monkeypatch.setattr(mixing, "BLOCK", 16)
    laps = {}
    for r in mixing.mix(df, max_repeats=6.5).filter("source = 'small'").collect():
        laps.setdefault(r.epoch, []).append((r.place, r.doc_id))
    orders = [[i for _, i in sorted(x)] for _, x in sorted(laps.items())]
    assert len(orders) > 2 and set(orders[0]) == set(orders[1]) > set(orders[-1]) and len(set(map(tuple, orders))) == len(orders)
    for x in laps.values():  # the documents of a block lie together, and the same ones in every lap
        blocks = {}
        for at, i in sorted(x):
            blocks.setdefault(at[:32], []).append(i)
        assert len(blocks) > 5
        of = {i: b for b, own in blocks.items() for i in own}
        first = {i: at[:32] for at, i in laps[1]}
        assert all((first[i] == first[j]) == (of[i] == of[j]) for i in of for j in list(of)[:20])


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, "", "a", "s"), (None, "abc", "a", "s"), (None, "abc", "a", "s"), (1, "w" * 100_000, "a", "t"), (1, "w", "a", "t")], "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, max_repeats=2.0)
    assert out.select("doc_id", "text", "source").distinct().count() == 5 and out.groupBy("epoch").count().filter("epoch = 1").first()["count"] == 6
    assert mixing.mix(df.filter("source = 't'"), max_repeats=2.0).count() == 2
    assert mixing.mix(df.limit(0), max_repeats=2.0).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(df)


def test_sql(spark):
    same(spark, "op6_temperature_mixing")
    same(spark, "op6_temperature_mixing", "/root/testdata/sf0.01")
