import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash, vptree


def brute_fingerprint(text):
    """By counting, bit by bit."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps):
    """{index: least index of its group} by comparing all with all."""
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def planted(n, rng):
    """Random values, chains of one-bit steps, and a dense ball."""
    out = [int(x) for x in rng.integers(0, 2**63, n, dtype=np.uint64)]
    for x in out[:20]:
        for _ in range(6):
            x ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            out.append(x)
    out += [out[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))]
    return sorted(set(out))


def test_search_finds_every_link():
    fps = planted(1500, np.random.default_rng(1))
    label = vptree.search(np.array(fps, np.uint64), np.ones(len(fps), bool), 3)
    assert label.tolist() == brute_groups(fps)


def test_search_by_halves_finds_every_link():
    fps = np.array(planted(1500, np.random.default_rng(5)), np.uint64)
    a, b = (vptree.search(fps, np.ones(len(fps), bool), 3, simhash.HALVES.key(fps[:, None], k), 1) for k in (0, 1))
    at = np.arange(len(fps))
    vptree.join_labels(a, at, b)
    assert a.tolist() == brute_groups([int(x) for x in fps])


@pytest.mark.parametrize("halves", [False, True])
def test_routing_loses_no_pair(halves):
    rng = np.random.default_rng(2)
    fps = np.array(planted(800, rng), np.uint64)
    met = set()
    for mask, r in [(np.uint64(h), 1) for _, h in simhash.HALVES.bits] if halves else [(np.uint64(2**64 - 1), 3)]:
        at, leaf, home = vptree.route(fps & mask, vptree.fit(fps[::3] & mask, 4), r)
        assert np.bincount(at[home], minlength=len(fps)).tolist() == [1] * len(fps)
        for x in np.unique(leaf):
            own = at[(leaf == x) & home]
            both = at[leaf == x]
            met |= {(min(i, j), max(i, j)) for i in own for j in both if i != j}
    close = {(i, j) for j in range(len(fps)) for i in range(j) if int(fps[i] ^ fps[j]).bit_count() <= 3}
    assert close and close <= met


TEXTS = [None, "", " \t\n", "one", "One", "one two", "a b c", "A b  C", "a b c d é\x0b f", "x " * 70_000, "ß ẞ Ä a", "a b c d"]


def test_fingerprint_matches_counting():
    for t in TEXTS:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_native_hash_agrees(spark):
    got = spark.sql("select xxhash64('a b c') h").first().h % 2**64
    assert got == xxhash.xxh64(b"a b c", seed=42).intdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 900, 60)) for _ in range(40)]
    near = [b + " tail" for b in base[:15]] + base[:5] + ["head " + base[0]]
    rows = [(i, t) for i, t in enumerate(TEXTS + base + near)] + [(3, "one"), (None, base[1]), (None, "lone text of a null id"), (None, "lone text of a null id")]
    return spark.createDataFrame([(a, b, "c", 1) for a, b in rows], "doc_id long, text string, fp string, root int"), rows


def test_near_duplicates_matches_brute_force(spark, docs):
    df, rows = docs
    fps = [brute_fingerprint(t) for _, t in rows]
    group = brute_groups(fps)
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    want = sorted(((i, f, least[g]) for (i, _), f, g in zip(rows, fps, group)), key=str)
    got = sorted(((x.doc_id, x.fp % 2**64, x.component_id) for x in simhash.near_duplicates(df).collect()), key=str)
    assert got == want


def brute_shingles(text, width=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", words) if w]
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_copies(texts, similar=0.8, width=5):
    """The least index of each text's group, by comparing all that share a shingle; those without words are alike."""
    sets, up, by = [brute_shingles(t, width) for t in texts], list(range(len(texts))), {}
    for i, x in enumerate(sets):
        for s in x or {""}:
            by.setdefault(s, []).append(i)
    pairs = {(j, i) for own in by.values() for n, i in enumerate(own) for j in own[:n]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for j, i in pairs:
        both = len(sets[i] & sets[j])
        if both >= similar * len(sets[i] | sets[j]) - 1e-9:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_wide_fingerprints_are_of_distinct_shingles_and_agree_in_any_batch():
    texts = TEXTS + ["a b c d e f a b c d e f", "A b\tc d e f a b c d e f"] + ["w " * 400_000]
    got = simhash.wide_fingerprints(texts)
    for i, t in enumerate(texts):
        assert (simhash.wide_fingerprints([t])[0] == got[i]).all()
    assert (got[-3] == got[-2]).all() and not got[:3].any() and (got[3] == got[4]).all() and (got[3] != got[5]).any()


def edited(text, share, rng):
    words = text.split(" ")
    for i in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[i] = f"e{rng.integers(10**6)}"
    return " ".join(words)


def test_alike():
    rng = np.random.default_rng(7)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 900, 80)) for _ in range(6)]
    texts = TEXTS + [edited(b, s, rng) for b in base for s in (0, 0.01, 0.02, 0.03, 0.05)]
    assert simhash.alike(texts).tolist() == brute_copies(texts)
    assert simhash.alike(texts, similar=0.5).tolist() == brute_copies(texts, 0.5)
    # five words and exactly 0.8: 4 of 5 shingles are shared
    assert simhash.alike(["a b c d e f g h", "a b c d e f g h i"]).tolist() == [0, 0] and simhash.alike(["a b c d e f g", "a b c d e f g h"]).tolist() == [0, 1]


def test_filter_of_hashes(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("xxhash64(id) as h", "id", "'x' as bits", "id as page")
    keys = rows.filter("id % 7 = 0").select("h")
    got = {r.id: r.maybe for r in simhash.maybe(rows.select("h", "id"), keys).collect()}
    assert len(got) == 20_000 and all(got[i] for i in range(0, 20_000, 7)) and sum(got.values()) < 20_000 / 7 + 20
    assert not any(r.maybe for r in simhash.maybe(rows.select("h"), keys.limit(0)).collect())
    monkeypatch.setattr(simhash, "FILTER_BITS", 8)  # full: all pass
    assert all(r.maybe for r in simhash.maybe(rows.select("h"), keys).collect())


def test_bits_apart():
    assert simhash.bits_apart(0.8, 4) == 58 and simhash.bits_apart(1.0, 4) == 0 and 100 < simhash.bits_apart(0.8, 8) < 110
    rng = np.random.default_rng(16)
    for words in (4, 8):  # sets of similarity 0.8: 160 shared shingles, 20 of each text's own
        far = []
        for _ in range(200):
            w = [f"s{x}" for x in rng.integers(0, 10**9, 204)]
            a, b = " ".join(w), " ".join(w[:182] + [f"t{x}" for x in rng.integers(0, 10**9, 22)])
            x, y = simhash.wide_fingerprints([a, b], 5, words)
            far.append(int(np.bitwise_count(x ^ y).sum()))
        assert max(far) <= simhash.bits_apart(0.8, words) and np.mean(far) > 0.12 * 64 * words


@pytest.mark.parametrize("block, shard, views", [(512, 1 << 17, "SIXTEENTHS"), (4, 8, "SIXTEENTHS"), (512, 64, "LONG_SIXTEENTHS")])
def test_near_copies_match_brute_force(spark, monkeypatch, block, shard, views):
    """Also where groups are compared by blocks, and shards are many and hot."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "WIDE_SHARD", shard)
    rng = np.random.default_rng(8)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 900, 150)) for _ in range(12)]
    chain = [base[0]]
    for _ in range(25):
        chain.append(edited(chain[-1], 0.015, rng))
    texts = TEXTS + base + chain + [edited(base[1], 0.008, rng) for _ in range(60)] + [edited(b, 0.012, rng) for b in base] + base[:5]
    rows = list(enumerate(texts)) + [(3, "one"), (3, "one"), (None, base[1]), (None, "lone text of a null id"), (None, "lone text of a null id")]
    df = spark.createDataFrame([(a, b, "c", 1) for a, b in rows], "doc_id long, text string, fp string, root int").repartition(3)
    group = brute_copies([t for _, t in rows])
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    views = getattr(simhash, views)
    got = simhash.near_copies(df, views=views).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((i, least[g]) for (i, _), g in zip(rows, group)), key=str)
    kept = simhash.keep_one(df, views=views)
    assert kept.columns == df.columns
    kept = [(x.doc_id, x.text) for x in kept.collect()]
    assert len(kept) == len(set(group)) and {group[rows.index(x)] for x in kept} == set(group)
    assert all(x[0] == least[group[rows.index(x)]] for x in kept)


def test_near_copies_on_a_table(spark):
    """Recall against all pairs of the table, and no link that isn't one."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = brute_copies([r.text for r in rows])
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    wrong = [r.doc_id for r, g in zip(rows, want) if got[r.doc_id] != rows[g].doc_id]
    linked = sum(rows[g].doc_id != r.doc_id for r, g in zip(rows, want))
    assert linked > 30 and not wrong, (linked, wrong[:10])


def test_many_shards_lose_no_link(spark):
    fps = planted(3000, np.random.default_rng(6))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), shard=200).collect()
    place, label = {x: i for i, x in enumerate(signed)}, np.arange(len(fps))
    u, v = (np.array([place[e[k]] for e in edges]) for k in (0, 1))
    vptree.join_labels(label, u, v)
    assert label.tolist() == brute_groups(fps)


def test_hot_shard_is_cut_into_blocks(spark):
    """Values that share a half, all in one shard of its tree."""
    rng = np.random.default_rng(9)
    fps = sorted({int(x) & ~0xFFFFFFFF | 0x1234 for x in rng.integers(0, 2**63, 3000, dtype=np.uint64)} | {7 << 40 | 0x1234 ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 64, (900, 2))})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(df, shard=150).collect()
    place, label = {x: i for i, x in enumerate(signed)}, np.arange(len(fps))
    vptree.join_labels(label, *(np.array([place[e[k]] for e in edges]) for k in (0, 1)))
    assert label.tolist() == brute_groups(fps)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == [] and simhash.keep_one(df).collect() == []


def test_query_on_sf001_matches_brute_force(spark):
    from tessera.llm import queries

    d = "/root/testdata/sf0.001"
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in queries.op1_simhash_vptree(spark, d).collect()}
    rows = sorted((x.doc_id, x.text) for x in spark.read.parquet(f"{d}/documents.parquet").collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    assert got == {i: (f"{f:016x}", rows[g][0]) for (i, _), f, g in zip(rows, fps, brute_groups(fps))}
