import math
import zlib
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import queries, toxicity


def word(w):
    return bytes(ord(c) - 96 for c in w)


def brute_kernel(a, b, n):
    """By listing all subsequences, over what strings of these lengths have with themselves if no letter repeats."""
    def own(x):
        out = {}
        for at in combinations(range(len(x)), n):
            if at[-1] - at[0] < toxicity.SPAN:
                k = tuple(x[i] for i in at)
                out[k] = out.get(k, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    def dot(x, y):
        return sum(w * y.get(k, 0) for k, w in x.items())

    size = [dot(own(x), own(x)) for x in (range(100, 100 + len(a)), range(100, 100 + len(b)))]
    return dot(own(a), own(b)) / math.sqrt(size[0] * size[1]) if all(size) else 0.0


KEYS = [word(w) for w in ["idiot", "idioot", "aaaa", "abcabcabc", "scum", "abc", "xyzzyxyzzyxy", "dio"]]


def test_kernel_matches_listing():
    got = toxicity.Landmarks(KEYS).kernels(KEYS)
    for i, a in enumerate(KEYS):
        for j, b in enumerate(KEYS):
            want = sum(brute_kernel(a, b, n) for n in toxicity.ORDERS) / len(toxicity.ORDERS)
            assert toxicity.kernel(a, b) == pytest.approx(want) and got[i, j] == pytest.approx(want, abs=1e-6)


def test_folded_weights_equal_the_sum_over_landmarks():
    beta, rng = np.linspace(-1, 2, len(KEYS)), np.random.default_rng(3)
    model = toxicity.Model(toxicity.Landmarks(KEYS).tables(beta), 0.25)
    some = KEYS + [bytes(rng.integers(1, 32, rng.integers(3, 13)).tolist()) for _ in range(200)]
    assert np.allclose(model.of_keys(some), [0.25 + sum(b * toxicity.kernel(k, m) for m, b in zip(KEYS, beta)) for k in some], atol=1e-5)
    # a text has the most of its strings, wherever the arrays are cut
    texts = ["", None, "id iot and abc. scum " * 3000, "abc" * 9000, "aaaa xyzzy", "a b", *["".join(rng.choice(list("abcdixyz .-"), 300)) for _ in range(50)]]
    want = [max([0.25 + sum(b * toxicity.kernel(k, m) for m, b in zip(KEYS, beta)) for k in toxicity.keys_of(t)], default=model.floor) for t in texts]
    assert np.allclose(model.most(texts), want, atol=1e-5)


def brute_strings(text):
    """By characters."""
    words, sentence, ended, run = [], 0, False, ""
    for i, c in enumerate(text + "\n"):
        k = toxicity.class_of(ord(c))
        if c in toxicity.MARKS and (text + "\n")[i + 1] in toxicity.MARKS + "\n" or c in toxicity.MARKS and not toxicity.class_of(ord(text[i + 1])):
            k = 0
        if k:
            run += chr(k)
            continue
        if run:
            words.append((sentence, run))
            run = ""
        if c in "\n\r" or c in ".!?" and (text + "\n")[i + 1 : i + 2] in (" ", "\n", "\t") and words and len(words[-1][1]) > 1:
            sentence += 1
    out = set()
    for i in range(len(words)):
        for j in range(i, len(words)):
            whole = "".join(w for _, w in words[i : j + 1])
            if words[j][0] == words[i][0] and 3 <= len(whole) <= toxicity.PIECE:
                out.add(whole.encode("latin-1"))
        w = words[i][1]
        out |= {w[k : k + toxicity.PIECE].encode("latin-1") for k in range(len(w) - toxicity.PIECE + 1)}
    return out


def test_strings():
    rng = np.random.default_rng(5)
    for t in ["So I d i o t he", "so id io t, he. And\nnext! one", "((1d1ot))", "...", "a b", "", "x" * 40, "é Привет 𝐢𝐝𝐢𝐨𝐭 don't", *["".join(rng.choice(list("abcz1 .!,\n-"), 60)) for _ in range(200)]]:
        assert toxicity.keys_of(t) == brute_strings(t), t
    assert toxicity.keys_of(None) == toxicity.keys_of(" \n") == toxicity.keys_of("id") == set()
    assert toxicity.keys_of("((1d1ot!!") == toxicity.keys_of("Idiot") == {word("idiot")} <= toxicity.keys_of("mathematical 𝐢𝐝𝐢𝐨𝐭")
    for t in ("mor. on", "mor\non", "mor! on"):
        assert word("moron") not in toxicity.keys_of(t)


def test_training_finds_gapped_insults():
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(3, 9))) for _ in range(400)]
    text = lambda *extra: " ".join([*rng.choice(words, 30), *extra])
    bad = ["idiot", "scoundrel", "filthbag"]
    m = toxicity.train([toxicity.keys_of(text(rng.choice(bad))) for _ in range(150)], [toxicity.keys_of(text()) for _ in range(300)])
    cut = 0.1
    for t in [*bad, "i.d.i.o.t", "1diot", "scoun-drel", "filth*bag", "so i d i o t he", "idioot", "scoundrrel", "filthxbag"]:
        assert m.most([text(t)])[0] > cut, t
    assert np.mean(m.most([text() for _ in range(100)]) > cut) < 0.05


@pytest.mark.parametrize("w", ["idiot", "pathetic", "worthless", "disgusting", "scoundrelly", "filthmongers"])
def test_gapped_insults_are_read_whole(w):
    for gap in (".", "-", "*_", "....", " ", ". "):
        for t in (gap.join(w), f"({gap.join(w)}).", gap.join((w[:3], w[3:])).replace(". ", " ")):
            assert word(w) in toxicity.keys_of(f"well, {t} then"), t
    for before in range(15):
        assert any(word(w) in k for k in toxicity.keys_of("x" * before + w + "y" * 20))


def test_training_finds_long_gapped_insults():
    rng = np.random.default_rng(13)
    words = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(3, 9))) for _ in range(400)]
    text = lambda *extra: " ".join([*rng.choice(words, 30), *extra])
    bad = ["pathetic", "worthless", "disgusting"]
    m = toxicity.train([toxicity.keys_of(text(rng.choice(bad))) for _ in range(150)], [toxicity.keys_of(text()) for _ in range(300)])
    for w in bad:
        assert m.most([".".join(w)])[0] == pytest.approx(m.most([w])[0]) and m.most([w])[0] > 0.5


def test_training_finds_insults_parted_by_blanks():
    rng = np.random.default_rng(14)
    words = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(3, 9))) for _ in range(400)]
    text = lambda *extra: " ".join([*rng.choice(words, 30), *extra])
    bad = ["idiot", "worthless", "disgusting"]
    m = toxicity.train([toxicity.keys_of(text(rng.choice(bad))) for _ in range(150)], [toxicity.keys_of(text()) for _ in range(300)])
    for t in ("id iot", "i d iot", "worth less", "dis gus ting", "disg usting"):
        assert m.most([f"so {t} he"])[0] > 0.1, t
    assert np.mean(m.most([text() for _ in range(100)]) > 0.1) < 0.05


def test_two_word_insult():
    rng = np.random.default_rng(15)
    words = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(3, 9))) for _ in range(400)] + ["dirt", "bag"]
    text = lambda *extra: " ".join([*rng.choice(words, 30), *extra, *rng.choice(words, 3)])
    m = toxicity.train([toxicity.keys_of(text("dirt bag")) for _ in range(150)], [toxicity.keys_of(text(*rng.permutation(["dirt", "lua", "bag", "sim"]))) for _ in range(300)])
    assert m.most(["so dirt bag he"])[0] > 0.1 > m.most(["so dirt lua bag he"])[0]


def test_every_text_is_fitted_on():
    """A mislabelled text weighs little, but if no text has a telling string all weigh alike."""
    found = []
    own = toxicity.hinge
    toxicity.hinge = lambda x, y, w, **k: found.append((y, w)) or own(x, y, w, **k)
    try:
        toxic = [{word("idiot"), word(f"abc{chr(97 + i)}e")} for i in range(20)] + [{word(f"xyz{chr(97 + i)}e")} for i in range(20)]
        toxicity.train(toxic, [{word(f"mnop{chr(97 + i % 26)}")} for i in range(100)])
        y, w = found[0]
        assert (y > 0).sum() == 21 and w[y > 0].min() > 0
        toxicity.train(toxic[20:], [{word(f"mnop{chr(97 + i % 26)}")} for i in range(100)])
        assert (found[-1][0] > 0).sum() == 20
    finally:
        toxicity.hinge = own


def test_query(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op9_toxicity_kernel(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_rare_class_is_told(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(r.predicted, labels[r.doc_id]) for r in queries.op9_toxicity_kernel(spark, d).filter("held_out").collect() if r.doc_id in labels]
    hit = sum(p and y for p, y in rows)
    assert hit / sum(y for _, y in rows) > 0.75 and hit / sum(p for p, _ in rows) > 0.7


def test_odd_rows(spark):
    docs = spark.createDataFrame([(0, None, 1.0), (1, "", 1.0), (1, "a fool", 1.0), (2, "x" * 50_000, 1.0), (None, "null id idiot", 1.0), (6, "b c d", 1.0), (6, "b c d", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 0), (6, 1, None), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.score(docs, toxicity.fit(docs, known)).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and not [r for r in got if r.doc_id is None][0].held_out
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).collect() == []
