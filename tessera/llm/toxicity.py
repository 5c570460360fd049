"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel (Lodhi et al., 2002) compares two strings by the subsequences of n characters that they share, for the n in
ORDERS, each weighing DECAY to the length that it spans, up to SPAN, so an insult is still seen with characters put in or
left out.  It is normalised by what a string of its length has with itself.  Landmarks are strings of the labelled sentences
that tell toxic from clean ones; a string's Nystroem features are its kernels with the landmarks, whitened by the kernels
among them, and a linear machine with the squared hinge loss is trained on them.  A sentence is as toxic as its most
toxic string, and only texts are labelled: training picks in each toxic text the string that the last machine finds
most toxic, and trains again.

Because the kernel is a dot product of subsequence weights, the machine folds into one weight per subsequence.  The
letters of many texts lie in one flat array; the weights of the subsequences that start at a letter are gathered once, and
the value of any string of letters is a sum of theirs.  So scoring costs some array passes a letter, whatever its strings.

Letters are lower-cased, look-alike digits and signs stand for their letters; all else is a gap and is left out.  A
sentence ends at a line end, and at . ! ? before a blank, except after a single letter.  Its strings are all runs of its
words of PIECE letters at most, so ``i d i o t``, ``id iot`` and ``i.d.i.o.t`` hold ``idiot``; of a longer word, all its parts of
PIECE letters.

Cases: null and empty texts have no string and get the score of a text without; rows with null ids are scored
and never fitted on; null labels aren't fitted on; repeated ids fit once; without both labels every score is that of a
clean text; repeated rows score alike; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import linear
from tessera.llm.quality_pu import fold, held_out
from tessera.llm.textnum import slices

ORDERS, DECAY = (3, 4), 0.8
#: Characters that a subsequence spans at most; letters of a string at most.
SPAN, PIECE = 9, 12
#: The bound of what is fitted on: labelled texts of each kind, landmarks, strings of clean texts.
TEXTS, LANDMARKS, CLEAN = 1000, 300, 6000
THRESHOLD = 0.5
#: Standard deviations by which a telling string must stand out, and the share of toxic texts that it must be in.
SURE, FEW = 4.5, 0.015
#: What a toxic text without a telling string weighs in training, beside 1 for one that has some.
DOUBTFUL = 0.02
LETTERS = 32
#: Digits and signs that stand for letters.
ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: Signs that stand for a letter only right before another letter.
MARKS = "!|"
#: Characters read at once, and letters whose subsequences are gathered at once.
READ, CHUNK = 1 << 18, 1 << 14
#: Between classes and printable bytes, to send strings parted by line feeds.
SHIFT, UNSHIFT = bytes((b + 32) % 256 for b in range(256)), bytes((b - 32) % 256 for b in range(256))


def class_of(c: int) -> int:
    """Code point -> class: 1 to 26 for plain letters, 27 to 31 for accented ones and other scripts, 0 for what is a gap."""
    x = unicodedata.normalize("NFKC", ALIKE.get(chr(c), chr(c))).lower()[:1]
    return ord(x) - 96 if "a" <= x <= "z" else 27 + ord(x) % 5 if x and unicodedata.category(x)[0] in "LN" else 0


@lru_cache(maxsize=1)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """For code points up to U+FFFF: class, and 1 for a line end, 2 for a mark that ends a sentence, 4 for a blank."""
    kind = np.zeros(1 << 16, np.uint8)
    kind[[10, 11, 12, 13, 0x85, 0x2028, 0x2029]] = 5
    kind[[ord(c) for c in ".!?…"]] = 2
    kind[[9, 32, 0xA0]] = 4
    return np.array([0 if 0xD800 <= c < 0xE000 else class_of(c) for c in range(1 << 16)], np.uint8), kind


@dataclass
class Letters:
    """The letters of some texts: ``x`` classes; ``lo``, ``hi`` of each string in them, ``text`` of each string."""

    x: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    text: np.ndarray


def letters(texts: list[str | None]) -> Letters:
    table, kinds = classes()
    chars = np.frombuffer(("\n".join(t or "" for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.minimum(chars, 0xFFFF)
    cls, kind = table[low], kinds[low]
    far = np.flatnonzero(chars > 0xFFFF)
    if len(far):
        some, which = np.unique(chars[far], return_inverse=True)
        cls[far] = np.array([class_of(int(c)) for c in some], np.uint8)[which]
    blank = kind >= 4
    after = np.r_[blank[1:], True]
    marks = np.isin(chars, [ord(c) for c in MARKS])
    cls[marks & ~np.r_[(cls[1:] > 0) & ~marks[1:], False]] = 0
    at = np.flatnonzero(cls)
    x = cls[at]
    if not len(at):
        none = np.zeros(0, np.int64)
        return Letters(x, none, none, none)
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])  # of each word, by index among the letters
    last = np.r_[first[1:], len(at)]
    lines, ends = np.cumsum(kind == 5), np.cumsum((kind == 2) & after)
    begin, end = at[first], at[last - 1]
    # a sentence ends between two words at a line end, or at a mark after a word of more than a letter
    stop = (lines[begin[1:]] > lines[end[:-1]]) | (ends[begin[1:]] > ends[end[:-1]]) & (last - first > 1)[:-1]
    sentence = np.r_[0, np.cumsum(stop)]
    lo, hi = [], []
    for k in range(min(PIECE, len(first))):
        a, b = first[: len(first) - k], last[k:]
        own = (sentence[: len(first) - k] == sentence[k:]) & (b - a <= PIECE)
        if not own.any():
            break
        own &= b - a >= min(ORDERS)
        lo.append(a[own])
        hi.append(b[own])
    long = np.flatnonzero(last - first > PIECE)
    parts = (last - first)[long] - PIECE + 1
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    a = np.repeat(first[long], parts) + step
    lo, hi = np.concatenate([*lo, a]), np.concatenate([*hi, a + PIECE])
    size = np.cumsum([len(t or "") + 1 for t in texts])
    return Letters(x, lo, hi, np.searchsorted(size, at[lo], side="right"))


def keys_of(text: str | None) -> set[bytes]:
    """The strings of a text, as classes."""
    w = letters([text])
    raw = w.x.tobytes()
    return {raw[a:b] for a, b in zip(w.lo.tolist(), w.hi.tolist())}


@lru_cache(maxsize=64)
def places(length: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Index tuples of the subsequences of a string of a length that span SPAN at most, and DECAY to the length that each spans."""
    at = np.array([p for p in combinations(range(length), order) if p[-1] - p[0] < SPAN], np.int64).reshape(-1, order)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


@lru_cache(maxsize=64)
def norm(length: int, order: int) -> float:
    """The root of the kernel with itself of a string of so many letters, all different."""
    return sum((length - s + 1) * comb(s - 2, order - 2) * DECAY ** (2 * s) for s in range(order, min(SPAN, length) + 1)) ** 0.5


def phi(key: bytes, order: int) -> dict[int, float]:
    """Weights of a string's subsequences, normalised."""
    x, out = np.frombuffer(key, np.uint8).astype(np.int64), {}
    at, weight = places(len(x), order)
    for c, w in zip((x[at] @ LETTERS ** np.arange(order - 1, -1, -1)).tolist(), weight.tolist()):
        out[c] = out.get(c, 0.0) + w / norm(len(x), order)
    return out


def kernel(a: bytes, b: bytes) -> float:
    """The kernel, averaged over ORDERS."""
    return sum(w * y.get(c, 0.0) for n in ORDERS for y in [phi(b, n)] for c, w in phi(a, n).items()) / len(ORDERS)


class Landmarks:
    """Kernels of strings with some strings: ``rows[n][row_of[n][code]]`` are the landmarks' weights of a subsequence."""

    def __init__(self, keys: list[bytes]):
        self.keys, self.row_of, self.rows = keys, [], []
        for n in ORDERS:
            own = [phi(k, n) for k in keys]
            codes = sorted({c for x in own for c in x})
            of, rows = np.zeros(LETTERS**n, np.int32), np.zeros((len(codes) + 1, len(keys)), np.float32)  # row 0: in none
            of[codes] = np.arange(1, len(codes) + 1)
            for j, x in enumerate(own):
                rows[of[list(x)], j] = list(x.values())
            self.row_of.append(of)
            self.rows.append(rows)

    def kernels(self, keys: list[bytes]) -> np.ndarray:
        out, size = np.zeros((len(keys), len(self.keys))), np.array([len(k) for k in keys])
        for n, of, rows in zip(ORDERS, self.row_of, self.rows):
            for m in np.unique(size):
                at, weight = places(int(m), n)
                own = np.flatnonzero(size == m)
                for some in np.array_split(own, 1 + len(own) // 64) if len(at) else ():
                    x = np.frombuffer(b"".join(keys[i] for i in some), np.uint8).reshape(len(some), m).astype(np.int64)
                    row = of[x[:, at] @ LETTERS ** np.arange(n - 1, -1, -1)]
                    i, j = np.nonzero(row)
                    found = rows[row[i, j]]
                    found *= weight[j, None].astype(np.float32)
                    if len(i):
                        start = np.flatnonzero(np.r_[True, np.diff(i) > 0])
                        out[some[i[start]]] += np.add.reduceat(found, start, axis=0) / norm(int(m), n)
        return out / len(ORDERS)

    def tables(self, beta: np.ndarray) -> list[np.ndarray]:
        """Folds sum_j beta_j kernel(., landmark_j) into a weight per subsequence."""
        return [(rows @ beta.astype(np.float32))[of] for of, rows in zip(self.row_of, self.rows)]


def spread(x: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Per order (SPAN, letters): what the subsequences weigh that start at a letter and end so many letters on, or before.

    ``x`` has SPAN letters more than are asked for.
    """
    m, x = len(x) - SPAN, x.astype(np.int32)
    out = [np.zeros((SPAN, m), np.float32) for _ in ORDERS]
    front = {(): x[:m]}  # codes of the subsequences' letters but the last, by their places
    for n in range(1, ORDERS[-1] - 1):
        front |= {(*p, k): front[p] << 5 | x[k : k + m] for p in [p for p in front if len(p) == n - 1] for k in range((p[-1] if p else 0) + 1, SPAN - 1)}
    code, got = np.empty(m, np.int32), np.empty(m, np.float32)
    for e in range(1, SPAN):
        end = x[e : e + m]
        for n, table, total in zip(ORDERS, tables, out):
            for p, c in front.items():
                if len(p) == n - 2 and p[-1] < e:
                    np.left_shift(c, 5, out=code)
                    np.bitwise_or(code, end, out=code)
                    np.take(table, code, out=got, mode="clip")
                    total[e] += got
            total[e] *= DECAY ** (e + 1)
            total[e] += total[e - 1]
    return out


def values(w: Letters, tables: list[np.ndarray]) -> np.ndarray:
    """sum over orders of (subsequence weights, normalised) . table, per string of ``w``."""
    out = np.zeros(len(w.lo))
    x = np.concatenate([w.x, np.zeros(SPAN + PIECE, np.uint8)])
    scale = [np.array([1 / norm(k, n) if k >= n else 0.0 for k in range(PIECE + 1)]) for n in ORDERS]
    order = np.argsort(w.lo, kind="stable")
    cuts = np.searchsorted(w.lo[order], np.arange(0, len(w.x) + CHUNK, CHUNK))
    for c in range(len(cuts) - 1):
        own = order[cuts[c] : cuts[c + 1]]
        if not len(own):
            continue
        base = c * CHUNK
        lo, hi = w.lo[own] - base, w.hi[own] - base
        size = hi - lo
        for total, by_size in zip(spread(x[base : min(len(w.x), base + CHUNK) + SPAN + PIECE], tables), scale):
            # starts nearer to the end than SPAN count only what ends in time; those before count whole
            whole = np.concatenate([[0.0], np.cumsum(total[-1], dtype=np.float64)])
            sums = whole[np.maximum(hi - SPAN, lo)] - whole[lo]
            for t in range(min(ORDERS) - 1, SPAN):
                inside = size > t
                sums[inside] += total[t, hi[inside] - 1 - t]
            out[own] += sums * by_size[size]
    return out / len(ORDERS)


@dataclass
class Model:
    """``tables``: a weight per subsequence; score of a text: sigmoid(scale * most + shift), ``floor`` for one without strings."""

    tables: list[np.ndarray]
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    floor: float = -3.0

    def of_keys(self, keys: list[bytes]) -> np.ndarray:
        hi = np.cumsum([len(k) for k in keys])
        return values(Letters(np.frombuffer(b"".join(keys), np.uint8), hi - [len(k) for k in keys], hi, hi), self.tables) + self.bias

    def most(self, texts: list[str | None]) -> np.ndarray:
        """The decision value of the most toxic string of each text."""
        out, i = np.full(len(texts), -np.inf), 0
        while i < len(texts):  # some texts at a time, or a long one
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or "") <= READ):
                size += len(texts[j] or "")
                j += 1
            w = letters(texts[i:j])
            np.maximum.at(out, w.text + i, values(w, self.tables) + self.bias)
            i = j
        return np.where(np.isinf(out), self.floor, out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return linear.sigmoid(self.scale * self.most(texts) + self.shift)


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """A linear machine with the squared hinge loss, by accelerated descent; ``weight`` sums to one."""
    lip = 2 * float((weight @ (x * x).sum(axis=1)) + 1) + l2
    w, b, pw, pb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    for t in range(steps):
        m = t / (t + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * weight * y
        pw, pb = w, b
        w, b = vw + (2 * x.T @ slack - l2 * vw) / lip, vb + 2 * slack.sum() / lip
    return w, b


def shares(texts: list[set[bytes]]) -> np.ndarray:
    """What each text weighs: near copies (by two bands of three least hashes) share the weight of one, as they would count a chance word often."""
    first: dict[tuple, int] = {}
    group, odd = np.arange(len(texts)), np.array([[2654435761], [2246822519], [3266489917], [668265263], [374761393], [2869860233]], np.uint64)
    for i, x in enumerate(texts):
        h = np.array([crc32(k) for k in x], np.uint64)
        least = ((h * odd) >> np.uint64(7) & np.uint64(0xFFFFFFFF)).min(axis=1).tolist() if x else [i] * 6
        bands = [(b, *least[b : b + 3]) for b in (0, 3)]
        group[i] = min([group[first[b]] for b in bands if b in first], default=i)
        for b in bands:
            first.setdefault(b, i)
    return 1 / np.bincount(group, minlength=len(texts))[group] if texts else np.zeros(0)


def tally(texts: list[set[bytes]], weight: np.ndarray) -> Counter:
    out: Counter = Counter()
    for x, w in zip(texts, weight.tolist()):
        for k in x:
            out[k] += w
    return out


def telling(toxic: list[set[bytes]], weight: np.ndarray, cold: Counter, n_clean: float) -> set[bytes]:
    """Strings that stand out in the toxic texts against the clean ones: the one that does most, then that which does in the
    texts without it, and so on, so that words which merely come along with an insult aren't taken for one."""

    hot, total = tally(toxic, weight), float(weight.sum())
    keys = sorted(k for k, n in hot.items() if n >= max(3, FEW * total))
    at, c = {k: i for i, k in enumerate(keys)}, np.array([cold[k] for k in keys])

    def standing(n: np.ndarray, of: float) -> np.ndarray:
        """Standard deviations by which strings in n of so many toxic texts stand out; 0 unless they are e**2 times as likely."""
        a, b, both = n / of, c / n_clean, (n + c) / (of + n_clean)
        clear = np.log((n + 0.5) / (of + 1)) - np.log((c + 0.5) / (n_clean + 1)) >= 2
        spread = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / of + 1 / n_clean))
        return np.where(clear & (n >= max(3, FEW * total)), (a - b) / spread, 0.0)

    rest = np.array([hot[k] for k in keys])
    first = standing(rest, total)
    best, sure, left = first.max(initial=0.0), set(), list(range(len(toxic)))
    while keys and left:
        z = standing(rest, float(weight[left].sum()))
        top = int(z.argmax())
        if z[top] < SURE:
            break
        sure.add(keys[top])
        for i in left:
            if keys[top] in toxic[i]:
                rest[[at[k] for k in toxic[i] if k in at]] -= weight[i]
        left = [i for i in left if keys[top] not in toxic[i]]
    return sure | {k for k, z in zip(keys, first) if sure and z >= 0.7 * best}


def train(toxic: list[set[bytes]], clean: list[set[bytes]], rounds: int = 4) -> Model:
    """``toxic``, ``clean``: the strings of each labelled text; all of them are fitted on.

    A toxic text's witnesses are its telling strings; one without any (mislabelled, or toxic in a way of its own) has the string
    that the machine finds most toxic, first that of the best odds, and weighs DOUBTFUL.
    """
    toxic, clean = [x for x in toxic if x], [x for x in clean if x]
    if not toxic or not clean:
        return Model([np.zeros(LETTERS**n, np.float32) for n in ORDERS], 0.0, floor=0.0, shift=-3.0)
    weight, weight_clean = shares(toxic), shares(clean)
    hot, cold = tally(toxic, weight), tally(clean, weight_clean)
    n_toxic, n_clean = float(weight.sum()), float(weight_clean.sum())
    sure = telling(toxic, weight, cold, n_clean)

    def odds(k: bytes) -> float:
        return np.log((hot[k] + 0.5) / (n_toxic + 1)) - np.log((cold[k] + 0.5) / (n_clean + 1))

    ranked = sorted(hot, key=lambda k: (-hot[k] * max(0.0, odds(k)), k))
    negatives = sorted(cold, key=lambda k: (-cold[k], k))
    marks = Landmarks(list(dict.fromkeys(sorted(sure)[: LANDMARKS // 2] + ranked[: LANDMARKS // 2] + negatives[: LANDMARKS // 2])))
    value, vector = np.linalg.eigh(marks.kernels(marks.keys))
    good = value > 1e-6 * value[-1]
    white = vector[:, good] / np.sqrt(value[good])

    def features(keys: list[bytes]) -> np.ndarray:
        return marks.kernels(keys) @ white

    rng = np.random.default_rng(11)
    common, rare = negatives[: CLEAN // 3], negatives[CLEAN // 3 :]
    negatives = common + [rare[i] for i in rng.permutation(len(rare))[: CLEAN - len(common)]]
    x_neg, usual = features(negatives), len(negatives)

    def witnesses(rank) -> Counter:
        out: Counter = Counter()
        for x, w in zip(toxic, weight.tolist()):
            for k in x & sure or ():
                out[k] += w
            if not x & sure:
                out[max(x, key=rank)] += DOUBTFUL * w
        return out

    witness = witnesses(lambda k: (odds(k) * min(hot[k], 5), k))
    for turn in range(rounds):
        found = {k: n / max(n, 1) ** 0.5 for k, n in witness.items()}  # many witnesses alike weigh less each
        keys = sorted(found)
        x = np.r_[features(keys), x_neg]
        y = np.r_[np.ones(len(keys)), -np.ones(len(negatives))]
        own = np.array([found[k] for k in keys])
        # of the clean strings' half, those once taken for toxic have as much as all others
        hard = np.arange(len(negatives)) >= usual
        cool = np.where(hard, 1 / max(1, hard.sum()), 1 / usual)
        w, b = hinge(x, y, np.r_[own / own.sum(), cool / cool.sum()] / 2)
        model = Model(marks.tables(white @ w), float(b))
        if turn + 1 < rounds:
            # strings of clean texts that the machine takes for toxic are negatives from here on
            extra = sorted(cold.keys() - set(negatives))
            if extra:
                z = model.of_keys(extra)
                worst = [extra[i] for i in np.argsort(-z, kind="stable")[: CLEAN // 4] if z[i] > -0.8]
                if worst:
                    negatives, x_neg = negatives + worst, np.r_[x_neg, features(worst)]
            # only texts without a telling string look for the most toxic one
            every = sorted(set().union(*(x for x in toxic if not x & sure)))
            z = dict(zip(every, model.of_keys(every)))
            witness = witnesses(lambda k: (z[k], k))
    model.floor = float(min(b, -1.0))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """On the strings of TEXTS texts of each label, hash-chosen outside the held-out fold; calibrated on fold 1, to the labels' share of toxic texts."""
    own = labels.filter(~held_out()).select("doc_id", F.col(label).cast("int").alias("y"))
    ids = linear.least_ids(own, {0: TEXTS, 1: TEXTS}, F.col("y"), 5).drop("part").withColumn("check", fold() == 1)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.iloc[i : i + 64]
                yield part.drop(columns="text").assign(keys=[b"\n".join(k.translate(SHIFT) for k in sorted(keys_of(t))) for t in part["text"]])

    rows = linear.sampled(docs, ids).mapInPandas(of, "doc_id long, y int, check boolean, keys binary").toPandas().sort_values(["doc_id", "y"], kind="stable")
    known: dict[bytes, bytes] = {}  # texts share most strings; keep one of each
    sets = [{known.setdefault(k, k.translate(UNSHIFT)) for k in bytes(x).split(b"\n") if k} for x in rows["keys"]]
    y, check = rows["y"].to_numpy(int), rows["check"].to_numpy(bool)
    del rows
    model = train([s for s, t, c in zip(sets, y, check) if t == 1 and not c], [s for s, t, c in zip(sets, y, check) if t == 0 and not c])
    if len(set(y[check])) == 2:
        z = [float(model.of_keys(sorted(s)).max()) if s else model.floor for s, c in zip(sets, check) if c]
        model.scale, model.shift = linear.platt(np.array(z), y[check].astype(float))
        # the sample has more toxic texts than the labels: their odds there are what a score tells
        of = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
        model.shift += float(np.log(of[1] / y[check].sum()) - np.log(of[0] / (1 - y[check]).sum()))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in (x for b in batches for x in slices(b)):
            yield pd.Series(shared.value.score(s.tolist()))

    return docs.select("doc_id", held_out().alias("held_out"), of("text").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
