"""Linear models over hashed word and character n-grams: features, training on a bounded sample, scoring.

A text's features are, per kind of gram, the mean over its grams of a one in the gram's bucket; a score is
then a gather of weights and a mean, whatever the text's length.  Texts without a gram of a kind have zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import textnum
from tessera.runtime import store

#: Kind, length, buckets (powers of two).
GRAMS = (("char", 4, 1 << 16), ("word", 1, 1 << 15), ("word", 2, 1 << 15))
BUCKETS = sum(g[2] for g in GRAMS)
#: Features are means, so small; this brings the usual text's vector near length one.
SCALE = 8.0


def grams(texts: textnum.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) per kind of gram."""
    at = 0
    for kind, k, size in GRAMS:
        doc, h = texts.char_grams(k) if kind == "char" else texts.word_grams(k)
        yield doc, (textnum.mix(h + np.uint64(at)) & np.uint64(size - 1)).astype(np.int64) + at
        at += size


def score_texts(texts: textnum.Texts, weights: np.ndarray) -> np.ndarray:
    """Sum over kinds of the mean weight of a text's grams."""
    out = np.zeros(texts.n)
    for doc, bucket in grams(texts):
        out += np.bincount(doc, weights=weights[bucket], minlength=texts.n) / np.maximum(np.bincount(doc, minlength=texts.n), 1)
    return out * SCALE


def scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    return np.concatenate([score_texts(t, weights) for _, t in textnum.batches(texts)] or [np.zeros(0)])


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one text."""
    part, cols, vals = textnum.Texts([text]), [], []
    for doc, bucket in grams(part):
        if len(doc):
            b, n = np.unique(bucket, return_counts=True)
            cols.append(b.astype(np.int32))
            vals.append((SCALE * n / len(doc)).astype(np.float16))
    return (np.concatenate(cols), np.concatenate(vals)) if cols else (np.zeros(0, np.int32), np.zeros(0, np.float16))


class Rows:
    """A sparse matrix by rows; products go by blocks of BLOCK entries, so they need little besides it."""

    BLOCK = 1 << 19

    def __init__(self, col: list[bytes], val: list[bytes]):
        self.n = len(col)
        size = [len(c) // 4 for c in col]
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), size)
        self.col = np.frombuffer(b"".join(col), np.int32)
        self.val = np.frombuffer(b"".join(val), np.float16)

    def __len__(self) -> int:
        return self.n

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(0, len(self.col), self.BLOCK):
            at = slice(i, i + self.BLOCK)
            yield self.row[at], self.col[at], self.val[at].astype(np.float32)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for row, col, val in self.blocks():
            out += np.bincount(row, weights=val * w[col], minlength=self.n)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for row, col, val in self.blocks():
            out += np.bincount(col, weights=val * g[row], minlength=BUCKETS)
        return out


#: Bytes of text that a model is fitted on at most; of a longer sample the texts of the least hashes stay.
FIT_BYTES = 64 << 20


def least_ids(df: DataFrame, sizes: dict[int, int], part: Column, salt: int) -> DataFrame:
    """Of each part of ``df(doc_id, ...)`` so many distinct rows, those of the least hash of (salt, doc_id), with the part as ``part``.

    Only rows under a bound on the hash are dealt out, which is raised for parts that it leaves short; so repeats are told
    apart without dealing out all ids.
    """
    most, names = 1 << 40, [f"`{c}`" for c in df.columns]
    h = F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(most))
    rows = df.filter("doc_id is not null").withColumn("part", part)
    share, left, out = 4 * max(sizes.values()) / max(1, df.count()), dict(sizes), []
    while left:
        few = store(rows.filter(F.col("part").isin(list(left)) & (h < int(min(1.0, share) * most))).distinct(), "ids")
        there = {r.part: r["count"] for r in few.groupBy("part").count().collect()}
        full = [p for p, n in left.items() if there.get(p, 0) >= n or share >= 1]
        out += [few.filter(F.col("part") == p).orderBy(h, *names).limit(left[p]) for p in full]
        left, share = {p: n for p, n in left.items() if p not in full}, share * 16
    return reduce(DataFrame.unionAll, out)


def sampled(docs: DataFrame, ids: DataFrame, most: int = FIT_BYTES) -> DataFrame:
    """(doc_id, the other columns of ``ids``, text): a text for each row of ``ids``, which is bounded, written once.

    Of rows that share an id the text of the least hash counts.  Texts are taken by the hash of their ids as far as
    ``most`` bytes go, and always one.
    """
    keys = [f"`{c}`" for c in ids.columns]
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy(*keys).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(W.orderBy(F.xxhash64(F.lit(9), "doc_id"), *keys).rowsBetween(W.unboundedPreceding, -1))
    return store(rows.withColumn("__upto", upto).filter(F.coalesce("__upto", F.lit(0)) < most).drop("__upto"), "sample")


def featured(rows: DataFrame) -> pd.DataFrame:
    """Collects (the columns of ``rows(doc_id, ..., text)`` but the text, col, val), for a bounded sample."""
    rest = [f for f in rows.schema.fields if f.name not in ("doc_id", "text")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.iloc[i : i + 64]
                pairs = [sparse(t) for t in part["text"]]
                yield part.drop(columns="text").assign(col=[c.tobytes() for c, _ in pairs], val=[v.tobytes() for _, v in pairs])

    schema = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "col binary", "val binary"])
    names = ["doc_id", *(f.name for f in rest)]
    return rows.select(*names, "text").mapInPandas(of, schema).toPandas().sort_values(names, kind="stable").reset_index(drop=True)


def matrix(rows: pd.DataFrame) -> Rows:
    return Rows(rows["col"].tolist(), rows["val"].tolist())


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def descend(gradient, steps: int, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on (weights, bias); ``gradient(w, b)`` gives both parts."""
    w, b = np.zeros(BUCKETS), 0.0
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = gradient(w, b)
        g = g + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w = w - rate * fix * m / (np.sqrt(v) + 1e-8)
        b = b - rate * fix * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def logistic(x: Rows, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weighted logistic regression."""
    weight = weight / weight.sum()

    def gradient(w, b):
        g = (sigmoid(x.dot(w) + b) - y) * weight
        return x.back(g), g.sum()

    return descend(gradient, steps)


def platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, c) of sigmoid(a * z + c), by Newton's method on Platt's smoothed targets."""
    if not len(z) or y.min() == y.max():
        return 1.0, 0.0
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, p = np.stack([z, np.ones(len(z))], 1), np.zeros(2)
    for _ in range(steps):
        q = sigmoid(x @ p)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (q - target))
        p = p - np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return (float(p[0]), float(p[1])) if p[0] > 0 else (1.0, 0.0)
