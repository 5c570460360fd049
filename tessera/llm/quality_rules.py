"""Quality rules: counts with fixed limits, then a calibrated n-gram classifier with a fixed limit.

The classifier is a logistic regression over hashed word and character n-grams, fitted on a bounded, hash-chosen
sample of labelled rows; its probabilities are calibrated (Platt) on a fold that it wasn't fitted on.  Texts
are scored whole, in Arrow batches, in one pass with the counts.

Cases: a null text has no words; a text that fails a count is rejected whatever the classifier says; texts
without grams score the intercept; rows with null or repeated ids are rows like others (only fitting needs an
id); null labels aren't fitted on; with labels of one kind or none the classifier accepts all; extra columns
stay or are ignored; equal windows and lines are found by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import linear, textnum
from tessera.llm.quality_pu import fold, held_out

#: The bound of the sample for each label, for fitting and for calibration.
FIT, CALIBRATE = 700, 300
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
ACCEPT = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences of the like in the text, whether an earlier one exists) per element."""
    key = textnum.mix(h ^ textnum.mix(doc.astype(np.uint64)))
    _, first, which, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return n[which], later


def counts(t: textnum.Texts) -> dict[str, np.ndarray]:
    """The base counts per text."""
    solid = ~textnum.SPACE[t.data]
    ends = np.flatnonzero(t.data == 10)  # also after each text, so no line holds two texts
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    full = n[ends] > n[begins]
    begins, ends = begins[full], ends[full]
    doc = np.searchsorted(t.last, begins, side="right")
    _, later = repeated(doc, t.spans(begins, ends))
    at, owner, h = t.windows(WINDOW)
    again = at[repeated(owner, h)[0] > 1]
    cover = np.zeros(len(t.hash) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    return {
        "n_words": t.counts(),
        "word_chars": t.per_text(solid & ((t.data & 0xC0) != 0x80)),
        "n_symbols": t.per_text(SYMBOLS[t.data]),
        "n_dup_lines": np.bincount(doc[later], minlength=t.n),
        "n_repeat_words": np.bincount(t.doc[np.cumsum(cover[:-1]) > 0], minlength=t.n),
    }


@dataclass
class Model:
    """p = sigmoid(scale * (weights . grams + bias) + shift)."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, z: np.ndarray) -> np.ndarray:
        return linear.sigmoid(self.scale * (z + self.bias) + self.shift)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """On FIT rows of each label from folds 2-4 and calibrated on CALIBRATE rows of each from fold 1; fold 0 stays unseen."""
    own = labels.filter(~held_out()).select("doc_id", F.col(label).cast("int").alias("y"))
    check = (fold() == 1).cast("int")
    ids = linear.least_ids(own, {0: FIT, 1: CALIBRATE, 2: FIT, 3: CALIBRATE}, F.col("y") * 2 + check, 3).withColumn("check", F.col("part") % 2 == 1)
    rows = linear.featured(linear.sampled(docs, ids.drop("part")))
    last = rows["check"].to_numpy(bool)
    y, y_check = rows["y"].to_numpy(float)[~last], rows["y"].to_numpy(float)[last]
    train, check = linear.matrix(rows[~last]), linear.matrix(rows[last])
    del rows
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(linear.BUCKETS), 0.0, 1.0, 35.0)
    # both labels weigh as much as the other in fitting and in calibration: a fixed limit then means the same for any mix
    w, b = linear.logistic(train, y, np.where(y > 0, 1 / y.sum(), 1 / (1 - y).sum()))
    return Model(w, b, *linear.platt(check.dot(w) + b, y_check))


def judged(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """A struct column: the counts, base_failed, probability, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in COUNTS} | {"base_failed": pd.Series(dtype=bool), "probability": pd.Series(dtype=float), "kept": pd.Series(dtype=bool)})

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, probability double, kept boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in (x for b in batches for x in textnum.slices(b)):
            out = []
            for _, t in textnum.batches(s.tolist()):
                own = counts(t)
                failed = (own["n_words"] < MIN_WORDS) | (100 * own["n_repeat_words"] > MAX_REPEAT_PERCENT * own["n_words"])
                p = shared.value.probability(linear.score_texts(t, shared.value.weights))
                out.append(pd.DataFrame(own | {"base_failed": failed, "probability": p, "kept": ~failed & (p >= ACCEPT)}))
            yield pd.concat(out or [empty], ignore_index=True)

    return of(F.col(text))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, counts, base_failed, probability, kept) per row."""
    return docs.select("doc_id", judged(model, docs).alias("q")).select("doc_id", "q.*")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    return docs.withColumn("__q", judged(model, docs)).filter("__q.kept").drop("__q")
