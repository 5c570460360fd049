"""Quality by positive-unlabelled learning: trusted positives, unlabelled text and an estimated class prior.

The model is linear over hashed n-grams and minimises the non-negative unbiased risk of Kiryo et al. (2017)
with the logistic loss: prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)]); where the second part is
negative, a step goes up its gradient instead, so that it can't be fitted below zero.  No text is ever used as
a negative.  The class prior is the best-bin estimate: over the thresholds of a classifier that parts positives
from unlabelled text, the least ratio of the shares above, with a margin for the sample's size.

Cases: a null text is an empty one and gets the score of a text without grams; rows with a null id are scored
and not held out; null ids are never fitted on, repeated ids once; with no positive or no text to fit on, every score is the prior's stand-in 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import linear
from tessera.llm.textnum import slices

#: The bound of the sample that the model is fitted on.
POSITIVES, UNLABELLED = 600, 2000
#: The bound of the sample that the prior and the intercept are estimated on.
CHECK_POSITIVES, CHECK_UNLABELLED = 4000, 8000
THRESHOLD = 0.3


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


@dataclass
class Model:
    """``bias`` is set so that the estimated prior's share of unlabelled text reaches THRESHOLD."""

    weights: np.ndarray
    bias: float
    prior: float


def best_bin_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among ``u``: the least of (share of u above t + margin) / (share of p above t)."""
    cuts = np.sort(p)
    if not len(p) or not len(u):
        return 0.5
    above_p = 1 - np.searchsorted(cuts, cuts, side="left") / len(p)
    above_u = 1 - np.searchsorted(np.sort(u), cuts, side="left") / len(u)
    margin = np.sqrt(np.log(20) / 2 / len(u)) + np.sqrt(np.log(20) / 2 / len(p))
    at = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[at] / above_p[at], 0.05, 0.95))


def apart(p: linear.Rows, u: linear.Rows, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Gradient of the logistic loss that parts positives from unlabelled text, both weighing as much."""
    gp, gu = -linear.sigmoid(-p.dot(w) - b) / len(p), linear.sigmoid(u.dot(w) + b) / len(u)
    return p.back(gp) + u.back(gu), gp.sum() + gu.sum()


def nn_pu(p: linear.Rows, u: linear.Rows, prior: float, steps: int = 80) -> tuple[np.ndarray, float]:
    """Minimises the non-negative risk over the sample."""

    def gradient(w, b):
        zp, zu = p.dot(w) + b, u.dot(w) + b
        gp_pos, gp_neg, gu = -linear.sigmoid(-zp) * prior / len(p), linear.sigmoid(zp) * prior / len(p), linear.sigmoid(zu) / len(u)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            gp = gp_pos - gp_neg
        else:  # only the part below zero, upwards
            gp, gu = gp_neg, -gu
        return p.back(gp) + u.back(gu), gp.sum() + gu.sum()

    return linear.descend(gradient, steps, l2=1e-4)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED, check_positives: int = CHECK_POSITIVES, check_unlabelled: int = CHECK_UNLABELLED) -> Model:
    """Fits on the hash-first trusted ids and ids of ``docs`` in folds 2-4; the prior and the intercept come from fold 1.

    Only grams of the fitted sample and scores of the checked one reach the driver, both of bounded number and size; the
    sampled texts are read from ``docs`` once.
    """
    free = ~held_out()
    trusted, others = labels.filter(free & (F.col(label) == 1)).select("doc_id"), docs.filter(free).select("doc_id")
    check = (fold() == 1).cast("int")
    parts = [
        linear.least_ids(df, {0: fit_on, 1: check_on}, check, salt).withColumns({"kind": F.lit(2 - salt), "check": F.col("part") == 1}).drop("part")
        for df, salt, fit_on, check_on in ((trusted, 1, positives, check_positives), (others, 2, unlabelled, check_unlabelled))
    ]
    texts = linear.sampled(docs, reduce(DataFrame.unionAll, parts))
    rows = linear.featured(texts.filter("not check"))
    p, u = linear.matrix(rows[rows["kind"] == 1]), linear.matrix(rows[rows["kind"] == 0])
    del rows
    if not len(p) or not len(u):
        return Model(np.zeros(linear.BUCKETS), 0.0, 0.5)
    w, b = linear.descend(lambda w, b: apart(p, u, w, b), 30)
    prior = best_bin_prior(*scored(texts, w))
    w, b = nn_pu(p, u, prior)
    # the sample's size leaves the posterior too high or low as a whole: as many as the prior says pass the threshold
    cut = scored(texts, w)[1]
    return Model(w, float(np.log(THRESHOLD / (1 - THRESHOLD)) - np.quantile(cut, 1 - prior)) if len(cut) else b, prior)


def scored(texts: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores without intercept of the positives and of the unlabelled texts of the checked sample, which are few."""
    rows = texts.filter("check").select("kind", raw_score(texts, weights)("text").alias("z")).collect()
    return tuple(np.array([r.z for r in rows if r.kind == k]) for k in (1, 0))


def raw_score(docs: DataFrame, weights: np.ndarray):
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in (x for b in texts for x in slices(b)):
            yield pd.Series(linear.scores(s.tolist(), shared.value))

    return of


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""
    z = raw_score(docs, model.weights)("text") + F.lit(model.bias)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))
    return docs.select("doc_id", held_out().alias("held_out"), p.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
