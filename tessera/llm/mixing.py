"""Mixing sources to target weights, in DataFrame operations only.

Weights are the sources' token shares to the power of an exponent, normalised.  The exponent is bisected: to the
flattest mix whose most repeated source goes round at most ``max_repeats`` times, or to a given entropy.  With a
budget of tokens each source gets its weight's part of it; without one the budget is the least at which every
source goes round once, so that nothing is lost.

A source's part is realised as laps over its documents: whole laps, and one more as far as the rest of the part
goes.  In a lap the documents are permuted by blocks: a hash deals them to blocks, another orders the blocks, a
third the documents of a block.  The rest ends in one block of a source, found by prefix sums over the blocks'
totals, and there at one document.  So each source has a single threshold, and whether a document is in the last
lap is told from its hashes alone: texts are never dealt out, and no window holds more than a source's block
totals or one block.  The table of thresholds has one short row per source.

Cases: a document counts at least one token, so empty and null texts count one; a null source is a source; the
place of a row comes from its id, or from its text where the id is null, so rows alike go together; a source
with one document has one block; a single source has weight one; an empty table gives an empty one; extra columns
stay, but for ``epoch`` and ``place``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.runtime import store

SEED, BLOCK, STEPS = 17, 4096, 60


def tokens(text: str = "text") -> Column:
    """An estimate: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(F.col(text), F.lit(""))) / 4)).cast("long")


def key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))))


def exponent(max_repeats: float | None, entropy: float | None) -> str:
    """SQL for the exponent over ``lp``, the sorted array of log shares; by bisection."""
    if entropy is None:  # repeats fall as the exponent grows; the greatest share goes round once, the least most often
        low, high, fits = 0.0, 1.0, f"exp((1 - (a.lo + a.hi) / 2) * (array_max(lp) - array_min(lp))) <= {float(max_repeats)}D"
    else:  # entropy falls as the exponent grows
        low, high = 0.0, 16.0
        x = "exp((a.lo + a.hi) / 2 * (l - array_max(lp)))"
        z, m = f"aggregate(transform(lp, l -> {x}), 0D, (s, e) -> s + e)", f"aggregate(transform(lp, l -> {x} * (l - array_max(lp))), 0D, (s, e) -> s + e)"
        fits = f"ln({z}) - (a.lo + a.hi) / 2 * {m} / {z} <= {float(entropy)}D"
    step = f"if({fits}, named_struct('lo', a.lo, 'hi', (a.lo + a.hi) / 2), named_struct('lo', (a.lo + a.hi) / 2, 'hi', a.hi))"
    return f"aggregate(sequence(1, {STEPS}), named_struct('lo', {low}D, 'hi', {high}D), (a, i) -> {step}).hi"


def weights(sources: DataFrame, max_repeats: float | None = None, entropy: float | None = None, budget: int | None = None, by: str = "source") -> DataFrame:
    """``sources(source, t, n)``, a row each -> with p, alpha, w, part (tokens), laps, rest, blocks."""
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give max_repeats or entropy")
    one = sources.agg(F.sum("t").cast("double").alias("total"), F.min("t").alias("low"), F.max("t").alias("high"), *([] if entropy is None else [F.collect_list("t").alias("all")]))
    # the repetition limit asks for the least and the greatest share alone; the entropy for all, a number per source
    one = one.withColumn("lp", F.expr("array_sort(transform(all, x -> ln(x / total)))") if entropy is not None else F.array(F.log(F.col("low") / F.col("total")), F.log(F.col("high") / F.col("total"))))
    one = store(one.select("total", F.expr(exponent(max_repeats, entropy)).alias("alpha")), "exponent")
    rows = sources.withColumns({"total": one.select("total").scalar(), "alpha": one.select("alpha").scalar()})
    rows = store(rows.withColumn("p", F.col("t") / F.col("total")).withColumn("own", F.exp(F.col("alpha") * F.log("p"))), "shares")
    sums = store(rows.agg(F.sum("own").alias("z"), F.max(F.col("t") / F.col("own")).alias("least")), "sums")
    rows = rows.withColumns({"z": sums.select("z").scalar(), "least": sums.select("least").scalar()}).withColumn("w", F.col("own") / F.col("z"))
    whole = F.lit(float(budget)) if budget is not None else F.col("least") * F.col("z")
    rows = rows.withColumn("part", F.round(F.col("w") * whole).cast("long"))
    return rows.select(by, "t", "n", "p", "alpha", "w", "part", F.expr("part div t").alias("laps"), F.expr("part % t").alias("rest"), F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))


def mix(docs: DataFrame, max_repeats: float | None = None, entropy: float | None = None, budget: int | None = None, by: str = "source", plan: DataFrame | None = None) -> DataFrame:
    """``docs`` with a row per lap that a document is in, numbered from 1 in ``epoch``; a lap's order is that of ``place``."""
    if plan is None:
        plan = thresholds(docs, max_repeats, entropy, budget, by)
    known = plan.select(F.col(by).alias("__by"), *(F.col(c).alias(f"__{c}") for c in ("laps", "blocks", "edge_place", "edge_block", "edge_own")))
    rows = docs.drop("epoch", "place").withColumn("__key", key()).join(known, F.col(by).eqNullSafe(F.col("__by")))
    block, own = position("__key", "__blocks", "__laps")
    rows = rows.withColumns({"__block": block, "__own": own}).withColumn("__place", place("__laps", "__block"))
    last = (F.col("__place") < F.col("__edge_place")) | (F.col("__place") == F.col("__edge_place")) & ((F.col("__block") < F.col("__edge_block")) | (F.col("__block") == F.col("__edge_block")) & (F.col("__own") <= F.col("__edge_own")))
    copies = F.col("__laps") + F.when(last, 1).otherwise(0)
    rows = rows.withColumn("__copies", copies).filter("__copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long"))))
    # each lap permutes the blocks, and the documents of each
    _, again = position("__key", "__blocks", "__lap")
    rows = rows.withColumn("__lap", F.col("epoch") - 1).withColumn("place", F.concat(place("__lap", "__block"), again))
    return rows.select(*[c for c in docs.columns if c not in ("epoch", "place")], "epoch", "place")


def position(key: str, blocks: str, laps: str) -> tuple[Column, Column]:
    """The block that a document is dealt to, and its place within a block in the last lap."""
    return F.pmod(F.conv(F.substring(key, 1, 15), 16, 10).cast("long"), F.col(blocks)), F.md5(F.concat(F.col(key), F.lit("|"), F.col(laps).cast("string")))


def place(laps: str, block: str) -> Column:
    """The place of a block in the last lap."""
    return F.md5(F.concat(F.lit(f"{SEED}|"), F.col(laps).cast("string"), F.lit("|"), F.col(block).cast("string")))


def thresholds(docs: DataFrame, max_repeats: float | None = None, entropy: float | None = None, budget: int | None = None, by: str = "source") -> DataFrame:
    """The weights' table with the end of each source's last lap: edge_place, edge_block, edge_own; null without such a lap."""
    sized = docs.select(F.col(by).alias(by), key().alias("key"), tokens().alias("tk"))
    sources = sized.groupBy(by).agg(F.sum("tk").alias("t"), F.count("tk").alias("n"))
    plan = store(weights(store(sources, "sources"), max_repeats, entropy, budget, by), "weights")
    own = plan.filter("rest > 0").select(F.col(by).alias("__by"), "laps", "rest", "blocks")
    block, place_in = position("key", "blocks", "laps")
    rows = sized.join(own, F.col(by).eqNullSafe(F.col("__by"))).withColumns({"block": block, "own": place_in})
    totals = rows.groupBy(by, "laps", "rest", "block").agg(F.sum("tk").alias("tk")).withColumn("place", place("laps", "block"))
    upto = F.sum("tk").over(W.partitionBy(by).orderBy("place", "block").rowsBetween(W.unboundedPreceding, 0))
    edges = totals.withColumn("upto", upto).filter("upto >= rest and upto - tk < rest")
    edges = store(edges.select(F.col(by).alias("__e"), F.col("place").alias("edge_place"), F.col("block").alias("edge_block"), (F.col("rest") - F.col("upto") + F.col("tk")).alias("left")), "edges")
    inside = rows.join(edges, F.col(by).eqNullSafe(F.col("__e")) & (F.col("block") == F.col("edge_block")))
    upto = F.sum("tk").over(W.partitionBy(by, "block").orderBy("own").rowsBetween(W.unboundedPreceding, 0))
    ends = inside.withColumn("upto", upto).filter(F.col("upto") - F.col("tk") < F.col("left")).groupBy("__e", "edge_place", "edge_block").agg(F.max("own").alias("edge_own"))
    return store(plan.join(ends, F.col(by).eqNullSafe(F.col("__e")), "left").drop("__e"), "thresholds")
