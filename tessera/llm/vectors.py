"""Near-duplicate vectors by cross-polytope hashing, with multiprobe buckets and verified pairs.

Equal vectors of a label collapse to a class first.  A class is hashed by TABLES tables: its direction is spun by
sign flips and fast Hadamard transforms, and the axis nearest to it, with its sign, is its bucket; with many
classes several axes make a bucket.  It lives in that bucket of a table and also visits those of the next best
axes.  Bucket mates are compared in blocks by matrix products in double precision; a pair that meets more than
once counts where it meets first, which both signatures tell.  A task returns, per class, how many vectors it
is linked to there and a spanning forest of the links, never the pairs.

A bucket with more members than BLOCK is cut into blocks, and every two blocks meet in a task of their own, so
the members of a hot bucket are all compared, over many tasks.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, have
no links and stand alone; vectors of other lengths are never compared; repeated rows are vectors that are linked
to each other; a null id names a component only where it has no other (then component_id is null, and each such
row is kept); extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.vptree import join_labels
from tessera.runtime import store

MIN_COSINE = 0.98
TABLES, PROBES, SPINS, SEED = 3, 2, 3, 23
#: Classes that a bucket is meant to hold, and members beyond which it is cut.
BUCKET, BLOCK = 64, 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def signatures(x: np.ndarray, axes: int) -> np.ndarray:
    """Rows of ``x`` (directions) -> their buckets: (rows, TABLES, 1 + PROBES * axes), the home first."""
    n, d = x.shape
    wide = 1 << max(PROBES.bit_length() + 1, (d - 1).bit_length())  # more axes than probes
    rng = np.random.default_rng([SEED, d])
    out = np.zeros((n, TABLES, 1 + PROBES * axes), np.int64)
    rows = np.arange(n)
    for t in range(TABLES):
        best = np.zeros((axes, 1 + PROBES, n), np.int64)
        for k in range(axes):
            y = np.zeros((n, wide))
            y[:, :d] = x
            for _ in range(SPINS):
                y = hadamard(y * rng.choice([-1.0, 1.0], wide)) / np.sqrt(wide)
            size = np.abs(y)
            for p in range(1 + PROBES):
                at = size.argmax(axis=1)
                best[k, p] = 2 * at + (y[rows, at] < 0)
                size[rows, at] = -1
        scale = (2 * wide) ** np.arange(axes)
        home = (best[:, 0] * scale[:, None]).sum(axis=0)
        out[:, t, 0] = home
        for k in range(axes):
            for p in range(PROBES):
                out[:, t, 1 + k * PROBES + p] = home + (best[k, 1 + p] - best[k, 0]) * scale[k]
    return out


def directions(vectors: list | pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def met_before(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Whether pairs of signatures share a home, or one visits the other's, in a table before t."""
    out = np.zeros(len(a), bool)
    for s in range(t):
        out |= (a[:, s] == b[:, s, :1]).any(axis=1) | (b[:, s] == a[:, s, :1]).any(axis=1)
    return out


def compare(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, t: int, bucket: int, visits: bool, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked directions that first meet here; ``visits``: those of x don't live here, ``same``: x is y."""
    for i in range(0, len(x), 512):
        for j in range(i if same else 0, len(y), 2048):
            p, q = np.nonzero(x[i : i + 512] @ y[j : j + 2048].T >= MIN_COSINE)
            p, q = p + i, q + j
            if same:
                p, q = p[p < q], q[p < q]
            a, b = sx[p], sy[q]
            new = ~met_before(a, b, t)
            if visits:  # each may visit the other's home: then the lesser bucket counts
                new &= ~((b[:, t] == a[:, t, :1]).any(axis=1) & (a[:, t, 0] < bucket))
            yield p[new], q[new]


def linked_in(b: pd.DataFrame) -> pd.DataFrame:
    """The buckets of one call: (cid, n, root) of their linked classes.

    side 1: at home in the bucket, or in the one block of it; 0: a visitor, or of the left block; 2: of the right block.
    """
    out = [pd.DataFrame({"cid": [], "n": [], "root": []}).astype("int64")]
    keys = ["label", "t", "bucket", "i", "j"]
    for _, g in b.groupby(b["v"].map(len)):
        g = g.sort_values([*keys, "cid"], kind="stable")
        x, cid, m, side = directions(g["v"]), g["cid"].to_numpy(np.int64), g["m"].to_numpy(np.int64), g["side"].to_numpy()
        s = np.frombuffer(b"".join(g["sig"]), np.int64).reshape(len(g), TABLES, -1)
        at = g[keys].to_numpy(np.int64)
        cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
        n, label = np.zeros(len(g), np.int64), np.arange(len(g))
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(g)]):
            t, bucket, i, j = at[lo, 1:]
            left, home, right = (lo + np.flatnonzero(side[lo:hi] == k) for k in (0, 1, 2))
            pairs = [(home, home, False, True), (left, home, True, False)] if i == j else [(left, right, i < 0, False)]
            for a, c, visits, same in pairs:
                if len(a) and len(c):
                    for p, q in compare(x[a], x[c], s[a], s[c], t, bucket, visits, same):
                        np.add.at(n, a[p], m[c[q]])
                        np.add.at(n, c[q], m[a[p]])
                        join_labels(label, a[p], c[q])
        # a class is in the call once per bucket and block: each tells of its own links
        out.append(pd.DataFrame({"cid": cid, "n": n, "root": cid[label]})[n > 0])
    return pd.concat(out, ignore_index=True)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    wide = vectors.schema[embedding].dataType.simpleString() == "array<double>"  # floats are exact in either
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>" if wide else "array<float>").alias("v"), F.col(label).cast("long").alias("label"))
    fine = F.col("label").isNotNull() & F.coalesce(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False)
    )
    rows = rows.withColumns({"fine": fine, "k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(SEED), "label", "v")})
    # 128 bits of hash tell vectors apart
    classes = rows.filter("fine").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("first_id"), F.count("k1").alias("m"))
    classes = store(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    links = store(linked(classes.select("cid", "label", "v", "m")), "links")
    roots = components(links.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    tied = store(classes.select("cid", "first_id").join(roots.withColumnRenamed("node", "cid"), "cid"), "tied")
    named = tied.join(tied.groupBy("root").agg(F.min("first_id").alias("least")), "root").select("cid", "least")
    known = classes.join(links.groupBy("cid").agg(F.sum("n").alias("n")), "cid", "left").join(named, "cid", "left")
    known = store(known.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.when(F.col("least").isNull(), F.col("first_id")).otherwise(F.col("least")).alias("least")), "known")
    out = rows.select("vec_id", "fine", "k1", "k2").join(known, F.col("fine") & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.when(F.col("fine"), F.col("least")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def linked(classes: DataFrame, axes: int | None = None) -> DataFrame:
    """``classes(cid, label, v, m)`` -> (cid, n, root): links found in each task, and a forest of them.

    ``axes`` make a bucket; by default as many as leave about BUCKET classes in one.
    """
    n, own_axes = classes.count(), axes

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, g in b.groupby(b["v"].map(len)):
                axes = own_axes or max(1, round(np.log(max(1, n) / BUCKET) / np.log(4 * max(1, size))))
                sig = signatures(directions(g["v"]), axes)
                yield g.assign(sig=[z.tobytes() for z in sig], buckets=list(sig.reshape(len(g), -1)), width=sig.shape[2])

    signed = store(classes.mapInPandas(sign, f"cid long, label long, v {classes.schema['v'].dataType.simpleString()}, m long, sig binary, buckets array<long>, width int"), "signed")
    place = F.posexplode("buckets").alias("at", "bucket")
    where = [F.expr("at div width").cast("int").alias("t"), "bucket", (F.expr("at % width") == 0).alias("home")]
    light = signed.select("cid", "label", "width", place).select("cid", "label", *where)
    sizes = light.groupBy("label", "t", "bucket").agg(F.count(F.when(F.col("home"), 1)).alias("h"), F.count(F.when(~F.col("home"), 1)).alias("o"))
    big = store(sizes.filter((F.col("h") > 0) & (F.col("h") + F.col("o") > BLOCK)).select("label", "t", "bucket", *(F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int").alias(f"{c}b") for c in ("h", "o"))), "big")
    every = signed.select("cid", "label", "v", "m", "sig", "width", place).select("cid", "label", "v", "m", "sig", *where)
    every = every.join(big, ["label", "t", "bucket"], "left")
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("ob"))).cast("int")
    every = every.withColumn("own", own)
    pair = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    # of a big bucket, a home meets its own block, the other home blocks, and each block of visitors (i < 0)
    with_homes = F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda k: pair(F.least(k, F.col("own")), F.greatest(k, F.col("own")), F.when(k == F.col("own"), 1).when(F.col("own") < k, 0).otherwise(2)))
    with_visitors = F.transform(F.sequence(F.lit(0), F.col("ob") - 1), lambda k: pair(-1 - k, F.col("own"), F.lit(2)))
    as_visitor = F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda k: pair(-1 - F.col("own"), k, F.lit(0)))
    whole = F.array(pair(F.lit(0), F.lit(0), F.col("home").cast("int")))
    tasks = every.withColumn("task", F.explode(F.when(F.col("hb").isNull(), whole).when(F.col("home"), F.concat(with_homes, with_visitors)).otherwise(as_visitor)))
    tasks = tasks.select("cid", "label", "v", "m", "sig", "t", "bucket", "task.i", "task.j", "task.side")
    # several small buckets share a call; a block of a big one is dealt by a key of its own
    cells = max(1, n * TABLES * (1 + PROBES) // (2 * BLOCK))
    cell = F.pmod(F.xxhash64("label", "t", "bucket", "i", "j"), F.lit(cells))
    return tasks.withColumn("cell", cell).groupBy("cell").applyInPandas(lambda b: linked_in(b.drop(columns="cell")), "cid long, n long, root long")
