"""SimHash near-duplicates: fingerprints of word shingles, linked through vantage-point trees.

Two kinds: ``near_duplicates`` links by the fingerprints alone, at DISTANCE bits of 64.  ``near_copies`` links texts whose
shingle sets are SIMILAR by Jaccard's measure, for which 64 bits are too few: its fingerprints have 256 bits of a text's
distinct shingles, a tree for each 16 of them finds the candidates, and these are compared by their shingles.

``fingerprints`` is one pass over the texts; identical fingerprints then collapse to a class, and only the
distinct values (16 bytes a row) are searched: a tree for each half of the bits, fitted on a bounded sample, deals
them to shards, a fingerprint near a shard's boundary also visits the shard behind it, and each shard is searched
by its own tree.  A shard returns a spanning forest of its links, never the pairs, so a dense group costs a row a member.

Cases: a null text is an empty one; texts without a word have fingerprint zero and are linked like any other;
fewer words than a shingle hash as one sequence; repeated rows and ids keep a row each; a null id takes part
in links, but names a component only where it has no other id (then component_id is null); extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textnum, vptree
from tessera.llm.components import components
from tessera.llm.textnum import slices
from tessera.llm.vptree import join_labels
from tessera.runtime import store

SEED, DISTANCE, SHARD, MAX_DEPTH = 42, 3, 8192, 16
#: Shards beyond this many times their meant size are cut into blocks.
HOT = 4
#: Near copies: words of a shingle, least similarity of the sets.
WIDTH, SIMILAR = 5, 0.8
WIDE_SHARD, WIDE_LEAF = 1 << 17, 48
#: Texts, and bytes, of candidates that are compared in one task; members of a larger group that all others are compared with first.
BLOCK, BLOCK_BYTES, LEADERS = 512, 16 << 20, 4
#: Bits of the filter of text hashes.
FILTER_BITS = 26
#: Shingles hashed at once; bounds the memory that a very long text takes.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """Majority bits over the XXH64 of all ``width``-word shingles of the text, A-Z lower-cased."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only \x20 \x09-\x0D part
    if not words:
        return 0
    if len(words) <= width:
        return h(b" ".join(words), seed)
    n, votes = len(words) - width + 1, np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        part = words[i : min(n, i + CHUNK) + width - 1]
        hashes = np.array([h(b" ".join(x), seed) for x in zip(*(part[k:] for k in range(width)))], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` with a long column ``name``: the fingerprint's bits, as a signed number."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in (x for b in texts for x in slices(b)):
            yield pd.Series(np.array([fingerprint(x, width) for x in s], np.uint64).view(np.int64))

    return docs.withColumn(name, of(F.col(text)))


def wide_fingerprints(texts: list[str | None], width: int = WIDTH, words: int = 4) -> np.ndarray:
    """(texts, words) majority bits over the texts' distinct shingles, each hashed to 64-bit words; 0 for a text without words."""
    out, salts = np.zeros((len(texts), words), np.uint64), np.arange(words, dtype=np.uint64) * textnum.MULT
    for at, t in textnum.batches(texts, lower=True):
        doc, h = t.shingles(width)
        votes, n = np.zeros((t.n, 64 * words), np.int64), np.bincount(doc, minlength=t.n)
        for i in range(0, len(h), CHUNK >> 2):
            d, own = doc[i : i + (CHUNK >> 2)], h[i : i + (CHUNK >> 2)]
            hashes = np.stack([textnum.mix(own + x) for x in salts], axis=1)
            bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            votes[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[at : at + t.n] = np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view("<u8")
    return out


@dataclass(frozen=True)
class Views:
    """Which bits of a fingerprint of ``words`` words the trees go by: (word, mask) each, and how many of them may differ."""

    words: int
    bits: tuple[tuple[int, int], ...]
    near: int

    def key(self, points: np.ndarray, k: int) -> np.ndarray:
        word, mask = self.bits[k]
        return points[:, word] & np.uint64(mask)


#: Of two values that differ in 3 bits one half differs in 1 at most.
HALVES = Views(1, ((0, 0xFFFFFFFF), (0, 0xFFFFFFFF << 32)), DISTANCE // 2)
#: For near copies.  Of two texts of similarity 0.8 a bit differs with a chance of 0.15, so of 16 times 16 bits one differs in one
#: bit at most for 99.4 pairs in 100 (at 0.85: 99.9).  Two texts by chance do in a view for one pair in 3,855.
SIXTEENTHS = Views(4, tuple((w, 0xFFFF << s) for w in range(4) for s in (0, 16, 32, 48)), 1)
#: The same for tables of 10 ** 8 texts and more: of 16 times 32 bits one differs in three at most for 99.3 pairs in 100, and by
#: chance for one pair in 782,000, at the price of fingerprints of twice the size and of more shards visited.
LONG_SIXTEENTHS = Views(8, tuple((w, 0xFFFFFFFF << s) for w in range(8) for s in (0, 32)), 3)


def bits_apart(similar: float, words: int) -> int:
    """Bits in which wide fingerprints of texts of a similarity differ, but for 4 pairs in 10 ** 4."""
    p, n = float(np.arccos(min(1.0, 2 * similar / (1 + similar))) / np.pi), 64 * words
    return int(np.ceil(n * p + 3.35 * np.sqrt(n * p * (1 - p))))


def links(distinct: DataFrame, r: int = DISTANCE, shard: int = SHARD, views: Views = HALVES, leaf: int = vptree.LEAF) -> DataFrame:
    """``distinct(fp)`` of distinct longs, or (fp, wide) with fingerprints in a binary column -> edges (u, v) of fp's: a
    spanning forest per shard of all links at distance <= r that a view allows."""
    spark, n, wide = distinct.sparkSession, distinct.count(), "wide" in distinct.columns
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n) / shard)))))
    # the trees' sample: 64 points a shard, so at most 64 * 2 ** MAX_DEPTH fingerprints on the driver
    share = min(1.0, 64 * 2**depth * 1.5 / max(1, n))
    schema = "fp long, wide binary" if wide else "fp long"

    def points(b: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(b["wide"]), "<u8").reshape(len(b), -1) if wide else b["fp"].to_numpy(np.int64).view(np.uint64)[:, None]

    if depth:
        picked = distinct.filter(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(64 * 2**MAX_DEPTH)
        sample = points(picked.toPandas().sort_values("fp"))
    else:
        sample = np.zeros((0, views.words), np.uint64)
    count = len(views.bits)
    trees = spark.sparkContext.broadcast([vptree.fit(views.key(sample, k), depth) for k in range(count)])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 4096):  # a row visits several shards
                own = b.iloc[i : i + 4096]
                pts = points(own)
                for k, tree in enumerate(trees.value):
                    at, to, home = vptree.route(views.key(pts, k), tree, views.near)
                    yield own.iloc[at].assign(leaf=count * to + k, home=home)

    def link(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["fp", "side"], ascending=[True, False])
        fp, pts, cross = b["fp"].to_numpy(np.int64), points(b), bool(b["j"].iloc[0] != b["i"].iloc[0])
        key = views.key(pts, int(b["leaf"].iloc[0] % count))
        label = vptree.search(pts, b["side"].to_numpy(int) == 1, r, key, views.near, cross, leaf)
        tied = label != np.arange(len(label))
        return pd.DataFrame({"u": fp[tied], "v": fp[label[tied]]})

    dealt = distinct.select(*schema.replace(" long", "").replace(" binary", "").split(", ")).mapInPandas(deal, f"{schema}, leaf long, home boolean")
    # a shard far beyond its size, as many values share the bits of its view, is cut into blocks: every two meet in a task
    sizes = dealt.groupBy("leaf").agg(F.count(F.when(F.col("home"), 1)).alias("h"), F.count(F.when(~F.col("home"), 1)).alias("o"))
    hot = store(sizes.filter(F.col("h") + F.col("o") > HOT * shard).select(F.col("leaf").alias("hot"), *(F.greatest(F.ceil(F.col(c) / shard), F.lit(1)).cast("int").alias(f"{c}b") for c in "ho")), "hot")
    rows = dealt.join(hot, F.col("leaf") == F.col("hot"), "left")
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("ob"))).cast("int")
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    mates = F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda k: F.when(k < F.col("own"), task(k, F.col("own"), 0)).otherwise(task(F.col("own"), k, 1)))
    guests = F.transform(F.sequence(F.lit(1), F.col("ob")), lambda k: task(F.col("own"), -k, 1))
    visits = F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda k: task(k, -1 - F.col("own"), 0))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").cast("int").alias("side")))
    rows = rows.withColumn("own", own).withColumn("task", F.explode(F.when(F.col("hb").isNull(), whole).when(F.col("home"), F.concat(mates, guests)).otherwise(visits)))
    return rows.select(*dealt.columns[:-2], "leaf", "task.*").groupBy("leaf", "i", "j").applyInPandas(link, "u long, v long")


def linked(fps: DataFrame, r: int = DISTANCE) -> DataFrame:
    """``fps(doc_id, fp)`` in the shared folder -> one row per distinct fp: (fp, root, component_id); root is the least fp of the group."""
    classes = store(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(links(classes.select("fp"), r)).withColumnRenamed("node", "fp")
    tied = store(classes.join(roots, "fp"), "tied")
    named = tied.join(tied.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "root", "component_id")
    alone = classes.join(tied.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("first_id").alias("component_id"))
    return store(alone.unionAll(named), "linked")


def near_duplicates(docs: DataFrame, width: int = 3, r: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs(doc_id, text)``."""
    fps = store(fingerprints(docs.select("doc_id", "text"), width=width).select("doc_id", "fp"), "fps")
    return fps.join(linked(fps, r), "fp").select("doc_id", "fp", "component_id")


def maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows(h, ...)`` with a column ``maybe``: whether h may be among those of ``keys``.

    By a bitmap of 2 ** FILTER_BITS bits, 8 MB whatever the number of keys, so it is broadcast: texts that can't meet a key
    needn't be dealt out to find that.  Of 10 ** 6 keys it lets pass 1.5 rows in 100 that aren't among them.
    """
    place, page = F.pmod(F.col("h"), F.lit(1 << FILTER_BITS)), 1 << 15
    bits = keys.select(place.alias("p")).groupBy(F.expr(f"p div {page}").alias("page")).agg(F.bitmap_construct_agg(F.col("p") % page).alias("bits"))
    out = rows.withColumn("p", place).withColumn("at", F.col("p") % page).join(F.broadcast(bits), F.expr(f"p div {page}") == F.col("page"), "left")
    bit = F.expr("getbit(cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as bigint), cast(at % 8 as int)) = 1")
    return out.withColumn("maybe", F.coalesce(bit, F.lit(False))).drop("p", "at", "page", "bits")


def alike(texts: list[str | None], width: int = WIDTH, similar: float = SIMILAR, visitor: np.ndarray | None = None) -> np.ndarray:
    """Labels of the sets that texts of similar shingle sets make; with ``visitor`` flags, only links of a visitor with another count."""
    n, label = len(texts), np.arange(len(texts))
    parts = [(doc + at, h) for at, t in textnum.batches(texts, lower=True) for doc, h in [t.shingles(width)]]
    doc, h = (np.concatenate(x) for x in zip(*parts))
    size = np.bincount(doc, minlength=n)
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    doc, column = doc[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    both = np.zeros((n, n), np.float32)  # counts of shared shingles, exact below 2 ** 24
    step = max(64, (1 << 22) // max(1, n))
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + step + 1, step))
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        some = np.zeros((n, step), np.float32)
        some[doc[lo:hi], column[lo:hi] - k * step] = 1
        both += some @ some.T
    a, b = np.nonzero(np.triu(both.astype(float) * (1 + similar) >= similar * (size[:, None] + size) - 1e-6, 1))
    if visitor is not None:
        own = visitor[a] != visitor[b]
        a, b = a[own], b[own]
    join_labels(label, a, b)
    return label


class Compared:
    """Compares texts of classes: ``tasks(cell, task, cid, side)`` -> edges (u, v), a spanning forest per task of its links; of side 0
    with side 1 only, if both are there.

    ``hashed(doc_id, text, h, g)`` are all rows, ``known(h, g, cid, own)`` the classes that may be compared, each of which has its
    first row's text go to its tasks.  Only texts that pass a filter of the classes' hashes are dealt, to the classes and to cells, and so at any size.
    """

    def __init__(self, hashed: DataFrame, known: DataFrame, repeated: bool, width: int, similar: float):
        self.hashed, self.known, self.repeated, self.width, self.similar = hashed, known, repeated, width, similar

    def edges(self, tasks: DataFrame) -> DataFrame:
        width, similar = self.width, self.similar

        def of(b: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, x in b.drop_duplicates(["task", "cid"]).sort_values(["task", "cid"]).groupby("task", sort=False):
                side, cid = x["side"].to_numpy(int), x["cid"].to_numpy(np.int64)
                label = alike(x["text"].tolist(), width, similar, side == 0 if (side == 0).any() else None)
                tied = label != np.arange(len(label))
                out.append(pd.DataFrame({"u": cid[tied], "v": cid[label[tied]]}))
            return pd.concat(out, ignore_index=True)

        one = self.known.select("h", "g", "cid", F.struct("own.a", "own.b").alias("first"))
        wanted = store(one.join(tasks, "cid"), "tasks")  # written, so that Spark knows its size before it deals texts
        rows = maybe(self.hashed, wanted).filter("maybe").withColumn("here", F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b")))
        rows = rows.join(wanted.hint("merge"), ["h", "g"]).filter(F.col("here").eqNullSafe(F.col("first"))).select("cell", "task", "cid", "side", "text")
        if self.repeated:  # rows that are repeated whole
            rows = rows.dropDuplicates(["cell", "task", "cid", "side"])
        return rows.groupBy("cell").applyInPandas(lambda b: of(b.drop(columns="cell")), "u long, v long")


def verified(found: DataFrame, compared: Compared) -> DataFrame:
    """``found(cid, root, bytes)``, classes by groups of candidates, in the shared folder -> edges (u, v) of the similar ones.

    A group's texts are compared all with all, in a task or, if there are too many, within blocks.  The blocks of a group share
    LEADERS of its members, so most of it links to them; texts that don't are then compared with all other blocks.
    """
    groups = found.groupBy("root").agg(
        F.greatest(F.ceil(F.count("cid") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"), F.sum("bytes").alias("all"),
        F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64(F.lit(k), "cid").alias("h"), "cid"))["cid"] for k in range(LEADERS)))).alias("leaders"),
    )
    groups = store(groups.withColumnRenamed("root", "r"), "groups")
    cells = max(1, int((groups.agg(F.sum("all")).first()[0] or 0) // (BLOCK_BYTES // 8)))
    rows = found.join(groups, F.col("root") == F.col("r")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = rows.withColumn("block", F.explode(F.when(F.array_contains("leaders", F.col("cid")), every).otherwise(F.array("block"))))
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(cells)).cast("string")).otherwise(F.concat_ws("|", "root", "block"))
    edges = store(compared.edges(first.select(cell.alias("cell"), F.xxhash64("root", "block").alias("task"), "cid", F.lit(1).alias("side"))), "edges")
    if groups.filter("blocks > 1").isEmpty():
        return edges
    members = rows.filter("blocks > 1").select("cid", "root", "block", "blocks")
    parts = members.join(components(edges).withColumnRenamed("root", "part"), F.col("cid") == F.col("node"), "left").select("cid", "root", F.coalesce("part", "cid").alias("part"))
    main = parts.groupBy("root", "part").count().groupBy(F.col("root").alias("m")).agg(F.max(F.struct("count", F.col("part").alias("main")))["main"].alias("main"))
    left = store(parts.join(main, (F.col("root") == F.col("m")) & (F.col("part") == F.col("main")), "left_anti").select(F.col("cid").alias("x"), F.col("root").alias("g")), "left")
    lots = store(left.groupBy(F.col("g").alias("l")).agg(F.ceil(F.count("x") / BLOCK).cast("int").alias("lots")), "lots")
    if lots.isEmpty():
        return edges
    mates = rows.join(lots, F.col("root") == F.col("l")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).withColumn("side", F.lit(1))
    guests = rows.join(left, (F.col("root") == F.col("g")) & (F.col("cid") == F.col("x"))).join(lots, F.col("root") == F.col("l"))
    guests = guests.withColumn("lot", F.pmod(F.xxhash64(F.lit(1), "cid"), F.col("lots")).cast("int")).withColumnRenamed("block", "own").withColumn("block", F.explode(every))
    guests = guests.filter("block <> own").withColumn("side", F.lit(0))
    both = [x.select(F.concat_ws("|", "root", "block", "lot").alias("cell"), F.lit(0).cast("long").alias("task"), "cid", "side") for x in (mates, guests)]
    return edges.unionAll(compared.edges(both[0].unionAll(both[1])))


def copies(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, views: Views = SIXTEENTHS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, g) of ``docs(doc_id, text)``, h and g being hashes of the text, and classes of texts alike (h, g, own, cid,
    root): own is the first row of a class, root the same for all classes that are linked.  Both are in the shared folder."""

    @F.pandas_udf("binary")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in (x for b in texts for x in slices(b)):
            yield pd.Series([x.tobytes() for x in wide_fingerprints(s.tolist(), width, views.words)], dtype=object)

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(SEED), "text").alias("g"))
    rows = store(hashed.select("doc_id", "h", "g", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), of("text").alias("wide")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("h").alias("c"))
    classes = rows.groupBy("h", "g").agg(F.min(order).alias("own"), F.first("bytes").alias("bytes"), F.first("wide").alias("wide"))
    classes = store(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    near = components(links(classes.select(F.col("cid").alias("fp"), "wide"), bits_apart(similar, views.words), WIDE_SHARD, views, WIDE_LEAF))
    known = store(classes.join(near, F.col("cid") == F.col("node")).select("h", "g", "cid", "root", "bytes", "own"), "known")
    repeated = not rows.groupBy("doc_id", "h", "g").count().filter("count > 1").isEmpty()
    pairs = components(verified(known.select("cid", "root", "bytes"), Compared(hashed, known, repeated, width, similar))).withColumnRenamed("root", "tied")
    out = classes.join(pairs, F.col("cid") == F.col("node"), "left").select("h", "g", "own", "cid", F.coalesce("tied", "cid").alias("root"))
    return rows, store(out, "copies")


def near_copies(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, views: Views = SIXTEENTHS) -> DataFrame:
    """(doc_id, component_id) per row: the least doc_id of the texts that links of similar shingle sets reach, null if none has one."""
    rows, classes = copies(docs, width, similar, views)
    least = classes.groupBy(F.col("root").alias("r")).agg(F.min("own.b").alias("component_id"))
    named = classes.join(least, F.col("root") == F.col("r")).select("h", "g", "component_id")
    return rows.join(named, ["h", "g"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, views: Views = SIXTEENTHS) -> DataFrame:
    """Rows of ``docs`` with one left of each group of near copies: that with the least doc_id (null last), then the least text hash.

    A row is known by (doc_id, XXH64 of its text), so a repeated id with another text is a row of its own; of rows
    alike in both, one stays.  The rows that go are the short side of an anti-join, to which only rows come that pass a
    filter of their hashes.  Repeats' texts are dealt by key only where there are some.
    """
    rows, classes = copies(docs.select("doc_id", "text"), width, similar, views)
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("h").alias("c"))
    # a group's first row is found over its classes, so rows are never dealt by group
    first = store(classes.join(classes.groupBy(F.col("root").alias("r")).agg(F.min("own").alias("first")), F.col("root") == F.col("r")).select("h", "g", "first"), "first")
    gone = store(rows.join(first, ["h", "g"]).filter(order != F.col("first")).select(F.col("doc_id").alias("__id"), F.col("h").alias("__g")).distinct(), "gone")
    left, same = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("h")), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__g"))
    marked = maybe(left, gone.select(F.col("__g").alias("h"))).select("row.*", F.col("h").alias("__h"), F.col("maybe").alias("__maybe"))
    kept = marked.filter("not __maybe").unionAll(marked.filter("__maybe").join(gone.hint("merge"), same, "left_anti")).drop("__maybe")
    repeats = rows.groupBy("doc_id", "h").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("h").alias("__g"))
    if not repeats.isEmpty():
        again = store(repeats, "repeats")
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "__h"]))
    return kept.drop("__h")
