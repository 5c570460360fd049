"""Rule bodies as DataFrames: joins, semi- and anti-joins, filters, computed columns, explodes.

The running DataFrame has a column per bound variable, named by it.  Elements are lowered left to right, which
fixes what is bound where; the order of joins is Catalyst's.

A join whose pairs a guard then compares (a theta join) may make far more pairs than it has rows, of few keys, and Spark
deals by the bytes of its input.  Where there are many pairs, both sides of a key are cut in blocks, and every block meets every
block of the other side once, in tasks by the number of pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.rules import Atom, Bind, Guard, Iterate, Rule
from tessera.runtime import Stored
from tessera.terms import BOT, IGNORE, Expr, LVar, Var, value

#: Columns that provenance adds to the relations of a program.
HEIGHT, RULE = "_height", "_rule"
#: Rows of a block of a key in a theta join, left and right; a merge join holds the right ones in an array up to 4,096.
BLOCK = 16_384, 3_584
#: Pairs beyond which a theta join is cut in blocks, and pairs a task.
PAIRS = 1 << 24
#: Tasks of a theta join at most.
TASKS = 20_000


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def in_blocks(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], on: list[Column]) -> DataFrame:
    """The inner join of two sides whose keys may have many pairs.  The keys that are cut have a side larger than a block, so they are
    few and are broadcast."""
    names = [f"__k{i}" for i in range(len(keys))]
    sizes = [df.groupBy(*(k[side].alias(n) for n, k in zip(names, keys))).agg(F.count(F.lit(1)).alias(f"__n{side}")) for side, df in enumerate((left, right))]
    pairs = F.col("__n0").cast("double") * F.col("__n1")
    both = Stored(left.sparkSession, sizes[0].join(sizes[1], names), "sizes")
    total = both.df.agg(F.sum(pairs)).first()[0] or 0
    if total <= PAIRS:
        both.drop()
        return left.join(right, all_of(on), "inner")
    cuts = [F.ceil(F.col(f"__n{side}") / n).cast("int").alias(f"__s{side}") for side, n in enumerate(BLOCK)]
    heavy = F.broadcast(both.df.filter(pairs > BLOCK[0] * BLOCK[1]).select(*names, *cuts))
    tasks = min(max(math.ceil(total / PAIRS), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), TASKS)
    dealt = []
    for side, df in enumerate((left, right)):
        own, other = [F.coalesce(F.col(f"__s{i}"), F.lit(1)) for i in (side, 1 - side)]
        mine = F.pmod(F.xxhash64(*(F.col(f"`{n}`") for n in df.columns)), own).cast("int").alias(f"__b{side}_{side}")
        cut = df.join(heavy, all_of([k[side] == F.col(n) for n, k in zip(names, keys)]), "left_outer")
        cut = cut.select(*(F.col(f"`{n}`") for n in df.columns), mine, F.explode(F.sequence(F.lit(0), other - 1)).alias(f"__b{side}_{1 - side}"))
        dealt.append(cut.repartition(tasks, *(k[side] for k in keys), F.col(f"__b{side}_0"), F.col(f"__b{side}_1")))
    return dealt[0].join(dealt[1].hint("merge"), all_of([*on, F.col("__b0_0") == F.col("__b1_0"), F.col("__b0_1") == F.col("__b1_1")]), "inner")


class Body:
    """The state of lowering one rule."""

    def __init__(self, spark: SparkSession, rule: Rule, provenance: bool = False):
        self.spark, self.rule, self.provenance = spark, rule, provenance
        self.df: DataFrame | None = None
        self.bound: list[str] = []
        self.lattices = rule.lattice_of
        self.seen = 0

    def env(self) -> dict[str, Column]:
        return {n: F.col(f"`{n}`") for n in self.bound}

    def start(self) -> DataFrame:
        """A frame of one row, for a rule that begins without an atom."""
        if self.df is None:
            self.df = self.spark.range(1).select(*([F.lit(0).alias(HEIGHT)] if self.provenance else []))
        return self.df

    def atom(self, a: Atom, df: DataFrame, theta: bool = False) -> None:
        """``theta``: a guard compares the pairs of the join."""
        self.seen += 1
        names = list(a.relation.columns)
        lattices = a.relation.lattices
        own = [f"__{self.seen}_{i}" for i in range(len(names))]
        df = df.select(*(F.col(f"`{n}`").alias(o) for n, o in zip(names, own)), *([F.struct(*(F.col(f"`{n}`") for n in names)).alias("__whole")] if a.whole is not None else []), *([F.col(HEIGHT).alias("__height")] if self.provenance else []))
        bound = set(self.bound)
        # every term given: membership, which on a table with lattice columns asks for the key alone
        point = not a.negated and a.whole is None and all(t is not IGNORE and (not isinstance(t, Var) or t.name in bound) for t in a.terms)
        by_key = (point or a.negated) and bool(lattices)
        local: dict[str, str] = {}
        filters: list[Column] = []
        joins: list[tuple[str, Column]] = []
        bounds: list[tuple[LVar, str]] = []
        for t, name, o in zip(a.terms, names, own):
            if t is IGNORE or by_key and name in lattices:
                continue
            if isinstance(t, LVar):
                lifted = F.col(o) if name in lattices else t.lattice.lift(F.col(o))
                df = df.withColumn(o, lifted)
                if t.name in local:
                    df = df.withColumn(local[t.name], t.lattice.join(F.col(local[t.name]), F.col(o)))
                else:
                    local[t.name] = o
                    if t.name in bound:
                        bounds.append((t, o))
            elif isinstance(t, Var):
                if t.name in local:
                    filters.append(F.col(local[t.name]) == F.col(o))
                else:
                    local[t.name] = o
                    if t.name in bound:
                        joins.append((t.name, F.col(o)))
            elif isinstance(t, Expr) and t.uses:
                joins.append(("", F.col(o) == t.build(self.env())))
            else:
                filters.append(F.col(o) == value(t).build({}))
        whole = a.whole.name if a.whole is not None else None
        if whole in bound:
            joins.append((whole, F.col("__whole")))
        if filters:
            df = df.filter(all_of(filters))
        on = [F.col(f"`{n}`") == c if n else c for n, c in joins]
        if a.negated:
            self.df = self.start().join(df.select(*own) if on else df.select(own[0]).limit(1), all_of(on), "left_anti")
            return
        new = [(n, o) for n, o in local.items() if n not in bound]
        keep = [F.col(f"`{n}`") for n in self.bound]
        height = [F.greatest(F.col(HEIGHT), F.col("__height")).alias(HEIGHT)] if self.provenance else []
        if point and not bounds and not self.provenance:
            self.df = self.start().join(df.select(*own) if on else df.select(own[0]).limit(1), all_of(on), "left_semi")
            return
        if self.df is None:
            joined, height = df, [F.col("__height").alias(HEIGHT)] if self.provenance else []
        elif theta and (keys := [(F.col(f"`{n}`"), c) for n, c in joins if n]) and not (self.df.isStreaming or df.isStreaming):
            joined = in_blocks(self.df, df, keys, on)
        elif on:
            joined = self.df.join(df, all_of(on), "inner")
        else:
            joined = self.df.crossJoin(df)
        if point and self.provenance:  # membership adds one derivation, of the least height
            joined = joined.groupBy(*keep, HEIGHT).agg(F.min("__height").alias("__height")) if keep else joined.limit(1)
        merged = {t.name: t.lattice.join(F.col(f"`{t.name}`"), F.col(o)) for t, o in bounds}
        out = [merged[n].alias(n) if n in merged else F.col(f"`{n}`") for n in self.bound]
        out += [F.col(o).alias(n) for n, o in new]
        self.bound += [n for n, _ in new]
        if whole is not None and whole not in bound:
            out.append(F.col("__whole").alias(whole))
            self.bound.append(whole)
        # a rule may bind nothing: its rows still count
        self.df = joined.select(*out, *height) if out or height else joined.select(F.lit(1).alias("__row"))

    def element(self, e: Guard | Bind | Iterate) -> None:
        df = self.start()
        if isinstance(e, Guard):
            self.df = df.filter(e.condition.build(self.env()))
            return
        column, name = e.expr.build(self.env()), e.var.name
        if isinstance(e, Bind):
            if name in self.bound and isinstance(e.var, LVar):
                self.df = df.withColumn(name, e.var.lattice.join(F.col(f"`{name}`"), column))
            elif name in self.bound:
                self.df = df.filter(F.col(f"`{name}`") == column)
            else:
                self.df, self.bound = df.withColumn(name, column), [*self.bound, name]
            return
        own = [F.col(f"`{n}`") for n in self.bound] + ([F.col(HEIGHT)] if self.provenance else [])
        if e.index is None:
            df = df.select(*own, F.explode(column).alias("__element"))
        else:
            df = df.select(*own, F.posexplode(column).alias("__index", "__element"))
        for var, c in ((e.index, "__index"), (e.var, "__element")):
            if var is None:
                continue
            if var.name in self.bound:
                df = df.filter(F.col(f"`{var.name}`") == F.col(c)).drop(c)
            else:
                df, self.bound = df.withColumnRenamed(c, var.name), [*self.bound, var.name]
        self.df = df


def compared(rule: Rule, at: int, bound: set[str]) -> bool:
    """Whether a guard compares what the atom at a position binds with what was bound before, ahead of the next atom."""
    new = set(rule.body[at].names) - bound
    following = itertools.takewhile(lambda e: not isinstance(e, Atom), rule.body[at + 1 :])
    return any(isinstance(e, Guard) and new & set(e.condition.uses) and bound & set(e.condition.uses) for e in following)


def body(spark: SparkSession, rule: Rule, frame: Callable[[int, Atom], DataFrame], provenance: bool = False, blocks: bool = True) -> Body:
    """Lowers a rule's body; ``frame`` gives the DataFrame that an atom at a position reads; with ``blocks``, theta joins are cut."""
    b = Body(spark, rule, provenance)
    for i, e in enumerate(rule.body):
        if isinstance(e, Atom):
            b.atom(e, frame(i, e), blocks and not e.negated and compared(rule, i, set(b.bound)))
        else:
            b.element(e)
    return b


def head(b: Body) -> DataFrame:
    """The derivations of a rule as rows of its head: cast to the declared types, bottoms as NULL."""
    rule, df = b.rule, b.start()
    if not isinstance(rule.head, Atom):
        return df.select(*(e.build(b.env()).alias(k) for k, e in rule.head.items()))
    out = []
    for t, (name, kind) in zip(rule.head.terms, rule.head.relation.columns.items()):
        c = F.lit(None) if t is BOT else value(t).build(b.env())
        typed = rule.head.relation.type_of(name)
        if not isinstance(kind, str) and t is not BOT and not isinstance(t, LVar) and typed.startswith("array"):
            c = F.when(F.lit(False), F.lit(None).cast(typed)).otherwise(c) if is_array(df, c) else kind.lift(c)
        out.append(c.cast(typed).alias(name))
    extra = [(F.col(HEIGHT) + 1).cast("int").alias(HEIGHT), F.lit(rule.index).alias(RULE)] if b.provenance else []
    return df.select(*out, *extra)


def is_array(df: DataFrame, c: Column) -> bool:
    return df.select(c.alias("x")).schema["x"].dataType.typeName() == "array"


def normalised(df: DataFrame, relation, provenance: bool = False) -> DataFrame:
    """A set of rows, or a row per key with its lattice columns merged; of proofs the lowest."""
    keys = [f"`{k}`" for k in relation.keys]
    proof = [F.min(F.struct(HEIGHT, RULE)).alias("__proof")] if provenance else []
    if not relation.lattices:
        if not provenance:
            return df.distinct()
        return df.groupBy(*keys).agg(*proof).select(*keys, f"__proof.{HEIGHT}", f"__proof.{RULE}")
    merged = df.groupBy(*keys).agg(*(t.merge(F.col(f"`{n}`")).alias(n) for n, t in relation.lattices.items()), *proof, F.count(F.lit(1)).alias("__n"))
    merged = merged.filter("__n > 0")  # without a key, no rows make no row
    return merged.select(*(f"`{n}`" for n in relation.columns), *([f"__proof.{HEIGHT}", f"__proof.{RULE}"] if provenance else []))
