"""Strata: one pass over the rules that don't recur, then semi-naive rounds until nothing is new.

A round reads, for each recursive position of a rule, the last round's news there, at recursive positions before it all that
is known, and after it what was known before, so that no derivation from news is made twice.  News is written to the
shared folder, so a round's plan is as long as a rule's; what is known is kept as its rounds' tables and gathered anew
now and then, so it isn't rewritten each round.  The rounds' tables of a set are disjoint; those of a lattice hold a row
for a key that is new or better, and merge where they are read.

What doesn't change from round to round, external relations and finished tables, is written once per run, only the
columns that rules read; so are derived tables that several readers share.

Before the first two atoms of a recursive rule are joined, the second is cut to the rows whose keys the first has, by keys
alone: a join on few keys (a graph's hubs) then has a small side, which is broadcast, so the many rows of such a key don't
meet in one task.  What the cut rows hold bounds what the round can derive, and only what is known within these bounds is read to
tell what is new.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lower
from tessera.plans.rules import Atom, ProgramError, Relation, Rule
from tessera.runtime import Stored
from tessera.terms import IGNORE, LVar, Var

#: Rounds after which a table's parts are gathered into one.
GATHER = 12
#: Rows up to which a cut table or its keys are broadcast.
SMALL = 1 << 20
#: Rows known in a stratum from which on atoms are cut; below, the jobs for it take longer than they save.
MANY = 1 << 18
#: A first cut that leaves a larger share of the rows isn't followed by others.
WORTH = 0.25
INTEGERS = {"tinyint": 1, "byte": 1, "smallint": 2, "short": 2, "int": 3, "integer": 3, "bigint": 4, "long": 4}


@dataclass
class Known:
    """What is known of a table: parts in the shared folder, the last of them the last round's news."""

    relation: Relation
    provenance: bool
    parts: list[Stored] = field(default_factory=list)
    size: int | None = None  # of the news
    rows: int = 0  # in all parts
    bettered: bool = False  # whether a lattice's parts share keys

    def _whole(self, parts: list[Stored]) -> DataFrame | None:
        if not parts:
            return None
        rows = reduce(DataFrame.unionAll, [p.df for p in parts])
        return lower.normalised(rows, self.relation, self.provenance) if self.bettered and len(parts) > 1 else rows

    @property
    def df(self) -> DataFrame:
        return self._whole(self.parts)

    @property
    def news(self) -> DataFrame:
        return self.parts[-1].df

    @property
    def stable(self) -> DataFrame | None:
        """What was known before the news, None if nothing; of a lattice all, as its older rows may have been bettered."""
        if not self.size or self.relation.lattices and len(self.parts) > 1:
            return self.df
        return self._whole(self.parts[:-1])


@dataclass
class Bound:
    """The values of a head's column that a way can derive: their range, and the rows that hold them if they are few."""

    least: int
    most: int
    rows: DataFrame | None


def within(known: DataFrame, ways: list[dict[str, Bound]]) -> DataFrame:
    """What is known that the ways could derive again."""
    for n in ways[0]:
        own = [w[n] for w in ways if n in w]
        if len(own) < len(ways):
            continue
        known = known.filter(F.col(f"`{n}`").between(min(x.least for x in own), max(x.most for x in own)))
        if all(x.rows is not None for x in own):
            values = reduce(DataFrame.unionAll, [x.rows for x in own]).distinct()
            known = known.join(F.broadcast(values), F.col(f"`{n}`") == F.col("__value"), "left_semi")
    return known


def unknown(relation: Relation, made: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a set that are new."""
    old = known.select(*(F.col(f"`{n}`").alias(f"__k{i}") for i, n in enumerate(relation.columns)))
    on = lower.all_of([F.col(f"`{n}`").eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(relation.columns)])
    return made.join(old, on, "left_anti")


def improved(relation: Relation, made: DataFrame, known: list[DataFrame], provenance: bool, seen: Observation) -> DataFrame:
    """Rows of a set that are new; keys of a lattice table that are new or better, merged with what was known; in one aggregation.
    ``seen`` counts the keys that were known."""
    extra = [lower.HEIGHT, lower.RULE] if provenance else []
    cols = [*(F.col(f"`{n}`") for n in relation.columns), *extra]
    both = reduce(DataFrame.unionAll, [made.select(*cols, F.lit(False).alias("__was")), *(k.select(*cols, F.lit(True)) for k in known)])
    was = lambda n: F.when(F.col("__was"), F.col(f"`{n}`"))
    aggs = [t.merge(F.col(f"`{n}`")).alias(f"{n}") for n, t in relation.lattices.items()] + [t.merge(was(n)).alias(f"__old_{i}") for i, (n, t) in enumerate(relation.lattices.items())]
    proof = [F.min(F.struct(*extra)).alias("__proof")] if provenance else []
    out = both.groupBy(*(f"`{k}`" for k in relation.keys)).agg(*aggs, *proof, F.max("__was").alias("__there"), (~F.min("__was")).alias("__made"))
    better = [t.better(F.col(f"`{n}`"), F.col(f"__old_{i}")) for i, (n, t) in enumerate(relation.lattices.items())]
    new = F.col("__made") & reduce(lambda a, b: a | b, better, ~F.col("__there"))
    return out.filter(new).observe(seen, F.count_if("__there").alias("n")).select(*(F.col(f"`{n}`") for n in relation.columns), *(F.col(f"__proof.{x}").alias(x) for x in extra))


def reads(rule: Rule) -> list[Atom]:
    return [e for e in rule.body if isinstance(e, Atom)]


class Fixpoint:
    """``readers``: the rules, sinks and constraints that read tables after their stratum, to tell which tables are shared."""

    def __init__(self, spark: SparkSession, done: dict[Relation, DataFrame], provenance: bool, max_rounds: int, on_round=None, readers: Iterable[Rule] = ()):
        self.spark, self.done, self.provenance, self.max_rounds, self.on_round = spark, done, provenance, max_rounds, on_round
        self.times = Counter(a.relation for r in readers for a in reads(r))
        self.fixed: dict[Relation, DataFrame] = {}
        self.idle: set[tuple[int, int]] = set()  # rules and positions of news at which a cut isn't worth it
        self.tried: set[tuple[int, int]] = set()

    def source(self, a: Atom) -> DataFrame:
        df = self.fixed.get(a.relation)
        if df is None:
            df = self.done.get(a.relation) if a.relation.derived else a.relation.source
        if df is None:
            df = self.spark.createDataFrame([], ", ".join(f"`{n}` {a.relation.type_of(n)}" for n in a.relation.columns))
        return df.withColumn(lower.HEIGHT, F.lit(0)) if self.provenance and lower.HEIGHT not in df.columns else df

    def fix(self, rules: list[Rule], others: list[Rule]) -> list[Stored]:
        """Writes what the recursive rules read besides their own tables, once, for them and the others of the stratum; columns
        that no atom reads as nulls."""
        out = []
        outer = [a for r in rules for i, a in enumerate(r.body) if isinstance(a, Atom) and i not in r.recursive]
        for t in dict.fromkeys(a.relation for a in outer):
            if t.derived and (t not in self.done or self.times[t] > 1):  # empty, or written already
                continue
            own = [a for r in [*rules, *others] for a in reads(r) if a.relation is t]
            whole = any(a.whole is not None for a in own)
            used = [n for i, n in enumerate(t.columns) if whole or any(a.terms[i] is not IGNORE for a in own)]
            df = self.done[t] if t.derived else t.source
            extra = [c for c in (lower.HEIGHT, lower.RULE) if c in df.columns and c not in t.columns]
            out.append(Stored(self.spark, df.select(*(F.col(f"`{n}`") if n in used else F.lit(None).cast(t.type_of(n)).alias(n) for n in t.columns), *extra), t.name))
            self.fixed[t] = out[-1].df
        return out

    def derive(self, rule: Rule, frames: dict[int, DataFrame] | None = None) -> DataFrame:
        return lower.head(lower.body(self.spark, rule, lambda i, a: (frames or {}).get(i) if i in (frames or {}) else self.source(a), self.provenance))

    def run(self, rules: list[Rule]) -> dict[Relation, DataFrame]:
        """The tables of one stratum; what ``done`` has of them is merged in."""
        tables = list(dict.fromkeys(r.head.relation for r in rules))
        recursive = [r for r in rules if r.recursive]
        fixed = self.fix(recursive, [r for r in rules if not r.recursive]) if recursive else []
        made = {t: [self.derive(r) for r in rules if r.head.relation is t and not r.recursive] + ([self.done[t]] if t in self.done else []) for t in tables}
        if not recursive:
            out = {t: lower.normalised(reduce(DataFrame.unionAll, dfs), t, self.provenance) for t, dfs in made.items()}
            return {t: Stored(self.spark, df, t.name).df if self.times[t] > 1 else df for t, df in out.items()}
        known = {}
        for t in tables:
            base = reduce(DataFrame.unionAll, made[t]) if made[t] else self.empty(t, proof=True)
            first, size = self.written(t, lower.normalised(base, t, self.provenance))
            known[t] = Known(t, self.provenance, [first], size, size)
        for round_ in range(1, self.max_rounds + 1):
            fresh, cut, many = {}, [], sum(k.rows for k in known.values()) > MANY
            for t in tables:
                ways, bounds = [], []
                for r in recursive:
                    for i in sorted(r.recursive) if r.head.relation is t else ():
                        if not known[r.body[i].relation].size or (f := self.frames(r, i, known)) is None:
                            continue
                        f, bound, stored = self.narrowed(r, i, f) if many else (f, {}, [])
                        cut += stored
                        if f is not None:
                            ways.append(self.derive(r, f))
                            bounds.append(bound)
                if ways:
                    every, seen = reduce(DataFrame.unionAll, ways), Observation()
                    if t.lattices or any(bounds):
                        fresh[t] = improved(t, every, [within(p.df, bounds) for p in known[t].parts], self.provenance, seen), seen
                    else:
                        fresh[t] = unknown(t, lower.normalised(every, t, self.provenance), known[t].df), seen
            fresh = {t: (*self.written(t, df), seen) for t, (df, seen) in fresh.items()}  # all of a round before any is known
            for x in cut:
                x.drop()
            sizes = {t.name: fresh[t][1] if t in fresh else 0 for t in tables}
            if self.on_round:
                self.on_round(round_, sizes)
            for t in tables:
                made_, size, seen = fresh.get(t, (None, 0, None))
                known[t].bettered |= bool(size and t.lattices and seen.get.get("n", 0))
                self.advance(known[t], made_, size)
            if not any(sizes.values()):
                for x in fixed:
                    x.drop()
                self.fixed = {}
                return {t: k.df for t, k in known.items()}
        raise ProgramError(f"no fixpoint in {self.max_rounds} rounds of {[t.name for t in tables]}")

    def empty(self, t: Relation, proof: bool = False) -> DataFrame:
        extra = f", {lower.HEIGHT} int" + f", {lower.RULE} int" * proof if self.provenance else ""
        return self.spark.createDataFrame([], ", ".join(f"`{n}` {t.type_of(n)}" for n in t.columns) + extra)

    def frames(self, rule: Rule, at: int, known: dict[Relation, Known]) -> dict[int, DataFrame] | None:
        """What the recursive positions read if the news is at one of them; None if one would read nothing."""
        out = {}
        for i in rule.recursive:
            k = known[rule.body[i].relation]
            out[i] = k.news if i == at else k.df if i < at else k.stable
        return None if any(df is None for df in out.values()) else out

    def narrowed(self, rule: Rule, at: int, frames: dict[int, DataFrame]) -> tuple[dict[int, DataFrame] | None, dict[str, Bound], list[Stored]]:
        """The frames with the second atom cut to the keys of the first, None if nothing is left; bounds of the head's columns; and
        what was written for it."""
        if (rule.index, at) in self.idle or len(rule.body) < 2 or any(not isinstance(a, Atom) or a.negated or a.whole is not None for a in rule.body[:2]):
            return frames, {}, []
        plain = [{t.name: n for t, n in zip(a.terms, a.relation.columns) if isinstance(t, Var) and not isinstance(t, LVar)} for a in rule.body[:2]]
        shared = [v for v in plain[0] if v in plain[1]]
        if not shared:
            return frames, {}, []
        one, two = (frames[i] if i in frames else self.source(rule.body[i]) for i in (0, 1))
        keys, size = self.written(rule.body[0].relation, one.select(*(F.col(f"`{plain[0][v]}`").alias(f"__k{i}") for i, v in enumerate(shared))).distinct())
        on = lower.all_of([F.col(f"`{plain[1][v]}`") == F.col(f"__k{i}") for i, v in enumerate(shared)])
        held = two.join(F.broadcast(keys.df) if size <= SMALL else keys.df, on, "left_semi")
        spans = {}
        for t, (n, kind) in zip(rule.head.terms, rule.head.relation.columns.items()):
            own = plain[1].get(t.name) if isinstance(t, Var) and not isinstance(t, LVar) else None
            if own and isinstance(kind, str) and 0 < INTEGERS.get(rule.body[1].relation.type_of(own), 0) <= INTEGERS.get(kind, 0):
                spans[n] = own
        seen = Observation()
        aggs = [f(F.col(f"`{c}`")).alias(f"{name}{i}") for i, c in enumerate(spans.values()) for f, name in ((F.min, "least"), (F.max, "most"), (lambda x: F.count_if(x.isNull()), "nulls"))]
        rows = Stored(self.spark, held.observe(seen, F.count(F.lit(1)).alias("n"), *aggs), rule.body[1].relation.name)
        keys.drop()
        got = seen.get
        if not got.get("n"):
            return None, {}, [rows]
        few = got["n"] <= SMALL
        if (rule.index, at) not in self.tried:
            self.tried.add((rule.index, at))
            if got["n"] > WORTH * two.count():
                self.idle.add((rule.index, at))
        bounds = {n: Bound(got[f"least{i}"], got[f"most{i}"], rows.df.select(F.col(f"`{c}`").alias("__value")) if few else None) for i, (n, c) in enumerate(spans.items()) if not got[f"nulls{i}"]}
        return frames | {1: F.broadcast(rows.df) if few else rows.df}, bounds, [rows]

    def written(self, t: Relation, df: DataFrame) -> tuple[Stored, int]:
        """A round's table and its rows, counted as they are written."""
        seen = Observation()
        return Stored(self.spark, df.observe(seen, F.count(F.lit(1)).alias("n")), t.name), seen.get.get("n", 0)

    def advance(self, k: Known, made: Stored | None, size: int) -> None:
        k.size, k.rows = size, k.rows + size
        if not size:
            if made is not None:
                made.drop()
            return
        k.parts = [*k.parts, made]
        if len(k.parts) > GATHER:  # the news stays a part of its own
            old = k.parts[:-1]
            k.parts = [Stored(self.spark, Known(k.relation, self.provenance, old).df, k.relation.name), made]
            for p in old:
                p.drop()
