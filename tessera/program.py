"""Programs: relations, rules and how to run them."""

from __future__ import annotations

import traceback
import weakref
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lattice import Lattice
from tessera.operators import lower
from tessera.operators.fixpoint import Fixpoint
from tessera.plans import strata
from tessera.plans.rules import Atom, ProgramError, Relation, Rule
from tessera.terms import value

#: Moments at which hooks are called.
CONFIGURE, FIXPOINT, END = 1, 2, 4
#: The one policy of evaluation.
SEMI_NAIVE = "semi-naive"
#: Programs by name, the last of each, as long as someone holds them.
registry: weakref.WeakValueDictionary[str, Program] = weakref.WeakValueDictionary()
#: Rows that a look at a table brings to the driver at most.
SHOWN = 10_000


class Program:
    """A set of rules over DataFrames.

    External relations are bags and aren't deduplicated; tables are sets, or a row per key if they have lattice
    columns.  Sources must not hold NULL in columns that rules compare: such rows match nothing.
    """

    def __init__(self, spark: SparkSession, name: str = "program", provenance: bool = False, max_rounds: int = 10_000, policy: str | None = None):
        if policy not in (None, SEMI_NAIVE):
            raise ProgramError(f"there is no policy {policy!r}: rules are evaluated by {SEMI_NAIVE!r}")
        self.spark, self.name, self.provenance, self.max_rounds, self.policy = spark, name, provenance, max_rounds, policy or SEMI_NAIVE
        self.where = next((f"{f.filename}:{f.lineno} in {f.name}" for f in traceback.extract_stack()[-2::-1]), "?")
        self.rules: list[Rule] = []
        self.sinks: dict[str, Rule] = {}
        self.constraints: list[tuple[str, Rule]] = []
        self.relations: dict[str, Relation] = {}
        self.counts: list[int] | None = None
        self.hooks: list[tuple[int, Callable[[Program, int, Any], None]]] = []
        self.trips = 0
        self.order: list[list[Rule]] | None = None
        self.done: dict[Relation, DataFrame] = {}
        registry[name] = self

    # declarations

    def external(self, df: DataFrame, name: str) -> Relation:
        """A source; its columns are taken by position, and named differently."""
        names = [n.lower() for n in df.columns]
        if len(set(names)) < len(names):
            raise ProgramError(f"{name} has columns of the same name: {df.columns}")
        return self._add(Relation(name, {f.name: f.dataType.simpleString() for f in df.schema.fields}, df))

    def table(self, name: str, schema: str | None = None, **columns: str | Lattice) -> Relation:
        """A derived relation: ``table("R", "u long, v long")`` or ``table("S", u="long", d=lmin())``."""
        own: dict[str, str | Lattice] = {}
        for part in (schema or "").split(","):
            if part.strip():
                n, _, t = part.strip().partition(" ")
                own[n] = t.strip()
        return self._add(Relation(name, own | columns))

    def _add(self, r: Relation) -> Relation:
        if r.name in self.relations:
            raise ProgramError(f"there is a relation {r.name} already")
        self.relations[r.name] = r
        return r

    def rule(self, head: Atom, *body: Any) -> Rule:
        r = Rule(head, list(body), len(self.rules))
        r.check()
        self._own(head, *body)
        self.rules.append(r)
        self.order = None
        return r

    def _own(self, *elements: Any) -> None:
        for a in elements:
            if isinstance(a, Atom) and self.relations.get(a.relation.name) is not a.relation:
                raise ProgramError(f"{a.relation.name} is a relation of another program")

    def emit(self, name: str, columns: dict[str, Any], *body: Any) -> Rule:
        """A sink: a row per derivation, repeats and all."""
        r = Rule({k: value(v) for k, v in columns.items()}, list(body), -1)
        r.check()
        self._own(*body)
        self.sinks[name] = r
        return r

    def constraint(self, message: str, *body: Any) -> Rule:
        """A condition that no derivation may meet."""
        r = Rule({"violated": value(1)}, list(body), -1)
        r.check()
        self._own(*body)
        self.constraints.append((message, r))
        return r

    def strata(self, counts: list[int]) -> None:
        """Strata by hand: so many rules each, as they are written."""
        self.counts = counts
        self.order = None

    def on(self, moments: int, hook: Callable[[Program, int, Any], None]) -> None:
        """Calls ``hook(program, moment, detail)`` at each of the moments (CONFIGURE, FIXPOINT, END, or several or-ed)."""
        self.hooks.append((moments, hook))

    def _tell(self, moment: int, detail: Any = None) -> None:
        for moments, hook in self.hooks:
            if moments & moment:
                hook(self, moment, detail)

    # running

    def plan(self) -> list[list[Rule]]:
        """The rules by stratum."""
        if self.order is None:
            self.order = strata.by_counts(self.rules, self.counts) if self.counts is not None else strata.stratify(self.rules)
        return self.order

    def run(self, result: Relation | str | None = None, ordered: bool | Sequence[str | Column] = False) -> DataFrame | None:
        """Runs all rules and constraints; the rows of a table or sink, sorted if ``ordered``: by key, or by the columns or
        expressions given, which may be descending or any comparison key of the caller's."""
        order = self.plan()
        self._tell(CONFIGURE, order)
        self.done = {}
        readers = [*self.rules, *self.sinks.values(), *(r for _, r in self.constraints)]
        fix = Fixpoint(self.spark, self.done, self.provenance, self.max_rounds, lambda n, sizes: self._tell(FIXPOINT, (n, sizes)), readers)
        if isinstance(result, Relation):
            fix.times[result] += 1
        for rules in order:
            self.done.update(fix.run(rules))
        for message, r in self.constraints:
            if not fix.derive(r).isEmpty():
                raise ProgramError(message)
        self.trips += 1
        out = None if result is None else self.rows(result, ordered) if isinstance(result, Relation) else self._sorted(fix.derive(self.sinks[result]), ordered, list(self.sinks[result].head))
        self._tell(END, out)
        return out

    def _sorted(self, df: DataFrame, ordered: bool | Sequence[str | Column], keys: list[str]) -> DataFrame:
        if ordered is False:
            return df
        return df.orderBy(*([F.col(f"`{k}`") for k in keys] if ordered is True else ordered))

    def rows(self, table: Relation, ordered: bool | Sequence[str | Column] = False) -> DataFrame:
        """The rows of a table after a run; bottoms as the lattice shows them."""
        df = self.done.get(table)
        if df is None:
            df = Fixpoint(self.spark, {}, self.provenance, 1).empty(table)
        proof = [c for c in (lower.HEIGHT, lower.RULE) if c in df.columns]
        df = df.select(*((t.shown(F.col(f"`{n}`")).alias(n) if isinstance(t, Lattice) else F.col(f"`{n}`")) for n, t in table.columns.items()), *proof)
        return self._sorted(df, ordered, table.keys)

    def proofs(self, table: Relation, row: tuple, limit: int = SHOWN) -> list[tuple[int, list[dict]]]:
        """One step of proof: per rule of a table, ``limit`` of the bindings that derive a row (its lattice columns aside)."""
        out = []
        fix = Fixpoint(self.spark, self.done, False, 1)
        for r in self.rules:
            if r.head.relation is not table:
                continue
            b = lower.body(self.spark, r, lambda i, a: fix.source(a), blocks=False)
            df = b.start()
            for t, v, (name, kind) in zip(r.head.terms, row, table.columns.items()):
                if not isinstance(kind, Lattice):
                    df = df.filter(value(t).build(b.env()).cast(kind) == F.lit(v))
            if found := [x.asDict() for x in df.limit(limit).collect()]:
                out.append((r.index, found))
        return out

    def explain(self) -> str:
        """Relations, and rules by stratum; recursive positions bear a ^."""
        lines = [f"program {self.name}"]
        for r in self.relations.values():
            own = ", ".join(f"{n} {t.name if isinstance(t, Lattice) else t}" for n, t in r.columns.items())
            lines.append(f"  {'table' if r.derived else 'external'} {r.name}({own})")
        for i, rules in enumerate(self.plan()):
            lines.append(f"  stratum {i}" + (" (recursive)" if any(r.recursive for r in rules) else ""))
            lines += [f"    {r!r}" for r in rules]
        lines += [f"  sink {n}: {r!r}" for n, r in self.sinks.items()]
        return "\n".join(lines)

    def dump(self, limit: int = 20) -> str:
        """The tables after a run as text, by stratum: their rows as far as ``limit`` goes, and how many there are."""
        lines = [f"program {self.name}, defined at {self.where}, {self.trips} runs"]
        for i, rules in enumerate(self.plan()):
            lines.append(f"  stratum {i}" + (" (recursive)" if any(r.recursive for r in rules) else ""))
            for t in dict.fromkeys(r.head.relation for r in rules):
                df = self.rows(t, True)
                lines.append(f"    {t.name}: {df.count()} rows")
                lines += [f"      {tuple(r)!r}" for r in df.limit(limit).collect()]
        return "\n".join(lines)

