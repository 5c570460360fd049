"""The elements of a rule, and the checks on a rule by itself."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from tessera.functions.lattice import Lattice
from tessera.terms import BOT, IGNORE, WITH_ELEMENTS, Expr, LVar, Var, value


class ProgramError(Exception):
    """A program that can't be run."""


class UnboundVariableError(ProgramError):
    pass


class StratificationError(ProgramError):
    pass


class ArityError(ProgramError):
    pass


@dataclass(eq=False)
class Relation:
    """A named relation: ``columns`` maps names to Spark types or lattices; ``source`` is its DataFrame if it is external."""

    name: str
    columns: dict[str, str | Lattice]
    source: Any = None

    def __call__(self, *terms: Any) -> Atom:
        whole, rest = None, list(terms)
        if len(terms) > 1 and terms[1] is WITH_ELEMENTS:
            whole, rest = terms[0], list(terms[2:])
        elif len(terms) == 1 and isinstance(terms[0], Var) and len(self.columns) > 1:
            whole, rest = terms[0], [IGNORE] * len(self.columns)
        if len(rest) != len(self.columns):
            raise ArityError(f"{self.name} has {len(self.columns)} columns, not {len(rest)}")
        return Atom(self, rest, whole)

    @property
    def derived(self) -> bool:
        return self.source is None

    @property
    def lattices(self) -> dict[str, Lattice]:
        return {n: t for n, t in self.columns.items() if isinstance(t, Lattice)}

    @property
    def keys(self) -> list[str]:
        return [n for n, t in self.columns.items() if not isinstance(t, Lattice)]

    def type_of(self, column: str) -> str:
        t = self.columns[column]
        return t.type if isinstance(t, Lattice) else t


@dataclass(eq=False)
class Atom:
    relation: Relation
    terms: list[Any]
    whole: Var | None = None
    negated: bool = False

    def __invert__(self) -> Atom:
        return Atom(self.relation, self.terms, self.whole, not self.negated)

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys([t.name for t in self.terms if isinstance(t, Var)] + ([self.whole.name] if self.whole is not None else [])))

    def __repr__(self) -> str:
        own = ", ".join(map(repr, self.terms))
        return f"{'!' * self.negated}{self.relation.name}({f'{self.whole} with ' if self.whole is not None else ''}{own})"


@dataclass(eq=False)
class Guard:
    condition: Expr

    def __repr__(self) -> str:
        return self.condition.text


@dataclass(eq=False)
class Bind:
    """Computes an unbound variable, or compares a bound one."""

    var: Var
    expr: Expr

    def __repr__(self) -> str:
        return f"{self.var} == {self.expr.text}"


@dataclass(eq=False)
class Iterate:
    """A row per element of an array, with its index from 0 if ``index`` is given."""

    var: Var
    expr: Expr
    index: Var | None = None

    def __repr__(self) -> str:
        return f"{self.var} == iterate({self.expr.text})" if self.index is None else f"tie({self.index}, {self.var}) == enumerate({self.expr.text})"


def guard(condition: Any) -> Guard:
    return Guard(value(condition))


def bind(var: Var, expr: Any) -> Bind:
    return Bind(var, value(expr))


def iterate(var: Var, expr: Any) -> Iterate:
    return Iterate(var, value(expr))


def enumerate_(index: Var, var: Var, expr: Any) -> Iterate:
    return Iterate(var, value(expr), index)


@dataclass(eq=False)
class Rule:
    """``head`` is an atom of a table, or for a sink a dict of named expressions."""

    head: Atom | dict[str, Expr]
    body: list[Any]
    index: int = 0
    recursive: set[int] = field(default_factory=set)

    def __repr__(self) -> str:
        head = repr(self.head) if isinstance(self.head, Atom) else "emit(" + ", ".join(f"{k}={v.text}" for k, v in self.head.items()) + ")"
        return f"{head} << " + " & ".join(f"{e!r}{'^' if i in self.recursive else ''}" for i, e in enumerate(self.body))

    def check(self) -> None:
        """Variables are bound by an earlier element before they are read; heads are complete."""
        if not self.body:
            raise ProgramError(f"rule {self!r} has no body")
        bound: set[str] = set()

        def need(names, what: str) -> None:
            if missing := [n for n in names if n not in bound]:
                raise UnboundVariableError(f"unbound variables {missing} at {what} in rule {self!r}")

        for i, e in enumerate(self.body):
            what = f"element {i} ({e!r})"
            if isinstance(e, Atom):
                for t in e.terms:
                    if isinstance(t, Expr) and not isinstance(t, Var):
                        need(t.uses, what)
                    elif t is BOT or t is WITH_ELEMENTS:
                        raise ProgramError(f"{t!r} can't stand in a body: {what}")
                if e.negated:
                    need(e.names, what)
                bound |= set(e.names)
            elif isinstance(e, Guard):
                need(e.condition.uses, what)
            elif isinstance(e, (Bind, Iterate)):
                need(e.expr.uses, what)
                bound |= {e.var.name} | ({e.index.name} if isinstance(e, Iterate) and e.index is not None else set())
            else:
                raise ProgramError(f"{e!r} isn't an element of a rule")
        if isinstance(self.head, Atom):
            if not self.head.relation.derived or self.head.negated or self.head.whole is not None:
                raise ProgramError(f"a head is a plain atom of a table: {self!r}")
            for t, (name, kind) in zip(self.head.terms, self.head.relation.columns.items()):
                if t is IGNORE or t is BOT and not isinstance(kind, Lattice):
                    raise ProgramError(f"{t!r} can't stand for column {name} of a head: {self!r}")
                if isinstance(t, Expr):
                    need(t.uses, "the head")
        else:
            for e in self.head.values():
                need(e.uses, "the head")

    @property
    def lattice_of(self) -> dict[str, Lattice]:
        return {t.name: t.lattice for e in self.body if isinstance(e, Atom) for t in e.terms if isinstance(t, LVar)}
