"""Variables and expressions of rules.

An expression is a function of the bound columns together with the variables that it reads, so that a rule can be
checked before any DataFrame exists.  Operators on variables build expressions; ``call`` applies any function of
columns, ``value`` makes a constant.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.lattice import Lattice


class Expr:
    """``build(env)`` gives the column, env mapping the names in ``uses`` to columns."""

    def __init__(self, build: Callable[[dict[str, Column]], Column], uses: tuple[str, ...] = (), text: str = "?"):
        self.build, self.uses, self.text = build, uses, text

    def _with(self, op, other: Any, sign: str, swap: bool = False) -> Expr:
        a, b = (value(other), self) if swap else (self, value(other))
        return Expr(lambda env: op(a.build(env), b.build(env)), tuple(dict.fromkeys(a.uses + b.uses)), f"({a.text} {sign} {b.text})")

    def __getitem__(self, key: Any) -> Expr:
        return Expr(lambda env: self.build(env)[key], self.uses, f"{self.text}[{key!r}]")

    def field(self, name: str) -> Expr:
        return Expr(lambda env: self.build(env).getField(name), self.uses, f"{self.text}.{name}")

    def __invert__(self) -> Expr:
        return Expr(lambda env: ~self.build(env), self.uses, f"!{self.text}")

    def __neg__(self) -> Expr:
        return Expr(lambda env: -self.build(env), self.uses, f"-{self.text}")

    def __repr__(self) -> str:
        return self.text

    __hash__ = object.__hash__


for _name, _sign in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "mod": "%", "and_": "&", "or_": "|"}.items():
    _op = getattr(operator, _name)
    _own = f"__{_name.rstrip('_')}__"
    setattr(Expr, _own, lambda self, other, op=_op, sign=_sign: self._with(op, other, sign))
    setattr(Expr, f"__r{_own[2:]}", lambda self, other, op=_op, sign=_sign: self._with(op, other, sign, True))
for _name, _sign in {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Expr, f"__{_name}__", lambda self, other, op=getattr(operator, _name), sign=_sign: self._with(op, other, sign))


class Var(Expr):
    """A variable; within a rule all its places hold one value."""

    def __init__(self, name: str):
        super().__init__(lambda env: env[name], (name,), name)
        self.name = name


class LVar(Var):
    """A variable over a lattice: its places are joined to their bound instead of compared."""

    def __init__(self, name: str, lattice: Lattice):
        super().__init__(name)
        self.lattice = lattice


class _Mark:
    def __init__(self, text: str):
        self.text = text

    def __repr__(self) -> str:
        return self.text


#: Matches anything and binds nothing.
IGNORE = _Mark("_")
#: The bottom of a lattice column.
BOT = _Mark("bot")
#: After a whole-row variable: the terms of its columns follow.
WITH_ELEMENTS = _Mark("with_elements")


def variables(names: str) -> list[Var]:
    return [Var(n) for n in names.split()]


def value(x: Any) -> Expr:
    """An expression of a constant; a Column stands for itself."""
    if isinstance(x, Expr):
        return x
    return Expr(lambda env: x if isinstance(x, Column) else F.lit(x), (), repr(x) if not isinstance(x, Column) else "column")


def call(f: Callable[..., Column], *args: Any, text: str | None = None) -> Expr:
    """f applied to the columns of the arguments."""
    own = [value(a) for a in args]
    uses = tuple(dict.fromkeys(u for a in own for u in a.uses))
    return Expr(lambda env: f(*(a.build(env) for a in own)), uses, text or f"{getattr(f, '__name__', 'f')}({', '.join(a.text for a in own)})")

