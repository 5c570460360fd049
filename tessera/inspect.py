"""Tables as JSON, and programs that run."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Row

from tessera.functions.lattice import Lattice
from tessera.plans.rules import Relation
from tessera.program import SHOWN, Program, registry


def json_of(v: Any) -> Any:
    """Numbers, strings and booleans as they are, rows and sequences as lists, others as their text."""
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    if isinstance(v, Row) or isinstance(v, (list, tuple)):
        return [json_of(x) for x in v]
    if isinstance(v, dict):
        return {str(k): json_of(x) for k, x in v.items()}
    return str(v)


def export_json(df: DataFrame, names: list[str] | None = None, convert=None, relation: Relation | None = None, limit: int | None = None) -> dict:
    """``{"columns": [...], "data": [[...], ...]}`` of a result that fits the driver, or of ``limit`` rows of it; lattice
    values of ``relation`` show their kind."""
    names = names or df.columns
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} headings for {len(df.columns)} columns")
    kinds = [relation.columns.get(c) if relation else None for c in df.columns]
    cell = lambda v, k: f"{k.name}({json_of(v)})" if isinstance(k, Lattice) else json_of(v)
    return {"columns": names, "data": [convert(r) if convert else [cell(v, k) for v, k in zip(r, kinds)] for r in (df if limit is None else df.limit(limit)).collect()]}


class Inspector:
    """What a debugger asks of programs: which there are, where to stop, what they are made of, what a table holds."""

    def help(self) -> dict[str, str]:
        return {n: (getattr(self, n).__doc__ or "").strip() for n in dir(self) if not n.startswith("_")}

    def programs(self) -> list[dict]:
        """Programs by name, where they are defined, how many rules they have and how often they ran."""
        return [{"name": n, "defined": p.where, "rules": len(p.rules), "runs": p.trips, "policy": p.policy, "provenance": p.provenance} for n, p in registry.items()]

    def set_break(self, name: str, moments: int, hook) -> None:
        """Calls a hook at moments of a program's runs."""
        registry[name].on(moments, hook)

    def resume(self, name: str, hook=None) -> int:
        """Removes a hook of a program, or all of them; how many went."""
        p: Program = registry[name]
        before = len(p.hooks)
        p.hooks = [] if hook is None else [(m, h) for m, h in p.hooks if h is not hook]
        return before - len(p.hooks)

    def show(self, name: str) -> list[dict]:
        """The relations of a program."""
        p: Program = registry[name]
        return [{"name": r.name, "columns": list(r.columns), "external": not r.derived} for r in p.relations.values()]

    def rules(self, name: str) -> str:
        """The relations and the rules of a program, by stratum."""
        return registry[name].explain()

    def table(self, name: str, relation: str, limit: int = SHOWN) -> dict:
        """Rows of a relation, as JSON."""
        p: Program = registry[name]
        r = p.relations[relation]
        return export_json(p.rows(r, ordered=True) if r.derived else r.source, relation=r, limit=limit)
