"""Rules over streams: a body without recursion is filters and joins, so it runs on a streaming source as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators import lower
from tessera.plans.rules import Atom, ProgramError, Rule
from tessera.program import Program


def stream(program: Program, sink: str) -> DataFrame:
    """The streaming DataFrame of a sink whose body reads external relations only; the caller writes it."""
    rule: Rule = program.sinks[sink]
    if any(isinstance(e, Atom) and e.relation.derived for e in rule.body):
        raise ProgramError(f"sink {sink} reads a table; streams feed external relations only")
    return lower.head(lower.body(program.spark, rule, lambda i, a: a.relation.source))
