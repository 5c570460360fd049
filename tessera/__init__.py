"""tessera: a deductive query engine on PySpark DataFrames."""

from tessera.functions.lattice import Lattice, custom, lbitset, lmax, lmin, lset, of_code
from tessera.plans.rules import ArityError, ProgramError, StratificationError, UnboundVariableError, bind, enumerate_, guard, iterate
from tessera.program import CONFIGURE, END, FIXPOINT, Program
from tessera.sources import from_parquet, from_rows, indexed, lookup, xrange
from tessera.terms import BOT, IGNORE, WITH_ELEMENTS, Expr, LVar, Var, call, value, variables

__all__ = [
    "BOT", "CONFIGURE", "END", "FIXPOINT", "IGNORE", "WITH_ELEMENTS", "ArityError", "Expr", "LVar", "Lattice", "Program", "ProgramError",
    "StratificationError", "UnboundVariableError", "Var", "bind", "call", "custom", "enumerate_", "from_parquet", "from_rows", "guard",
    "indexed", "iterate", "lbitset", "lmax", "lmin", "lookup", "lset", "of_code", "value", "variables", "xrange",
]
