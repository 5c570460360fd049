"""Where facts come from."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.terms import Expr, call, value


def from_rows(spark: SparkSession, rows: Iterable[Any], schema: str) -> DataFrame:
    """A source of host rows; a schema of one column takes plain values."""
    rows = [r if isinstance(r, (tuple, list, dict)) else (r,) for r in rows]
    return spark.createDataFrame(rows, schema)


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(df: DataFrame, column: str | dict[str, Any], key: Any = None) -> DataFrame:
    """Rows whose column equals a key, or whose columns equal the keys given by name; filters that reach the scan."""
    keys = column if isinstance(column, dict) else {column: key}
    for name, value_ in keys.items():
        df = df.filter(F.col(f"`{name}`") == F.lit(value_))
    return df


def indexed(df: DataFrame, name: str, *indexes: str | tuple[str, ...], buckets: int = 64) -> dict[tuple[str, ...], DataFrame]:
    """``df`` saved once per index as a table bucketed and sorted by the index's columns, so that lookups on them read one
    bucket and joins on them don't shuffle; the tables by their columns.  Tables of that name are replaced."""
    out = {}
    for columns in (c if isinstance(c, tuple) else (c,) for c in indexes):
        table = "_".join([name, "by", *columns])
        df.write.mode("overwrite").bucketBy(buckets, *columns).sortBy(*columns).saveAsTable(table)
        out[columns] = df.sparkSession.table(table)
    return out


def xrange(start: Any, stop: Any = None, step: Any = None) -> Expr:
    """An expression of the whole numbers from start up to (or, going down, down to) stop, which isn't among them.

    Without a stop it counts from 0; without a step, by one towards stop.  A step of 0 counts as none given; a step
    away from stop, and equal ends, give no numbers.
    """
    if stop is None:
        start, stop = 0, start

    def build(a, b, s=None):
        a, b = a.cast("bigint"), b.cast("bigint")
        way = F.signum(b - a).cast("bigint")
        s = F.when(s.cast("bigint") == 0, way).otherwise(s.cast("bigint")) if s is not None else way
        n = F.ceil((b - a) / F.when(s != 0, s))  # NULL where the ends are equal
        return F.when(n > 0, F.sequence(a, a + s * (F.greatest(n, F.lit(1)) - 1), F.when(s != 0, s).otherwise(F.lit(1).cast("bigint")))).otherwise(F.array().cast("array<bigint>"))

    return call(build, value(start), value(stop), *([] if step is None else [value(step)]), text=f"xrange({start}, {stop}, {step})")
