"""Helpers shared by the operators of this folder."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """While it holds, Arrow batches of actions are cut at ``size`` (wide rows are copied several times on their way)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def prepare(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package importable by its Python workers."""
    spark = df.sparkSession
    ship_package(spark)
    return spark



def slices(batch, column: int, size: int = 2 << 20):
    """A batch in parts of about ``size`` bytes of a string column: what a task holds at once stays small."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(n + 64) - n - 64) // size
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(cut, [*cut[1:], len(part)], strict=True):
        yield batch.slice(int(a), int(b - a))


def with_columns_of_text(df: DataFrame, keep: list[str], make, fields: str, column: str = "text") -> DataFrame:
    """Columns ``keep`` of ``df``, untouched, and those that ``make()`` computes per task from a string column.

    ``make()`` gives a function from a list of texts (null: the empty text) to one list per new column. ``fields`` is the
    DDL of the new columns. Rows travel as Arrow batches: other columns keep their exact values and nulls.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    new = _parse_datatype_string(fields)
    names = [f.name for f in new.fields]
    clash = {c.lower() for c in keep} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with the result's")
    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = type(new)([*kept.schema.fields, *new.fields])
    types = list(to_arrow_schema(new).types)
    all_names, k = [*keep, *names], len(keep)

    def run(batches):
        f = make()
        for whole in batches:
            for b in slices(whole, k):
                cols = f(["" if x is None else x for x in b.column(k).to_pylist()])
                arrays = [pa.array(c, type=t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *arrays], names=all_names)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").cast("string").alias("_in")).mapInArrow(run, schema)
