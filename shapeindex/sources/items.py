"""Section-item feeds (SRC5), corpus metadata (SRC7)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SECTION_ITEM

META = T.StructType([T.StructField("python_line_count", T.LongType()), T.StructField("repo_count", T.LongType())])


def write_items(items: DataFrame, path: str) -> None:
    """SRC5: items as JSON lines (title, url, code_snippets)."""
    items.select("title", "url", "code_snippets").write.mode("errorifexists").json(path)


def read_items(spark: SparkSession, *paths: str) -> DataFrame:
    """SRC5: bag union of feeds in the given order (``feed`` = position of the path)."""
    out = None
    for i, p in enumerate(paths):
        df = spark.read.schema(SECTION_ITEM).json(p).withColumn("feed", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out


def write_meta(meta: DataFrame, path: str) -> None:
    """SRC7: the one-row metadata aggregate as a single JSON file."""
    meta.coalesce(1).write.mode("overwrite").json(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).json(path)
