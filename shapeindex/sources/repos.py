"""Repository list (SRC1, SRC2)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import REPO_QUERY
from ..schemas import REPO

#: FIXED values: names of the published list's fields that the columns of REPO take their values from.
PUBLISHED = {"stars": "stargazers_count", "size_kb": "size"}
_RECORD = T.StructType([*REPO.fields, *[T.StructField(c, T.LongType()) for c in PUBLISHED.values()], T.StructField("_bad", T.StringType())])


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(seq, record, r): the elements of the JSON arrays in ``path`` as text and as structs. A file that is no array is one record."""
    text = spark.read.option("wholetext", True).text(path)
    parts = F.coalesce(F.from_json("value", "array<string>"), F.array("value"))
    parsed = F.from_json("record", _RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return text.select(F.posexplode(parts).alias("seq", "record")).withColumn("r", parsed)


def _good():
    return F.col("r").isNotNull() & F.col("r._bad").isNull() & F.col("r.name").isNotNull()


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: JSON arrays of repository objects with checked types: (seq, columns of REPO). ``seq`` is the place in the list.

    Stars and size are read from the fields of the published list, or from those of REPO's own names. Records that
    do not parse, have a value of another type or no name are left out; :func:`rejected_repos` has their texts.
    """
    ok = _records(spark, path).where(_good()).select("seq", "r.*")
    cols = [F.coalesce(c.name, PUBLISHED[c.name]).alias(c.name) if c.name in PUBLISHED else F.col(c.name) for c in REPO.fields]
    return ok.select("seq", *cols)


def rejected_repos(spark: SparkSession, path: str) -> DataFrame:
    """(seq, record): the text of every record that ``read_repos`` leaves out."""
    return _records(spark, path).where(~F.coalesce(_good(), F.lit(False))).select("seq", "record")


def select_repos(repos: DataFrame, language: str = REPO_QUERY["language"], min_stars: int = REPO_QUERY["min_stars"],
                 min_size_kb: int = REPO_QUERY["min_size_kb"], n: int = REPO_QUERY["n"]) -> DataFrame:
    """SRC2: language match, stars and size strictly above the limits, most stars first, top n.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps n rows.
    """
    return (repos.where((F.lower("language") == language.lower()) & (F.col("stars") > min_stars)
                        & (F.col("size_kb") > min_size_kb))
            .orderBy(F.desc("stars"), F.asc("name")).limit(n))
