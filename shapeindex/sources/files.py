"""Source-file scan (SRC3) and page scan (SRC4)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_sources(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """SRC3: regular ``*.py`` files below ``root`` (one folder per repository), paths with
    ``.git`` skipped. Returns (files, skipped): undecodable files are counted, not fatal.
    Text mode newlines: ``\\r\\n`` and lone ``\\r`` become ``\\n``.
    """
    root = root.rstrip("/")
    jvm = spark.sparkContext._jvm
    jroot = jvm.org.apache.hadoop.fs.Path(root)
    fs = jroot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    prefix = fs.makeQualified(jroot).toString().rstrip("/") + "/"  # e.g. file:/data/repos/
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.py").load(root).select("path", "content"))
    rel = F.when(F.col("path").startswith(prefix), F.expr(f"substring(path, {len(prefix) + 1})"))
    raw = raw.where(~rel.contains(".git"))
    text = F.col("content").cast("string")
    df = raw.select(F.split(rel, "/", 2).getItem(0).alias("repo"),
                    F.regexp_extract(rel, r"^[^/]*/(.*)$", 1).alias("relpath"),
                    F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
                    F.is_valid_utf8(text).alias("decodable"),
                    F.regexp_replace(text, "\r\n?", "\n").alias("content"))
    return df.where("decodable").drop("decodable"), df.where(~F.col("decodable")).select("repo", "relpath")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: pages (url, html[, page_id])."""
    return spark.read.parquet(path)
