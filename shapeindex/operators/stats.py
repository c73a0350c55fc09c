"""Corpus statistics (STA1-STA4): one global or per-repository aggregate each, no explode.

Line counts are computed per text with higher-order functions (inside codegen) and then summed,
so no row per line is ever materialised.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK_OR_COMMENT = r"^[ \t\r\f]*(#|$)"


def code_lines(text: Column) -> Column:
    """Lines that are neither blank nor a comment (docstrings count as code)."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(BLANK_OR_COMMENT)))


def code_line_count(files: DataFrame, text_col: str = "content", by=()) -> DataFrame:
    """STA1: total code lines, optionally per group."""
    agg = F.coalesce(F.sum(code_lines(F.col(text_col))), F.lit(0)).cast("long").alias("python_line_count")
    return files.groupBy(*by).agg(agg) if by else files.agg(agg)


def repo_count(files: DataFrame, repo_col: str = "repo") -> DataFrame:
    """STA2: number of repositories."""
    return files.agg(F.count_distinct(repo_col).cast("long").alias("repo_count"))


def ingest_report(files: DataFrame, valid_col: str = "valid", repo_col: str = "repo",
                  with_total: bool = False) -> DataFrame:
    """STA3: accepted and skipped files per repository (and a total row with ``repo`` null)."""
    aggs = [F.count_if(F.col(valid_col)).cast("long").alias("accepted"),
            F.count_if(~F.col(valid_col)).cast("long").alias("skipped")]
    return (files.rollup(repo_col) if with_total else files.groupBy(repo_col)).agg(*aggs)


def corpus_meta(files: DataFrame, text_col: str = "content", repo_col: str = "repo") -> DataFrame:
    """STA4: one row {python_line_count, repo_count}."""
    return files.agg(F.coalesce(F.sum(code_lines(F.col(text_col))), F.lit(0)).cast("long").alias("python_line_count"),
                     F.count_distinct(repo_col).cast("long").alias("repo_count"))
