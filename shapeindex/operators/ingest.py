"""Ingestion of a repository list as one operator: budget, files, documents, counts (IDX9, EXT13, IDX4, STA3)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import INDEX_MAX_BYTES
from ..sources import store
from . import index as I
from .html import dedup_first_wins, files_to_documents


def ingest_repositories(idx: I.Index, repos: DataFrame, files: DataFrame, undecodable: DataFrame | None = None,
                        max_bytes: int = INDEX_MAX_BYTES, already: int | None = None) -> DataFrame:
    """Adds the files of the listed repositories to the index in one commit, in list order, while the bytes before a
    repository are at most ``max_bytes``: (seq, repo, bytes, n_files, admitted, accepted, skipped) per listed repository with files.

    ``repos``: seq, name, html_url, head; a name that comes again is taken once. ``files``: repo, relpath, content. ``undecodable``: repo,
    relpath of files that are counted as skipped. ``already`` is the index's size, which counts as bytes before the first
    repository (None: what its folder holds). A repository without files is left out. What was accepted is counted from the new
    segment, so nothing is parsed again.
    """
    listed = dedup_first_wins(repos.select("seq", "name", "html_url", "head"), ["name"], ["seq"])
    sizes = files.groupBy("repo").agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n_files"))
    if undecodable is not None:
        lost = undecodable.groupBy("repo").agg(F.count(F.lit(1)).alias("n_lost"))
        sizes = sizes.join(lost, "repo", "full")
    else:
        sizes = sizes.withColumn("n_lost", F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    sizes = sizes.select("repo", *[F.coalesce(c, zero).alias(c) for c in ("bytes", "n_files", "n_lost")])
    have = listed.select("seq", F.col("name").alias("repo")).join(sizes, "repo")
    already = store.du_bytes(idx.spark, idx.path) if already is None else already
    taken = I.admit_within_budget(have.select("seq", "repo", "bytes"), max_bytes - already).select("repo", F.lit(True).alias("admitted"))
    taken = I.stored_beside(idx, taken, "admitted")
    docs = files_to_documents(files.join(taken.select("repo"), "repo", "left_semi"), listed)
    before = set(idx.meta["segments"])
    I.add_documents(idx, docs.select("title", "url", "content"))
    new = [s for s in idx.meta["segments"] if s not in before]
    accepted = idx.segment(new[0], "snippets").groupBy(F.get(F.split("title", " ", 2), 0).alias("repo")).agg(F.count(F.lit(1)).alias("accepted"))
    out = have.join(taken, "repo", "left").join(accepted, "repo", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))
    accepted, total = F.coalesce("accepted", zero), F.col("n_files") + F.col("n_lost")
    return out.select("seq", "repo", "bytes", total.alias("n_files"), "admitted", accepted.alias("accepted"),
                      F.when(F.col("admitted"), total - accepted).otherwise(zero).alias("skipped"))
