"""What git says of a folder: listings, changes, and the identity of files' contents."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _git(root: str, *args: str) -> list[str] | None:
    """Output of a git command in a folder, split at NUL bytes; None if it fails. Listings name files, whose contents
    are read by executors."""
    try:
        out = subprocess.run(["git", "-C", root, *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, check=False, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return [x for x in out.stdout.decode("utf-8", "replace").split("\0") if x] if out.returncode == 0 else None


def _line(root: str, *args: str) -> str | None:
    out = _git(root, *args)
    return None if out is None else "".join(out).strip() or None


def listing(spark: SparkSession, root: str) -> DataFrame | None:
    """Tracked files and those that git doesn't ignore, as (path, bytes) relative to the folder; None outside git."""
    names = _git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z")
    if names is None:
        return None
    rows = [(n, os.path.getsize(at)) for n in sorted(set(names)) if os.path.isfile(at := os.path.join(root, n))]
    return spark.createDataFrame(rows, "path string, bytes long")


def changed(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """Paths that differ from the index or the last commit, or aren't tracked; from `base` as well where given. Deleted
    ones have none."""
    asked = [("diff", "--name-only", "--relative", "-z"), ("diff", "--name-only", "--relative", "--cached", "-z"), ("ls-files", "--others", "--exclude-standard", "-z")]
    if base:
        asked.append(("diff", "--name-only", "--relative", "-z", f"{base}...HEAD"))
    found = {n for args in asked for n in _git(root, *args) or []}
    return spark.createDataFrame([(n,) for n in sorted(found) if os.path.exists(os.path.join(root, n))], "path string")


def repository_identity(spark: SparkSession, root: str) -> DataFrame:
    """One row: whether git knows the folder, where in its repository it lies, the commit, the branch, and whether
    anything isn't committed."""
    top = _line(root, "rev-parse", "--show-toplevel")
    if top is None:
        row = (False, None, None, None, None)
    else:
        row = (True, os.path.relpath(os.path.realpath(root), top), _line(root, "rev-parse", "HEAD"), _line(root, "branch", "--show-current"), bool(_git(root, "status", "--porcelain=v1", "-z", "--untracked-files=all")))
    return spark.createDataFrame([row], "git_available boolean, subpath string, commit string, branch string, dirty boolean")


def blobs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Blobs (path, blob) of the last commit and of the index."""
    head = [x.split("\t", 1) for x in _git(root, "ls-tree", "-r", "-z", "HEAD") or []]
    index = [x.split("\t", 1) for x in _git(root, "ls-files", "-s", "-z") or []]
    table = lambda rows, at: spark.createDataFrame([(p, meta.split()[at]) for meta, p in rows], "path string, blob string")
    return table(head, 2), table(index, 1)


def blob_id(content: Column) -> Column:
    """The id under which git keeps a content (binary or text in UTF-8)."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "UTF-8"), F.lit(b"\0"), raw))


def file_provenance(files: DataFrame, head: DataFrame, index: DataFrame, commit: str | None) -> DataFrame:
    """files(path, content) with what identifies the content of each: the blob of the last commit while it is that, else
    the working tree's own. Three equi-joins on paths; null contents have no blob."""
    rows = files.withColumn("working_blob", blob_id(F.col("content")))
    rows = rows.join(head.select("path", F.col("blob").alias("head_blob")), "path", "left").join(index.select("path", F.col("blob").alias("index_blob")), "path", "left")
    rows = rows.withColumns({"tracked": F.col("index_blob").isNotNull(), "dirty": ~(F.col("head_blob").eqNullSafe(F.col("index_blob")) & F.col("head_blob").eqNullSafe(F.col("working_blob")))})
    ours = F.col("dirty") | F.col("head_blob").isNull()
    source = F.when(ours, "working-tree").otherwise("HEAD")
    return rows.withColumns({"commit": F.lit(commit), "blob": F.when(ours, F.col("working_blob")).otherwise(F.col("head_blob")), "source": source})


def symbol_provenance(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols(path, name, start_line, end_line, fingerprint) with their files' identity."""
    return symbols.join(files.select("path", "commit", "blob", "source", "tracked", "dirty"), "path", "left")
