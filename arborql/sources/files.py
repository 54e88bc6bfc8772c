"""Corpora: folders, lists of paths, and tables whose rows or columns are documents."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..langs import BY_EXTENSION

#: Folders that a scan passes over (fixed values).
PASSED_OVER = (".git", "node_modules", "vendor", "dist", "build", "out", "target", "bin", "obj", ".idea", ".vscode", "__pycache__", ".lint")


def language_of(path: Column) -> Column:
    """The language of a path by its extension in any case; null if unknown."""
    known = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    return known[F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))]


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_id, path, lang, src, uri) of folders and files, anywhere that Spark reads.

    Below a folder, PASSED_OVER and folders that begin with a dot are left out; a file that is named is taken as it is. A
    path that isn't there is an error, as in any read. ``uri`` is the whole path and ``file_id`` its hash, so files of equal
    names below several roots are different files, and one that is below two of the roots is there once. ``path`` is what
    reports show and globs see: relative to the working folder for files in it, else to the root the file was found below.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    here = hadoop.Path(f"file://{os.getcwd()}").toUri().getPath().rstrip("/") + "/"
    found = None
    for named in paths:
        root = os.path.abspath(named) if not os.path.isabs(named) and os.path.exists(named) else named  # the JVM may run elsewhere
        at = hadoop.Path(root)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        status = system.getFileStatus(at)
        base = status.getPath().toString().rstrip("/")
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumnRenamed("path", "uri")
        if status.isDirectory():
            inside = F.expr(f"substring(uri, {len(base) + 2})")
            folders = F.slice(F.split(inside, "/"), 1, F.greatest(F.size(F.split(inside, "/")) - 1, F.lit(0)))
            read = read.where(~F.exists(folders, lambda x: x.isin(*PASSED_OVER) | x.startswith(".")))
        else:
            inside = F.lit(named)
        local = F.regexp_replace("uri", "^file:/+", "/")
        shown = F.when(F.startswith("uri", F.lit("file:/")) & F.startswith(local, F.lit(here)), F.substring(local, F.lit(len(here) + 1), F.length(local))).otherwise(inside)
        rows = read.select("uri", shown.alias("path"), "content")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no paths")
    files = found.withColumn("lang", language_of(F.col("path"))).where("lang is not null")
    files = files if len(paths) == 1 else files.dropDuplicates(["uri"])
    return files.select(F.xxhash64("uri").alias("file_id"), "path", "lang", F.col("content").cast("string").alias("src"), "uri")


def documents(df: DataFrame, id_col: str, src: Column | str, lang: str, path: Column | str | None = None) -> DataFrame:
    """A table as a corpus: one document per row, its text a column or an expression such as ``to_json(struct(...))``."""
    src = F.col(src) if isinstance(src, str) else src
    path = F.concat(F.lit(f"{lang}/"), F.col(id_col).cast("string")) if path is None else F.col(path) if isinstance(path, str) else path
    return df.select(F.col(id_col).cast("long").alias("file_id"), path.alias("path"), F.lit(lang).alias("lang"), src.alias("src"))
