"""Versions of a table in a folder: files are written first, and a small manifest that names the live ones makes them visible.

Manifests are numbered and never change. A writer creates the next number, which fails if another writer was there first;
a manifest that was torn while it was written counts as none. Files that no manifest names are never read.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

END = "\n#end"


class Conflict(RuntimeError):
    """Another writer made the version that was about to be made."""


def _folder(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all manifests, torn ones included, ascending."""
    path, fs = _folder(spark, root)
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(version, content) of the last whole manifest; (0, {}) if there is none."""
    for v in reversed(versions(spark, root)):
        text = spark.read.text(f"{root}/manifest/{v:012d}", wholetext=True).first()
        if text and text[0].endswith(END):
            return v, json.loads(text[0].removesuffix(END))
    return 0, {}


def commit(spark: SparkSession, root: str, version: int, content: dict) -> None:
    path, fs = _folder(spark, root)
    fs.mkdirs(path)
    try:
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, f"{version:012d}"), False)
    except Exception as e:
        if "exist" in str(e).lower():
            raise Conflict(f"version {version} of {root} was made by another writer") from None
        raise
    try:
        out.write(bytearray((json.dumps(content, sort_keys=True) + END).encode()))
    finally:
        out.close()


def following(spark: SparkSession, root: str) -> int:
    """The number a writer makes next."""
    return max(versions(spark, root), default=0) + 1
