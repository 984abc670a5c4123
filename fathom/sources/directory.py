"""Repositories on a file system as corpora.

The walk prunes excluded folders before it descends; only paths pass through the
driver. Contents are read on the executors.
"""

from __future__ import annotations

import os
import sys
import tomllib
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CONFIG_FILE, EXCLUSIONS, EXTENSIONS
from .corpus import SCHEMA


def exclusions(root: str, more: Iterable[str] = ()) -> list[str]:
    """Built-in names, the caller's, and those of the repository's config file; a config that can't be read is an error."""
    config = Path(root) / CONFIG_FILE
    listed = tomllib.loads(config.read_text(encoding="utf-8")).get("exclude", []) if config.is_file() else []
    if not isinstance(listed, list) or not all(isinstance(x, str) for x in listed):
        raise ValueError(f"{config}: exclude must be a list of names")
    return sorted({x.strip() for x in [*EXCLUSIONS, *more, *listed] if x.strip()})


def supported(path: str) -> bool:
    return os.path.splitext(path)[1][1:].lower() in EXTENSIONS


def walk(root: str, excluded: Iterable[str]) -> list[str]:
    """Relative paths of supported files in component-wise order; folders that can't be read are reported and passed over."""
    excluded = set(excluded)
    base = os.path.realpath(root)
    if not os.path.isdir(base):
        raise NotADirectoryError(root)
    if os.path.basename(base) in excluded:
        return []
    found = []
    for folder, folders, files in os.walk(base, onerror=lambda e: print(f"skipped: {e}", file=sys.stderr)):
        folders[:] = [d for d in folders if d not in excluded]
        found += [os.path.relpath(os.path.join(folder, f), base).replace(os.sep, "/") for f in files if supported(f)]
    return sorted(found, key=lambda p: p.split("/"))


def read(spark: SparkSession, root: str, exclude: Iterable[str] = ()) -> DataFrame:
    """The corpus of a repository. Ids are dense and follow the paths; files that are no UTF-8, or can't be read, are reported and left out."""
    base = os.path.realpath(root)
    paths = walk(root, exclusions(root, exclude))
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    listed = spark.createDataFrame(list(enumerate(paths)), "place int, relative_path string")

    def contents(batches):
        import pyarrow as pa

        for b in batches:
            for place, path in zip(b.column("place").to_pylist(), b.column("relative_path").to_pylist(), strict=True):
                try:
                    with open(os.path.join(base, path), encoding="utf-8", newline="") as f:
                        body = f.read()
                except (OSError, UnicodeDecodeError):
                    body = None
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([path]), pa.array([body], pa.string())], names=["place", "relative_path", "content"])

    # Spark's own file sources pass over hidden and empty files, which count here; the folder is one that all executors see.
    found = listed.mapInArrow(contents, "place int, relative_path string, content string")
    bad = found.where("content is null").select("place", "relative_path").orderBy("place").collect()  # what could not be read
    for r in bad:
        print(f"skipped: {r.relative_path} can't be read as UTF-8 text", file=sys.stderr)
    gaps = F.array(*(F.lit(r.place) for r in bad)) if bad else F.array().cast("array<int>")
    before = F.size(F.filter(gaps, lambda b: b < F.col("place")))
    return found.where("content is not null").select((F.col("place") - before).cast("long").alias("doc_id"), "relative_path", "content")
