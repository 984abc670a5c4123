"""Snapshots: an index's tables and a one-row meta table, kept inside the repository they describe."""

from __future__ import annotations

import os
import shutil
import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession

from ..operators.index import Index
from ..schema import SNAPSHOT_FOLDER, SNAPSHOT_VERSION
from . import directory

META = "version int, repository string, indexed_at_unix_seconds long, exclusions array<string>"


@dataclass
class Snapshot:
    index: Index
    meta: Row


def _place(repository: str) -> str:
    return os.path.join(os.path.realpath(repository), SNAPSHOT_FOLDER)


def save(index: Index, repository: str, exclusions: Iterable[str]) -> str:
    """Writes aside, then takes the old one's place. Returns the path."""
    spark, place = index.spark, _place(repository)
    fresh = os.path.join(place, f"new-{os.getpid()}")
    meta = [(SNAPSHOT_VERSION, os.path.realpath(repository), int(time.time()), sorted(exclusions))]
    index.save(f"file:{fresh}")
    spark.createDataFrame(meta, META).coalesce(1).write.parquet(f"file:{fresh}/meta")
    target = os.path.join(place, "index")
    shutil.rmtree(target, ignore_errors=True)
    os.replace(fresh, target)
    return target


def load(spark: SparkSession, repository: str) -> Snapshot | None:
    """None if there is none; an error if it is of another version or another repository."""
    place = os.path.join(_place(repository), "index")
    if not os.path.isdir(place):
        return None
    meta = spark.read.schema(META).parquet(f"file:{place}/meta").first()
    if meta.version != SNAPSHOT_VERSION:
        raise ValueError(f"snapshot version {meta.version} is not {SNAPSHOT_VERSION}")
    if meta.repository != os.path.realpath(repository):
        raise ValueError(f"snapshot belongs to {meta.repository}")
    return Snapshot(Index.load(spark, f"file:{place}"), meta)


def clear(repository: str) -> bool:
    """Deletes the snapshot; its folder only if nothing else is in it. Whether there was one."""
    place = _place(repository)
    there = os.path.isdir(os.path.join(place, "index"))
    if there:
        shutil.rmtree(os.path.join(place, "index"))
        if not os.listdir(place):
            os.rmdir(place)
    return there


def load_or_read(spark: SparkSession, repository: str) -> Index:
    """The snapshot if there is one, however old; else the files."""
    found = load(spark, repository)
    return found.index if found else Index(directory.read(spark, repository))
