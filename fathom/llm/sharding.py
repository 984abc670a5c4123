"""Sharding along a Hilbert curve.

Several metadata columns are quantised to levels, the levels give a place on a
Hilbert curve, rows are sorted by it and cut into runs of equal row counts. A
shard then spans a compact box of the metadata, so that minima and maxima of
files prune reads on any of the columns.

Levels are quantiles over all rows: of numbers as they are, of strings by the
six bytes that follow the prefix all of them share. Rows are ranked through a
range partitioning on (place, checksum, id), whose counts give each partition's
first rank; neither a hot place nor equal texts can gather in one task, as the
id takes part in the key.

Law: rows (counts of shards differ by one at most). Rows of a group (equal texts:
same size and checksum) all take the group's least place on the curve, so they
are neighbours in the order whatever their metadata, and a group is cut only
where a run ends.

Defined results: a null text has no bytes and the checksum of the empty text; a
null in a metadata column has level 0, before all values; rows that are equal in
all that counts take neighbouring slots in either order; with fewer rows than
shards the first shards have one row each; an empty table gives an empty table;
extra columns are kept, and where one is called curve, shard or slot the result's
column of that name has underscores after it.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, written

SHARDS, BITS = 8, 5
DIMENSIONS = ("lang", "source", "size")


def hilbert(levels, bits: int):
    """Places on the Hilbert curve of rows of levels (rows x dimensions), each below 2**bits (Skilling's transform)."""
    import numpy as np

    x = np.array(levels, dtype="i8").T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= np.where(on & (i > 0), 0, swap) if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _number(df: DataFrame, name: str, low: str | None, high: str | None) -> Column:
    """A column as a number of the same order."""
    if df.schema[name].dataType.simpleString() != "string":
        return F.col(name).cast("double")
    shared = len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))
    part = F.substring(F.col(name).cast("binary"), shared + 1, 6)
    return F.conv(F.rpad(F.hex(part), 12, "0"), 16, 10).cast("double")


def measured(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc, size, text_crc32, *keep)"""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(doc, (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *keep)


def shard(
    rows: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, group: tuple[str, ...] = ("size", "text_crc32"), ties: tuple[str, ...] = ("text_crc32", "size", "doc_id")
) -> DataFrame:
    """rows with ``curve``, ``shard`` and ``slot``; rows is a table that is written already. group: columns that rows of one group have in common."""
    curve, shard_, slot, place_, part, first_, g = (fresh(rows, n) for n in ("curve", "shard", "slot", "row_place", "part", "part_first", "g"))
    dims = [fresh(rows, f"dim_{i}") for i in range(len(dimensions))]
    strings = [d for d in dimensions if rows.schema[d].dataType.simpleString() == "string"]
    ends = rows.agg(*(f(d).alias(f"{n}_{d}") for d in strings for n, f in (("lo", F.min), ("hi", F.max))), F.count(F.lit(1)).alias("n")).first().asDict()
    numbers = rows.select("*", *(_number(rows, d, ends.get(f"lo_{d}"), ends.get(f"hi_{d}")).alias(n) for n, d in zip(dims, dimensions, strict=True)))
    total, levels = ends["n"], 1 << bits
    at = [i / (levels - 1) for i in range(1, levels - 1)]
    cuts = numbers.agg(*(F.percentile_approx(n, at, 10_000).alias(f"c{i}") for i, n in enumerate(dims))).first()
    edges = [sorted(set(c or [])) for c in cuts]

    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(curve, T.LongType())])

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            cols = [b.column(n).to_numpy(zero_copy_only=False).astype("f8") for n in dims]
            level = np.stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(np.array(e), c, side="left")) for c, e in zip(cols, edges, strict=True)], axis=1)
            b = b.select(names)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert(np.minimum(level, levels - 1), bits))], names=[*b.schema.names, curve])

    placed = written(numbers.mapInArrow(place, schema), "placed")
    # A minimum per group, combined before the shuffle, joined back; a group with very many rows is a skewed key of an equi-join.
    keys = [fresh(rows, f"group_{i}") for i in range(len(group))]
    least = placed.groupBy(*(F.col(c).alias(k) for c, k in zip(group, keys, strict=True))).agg(F.min(curve).alias(g))
    same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(group, keys, strict=True)))
    placed = placed.join(least, same).select(*names, F.col(g).alias(curve))
    ordered = placed.repartitionByRange(curve, *ties).sortWithinPartitions(curve, *ties).withColumn(place_, F.monotonically_increasing_id())
    ordered = written(ordered, "ordered")
    of = F.shiftrightunsigned(place_, 33)
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(of.alias("p")).count().collect())  # a row per partition
    first, before = {}, 0
    for p, n in counts:
        first[p], before = before, before + n
    starts = rows.sparkSession.createDataFrame(list(first.items()) or [(0, 0)], f"{part} long, {first_} long")
    ranked = ordered.withColumn(part, of).join(F.broadcast(starts), part).withColumn(g, F.col(first_) + F.col(place_).bitwiseAND(F.lit((1 << 33) - 1)))
    q, r = divmod(total, shards)
    big = F.lit(r * (q + 1))
    number = F.when(F.col(g) < big, F.expr(f"{g} div {q + 1}")).otherwise(F.expr(f"{r} + ({g} - {r * (q + 1)}) div {max(q, 1)}")).cast("int")
    run = F.when(F.col(g) < big, F.expr(f"{g} % {q + 1}")).otherwise(F.expr(f"({g} - {r * (q + 1)}) % {max(q, 1)}")).cast("long")
    return ranked.select(*names, curve, number.alias(shard_), run.alias(slot))
