"""Best-fit packing planned over the histogram of lengths.

Documents become token ids plus an end id; those longer than a sequence are cut
into pieces. The plan never sees documents: it reads how many pieces there are
of each length (a row per length, so at most ``capacity`` rows whatever the
input) and runs best-fit decreasing over these counts, moving whole groups of
equal sequences at once. Its outcome is a list of segments (length, ranks of
pieces, sequences, offset). Pieces are then ranked within their length and take
the slot that the segment of their length and rank says.

Ranks are dealt out in two levels, so that a length with a third of all rows
isn't ranked in one task: rows are ranked within (length, bucket of a hash), and
the counts of the buckets give where each bucket's ranks begin.

Defined results: null text counts as the empty text, which is the end id alone;
repeated rows are packed each; equal pieces take slots in an order of their own,
so results are the same up to a swap of fully equal rows; an empty table gives
an empty table; extra columns stay out.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import partitions, written

CAPACITY = 4096
END = 1


@dataclass(frozen=True)
class Segment:
    """Pieces of one length with ranks first_rank.. fill `each` slots in every one of the sequences first_sequence.. from offset on."""

    length: int
    first_rank: int
    end_rank: int
    first_sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Segment]:
    """Best-fit decreasing over counts of lengths from 1 to capacity."""
    room: dict[int, list[tuple[int, int]]] = {}  # what is left in a sequence: runs (first, count) of such sequences
    rooms: list[int] = []
    opened, out = 0, []

    def give(left: int, first: int, n: int) -> None:
        if left not in room:
            bisect.insort(rooms, left)
        room.setdefault(left, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                first, n, left = opened, -(-(end - rank) // (capacity // length)), capacity
                opened += n
            else:
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(at)
            each = left // length
            full, rest = divmod(end - rank, each)
            if full >= n:
                full, rest = n, 0
            if full:
                out.append(Segment(length, rank, rank + full * each, first, each, capacity - left))
                give(left - each * length, first, full)
                rank += full * each
            if rest:
                out.append(Segment(length, rank, rank + rest, first + full, rest, capacity - left))
                give(left - rest * length, first + full, 1)
                rank += rest
            if (idle := n - full - bool(rest)) > 0:
                give(left, first + full + bool(rest), idle)
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, doc: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc, piece, start, length, ids): a row per piece of a document; ids are little-endian unsigned 32-bit numbers."""
    tail = F.lit(bytearray(end.to_bytes(4, "little")))
    ids = bpe.encode(docs, text, (doc,), path, packed=True).select(doc, F.concat("ids", tail).alias("ids"))
    n = F.floor(F.length("ids") / 4).cast("long")
    cut = ids.select(doc, "ids", n.alias("n")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))))
    start = F.col("piece").cast("long") * capacity
    return cut.select(
        doc,
        "piece",
        start.alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("n") - start).alias("length"),
        F.substring("ids", (start * 4 + 1).cast("int"), F.lit(4 * capacity)).alias("ids"),
    )


def pack(parts: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), buckets: int | None = None) -> DataFrame:
    """parts with ``sequence_id`` and ``offset``. parts is read several times: give a table that is written already.

    order: columns that fix which of the pieces of a length come first.
    """
    spark = parts.sparkSession
    buckets = buckets or 4 * partitions(spark)
    salted = parts.withColumn("pack_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    tally = written(salted.groupBy(length, "pack_bucket").agg(F.count(F.lit(1)).alias("pack_n")), "packing-counts")
    counts = {r[0]: r[1] for r in tally.groupBy(length).agg(F.sum("pack_n")).collect()}  # a row per length: capacity rows at most
    segments = plan(counts, capacity)
    schema = f"{length} long, pack_first long, pack_end long, pack_sequence long, pack_each long, pack_offset long"
    slots = spark.createDataFrame([(s.length, s.first_rank, s.end_rank, s.first_sequence, s.each, s.offset) for s in segments], schema)
    before = Window.partitionBy(length).orderBy("pack_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.select(length, "pack_bucket", F.coalesce(F.sum("pack_n").over(before), F.lit(0)).alias("pack_before"))
    within = Window.partitionBy(length, "pack_bucket").orderBy(*order)
    ranked = salted.withColumn("pack_rank", F.row_number().over(within).cast("long") - 1).join(starts, [length, "pack_bucket"])
    ranked = ranked.withColumn("pack_rank", F.col("pack_rank") + F.col("pack_before"))
    # The segments are a few for each length, so they may be sent to every task: this bound is that of the histogram.
    met = ranked.join(F.broadcast(slots), [length]).where((F.col("pack_rank") >= F.col("pack_first")) & (F.col("pack_rank") < F.col("pack_end")))
    at = F.col("pack_rank") - F.col("pack_first")
    return met.select(
        *parts.columns,
        (F.col("pack_sequence") + F.expr("(pack_rank - pack_first) div pack_each")).alias("sequence_id"),
        (F.col("pack_offset") + (at % F.col("pack_each")) * F.col(length)).alias("offset"),
    )


def assemble(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, length, ids): the packed sequences. A sequence is bounded by the capacity, so each fits a task."""
    rows = F.array_sort(F.collect_list(F.struct("offset", ids)))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), rows.alias("rows")).select(
        "sequence_id", "length", F.aggregate("rows", F.lit(bytearray()), lambda a, r: F.concat(a, r[ids])).alias("ids")
    )


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, capacity, end, path=path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(written(cut, "pieces"), capacity, order=("doc_id", "piece", "start", "ids_crc32"))
