"""SimHash near-duplicates through pivot distance tables.

Fingerprint: 64 bits over a text's word shingles. Two fingerprints link if they
differ in at most ``most`` bits; classes are the connected components.

Pairs come from distances to reference fingerprints (pivots). By the triangle
inequality linked fingerprints have nearly equal distances to every pivot, so
d(x,p) and d(y,p) differ by ``most`` at most. Each fingerprint is kept at its
nearest pivot, at distance r(x). Of a linked pair take the one with the smaller
r as x: then d(y,p(x)) <= r(x) + most <= r(y) + most. So y is sent to every
pivot within r(y) + most, and meets x there; no pair is lost. At a pivot, pairs
are discarded by the largest difference over a table of further pivots'
distances, and the survivors are verified on the bits.

The number of pivots follows the square root of the number of distinct
fingerprints, so work grows as its power 1.5. Pivots are pseudo-random
constants, so nothing is gathered from the corpus and every worker makes them
itself. Equal fingerprints are one node, whatever their number. A pivot's
fingerprints are dealt to several tasks by a hash where they are many. A task
gives the edges of a spanning forest of its links only, not all pairs.

Defined results: null text counts as empty; texts without a word have
fingerprint zero and are linked like any other; a null id is in its class but
names none (a class without any id has a null id); repeated rows give a row
each; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import neardup
from .common import forget, fresh, numbered, partitions, released, written
from .components import components

SHINGLE, MOST, SEED = 4, 4, 42
#: Home fingerprints of a pivot that one task holds.
BLOCK = 4096
#: Further pivots whose distances discard pairs.
TABLE = 16


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc, *keep, fp long). A bit is 1 if it is set in over half of the shingles' XXH64."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest as h

        def one(t: str | None) -> int:
            words = (t or "").encode("utf-8", "surrogatepass").lower().split()
            if not words:
                return 0
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            k = min(shingle, len(words))
            a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
            ones, n = np.zeros(64, "i8"), len(a)
            for i in range(0, n, 1 << 15):
                x = np.fromiter((h(joined[p:q], seed) for p, q in zip(a[i : i + (1 << 15)], b[i : i + (1 << 15)])), "u8")
                ones += np.unpackbits(x.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
            return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])

        for b in batches:
            rest = b.drop_columns(["x"])
            fps = pa.array((one(t.as_py()) for t in b.column("x")), pa.int64())
            yield pa.RecordBatch.from_arrays([*rest.columns, fps], names=[*rest.schema.names, "fp"])

    names = [doc, *keep]
    schema = T.StructType([*(T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(names)), T.StructField("fp", T.LongType())])
    return docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(names)), docs[text].alias("x")).mapInArrow(released(run), schema).toDF(*names, "fp")


def pivots(n: int):
    """n pseudo-random 64-bit constants."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def links(fps: DataFrame, most: int = MOST, n: int | None = None, block: int = BLOCK) -> DataFrame:
    """(u, v): edges between distinct fingerprints `fp` that join all that differ in at most that many bits, not each link.

    fps: a table that is written already, with distinct fp; n: its count.
    """
    n = fps.count() if n is None else n
    many = 1 << max(4, math.ceil(math.log2(16 * math.sqrt(n + 1))))
    pieces = max(1, round(8 * n / many / block))

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        p = pivots(many)
        for batch in batches:
            whole = batch.column("fp").to_numpy(zero_copy_only=False).view("u8")
            step = max(1, (1 << 22) // many)
            for i in range(0, len(whole), step):
                x = whole[i : i + step]
                d = np.bitwise_count(x[:, None] ^ p[None, :])
                home = d.argmin(axis=1)
                r = d[np.arange(len(x)), home]
                row, piv = np.nonzero(d <= r[:, None] + np.uint8(most))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piv.astype("i4")), pa.array(x[row].view("i8")), pa.array(r[row].astype("i1")), pa.array(d[row, piv].astype("i1")), pa.array(home[row] == piv)],
                    names=["pivot", "fp", "r", "d", "home"],
                )

    def meet(key, frame):
        import numpy as np
        import pandas as pd

        kept = frame.home.to_numpy()
        order = np.argsort(frame.r.to_numpy()[kept], kind="stable")
        x, xr = frame.fp.to_numpy()[kept][order].view("u8"), frame.r.to_numpy()[kept][order]
        y, yr, yd = frame.fp.to_numpy().view("u8"), frame.r.to_numpy(), frame.d.to_numpy()
        table = pivots(many + TABLE)[many:]
        tx = np.bitwise_count(x[:, None] ^ table[None, :]).astype("i1")
        ty = np.bitwise_count(y[:, None] ^ table[None, :]).astype("i1")
        parent = {}

        def top(a):
            while (b := parent.get(a, a)) != a:
                parent[a] = parent.get(b, b)
                a = b
            return a

        edges = []
        for i in range(len(x)):
            # the pivot's own coordinate, then the table's, then the bits
            near = np.nonzero((yr >= xr[i]) & (yd <= xr[i] + most) & (yd >= xr[i] - most))[0]
            for a in range(0, TABLE, 4):
                if len(near):
                    near = near[np.abs(ty[near, a : a + 4] - tx[i, a : a + 4]).max(axis=1) <= most]
            near = near[np.bitwise_count(y[near] ^ x[i]) <= most]
            for b in y[near].tolist():
                a = top(int(x[i]))
                if a != (c := top(b)):
                    parent[max(a, c)] = min(a, c)
                    edges.append((int(x[i]), b))
        e = np.array(edges, dtype="u8").reshape(-1, 2).view("i8")
        return pd.DataFrame({"u": e[:, 0], "v": e[:, 1]})

    dealt = fps.repartition(partitions(fps.sparkSession) + 4, "fp").mapInArrow(deal, "pivot int, fp long, r byte, d byte, home boolean")
    if pieces == 1:
        dealt = dealt.withColumn("piece", F.lit(0))
    else:  # the home rows of a pivot are split by a hash; what visits the pivot visits every part
        split = F.pmod(F.xxhash64("fp"), F.lit(pieces)).cast("int")
        parts = F.sequence(F.lit(0), F.lit(pieces - 1))
        dealt = dealt.withColumn("piece", F.explode(parts)).withColumn("home", F.col("home") & (F.col("piece") == split))
    return dealt.groupBy("pivot", "piece").applyInPandas(meet, "u long, v long")


def classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", most: int = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, *keep, fp, component_id): component_id is the smallest id of the class."""
    marks = written(fingerprints(docs, doc, text, keep), "fingerprints")
    groups = written(marks.groupBy("fp").agg(F.min(doc).alias("least")), "distinct-fingerprints")
    roots = components(links(groups, most))
    owner = groups.join(roots, groups.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    owner = written(owner, "roots")
    named = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    of = owner.join(named, "root").select("fp", "component_id", "root")
    return marks.join(of, "fp").select(doc, *keep, "fp", "component_id", "root")


def near_rows(docs: DataFrame, row: str, text: str = "text", most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """(u, v): pairs of rows that join all rows whose fingerprints are linked, not each link, as a written table."""
    marks = written(fingerprints(docs, row, text, (), shingle), "fingerprints")
    groups = written(marks.groupBy("fp").agg(F.min(row).alias("least")), "distinct-fingerprints")
    same = marks.join(groups, "fp").where(F.col(row) > F.col("least")).select(F.col("least").alias("u"), F.col(row).alias("v"))
    side = lambda x: groups.select(F.col("fp").alias(x), F.col("least").alias(f"row_{x}"))
    near = links(groups, most).join(side("u"), "u").join(side("v"), "v").select(F.col("row_u").alias("u"), F.col("row_v").alias("v"))
    out = written(same.union(near), "near-rows")
    forget(marks, groups)
    return out


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", most: int = MOST, shingle: int = neardup.SHINGLE) -> DataFrame:
    """docs with one row of each class of near-duplicates: that of the smallest id, nulls last; of rows with that id the first.

    Classes are by the Jaccard similarity of the shingle sets: links of fingerprints are verified by it, and the pairs
    that differ in more bits come from an exact join (see `neardup`).
    """
    row = fresh(docs, "simhash_row")
    rows = numbered(docs, row)
    found = near_rows(rows, row, text, most, shingle)
    of = neardup.classes(rows, row, text, found, shingle).join(rows.select(row, F.col(doc).alias("id")), row)
    forget(found)
    first = of.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(row).alias("row"))).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)


def hexed(fp):
    """A fingerprint's 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
