"""The exact Jaccard part of near-dedup: verifies pairs that SimHash found, and finds those that it cannot.

Two texts link if the sets of their five-word shingles (lower case; a shorter
text is one shingle) have a Jaccard similarity of 0.8 at least; classes are the
connected components. No class is split: what SimHash's few bits miss comes from
an exact set-similarity join.

In any one order of all shingles, two sets of that similarity share one of the
first n - ceil(0.8 n) + 1 of each. Shingles are ordered by how often their
bucket of a fixed number of buckets occurs, then by hash, so that those in the
prefixes are rare; the order steers only how many pairs are met.

Pairs pass a filter on their sizes and one on how many shingles their prefixes
share (for sets of one size nearly half of a prefix), and are verified on the
whole sets in three rounds, of which each only meets what the ones before have not connected:
the pairs that SimHash gives; on each shared shingle every set with one hub; then
on each shared shingle the sets outside its largest class with all sets of other
classes. So a class of near copies does not list all its pairs: only members
that are similar neither by fingerprint nor to a hub meet the others.

Shingles are 64-bit hashes, and equal sets are one node, named by a 64-bit hash.
Sets are made from the texts whenever they are needed, and never stored for all.

Defined results: null text counts as empty; texts without a word are one class;
nulls, repeated rows and ties of ids are treated as in `simhash.one_of_each`;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, released, written
from .components import components

SHINGLE, SEED = 5, 42
#: Least similarity, as a fraction.
NUM, DEN = 4, 5
#: Buckets of shingles whose counts order them; words that a task remembers.
BUCKETS, MEMO = 1 << 17, 1 << 18


def _hasher(shingle: int):
    """A function of a text that gives the sorted distinct hashes of its shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    memo: dict[bytes, int] = {}
    factor, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)

    def one(t: str | None):
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, "i8")
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = h(w, SEED)
        w = np.fromiter(map(memo.__getitem__, words), "u8", len(words))
        k = min(shingle, len(w))
        out = np.full(len(w) - k + 1, k, "u8")
        with np.errstate(over="ignore"):
            for j in range(k):
                out = (out ^ w[j : len(w) - k + 1 + j]) * factor
                out ^= out >> shift
        return np.unique(out.view("i8"))

    return one


def _lists(parts):
    """Arrays as an Arrow column of lists."""
    import numpy as np
    import pyarrow as pa

    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype("i8")))


def shingle_sets(docs: DataFrame, row: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(row, hashes): the sorted distinct hashes of each text's shingles."""

    def run(batches):
        import pyarrow as pa

        one = _hasher(shingle)
        for b in batches:
            rows, texts = b.column("row"), b.column("x")
            for i in range(0, len(texts), 512):
                sets = [one(t.as_py()) for t in texts[i : i + 512]]
                yield pa.RecordBatch.from_arrays([rows[i : i + 512], _lists(sets)], names=["row", "hashes"])

    return docs.select(F.col(row).alias("row"), F.col(text).alias("x")).mapInArrow(released(run), "row long, hashes array<long>")


def _order(docs: DataFrame, text: str, shingle: int) -> bytes:
    """How often the shingles of each bucket occur, as BUCKETS numbers."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        one, total = _hasher(shingle), np.zeros(BUCKETS, "i8")
        for b in batches:
            texts = b.column("x")
            for i in range(0, len(texts), 512):
                values = np.concatenate([one(t.as_py()) for t in texts[i : i + 512]])
                total += np.bincount(values & (BUCKETS - 1), minlength=BUCKETS)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), pa.array(total[some])], names=["bucket", "c"])

    import numpy as np

    rows = docs.select(F.col(text).alias("x")).mapInArrow(released(run), "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(BUCKETS, "i8")
    out[rows.column("bucket").to_numpy()] = rows.column("c").to_numpy()
    return out.tobytes()


def prefixes(docs: DataFrame, row: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(row, node, n, prefix): of each text its set's name and size, and the set's rarest shingles, rarest first."""
    order = docs.sparkSession.sparkContext.broadcast(_order(docs, text, shingle))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest as h

        counts, one = np.frombuffer(order.value, "i8"), _hasher(shingle)

        def first(s):
            n = len(s)
            return s[np.lexsort((s, counts[s & (BUCKETS - 1)]))[: n + (-NUM * n // DEN) + 1]] if n else s

        for b in batches:
            rows, texts = b.column("row"), b.column("x")
            for i in range(0, len(texts), 512):
                sets = [one(t.as_py()) for t in texts[i : i + 512]]
                nodes = np.array([h(s.tobytes(), SEED) for s in sets], "u8").view("i8")
                sizes = np.array([len(s) for s in sets], "i4")
                columns = [rows[i : i + 512], pa.array(nodes), pa.array(sizes), _lists([first(s) for s in sets])]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "node", "n", "prefix"])

    schema = "row long, node long, n int, prefix array<long>"
    return docs.select(F.col(row).alias("row"), F.col(text).alias("x")).mapInArrow(released(run), schema)


def _sized() -> Column:
    """The filter on the sizes n_u and n_v."""
    return (DEN * F.col("n_u") >= NUM * F.col("n_v")) & (DEN * F.col("n_v") >= NUM * F.col("n_u"))


def _enough(c: str) -> Column:
    """The filter on c, how many shingles both prefixes share: any other shared one comes after the end of a prefix, so the overlap is at most c and what follows it."""
    after = lambda n: F.expr(f"({n} * {NUM} + {DEN - 1}) div {DEN} - 1")
    most = F.col(c) + F.greatest(after("n_u"), after("n_v"))
    return (NUM + DEN) * most >= NUM * (F.col("n_u") + F.col("n_v"))


def _side(posts: DataFrame, x: str) -> DataFrame:
    return posts.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "root")))


def _counted(joined: DataFrame) -> DataFrame:
    """(u, v, c): pairs of different classes, by how many of the joined shingles they share, if that can be enough."""
    far = joined.where((F.col("root_u") != F.col("root_v")) & _sized())
    pairs = far.groupBy(F.col("node_u").alias("u"), F.col("node_v").alias("v")).agg(F.count(F.lit(1)).alias("c"), F.first("n_u").alias("n_u"), F.first("n_v").alias("n_v"))
    return pairs.where(_enough("c")).select("u", "v", "c")


def _rooted(posts: DataFrame, roots: DataFrame) -> DataFrame:
    return posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def met_by_hub(posts: DataFrame) -> DataFrame:
    """(u, v): for each node the node of another class that is the hub of most shingles which both have in their prefixes."""
    hub = posts.groupBy("token").agg(F.min(F.struct("node", "n", "root")).alias("h"))
    pairs = _counted(_side(posts, "v").join(_side(hub.select("token", "h.*"), "u"), "token"))
    return pairs.groupBy("v").agg(F.max(F.struct("c", "u")).alias("m")).select(F.col("m.u").alias("u"), "v")


def met_by_rest(posts: DataFrame) -> DataFrame:
    """(u, v): all pairs of different classes that share enough of their prefixes; on a shingle, members of its largest class do not meet each other."""
    main = posts.groupBy("token", "root").count().groupBy("token")
    main = main.agg(F.max(F.struct("count", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("token", F.col("m.root").alias("main"))
    of = posts.join(main, "token")
    minor = _side(of.where("root <> main"), "u")
    every = of.select("token", *(F.col(c).alias(f"{c}_v") for c in ("node", "n", "root")), "main")
    # two nodes outside the largest class meet in one direction only, so each shared shingle counts once
    joined = minor.join(every, "token").where("root_v = main or node_u < node_v")
    ends = {"node_u": F.least("node_u", "node_v"), "node_v": F.greatest("node_u", "node_v"), "n_u": F.when(F.col("node_u") < F.col("node_v"), F.col("n_u")).otherwise(F.col("n_v"))}
    ends["n_v"] = F.col("n_u") + F.col("n_v") - ends["n_u"]
    return _counted(joined.select("root_u", "root_v", *(c.alias(n) for n, c in ends.items()))).select("u", "v")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, row: str, text: str, shingle: int) -> DataFrame:
    """(u, v): the pairs of nodes whose sets are similar, as a written table."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    ends = written(nodes.select("node", "row").join(ends, "node", "left_semi"), "ends")
    texts = docs.select(F.col(row).alias("row"), F.col(text).alias("x")).join(ends, "row")
    sets = written(shingle_sets(texts, "node", "x", shingle).withColumnRenamed("row", "node"), "candidate-sets")
    u, v = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"s_{x}")) for x in "uv")
    both = pairs.join(v, "v").join(u, "u").withColumn("o", F.size(F.array_intersect("s_u", "s_v")))
    out = written(both.where((NUM + DEN) * F.col("o") >= NUM * (F.size("s_u") + F.size("s_v"))).select("u", "v"), "links")
    forget(pairs, ends, sets)
    return out


def classes(docs: DataFrame, row: str, text: str = "text", found: DataFrame | None = None, shingle: int = SHINGLE) -> DataFrame:
    """(row, root): rows of near-duplicate texts have the same root. found: pairs (u, v) of rows to verify first, as a written table."""
    parts = written(prefixes(docs, row, text, shingle), "prefixes")
    nodes = written(parts.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "nodes")
    of = written(parts.select("row", "node"), "row-nodes")
    forget(parts)
    posts = nodes.select("node", "n", F.explode("prefix").alias("token"))
    twice = written(posts.groupBy("token").count().where("count > 1").select("token"), "shared")
    posts = written(posts.join(twice, "token", "left_semi"), "met")
    check = functools.partial(verified, nodes=written(nodes.select("node", "row"), "node-rows"), docs=docs, row=row, text=text, shingle=shingle)
    edges = []
    if found is not None:
        sizes = nodes.select("node", "n").join(of, "node")
        side = lambda x: sizes.select(F.col("row").alias(x), F.col("node").alias(f"node_{x}"), F.col("n").alias(f"n_{x}"))
        pairs = found.join(side("u"), "u").join(side("v"), "v").where("node_u <> node_v").where(_sized())
        edges.append(check(pairs.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct()))
    forget(nodes, twice)
    for meet in (met_by_hub, met_by_rest):
        roots = components(functools.reduce(DataFrame.union, edges)) if edges else None
        rooted = _rooted(posts, roots) if roots else posts.withColumn("root", F.col("node"))
        rooted = written(rooted, "rooted")
        edges.append(check(meet(rooted)))
        forget(rooted)
    roots = components(functools.reduce(DataFrame.union, edges))
    out = written(of.join(roots, "node", "left").select(F.col("row").alias(row), F.coalesce("root", "node").alias("root")), "near-classes")
    forget(of, posts, check.keywords["nodes"], *edges)
    return out
