"""Secret scans: fixed patterns, and a battery of randomness tests on long strings.

Base kinds are found as leftmost non-overlapping matches of their patterns. Added
spans (kind ``random``) are long strings over an encoding's alphabet that the
tests do not tell from random draws. For each such string the encoding is
inferred, and four tests give p-values under that hypothesis: chi-squared of
single characters, chi-squared of character classes, runs above and below the
middle of the alphabet, and lag-one serial correlation. Their least one,
Bonferroni-corrected, is the string's p. Over all strings of the corpus,
Benjamini-Hochberg with weights proportional to length (longer strings carry
more power, so more of the level) says which are not random; the others, with
enough bits, are spans. That bounds the share of truly random strings among
those let go. The thresholds come from a histogram of a fixed number of bins.

A string that no encoding fits as a whole (NAME=value, or characters of two
encodings) is split at its inner '='; a part that mixes '+' or '/' with '-' or
'_' is split at the first two and also at the last two. The parts with enough
bits are tested like whole strings; found ones that overlap are one span.

Everything is DataFrame functions. Positions are code points: the gaps between
matches come from splitting at the same pattern, and a running sum over a
document's matches gives their places; only matches are shuffled, not texts.

Defined results: null text is the empty text and has no spans; a random span
that overlaps a base one is left out; repeated rows (ids too) give a row each;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, numbered, written

#: Kinds in the order in which equal starts are listed: pattern, and least length of a match or, for assign, of its second group.
ASSIGN = "(?:(?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "random": "[A-Za-z0-9+/_=-]{14,}+"}
VALUE = 6
#: Encodings in the order in which they are tried: name, pattern, alphabet, and how many characters each class of it has.
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", "[+/_-]")
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", (6, 0, 10, 0)),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (0, 26, 6, 0)),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", (26, 0, 10, 0)),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", (26, 26, 10, 0)),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (26, 26, 10, 2)),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", (26, 26, 10, 2)),
)
SPLITS = ("[+/]", "[_-]")
#: Share of random strings among those let go; least bits of a secret; bins of the histogram of -log p, and how many make a unit.
LEVEL, BITS, BINS, GRAIN = 0.01, 80.0, 512, 16


def _tail(z: Column) -> Column:
    """Probability that a standard normal value exceeds z, by a logistic approximation."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def battery(strings: DataFrame, text: str = "s") -> DataFrame:
    """strings with ``encoding``, ``bits`` and ``p``; encoding is null, and so are the others, where none fits or digits or letters are missing."""
    s = F.regexp_replace(F.col(text), "=+$", "")
    name, alphabet, sizes = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("array<int>")
    for enc, pattern, chars, by in reversed(ENCODINGS):
        fits = F.col(text).rlike(pattern)
        name, alphabet = F.when(fits, enc).otherwise(name), F.when(fits, chars).otherwise(alphabet)
        sizes = F.when(fits, F.array(*map(F.lit, by))).otherwise(sizes)
    mixed = F.col(text).rlike("[0-9]") & F.col(text).rlike("[A-Za-z]")
    base = strings.withColumns({"encoding": F.when(mixed, name), "b_alphabet": alphabet, "b_sizes": sizes})
    one_case = F.when(F.col("encoding").isin("hex", "base36"), F.lower(s)).otherwise(s)
    base = base.withColumns({"b_s": one_case, "b_n": F.length(s).cast("double"), "b_a": F.length("b_alphabet").cast("double")})
    base = base.withColumn("b_v", F.expr("transform(filter(split(b_s, ''), c -> c <> ''), c -> cast(instr(b_alphabet, c) - 1 as double))"))
    n, a = F.col("b_n"), F.col("b_a")
    squares = F.expr("aggregate(filter(split(b_alphabet, ''), c -> c <> ''), 0D, (t, c) -> t + pow(b_n - length(replace(b_s, c, '')), 2))")
    chi = a / n * squares - n
    z_chi = (chi - (a - 1)) / F.sqrt(2 * (a - 1) * (1 - 1 / n))
    total = F.lit(0.0)
    for i, c in enumerate(CLASSES):
        hope = n * F.get("b_sizes", F.lit(i)) / a
        seen = n - F.length(F.regexp_replace("b_s", c, ""))
        total = total + F.when(hope > 0, (seen - hope) * (seen - hope) / hope).otherwise(0.0)
    df = F.size(F.filter("b_sizes", lambda x: x > 0)) - 1
    z_class = F.when(df > 0, ((F.pow(total / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))).otherwise(-8.0)
    base = base.withColumns({"b_mean": F.expr("aggregate(b_v, 0D, (t, x) -> t + x) / b_n"), "b_high": F.expr("aggregate(b_v, 0D, (t, x) -> t + if(x >= b_a / 2, 1, 0))"), "b_z1": z_chi, "b_z2": z_class})
    pairs = "zip_with(slice(b_v, 2, size(b_v)), slice(b_v, 1, greatest(size(b_v) - 1, 0)), (y, x) -> {})"
    base = base.withColumns({
        "b_runs": F.expr("1 + aggregate(" + pairs.format("if((x >= b_a / 2) <> (y >= b_a / 2), 1D, 0D)") + ", 0D, (t, x) -> t + x)"),
        "b_cov": F.expr("aggregate(" + pairs.format("(x - b_mean) * (y - b_mean)") + ", 0D, (t, x) -> t + x)"),
        "b_var": F.expr("aggregate(b_v, 0D, (t, x) -> t + (x - b_mean) * (x - b_mean))"),
    })
    h, low = F.col("b_high"), F.col("b_n") - F.col("b_high")
    mean = 2 * h * low / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = F.when(spread > 0, F.abs(F.col("b_runs") - mean) / F.sqrt(spread)).otherwise(8.0)
    z_serial = F.when(F.col("b_var") > 0, F.abs(F.col("b_cov") / F.col("b_var") * F.sqrt(n))).otherwise(8.0)
    least = F.least(_tail(F.col("b_z1")), _tail(F.col("b_z2")), 2 * _tail(z_runs), 2 * _tail(z_serial))
    ok = F.col("encoding").isNotNull()
    out = base.withColumns({"bits": F.when(ok, n * F.log2(a)), "p": F.when(ok, F.least(F.lit(1.0), 4 * least))})
    return out.select(*strings.columns, "encoding", "bits", "p")


def _bin(p: Column, length: Column, mean: float) -> Column:
    """The bin of -log of a weighted p; weights are lengths over their mean."""
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(-GRAIN * F.log(F.greatest(p * mean / length, F.lit(1e-300)))))).cast("int")


def not_random(tested: DataFrame, text: str = "s", level: float = LEVEL) -> tuple[int, float]:
    """The least bin that weighted Benjamini-Hochberg rejects (BINS if none), and the mean length. Reads a histogram of BINS rows."""
    have = tested.where("p is not null")
    n, mean = have.agg(F.count(F.lit(1)), F.avg(F.length(text))).first()
    if not n:
        return BINS, 1.0
    counts = dict(have.groupBy(_bin(F.col("p"), F.length(text), mean).alias("b")).count().collect())
    import math

    seen, least = 0, BINS
    for b in range(BINS - 1, -1, -1):
        seen += counts.get(b, 0)
        if seen and math.exp(-b / GRAIN) <= seen * level / n:  # the largest p of the bin
            least = b
    return least, mean


def _hits(docs: DataFrame, kind: str) -> DataFrame:
    """(row, kind, k, gap, hit, size): the k-th match in each text and the code points before it since the last."""
    pattern = F.lit(PATTERNS[kind])
    some = docs.where(F.col("t").rlike(PATTERNS[kind]))
    parts = F.arrays_zip(F.transform(F.split("t", PATTERNS[kind], -1), lambda x: F.length(x)).alias("gap"), F.regexp_extract_all("t", pattern, F.lit(0)).alias("hit"))
    value = F.regexp_extract_all("t", pattern, F.lit(1)) if kind == "assign" else None
    cols = ["row", F.lit(KINDS.index(kind)).alias("kind")]
    if kind == "assign":
        parts = F.arrays_zip(F.transform(F.split("t", PATTERNS[kind], -1), lambda x: F.length(x)).alias("gap"), F.regexp_extract_all("t", pattern, F.lit(0)).alias("hit"), value.alias("value"))
    out = some.select(*cols, F.posexplode(parts).alias("k", "m"))
    least = F.length("m.value") >= VALUE if kind == "assign" else F.lit(True)
    return out.select("row", "kind", "k", F.col("m.gap").alias("gap"), F.col("m.hit").alias("hit"), F.length("m.hit").alias("size"), least.alias("ok")).where("hit is not null")


def _split(strings: DataFrame, pattern: str) -> DataFrame:
    """The parts of each string between single characters that match; a running sum gives their places."""
    rest = [c for c in strings.columns if c not in ("start", "end", "s")]
    parts = strings.select(*rest, F.col("start").alias("from"), F.posexplode(F.split("s", pattern, -1)).alias("i", "s"))
    upto = Window.partitionBy("row", "from").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("end", F.col("from") + F.sum(F.length("s") + 1).over(upto) - 1)
    return parts.withColumn("start", F.col("end") - F.length("s")).select(*rest, "start", "end", "s")


def pieces(strings: DataFrame) -> DataFrame:
    """(row, kind, start, end, s): strings that an encoding fits as they are, and parts of the others."""
    fits = F.lit(False)
    for _, pattern, _, _ in ENCODINGS:
        fits = fits | F.col("s").rlike(pattern)
    core = F.regexp_replace("s", "=+$", "")
    other = strings.where(~fits).withColumns({"s": core, "last": F.col("start") + F.length(core), "whole": F.col("end")})
    # a part of fewer characters has too few bits in any encoding
    enough = F.length("s") * 6 >= BITS
    parts = _split(other, "=").where(enough)
    mixed = F.col("s").rlike(SPLITS[0]) & F.col("s").rlike(SPLITS[1])
    twice = _split(parts.where(mixed), SPLITS[0]).union(_split(parts.where(mixed), SPLITS[1])).where(enough).distinct()
    out = parts.where(~mixed).union(twice)
    # padding at the string's end is the last part's
    out = out.withColumn("end", F.when(F.col("end") == F.col("last"), F.col("whole")).otherwise(F.col("end")))
    return strings.where(fits).select("row", "kind", "start", "end", "s").union(out.select("row", "kind", "start", "end", "s"))


def spans(docs: DataFrame, text: str = "text", row: str = "row") -> DataFrame:
    """(row, kind, start, end): all spans of the texts, which `row` tells apart; kind is the place in KINDS."""
    body = docs.select(F.col(row).alias("row"), F.col(text).alias("t"))
    hits = None
    for kind in KINDS:
        one = _hits(body, kind)
        one = one.withColumn("hit", F.when(F.col("kind") == KINDS.index("random"), F.col("hit")))
        hits = one if hits is None else hits.union(one)
    order = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    placed = hits.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).where("ok")
    placed = written(placed.select("row", "kind", "start", "end", F.col("hit").alias("s")), "hits")
    tested = written(battery(pieces(placed.where(F.col("kind") == KINDS.index("random")))).where((F.col("bits") >= BITS) & F.col("p").isNotNull()), "tested")
    least, mean = not_random(tested)
    random = tested.where(_bin(F.col("p"), F.length("s"), mean) < least)
    both = placed.where(F.col("kind") != KINDS.index("random")).drop("s").union(random.select("row", "kind", "start", "end"))
    # A random span stays if no base span that starts before it ends in it, and none starts within it.
    base = F.col("kind") != KINDS.index("random")
    by = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    kept = both.withColumns({"before": before, "after": after})
    free = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    kept = kept.where(base | free)
    # parts that overlap are one: a span begins where no part before it of its kind reaches it
    by = Window.partitionBy("row", base).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("new", F.when(base | (F.coalesce(reach, F.lit(-1)) <= F.col("start")), 1).otherwise(0))
    kept = kept.withColumn("n", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.groupBy("row", "kind", base.alias("base"), "n").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("row", "kind", "start", "end")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, found): found is an array of (start, kind, end), in that order, empty where there is none."""
    rows = numbered(docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t")), "row")
    found = spans(rows, "t").groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end")))).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.select("row", "doc").join(found, "row", "left").select(F.col("doc").alias(doc), F.coalesce("found", empty).alias("found"))


def digests(found: DataFrame) -> DataFrame:
    """scan()'s rows as counts by base kind, the base spans' digest, and all spans as text."""
    base = F.filter("found", lambda x: x["kind"] < KINDS.index("random"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(*(c for c in found.columns if c != "found"), *map(count, KINDS[:3]), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, doc: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs, with each span in the text replaced by mark; texts without a span, null among them, stay as they are."""
    row, cuts = fresh(docs, "secret_row"), fresh(docs, "secret_cuts")
    rows = numbered(docs, row)
    found = spans(rows.select(row, F.coalesce(F.col(text), F.lit("")).alias("t")), "t", row)
    # spans that overlap or touch are one: a span begins where nothing before reaches it
    by = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    run = found.withColumn("new", F.when(F.coalesce(reach, F.lit(-1)) < F.col("start"), 1).otherwise(0))
    run = run.withColumn("n", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = run.groupBy("row", "n").agg(F.min("start").alias("a"), F.max("end").alias("b")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cuts"))
    met = rows.join(runs.select(F.col("row").alias(row), F.col("cuts").alias(cuts)), row, "left")
    before = lambda i: F.when(i > 0, F.get(cuts, i - 1)["b"]).otherwise(0)
    gaps = F.transform(cuts, lambda c, i: F.substring(F.col(text), (before(i) + 1).cast("int"), (c["a"] - before(i)).cast("int")))
    last = F.substring(F.col(text), (F.element_at(cuts, -1)["b"] + 1).cast("int"), F.lit(1 << 30))
    new = F.when(F.col(cuts).isNull(), F.col(text)).otherwise(F.array_join(F.concat(gaps, F.array(last)), mark))
    return met.withColumn(text, new).select(*docs.columns)
