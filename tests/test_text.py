import pytest
from pyspark.sql import functions as F

from fathom.functions import paths, text
from fathom.operators.index import Index
from fathom.plans import registry
from fathom.sources.corpus import from_rows


def terms_of(spark, body):
    return [tuple(r) for r in Index(from_rows(spark, [("a.md", body)])).tokens.orderBy("position").select("term", "position", "line").collect()]


@pytest.mark.parametrize(
    "body, length, want",
    [
        ("tide_table --", 1, [("tide_table", 0, 1), ("tide", 0, 1), ("table", 0, 1)]),
        ("low-water\n\nXMLFeed ", 2, [("low-water", 0, 1), ("low", 0, 1), ("water", 0, 1), ("xmlfeed", 1, 3), ("xml", 1, 3), ("feed", 1, 3)]),
        ("d'Été, été_3m; ___ (ÎleVerte)", 4, [("d", 0, 1), ("été", 1, 1), ("été_3m", 2, 1), ("été", 2, 1), ("3m", 2, 1), ("îleverte", 3, 1), ("île", 3, 1), ("verte", 3, 1)]),
        ("echo echo-Echo", 2, [("echo", 0, 1), ("echo-echo", 1, 1), ("echo", 1, 1)]),
        ("", 0, []),
    ],
)
def test_tokenizer(spark, body, length, want):
    assert sorted(terms_of(spark, body)) == sorted(want)
    assert Index(from_rows(spark, [("a.md", body)])).documents.first().token_count == length


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_snippets_and_paths(spark):
    body = F.lit("oak\n \t ash and elm \r\nyew")
    assert [one(spark, text.snippet(body, F.lit(n))) for n in (0, 1, 2, 3, 4)] == [None, "oak", "ash and elm", "yew", None]
    p = lambda s: F.lit(s)
    assert one(spark, paths.normalized(p("a/b/../../c/./d.rs"))) == "c/d.rs"
    assert one(spark, paths.normalized(p("../../a//b/"))) == "a/b"
    assert [one(spark, paths.extension(p(s))) for s in ("a/b.tar.gz", ".hidden", "x", "a.")] == ["gz", None, None, ""]
    assert [one(spark, paths.stem(p(s))) for s in ("a/b.tar.gz", ".hidden", "x/y")] == ["b.tar", ".hidden", "y"]
    assert [one(spark, paths.parent(p(s))) for s in ("a/b/c", "c")] == ["a/b", ""]


def test_components_order_before_characters(spark):
    rows = spark.createDataFrame([("src-x/a",), ("src/b",), ("src/a/z",)], "p string")
    assert [r.p for r in rows.orderBy(paths.order(F.col("p"))).collect()] == ["src/a/z", "src/b", "src-x/a"]


def test_categories(spark):
    known = registry.ADDRESSES + [("crates/a/benches/b.rs", "SourceCode"), ("docs/x.png", "Unknown")]
    rows = spark.createDataFrame(known, "path string, want string").withColumn("got", paths.category(F.col("path")))
    assert [(r.path, r.got) for r in rows.collect()][:16] == registry.ADDRESSES
