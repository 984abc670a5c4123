"""That work grows no faster than the input: what is shuffled, parsed and put into one task."""

import pytest
from pyspark.sql import functions as F

from fathom.functions import text
from fathom.functions.rust import ParseError, hopeless, parse
from fathom.operators import audit, overview, related, search, symbols
from fathom.operators.index import Index
from fathom.plans import repository
from fathom.sources.corpus import from_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def parts(spark, tmp_path):
    made = spark.range(60).select(F.col("id").alias("p_partkey"), F.lit("Brand#13").alias("p_brand"), F.lit("red sea").alias("p_name"), F.lit(3).alias("p_size"))
    made.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_files_of_parts_are_spread_over_tasks(spark, parts, monkeypatch):
    monkeypatch.setattr(repository, "ROWS", 10)
    corpus = repository.corpus(spark, parts)
    tasks = corpus.groupBy(F.spark_partition_id().alias("p")).count().where("count < 100")
    assert tasks.count() >= 6 and corpus.select("doc_id").distinct().count() == corpus.count() == 4 * 60 + 2


def test_related_files_shuffle_hits_and_parse_one_file(spark):
    index = Index(from_rows(spark, [("src/tide.rs", "pub struct Gauge; // harbour basin"), ("docs/gauge.md", "A Gauge of the harbour"), ("b.txt", "basin")]))
    shown = plan(related.related(index, "src/tide.rs"))
    assert "(term" not in "".join(x for x in shown.splitlines() if "hashpartitioning(term" in x and "doc_id" in x)
    assert "doc_id" in shown.split("MapInArrow", 1)[1].split("Filter", 1)[1].splitlines()[0]


@pytest.mark.parametrize("content", ["Tide-pool TidePool HTTPServer __x2y_ -", "ΑΣ'Α ΑΣ_b", "İstanbul aİB", "", None])
def test_terms_of_whole_texts_are_those_of_tokens(spark, content):
    index = Index(from_rows(spark, [("a.md", content), ("b.md", "other")]))
    assert sorted(index.pairs.collect()) == sorted(index.tokens.select("term", "doc_id").distinct().collect())
    for term in {r.term for r in index.tokens.where("doc_id = 0").collect()}:
        assert index.corpus.where(text.may_have(F.col("content"), [term])).where("doc_id = 0").count() == 1


def test_documents_that_share_an_id_count_once(spark):
    twice = from_rows(spark, [("a.md", "tide"), ("b.md", "moon")]).withColumn("doc_id", F.lit(7))
    assert {(r.term, r.df) for r in Index(twice.union(twice)).term_df.collect()} == {("tide", 1), ("moon", 1)}
    assert [tuple(r) for r in Index(twice.union(twice)).postings.where("term = 'tide'").select("doc_id", "tf").collect()] == [(7, 2)]


def rust(spark, *more):
    return Index(from_rows(spark, [("src/tide.rs", "pub struct Gauge;\npub fn r#type() {}\nimpl [u8] {}"), ("src/sea.rs", "pub struct Sea;"), ("docs/gauge.md", "A Gauge of the\nharbour Gauge"), *more]))


def test_boosts_parse_only_files_that_hold_a_name_of_the_query(spark):
    index = rust(spark)
    named = search.symbols_named(index, "new-Gauge r#type")
    assert "Contains(content" in plan(named).split("MapInArrow", 1)[1] and sorted(r.name for r in named.collect()) == ["Gauge", "r#type"]
    assert [r.name for r in search.symbols_named(index, "an <anonymous> type").collect()] == ["<anonymous>"]
    assert search.symbols_named(index, " -- ").count() == 0


def test_lookup_parses_only_files_that_hold_the_name(spark):
    index = rust(spark)
    found = symbols.lookup(index, "Gauge")
    assert "Contains(content" in plan(found.definitions).split("MapInArrow", 1)[1] and [(r.doc_id, r.line) for r in found.definitions.collect()] == [(0, 1)]
    assert "Contains(lower(content" in plan(found.references) and [(r.doc_id, r.line) for r in found.references.collect()] == [(2, 1), (2, 2)]
    assert [r.kind for r in symbols.lookup(index, "<anonymous>").definitions.collect()] == ["Implementation"]


def test_searches_cut_only_texts_with_a_term_and_once(spark):
    df = search.ranked(rust(spark, ("a.md", "harbour sea"), ("b.md", None)), "gauge harbour", match_all=True)
    assert plan(df).count("Contains(lower(content") >= 2
    assert [r.relative_path for r in df.collect()] == ["docs/gauge.md"]
    ran = plan(df).split("Initial Plan")[0]
    assert ran.count("posexplode(") == 1 and "ReusedExchange" in ran


@pytest.mark.parametrize("source", ["The sea", "tide", "tide!()", "a::b!()", "tide /**/ !()", "fn a() {}", "safe fn a() {}", "b'x'", "r#\"x\"#", "  moon, sun", "use a;", ";", "auto trait T {}", "moon . x", "", "tide !(x);"])
def test_texts_passed_over_unread_are_those_that_fail(source):
    try:
        parse(source)
        assert not hopeless(source)
    except ParseError:
        pass
    assert hopeless("The sea") and hopeless("  moon, sun") and not hopeless("tide !(x);")


def test_roles_are_counted_over_texts_with_a_term(spark):
    index = rust(spark, ("a.md", "harbour sea"), ("b.md", "else"))
    found = search.ranked(index, "gauge harbour").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    assert "Contains(lower(content" in plan(found) and {(r.category, r.n) for r in found.collect()} == {("SourceCode", 1), ("Documentation", 2)}


def audited(spark):
    index = rust(spark, ("docs/a.md", "`Gauge` `gone()` `src/no.rs` `a::b` `--x` `deep_key = 1` `fathom drop`"), ("conf/a.toml", "x_y = 1"))
    return audit.unresolved(index, audit.references(index), ["index"], ["--limit"])


def test_audits_read_each_kind_of_file_once(spark):
    df = audited(spark)
    assert sorted((r.kind, r.value) for r in df.collect()) == [("Command", "drop"), ("ConfigurationKey", "deep_key"), ("Module", "a::b"), ("Option", "--x"), ("Path", "src/no.rs"), ("Symbol", "gone")]
    assert plan(df).split("Initial Plan")[0].count("MapInArrow") == 3  # Markdown, Rust, keys


def test_high_findings_read_each_kind_of_file_once(spark):
    df = audit.at_least(audited(spark), "high")
    assert sorted(r.kind for r in df.collect()) == ["Command", "Option", "Path"]
    assert plan(df).split("Initial Plan")[0].count("MapInArrow") <= 3


def test_overview_parses_only_files_that_can_matter_and_sorts_by_parts(spark):
    index = rust(spark, ("src-x/a.rs", ""), ("src/main.rs", "use crate::tide;\nfn main() {}"), ("src/b/c.rs", "#[cfg(test)] mod t {}"), ("Cargo.toml", '[package]\nname = "a"'))
    df = overview.overview(index)
    got = df.first()
    assert (got.core_modules, got.tests, got.workflow) == (["src/b/c.rs", "src/sea.rs", "src/tide.rs", "src-x/a.rs"], ["src/b/c.rs"], ["main", "tide"])
    assert "Contains(content" in plan(df) and "array_sort" not in plan(df)


def test_postings_need_no_exchange(spark):
    index = rust(spark, ("a.md", "Tide-pool tide\n\nPool TidePool"), ("b.md", None), ("c.md", "--"))
    assert "Exchange" not in plan(index.postings) and plan(index._gathered(index.tokens)).count("Exchange") >= 1
    assert sorted(index.postings.collect()) == sorted(index._gathered(index.tokens).collect())


def test_related_files_read_texts_twice(spark):
    index = rust(spark, ("a.txt", "harbour"), ("b.txt", "harbour sea"))
    df = related.related(index, "docs/gauge.md")
    assert df.count() == 1
    assert not any("hashpartitioning(term" in x and "doc_id" in x for x in plan(df).splitlines()) and "posexplode" not in plan(df)


def test_summary_counts_terms_without_their_documents(spark):
    df = rust(spark, ("b.md", None)).summary()
    assert not any("hashpartitioning(term" in x and "doc_id" in x for x in plan(df).splitlines()) and "posexplode" not in plan(df)
    assert tuple(df.first())[:5] == (4, 4, 13, 16, 18)
