import math

import pytest
from pyspark.sql import functions as F

from fathom.operators import search
from fathom.operators.index import Index
from fathom.sources.corpus import from_rows


def index_of(spark, *rows):
    docs = from_rows(spark, [r[:2] for r in rows])
    roles = spark.createDataFrame([(i, r[2] if len(r) > 2 else "SourceCode") for i, r in enumerate(rows)], "doc_id long, role string")
    return Index(docs.join(roles, "doc_id"), "role")


def test_postings_and_statistics(spark):
    index = index_of(spark, ("src/ebb.rs", "tide\n\nTidePool tide pool"), ("src/flow.rs", "pool"), ("src/none.rs", ""))
    assert tuple(r if i < 2 else round(r, 6) for i, r in enumerate(index.stats.first())) == (3, 5, 1.666667)
    assert {r.term: r.df for r in index.term_df.collect()} == {"tide": 1, "tidepool": 1, "pool": 2}
    assert [tuple(r) for r in index.postings_for("pool").select("doc_id", "tf", "positions", "lines").collect()] == [(0, 2, [1, 3], [3, 3]), (1, 1, [0], [1])]
    assert index.postings_for("tide").first().positions == [0, 1, 2]
    assert index.postings_for("moon").count() == 0


def test_empty_corpus(spark):
    index = Index(from_rows(spark, [("a.rs", "x")]).limit(0))
    assert tuple(index.stats.first()) == (0, 0, 0.0)
    assert search.ranked(index, "x").count() == 0
    assert tuple(index.summary().first())[:5] == (0, 0, 0, 0, 0)


def found(index, query, **kw):
    return search.ranked(index, query, **kw).collect()


def test_any_orders_by_score_and_ignores_repeats(spark):
    index = index_of(spark, ("x", "moon tide"), ("y", "tide sand sand sand sand"), ("z", "sand"), ("w", "moon"), ("v", "sand sand"))
    got = found(index, "moon tide")
    assert [r.relative_path for r in got] == ["x", "w", "y"]
    assert [r.matched_terms for r in got] == [["moon", "tide"], ["moon"], ["tide"]]
    assert got[0].score > got[1].score > got[2].score
    assert [r.score for r in found(index, "tide tide moon")] == [r.score for r in got]


def test_all_needs_every_token(spark):
    index = index_of(spark, ("x", "ebb"), ("y", "flow\nand\nebb"), ("z", "tide_pool"))
    assert [(r.relative_path, r.line) for r in found(index, "ebb flow", match_all=True)] == [("y", 1)]
    assert [r.matched_terms for r in found(index, "TidePool", match_all=True)] == [["pool", "tide"]]


def test_boosts(spark):
    index = index_of(spark, ("a/tide.rs", "tide"), ("tide/a.md", "tide", "Documentation"), ("tide/tide.rs", "tide", "Test"), ("a/b.rs", "tide", "Unknown"))
    got = {r.relative_path: (r.file_name, r.path, r.category_boost) for r in found(index, "tide")}
    assert got == {"a/tide.rs": (2.0, 0.0, 0.30), "tide/a.md": (0.0, 1.0, 0.25), "tide/tide.rs": (2.0, 1.0, 0.15), "a/b.rs": (0.0, 0.0, 0.0)}
    twice = {r.relative_path: (r.file_name, r.bm25) for r in found(index, "tide tide")}
    assert twice["a/tide.rs"] == (4.0, {r.relative_path: r.bm25 for r in found(index, "tide")}["a/tide.rs"])


@pytest.mark.parametrize("query, boost", [("TideGauge", 4.0), ("tidegauge", 0.0), ("NewTideGauge", 0.0), ("new-TideGauge", 4.0)])
def test_symbol_boost(spark, query, boost):
    index = index_of(spark, ("src/sea.rs", "struct TideGauge { new: u8 }\nimpl TideGauge {}"))
    assert [r.exact_symbol for r in found(index, query)] == [boost]


def test_bm25_value(spark):
    got = found(index_of(spark, ("a", "search"), ("b", "other")), "search")[0]
    assert abs(got.bm25 - math.log(2)) < 1e-12 and abs(got.score - math.log(2) - 0.30) < 1e-12


def test_filters_follow_ranking(spark):
    index = index_of(spark, ("docs/guide.md", "search", "Documentation"), ("docs/notes.txt", "search", "Documentation"), ("src/main.rs", "search"))
    filters = search.Filters(["documentation"], " DOCS ", [".MD"], 1)
    assert (filters.path, filters.extensions, filters.active) == ("docs", ("md",), True)
    assert [r.relative_path for r in found(index, "search", filters=filters)] == ["docs/guide.md"]
    every = {r.relative_path: r.bm25 for r in found(index, "search")}
    assert found(index, "search", filters=filters)[0].bm25 == every["docs/guide.md"]
    with pytest.raises(ValueError):
        search.Filters(limit=0)
    assert not search.Filters().active


def test_no_terms(spark):
    assert found(index_of(spark, ("a", "x")), "  --  ") == []


def test_save_and_load(spark, tmp_path):
    index = index_of(spark, ("src/a.rs", "pub struct A;"), ("b.md", "A struct", "Documentation"))
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    assert found(again, "struct a") == found(index, "struct a")
    assert tuple(again.summary().first()) == tuple(index.summary().first())


def test_filters_reach_the_scan(spark, tmp_path):
    index_of(spark, ("src/a.rs", "pub struct A;"), ("b.md", "A struct")).save(str(tmp_path / "i"))
    plan = Index.load(spark, str(tmp_path / "i")).postings.where(F.col("term") == "a").select("doc_id")._jdf.queryExecution().toString()
    assert "EqualTo(term,a)" in plan and "positions" not in plan.split("ReadSchema")[-1]
