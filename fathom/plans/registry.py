"""The registered queries over the driver's tables, each with SQL that gives the same rows.

The documents table is the corpus, under synthetic paths; pages and part give
addresses and identifiers, and a repository of code is made of part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import audit, overview, related, search, symbols
from ..operators.index import Index
from ..schema import CATEGORIES, FINDINGS, LABELS
from ..sources.corpus import from_documents
from . import repository

QUERY, RARE, NAME = "the inhe", "Thing-ation of_the", "Brand13"


def _index(spark: SparkSession, sf_dir: str) -> Index:
    return Index(from_documents(spark, sf_dir))


def _flat(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumns({a: F.array_join(F.col(a).cast("array<string>"), ",") for a in arrays})


def tokens(spark, sf_dir):
    return _index(spark, sf_dir).tokens


def identifiers(spark, sf_dir):
    """Compound identifiers made of part names: snake, kebab, camel and acronym cases."""
    name = F.initcap("p_name")
    made = F.concat_ws(" ", F.replace("p_name", F.lit(" "), F.lit("_")), F.replace(name, F.lit(" "), F.lit("")), F.concat(F.lit("HTTP"), F.replace(name, F.lit(" "), F.lit("-"))), F.lit("__x2y_ -"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", made.alias("content"))
    return Index(parts.select(F.col("p_partkey").alias("doc_id"), F.lit("a.md").alias("relative_path"), "content")).tokens


def doc_lengths(spark, sf_dir):
    return _index(spark, sf_dir).documents.select("doc_id", "relative_path", "category", "token_count")


def postings(spark, sf_dir):
    return _flat(_index(spark, sf_dir).postings, "positions", "lines")


def term_df(spark, sf_dir):
    return _index(spark, sf_dir).term_df


def corpus_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats.withColumn("avg_len", F.round("avg_len", 6))


def category_counts(spark, sf_dir):
    return _index(spark, sf_dir).category_counts()


def index_summary(spark, sf_dir):
    return _index(spark, sf_dir).summary().withColumn("avg_len", F.round("avg_len", 6))


def top_terms(spark, sf_dir):
    return _index(spark, sf_dir).term_df.orderBy(F.desc("df"), "term").limit(50)


def exact_term(spark, sf_dir):
    return _flat(_index(spark, sf_dir).postings_for("inhe"), "positions", "lines")


def path_parts(spark, sf_dir):
    p = F.col("relative_path")
    docs = from_documents(spark, sf_dir)
    return docs.select("doc_id", paths.file_name(p).alias("file_name"), paths.stem(p).alias("stem"), paths.extension(p).alias("extension"), paths.parent(p).alias("parent"), F.array_join(text.terms(paths.stem(p)), ",").alias("stem_terms"))


def normalized_paths(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = F.concat(F.lit("./docs/x/../"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/../end.md"))
    return pages.select("page_id", paths.normalized(odd).alias("path"))


#: Paths of all roles, in which # stands for a document's source, and their categories.
ADDRESSES = [
    ("#/units.rs", "SourceCode"), ("#/tests/units.md", "Test"), ("src/#_test.rs", "Test"), ("examples/#.json", "Example"), ("README.md", "Documentation"), ("#/notes.txt", "Documentation"), ("#.toml", "Configuration"),
    ("deploy/#.JSON", "Configuration"), ("#/Cargo.toml", "ProjectMetadata"), ("package.json", "ProjectMetadata"), ("#/logo.png", "Unknown"), ("#.spec.ts", "Test"), ("Tests/#.md", "Test"), ("tests", "Unknown"),
    ("a/EXAMPLES/#/c.txt", "Example"), ("#.yml", "Configuration"),
]


def classify(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    which = F.element_at(F.array(*(F.lit(p) for p, _ in ADDRESSES)), (F.col("doc_id") % len(ADDRESSES) + 1).cast("int"))
    made = docs.select("doc_id", F.replace(which, F.lit("#"), F.coalesce("source", F.lit("none"))).alias("path"))
    return made.select("doc_id", "path", paths.category(F.col("path")).alias("category"))


def _results(df: DataFrame) -> DataFrame:
    return _flat(df, "matched_terms").withColumns({"rank": F.col("rank").cast("long"), "line": F.col("line").cast("long")})


def search_any(spark, sf_dir):
    return _results(search.ranked(_index(spark, sf_dir), QUERY, digits=6))


def search_all(spark, sf_dir):
    return _results(search.ranked(_index(spark, sf_dir), QUERY, match_all=True, digits=6))


def search_repeated(spark, sf_dir):
    return _results(search.ranked(_index(spark, sf_dir), f"inhe src3 src3 {QUERY}", digits=6))


def search_compound(spark, sf_dir):
    return _results(search.ranked(_index(spark, sf_dir), RARE, match_all=True, digits=6))


def search_filtered(spark, sf_dir):
    filters = search.Filters(["docs", "test"], "SRC1", [".md", "txt"], 25)
    return _results(search.ranked(_index(spark, sf_dir), QUERY, filters=filters, digits=6))


def search_top10(spark, sf_dir):
    return _results(search.ranked(_index(spark, sf_dir), QUERY, filters=search.Filters(limit=10), digits=6))


def search_by_role(spark, sf_dir):
    """Results counted by role, in display order."""
    found = search.ranked(_index(spark, sf_dir), QUERY, digits=6)
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("results"), F.min("rank").cast("long").alias("best_rank"))


def search_none(spark, sf_dir):
    return _results(search.ranked(_index(spark, sf_dir), "  --  ", digits=6))


def likely_references(spark, sf_dir):
    """Lines with a term that aren't the first of their document: tokens anti-joined with defined places."""
    index = _index(spark, sf_dir)
    lines = index.tokens.where("term = 'inhe'").select("doc_id", "line").distinct()
    first = lines.groupBy("doc_id").agg(F.min("line").alias("line"))
    return lines.join(first, ["doc_id", "line"], "left_anti").join(index.corpus, "doc_id").select("doc_id", "line", text.snippet(F.col("content"), F.col("line")).alias("snippet"))


def related_files(spark, sf_dir):
    index = _index(spark, sf_dir)
    return _flat(related.related(index, "./src/../docs/src8/doc_8.toml", digits=6), "symbols", "file_terms", "shared_terms")


def related_top(spark, sf_dir):
    index = _index(spark, sf_dir)
    return _flat(related.ranked(index, "docs/src8/doc_8.toml", 5, digits=6), "symbols", "file_terms", "shared_terms")


def _code(spark: SparkSession, sf_dir: str) -> Index:
    return Index(repository.corpus(spark, sf_dir))


def rust_symbols(spark, sf_dir):
    return _code(spark, sf_dir).symbols


def rust_failures(spark, sf_dir):
    return _code(spark, sf_dir).parse_failures.select("doc_id", "path")


def symbol_lookup(spark, sf_dir):
    found = symbols.lookup(_code(spark, sf_dir), NAME)
    a = found.definitions.select(F.lit("definition").alias("role"), "relative_path", "line", "kind", "snippet")
    return a.union(found.references.select(F.lit("reference"), "relative_path", "line", F.lit(None).cast("string"), "snippet"))


def symbol_boost(spark, sf_dir):
    found = search.ranked(_code(spark, sf_dir), f"{NAME} weigh", digits=6)
    return found.select("relative_path", "exact_symbol", "file_name", "path", "category_boost")


def related_symbols(spark, sf_dir):
    """Files related to a Rust file, by its symbols too."""
    return _flat(related.related(_code(spark, sf_dir), "src/unit_8.rs", digits=6), "symbols", "file_terms", "shared_terms")


def audit_findings(spark, sf_dir):
    index = _code(spark, sf_dir)
    found = audit.unresolved(index, audit.references(index), ["index", "search"], ["--limit", "--help"])
    return found.join(index.corpus, "doc_id").select("relative_path", "line", "kind", "value", "confidence", "reason")


def audit_high(spark, sf_dir):
    return audit.at_least(audit_findings(spark, sf_dir), "high")


def audit_counts(spark, sf_dir):
    index = _code(spark, sf_dir)
    return audit.counters(index, audit.references(index))


def stale_paths(spark, sf_dir):
    """Paths derived from the documents themselves, half of them to files that aren't there, through the audit's joins."""
    index = _index(spark, sf_dir)
    odd = F.concat(F.lit("../"), F.expr("array('src','tests','docs')[doc_id % 3]"), F.lit("/src"), F.col("doc_id") % 20, F.lit("/doc_"), F.col("doc_id"), F.lit(".md"))
    refs = index.corpus.select("doc_id", F.lit(1).alias("line"), F.lit("Path").alias("kind"), odd.alias("value"))
    modules = index.corpus.select("doc_id", F.lit(2).alias("line"), F.lit("Module").alias("kind"), F.concat(F.lit("a::doc_"), F.col("doc_id")).alias("value"))
    return audit.unresolved(index, refs.union(modules), [], []).select("doc_id", "kind", "value", "confidence")


def project_overview(spark, sf_dir):
    one = overview.overview(_code(spark, sf_dir))
    return _flat(one, *overview.LISTS, "workflow")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokens, identifiers, doc_lengths, postings, term_df, corpus_stats, category_counts, index_summary, top_terms, exact_term, path_parts, normalized_paths, classify,
        search_any, search_all, search_repeated, search_compound, search_filtered, search_top10, search_by_role, search_none, likely_references, related_files, related_top,
        rust_symbols, rust_failures, symbol_lookup, symbol_boost, related_symbols, audit_findings, audit_high, audit_counts, stale_paths, project_overview,
    )
}

# SQL. RE2 has no look-around, so camel cases are cut by putting a mark between the letters of a boundary.
_CLASS = r"[\p{L}\p{N}_-]+"


def _tokens(source: str) -> str:
    """Common tables from a relation docs(doc_id, content) to tk(doc_id, position, line, term)."""
    cut = r"regexp_replace(regexp_replace(regexp_replace(s, '[_-]', chr(1), 'g'), '(\p{Ll})(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1' || chr(1) || '\2', 'g')"
    return rf"""docs AS ({source}),
ln AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM docs),
rt AS (SELECT doc_id, line, unnest(regexp_extract_all(l, '{_CLASS}')) AS t, generate_subscripts(regexp_extract_all(l, '{_CLASS}'), 1) AS k FROM ln),
sp AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) - 1 AS position, trim(t, '_-') AS s FROM rt WHERE trim(t, '_-') <> ''),
tk AS (SELECT doc_id, position::INTEGER AS position, line::INTEGER AS line, unnest(list_distinct(list_concat([lower(s)], list_filter(list_transform(string_split({cut}, chr(1)), lambda x: lower(x)), lambda x: x <> '')))) AS term FROM sp)"""


_PATH = "(['src','tests','docs','examples','config',lang])[1 + doc_id % 6] || '/' || source || '/doc_' || doc_id || '.' || (['rs','md','txt','toml','json'])[1 + doc_id % 5]"
_DOCS = f"SELECT doc_id, {_PATH} AS relative_path, text AS content FROM documents"
_CATEGORY = """CASE WHEN doc_id % 6 = 1 THEN 'Test' WHEN doc_id % 6 = 3 THEN 'Example' ELSE (['SourceCode', 'Documentation', 'Documentation', 'Configuration', 'Configuration'])[1 + doc_id % 5] END"""
_TK = _tokens(_DOCS)
_FR = f"{_TK}, fr AS (SELECT term, doc_id, count(*) AS tf, min(line) AS first_line FROM tk GROUP BY term, doc_id)"
_LEN = "len AS (SELECT d.doc_id, d.relative_path, d.content, " + _CATEGORY.replace("doc_id", "d.doc_id") + " AS category, coalesce(n, 0)::BIGINT AS token_count FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM sp GROUP BY doc_id) USING (doc_id))"
_PRIOR = "CASE category WHEN 'SourceCode' THEN 0.30 WHEN 'Documentation' THEN 0.25 WHEN 'Configuration' THEN 0.20 WHEN 'Test' THEN 0.15 WHEN 'Example' THEN 0.10 ELSE 0.0 END"


def _values(rows: list[tuple], names: str) -> str:
    show = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({names})"


def _search(groups: list[list[str]], every: bool = False, where: str = "TRUE", limit: int | None = None) -> str:
    """groups: the distinct terms of each token of the query."""
    wanted = ", ".join(f"'{t}'" for t in sorted({t for g in groups for t in g})) or "NULL"
    g = _values([(i, t) for i, terms in enumerate(groups) for t in terms], "g, term")
    meta = lambda path: " + ".join(f"(len(list_intersect({path}, [{', '.join(repr(t) for t in terms)}])) > 0)::INTEGER" for terms in groups)
    stem = "['doc_' || doc_id, 'doc', doc_id::VARCHAR]"
    folder = "string_split(relative_path, '/')[1:2]"
    return f"""WITH {_FR}, {_LEN}, q AS ({g}), df AS (SELECT term, count(*) AS df FROM fr WHERE term IN ({wanted}) GROUP BY term),
st AS (SELECT count(*) AS n, avg(token_count) AS a FROM len),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * token_count / a))) AS bm25, string_agg(term, ',' ORDER BY term) AS matched_terms, min(first_line) AS line
  FROM fr JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY doc_id),
gr AS (SELECT doc_id, count(DISTINCT g) AS groups FROM fr JOIN q USING (term) GROUP BY doc_id),
f AS (SELECT doc_id, relative_path, category, line, bm25, 2.0 * ({meta(stem)}) AS file_name, 1.0 * ({meta(folder)}) AS path, matched_terms, content,
  {_PRIOR} AS category_boost FROM bm JOIN gr USING (doc_id) JOIN len USING (doc_id) WHERE {f'groups = {len(groups)}' if every else 'TRUE'}),
s AS (SELECT *, round(bm25 + file_name + path + category_boost, 6) AS score FROM f WHERE {where}),
r AS (SELECT row_number() OVER (ORDER BY score DESC, string_split(relative_path, '/')) AS rank, doc_id, relative_path, category, line::BIGINT AS line, score, round(bm25, 6) AS bm25,
  file_name::DOUBLE AS file_name, path::DOUBLE AS path, 0.0::DOUBLE AS exact_symbol, category_boost::DOUBLE AS category_boost, matched_terms, trim(string_split(content, chr(10))[line]) AS snippet FROM s)
SELECT * FROM r {f'WHERE rank <= {limit}' if limit else ''}"""


_G = [["the"], ["inhe"]]


def _related(limit: int | None = None) -> str:
    src = 8
    return f"""WITH {_FR}, me AS (SELECT DISTINCT term FROM fr WHERE doc_id = {src}),
n AS (SELECT count(*) AS n FROM docs), w AS (SELECT term, ln(1 + n / df) AS w FROM (SELECT term, count(*) AS df FROM fr WHERE term IN (SELECT term FROM me) GROUP BY term), n WHERE df BETWEEN 2 AND 6 AND length(term) >= 3),
sh AS (SELECT doc_id, term, w, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS k FROM fr JOIN w USING (term) WHERE doc_id <> {src}),
s AS (SELECT doc_id, string_agg(term, ',' ORDER BY k) AS shared_terms, sum(w) AS w, count(*) AS n_shared FROM sh WHERE k <= 5 GROUP BY doc_id),
ft AS (SELECT doc_id, string_agg(term, ',' ORDER BY term) AS file_terms, count(*) AS n_file FROM fr WHERE doc_id <> {src} AND term IN ('doc_{src}', 'doc', '{src}') GROUP BY doc_id),
m AS (SELECT doc_id, coalesce(file_terms, '') AS file_terms, coalesce(shared_terms, '') AS shared_terms, coalesce(n_file, 0) AS f, coalesce(n_shared, 0) AS t, coalesce(w, 0) AS w FROM s FULL JOIN ft USING (doc_id)),
x AS (SELECT doc_id, relative_path, {_CATEGORY} AS category, file_terms, shared_terms, f, t, w FROM m JOIN docs USING (doc_id) WHERE f > 0 OR t >= 2),
y AS (SELECT doc_id, relative_path, category, round(f * 2.0 + w + CASE category WHEN 'Test' THEN 1.5 WHEN 'Documentation' THEN 1.25 WHEN 'Configuration' THEN 1.0 WHEN 'Example' THEN 0.75 WHEN 'SourceCode' THEN 0.5 ELSE 0 END, 6) AS score,
  CASE WHEN f > 0 OR t >= 3 THEN 'Medium' ELSE 'Low' END AS confidence, '' AS symbols, file_terms, shared_terms FROM x)
SELECT * FROM y {f"ORDER BY score DESC, string_split(relative_path, '/') LIMIT {limit}" if limit else ''}"""


_IDENTIFIERS = _tokens(
    "SELECT p_partkey AS doc_id, replace(p_name, ' ', '_') || ' ' || list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '')"
    " || ' HTTP' || list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '-') || ' __x2y_ -' AS content FROM part"
)

ORACLE_SQL: dict[str, str] = {
    "tokens": f"WITH {_TK} SELECT doc_id, term, position, line FROM tk",
    "identifiers": f"WITH {_IDENTIFIERS} SELECT doc_id, term, position, line FROM tk",
    "doc_lengths": f"WITH {_TK}, {_LEN} SELECT doc_id, relative_path, category, token_count FROM len",
    "postings": f"WITH {_TK} SELECT term, doc_id, count(*) AS tf, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions, string_agg(line::VARCHAR, ',' ORDER BY position) AS lines, min(line) AS first_line FROM tk GROUP BY term, doc_id",
    "term_df": f"WITH {_FR} SELECT term, count(*) AS df FROM fr GROUP BY term",
    "corpus_stats": f"WITH {_TK}, {_LEN} SELECT count(*) AS n_docs, sum(token_count)::BIGINT AS total_tokens, round(avg(token_count), 6) AS avg_len FROM len",
    "category_counts": f"WITH k AS ({_values([(i, c, n) for i, (c, n) in enumerate(zip(CATEGORIES, LABELS, strict=True))], 'ordinal, category, label')}), c AS (SELECT {_CATEGORY} AS category, count(*) AS files FROM documents GROUP BY 1) SELECT ordinal, category, label, coalesce(files, 0)::BIGINT AS files FROM k LEFT JOIN c USING (category)",
    "index_summary": f"WITH {_FR}, {_LEN} SELECT (SELECT count(*) FROM docs) AS files, 0::BIGINT AS symbols, (SELECT count(DISTINCT term) FROM fr) AS unique_terms, (SELECT count(*) FROM fr) AS posting_entries, (SELECT sum(token_count)::BIGINT FROM len) AS tokens, (SELECT round(avg(token_count), 6) FROM len) AS avg_len",
    "top_terms": f"WITH {_FR} SELECT term, count(*) AS df FROM fr GROUP BY term ORDER BY df DESC, term LIMIT 50",
    "exact_term": f"WITH {_TK} SELECT term, doc_id, count(*) AS tf, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions, string_agg(line::VARCHAR, ',' ORDER BY position) AS lines, min(line) AS first_line FROM tk WHERE term = 'inhe' GROUP BY term, doc_id",
    "path_parts": f"WITH docs AS ({_DOCS}) SELECT doc_id, string_split(relative_path, '/')[3] AS file_name, 'doc_' || doc_id AS stem, (['rs','md','txt','toml','json'])[1 + doc_id % 5] AS extension, list_aggregate(string_split(relative_path, '/')[1:2], 'string_agg', '/') AS parent, 'doc_' || doc_id || ',doc,' || doc_id AS stem_terms FROM docs",
    "normalized_paths": "WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '' AND x <> '.') AS s FROM pages) SELECT page_id, list_aggregate(list_concat(['docs'], s[1:len(s) - 1], ['end.md']), 'string_agg', '/') AS path FROM p",
    "classify": f"SELECT doc_id, replace(list_extract([{', '.join(repr(p) for p, _ in ADDRESSES)}], (doc_id % {len(ADDRESSES)} + 1)::INTEGER), '#', coalesce(source, 'none')) AS path,"
    f" list_extract([{', '.join(repr(c) for _, c in ADDRESSES)}], (doc_id % {len(ADDRESSES)} + 1)::INTEGER) AS category FROM documents",
    "search_any": _search(_G),
    "search_all": _search(_G, every=True),
    "search_repeated": _search([["inhe"], ["src3"], ["src3"], ["the"], ["inhe"]]),
    "search_compound": _search([["ation", "thing", "thing-ation"], ["of", "of_the", "the"]], every=True),
    "search_filtered": _search(_G, where="category IN ('Documentation', 'Test') AND contains(lower(relative_path), 'src1') AND regexp_matches(relative_path, '[.](md|txt)$')", limit=25),
    "search_top10": _search(_G, limit=10),
    "search_by_role": f"SELECT category, count(*) AS results, min(rank) AS best_rank FROM ({_search(_G)}) GROUP BY category",
    "search_none": f"SELECT * FROM ({_search(_G, limit=1)}) WHERE FALSE",
    "likely_references": f"WITH {_TK}, l AS (SELECT DISTINCT doc_id, line FROM tk WHERE term = 'inhe') SELECT doc_id, line, trim(string_split(content, chr(10))[line]) AS snippet FROM l JOIN docs USING (doc_id) WHERE (doc_id, line) NOT IN (SELECT (doc_id, min(line)) FROM l GROUP BY doc_id)",
    "related_files": _related(),
    "related_top": _related(5),
    "rust_symbols": repository.SYMBOLS,
    "rust_failures": repository.FAILURES,
    "symbol_lookup": repository.lookup_sql(NAME),
    "symbol_boost": repository.boost_sql(NAME),
    "related_symbols": repository.related_sql(_tokens(repository.sql()), 8),
    "audit_findings": repository.findings_sql(FINDINGS),
    "audit_high": repository.findings_sql(FINDINGS, ("High",)),
    "audit_counts": repository.COUNTS,
    "stale_paths": f"""WITH docs AS ({_DOCS}), v AS (SELECT doc_id, relative_path, '../' || (['src','tests','docs'])[1 + doc_id % 3] || '/src' || doc_id % 20 || '/doc_' || doc_id || '.md' AS value FROM docs),
p AS (SELECT doc_id, 'Path' AS kind, value, 'High' AS confidence, value[4:] AS root, string_split(relative_path, '/')[1] || '/' || value[4:] AS here FROM v)
SELECT doc_id, kind, value, confidence FROM p WHERE root NOT IN (SELECT relative_path FROM docs) AND here NOT IN (SELECT relative_path FROM docs)
UNION ALL SELECT doc_id, 'Module', 'a::doc_' || doc_id, 'Medium' FROM docs WHERE doc_id % 5 <> 0""",
    "project_overview": repository.OVERVIEW,
}
