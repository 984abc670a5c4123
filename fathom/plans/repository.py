"""A code repository made of the part table, for the queries that read source code, and the SQL of what they find.

Each part gives a Rust file, a page of documentation, and two configuration
files, whose texts are put together from its columns by expressions that Spark
and DuckDB read alike. A seventh of the Rust files can't be parsed, a fifth has
tests of its own; the pages name things that are there and things that aren't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = "CAST(p_partkey AS STRING)"
BRAND, ADJECTIVE, NOUN, SIZE = "replace(p_brand, '#', '')", "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)", "CAST(p_size AS STRING)"
NL = "chr(10)"
#: Line by line, as in the file.
IMPLEMENTATION = f"'impl ' || {BRAND} || ' {{ pub fn weigh_' || {K} || '(&self) -> u32 {{ SIZE_' || {K} || ' }} }}'"
ALIAS = f"'type Alias_' || {K} || ' = ' || {BRAND} || ';'"
FIRST = f"'Unit `' || {BRAND} || '` lies in [`src/unit_' || {K} || '.rs`](../src/unit_' || {K} || '.rs), module `units::' || {BRAND} || '`.'"
KEY = f"CASE WHEN p_partkey % 2 = 0 THEN {ADJECTIVE} || '_' || {NOUN} ELSE {NOUN} || '_' || {ADJECTIVE} END"
RUST = (
    f"CASE WHEN p_partkey % 7 = 0 THEN 'fn broken_' || {K} || '( {{' || {NL} ELSE 'use crate::units;' || {NL} || 'pub struct ' || {BRAND} || ';' || {NL} || {IMPLEMENTATION} || {NL}"
    f" || 'pub(crate) const SIZE_' || {K} || ': u32 = ' || {SIZE} || ';' || {NL} || {ALIAS} || {NL} || CASE WHEN p_partkey % 5 = 0 THEN '#[cfg(test)] mod tests {{}}' || {NL} ELSE '' END END"
).replace("{{", "{").replace("}}", "}")
IMPLEMENTATION = IMPLEMENTATION.replace("{{", "{").replace("}}", "}")
PAGE = (
    f"{FIRST} || {NL} || {NL} || 'Missing: `src/gone_' || {K} || '.rs`, `lost_' || {K} || '()`, `fathom drop_' || {K} || '`, `--flag-' || {K} || '`, `' || {KEY} || ' = 1`, `units::gone_' || {K} || '`.'"
    f" || {NL} || {NL} || 'Planned: `src/later_' || {K} || '.rs`.' || {NL}"
)
TOML = f"CASE WHEN p_partkey % 50 = 0 THEN {ADJECTIVE} || '_' || {NOUN} ELSE 'size_key' END || ' = ' || {SIZE} || {NL}"
JSON = f"'{{\"wrap_key\": [{{\"' || CASE WHEN p_partkey % 3 = 0 THEN {NOUN} || '_' || {ADJECTIVE} ELSE 'other_key' END || '\": ' || {SIZE} || '}}]}}'".replace("{{", "{").replace("}}", "}")
#: Parts whose files are made in one task.
ROWS = 10_000
FILES = [("src", "rs", RUST), ("docs", "md", PAGE), ("config", "toml", TOML), ("config", "json", JSON)]
FIXED = [(-2, "Cargo.toml", '[package]\nname = "units"\n'), (-1, "src/main.rs", "use crate::unit_1;\nuse crate::{unit_2, unit_3};\nfn main() {}\n")]


def spread(parts: DataFrame) -> DataFrame:
    """The rows over tasks of ROWS parts at most: the table is small against the files made of it, so that one split of it would be the work of one task."""
    n = max(parts.sparkSession.sparkContext.defaultParallelism, -(-parts.count() // ROWS))
    return parts.repartition(n, "p_partkey")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, relative_path, content)"""
    pieces = {"key": K, "brand": BRAND, "adjective": ADJECTIVE, "noun": NOUN, "size": SIZE}
    parts = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *(F.expr(e).alias(n) for n, e in pieces.items())))
    path, content = "CASE j", "CASE j"
    for j, (folder, ext, text) in enumerate(FILES):
        for n, e in pieces.items():
            text = text.replace(e, n)
        path += f" WHEN {j} THEN '{folder}/unit_' || key || '.{ext}'"
        content += f" WHEN {j} THEN {text}"
    # A row per file before its text is made, so that a text which nobody reads, or which a filter drops, is not put together.
    files = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(FILES) - 1))).alias("j"))
    made = files.select(F.expr(f"{len(FILES)} * p_partkey + j").alias("doc_id"), F.expr(f"{path} END").alias("relative_path"), F.expr(f"{content} END").alias("content"))
    return made.union(spark.createDataFrame(FIXED, "doc_id long, relative_path string, content string"))


def sql() -> str:
    """The same relation as a DuckDB query."""
    made = [f"SELECT 4 * p_partkey + {j} AS doc_id, '{folder}/unit_' || {K} || '.{ext}' AS relative_path, {text} AS content FROM part" for j, (folder, ext, text) in enumerate(FILES)]
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    fixed = [f"SELECT {d}, {quoted(p)}, " + f" || {NL} || ".join(quoted(x) for x in c.split("\n")) for d, p, c in FIXED]
    return " UNION ALL ".join(made + fixed)


_RS = f"4 * p_partkey AS doc_id, 'src/unit_' || {K} || '.rs' AS path"
_KNOWN = f"{BRAND} IN (SELECT {BRAND} FROM part WHERE p_partkey % 7 <> 0)"
_KEYS = f"SELECT 'size_key' UNION ALL SELECT {ADJECTIVE} || '_' || {NOUN} FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT {NOUN} || '_' || {ADJECTIVE} FROM part WHERE p_partkey % 3 = 0"


def _symbol(line: int, kind: str, name: str, visibility: str, parent: str = "NULL", where: str = "TRUE") -> str:
    return f"SELECT 4 * p_partkey AS doc_id, {line} AS line, '{kind}' AS kind, {name} AS name, '{visibility}' AS visibility, {parent} AS parent FROM part WHERE p_partkey % 7 <> 0 AND {where}"


SYMBOLS = " UNION ALL ".join([
    _symbol(2, "Struct", BRAND, "Public"), _symbol(3, "Implementation", BRAND, "Private"), _symbol(3, "Function", f"'weigh_' || {K}", "Public", BRAND),
    _symbol(4, "Constant", f"'SIZE_' || {K}", "Crate"), _symbol(5, "TypeAlias", f"'Alias_' || {K}", "Private"), _symbol(6, "Module", "'tests'", "Private", where="p_partkey % 5 = 0"),
    "SELECT -1, 3, 'Function', 'main', 'Private', NULL",
])
FAILURES = f"SELECT {_RS} FROM part WHERE p_partkey % 7 = 0"


def lookup_sql(name: str) -> str:
    mine, rs, md = f"{BRAND} = '{name}'", f"'src/unit_' || {K} || '.rs'", f"'docs/unit_' || {K} || '.md'"
    return f"""SELECT 'definition' AS role, {rs} AS relative_path, 2 AS line, 'Struct' AS kind, 'pub struct {name};' AS snippet FROM part WHERE {mine} AND p_partkey % 7 <> 0
UNION ALL SELECT 'definition', {rs}, 3, 'Implementation', {IMPLEMENTATION} FROM part WHERE {mine} AND p_partkey % 7 <> 0
UNION ALL SELECT 'reference', {rs}, 5, NULL, {ALIAS} FROM part WHERE {mine} AND p_partkey % 7 <> 0
UNION ALL SELECT 'reference', {md}, 1, NULL, {FIRST} FROM part WHERE {mine}"""


def boost_sql(name: str) -> str:
    return f"""SELECT 'src/unit_' || {K} || '.rs' AS relative_path, CASE WHEN {BRAND} = '{name}' THEN 4.0 ELSE 0.0 END::DOUBLE AS exact_symbol, 0.0::DOUBLE AS file_name, 0.0::DOUBLE AS path, 0.3::DOUBLE AS category_boost FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT 'docs/unit_' || {K} || '.md', 0.0, 0.0, 0.0, 0.25 FROM part WHERE {BRAND} = '{name}'"""


def findings_sql(reasons: dict[str, tuple[str, str]], least: tuple[str, ...] = ("High", "Medium", "Low")) -> str:
    def one(kind: str, value: str, where: str = "TRUE", line: int = 3) -> str:
        confidence, reason = reasons[kind]
        return f"SELECT 'docs/unit_' || {K} || '.md' AS relative_path, {line} AS line, '{kind}' AS kind, {value} AS value, '{confidence}' AS confidence, '{reason}' AS reason FROM part WHERE {where}"

    found = [
        one("Path", f"'src/gone_' || {K} || '.rs'"), one("Symbol", f"'lost_' || {K}"), one("Command", f"'drop_' || {K}"), one("Option", f"'--flag-' || {K}"),
        one("ConfigurationKey", KEY, f"({KEY}) NOT IN ({_KEYS})"), one("Module", f"'units::gone_' || {K}"), one("Module", f"'units::' || {BRAND}", f"NOT {_KNOWN}", 1),
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(found)}) WHERE confidence IN ({', '.join(repr(x) for x in least)})"


COUNTS = f"SELECT count(*) AS documents_checked, sum(9 + CASE WHEN {_KNOWN} THEN 1 ELSE 0 END)::BIGINT AS references_checked FROM part"
OVERVIEW = f"""SELECT 'RustCli' AS project_kind, 'units' AS package_name, 'src/main.rs' AS entry_points,
(SELECT string_agg('src/unit_' || {K} || '.rs', ',' ORDER BY 'src/unit_' || {K} || '.rs') FROM part) AS core_modules,
'Cargo.toml,' || (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT 'config/unit_' || {K} || '.toml' AS p FROM part UNION ALL SELECT 'config/unit_' || {K} || '.json' FROM part)) AS configuration,
(SELECT string_agg('src/unit_' || {K} || '.rs', ',' ORDER BY 'src/unit_' || {K} || '.rs') FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 7 <> 0) AS tests,
'' AS examples, 'main,unit_1,unit_2,unit_3' AS workflow, NULL AS manifest_error"""


def related_sql(tokens: str, key: int) -> str:
    """Files related to the Rust file of that part; tokens: common tables that end with tk(doc_id, position, line, term)."""
    me = 4 * key
    return f"""WITH {tokens}, fr AS (SELECT DISTINCT term, doc_id FROM tk), me AS (SELECT term FROM fr WHERE doc_id = {me}), n AS (SELECT count(*) AS n FROM docs),
w AS (SELECT term, ln(1 + n / df) AS w FROM (SELECT term, count(*) AS df FROM fr WHERE term IN (SELECT term FROM me) GROUP BY term), n WHERE df BETWEEN 2 AND 6 AND length(term) >= 3),
sh AS (SELECT doc_id, term, w, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS k FROM fr JOIN w USING (term) WHERE doc_id <> {me}),
s AS (SELECT doc_id, string_agg(term, ',' ORDER BY k) AS shared_terms, sum(w) AS w, count(*) AS t FROM sh WHERE k <= 5 GROUP BY doc_id),
ft AS (SELECT doc_id, string_agg(term, ',' ORDER BY term) AS file_terms, count(*) AS f FROM fr WHERE doc_id <> {me} AND term IN ('unit_{key}', 'unit', '{key}') GROUP BY doc_id),
names AS (SELECT DISTINCT lower(name) AS term, name FROM ({SYMBOLS}) WHERE doc_id = {me} AND visibility <> 'Private'),
sy AS (SELECT doc_id, string_agg(name, ',' ORDER BY term) AS symbols, count(*) AS y FROM fr JOIN names USING (term) WHERE doc_id <> {me} GROUP BY doc_id),
m AS (SELECT doc_id, coalesce(symbols, '') AS symbols, coalesce(file_terms, '') AS file_terms, coalesce(shared_terms, '') AS shared_terms, coalesce(y, 0) AS y, coalesce(f, 0) AS f, coalesce(t, 0) AS t, coalesce(w, 0) AS w
  FROM sy FULL JOIN ft USING (doc_id) FULL JOIN s USING (doc_id)),
c AS (SELECT m.*, relative_path, CASE WHEN relative_path = 'Cargo.toml' THEN 'ProjectMetadata' WHEN starts_with(relative_path, 'src/') THEN 'SourceCode' WHEN starts_with(relative_path, 'docs/') THEN 'Documentation' ELSE 'Configuration' END AS category FROM m JOIN docs USING (doc_id))
SELECT doc_id, relative_path, category, round(5.0 * y + 2.0 * f + w + CASE category WHEN 'Documentation' THEN 1.25 WHEN 'Configuration' THEN 1.0 WHEN 'SourceCode' THEN 0.5 ELSE 0.25 END, 6) AS score,
  CASE WHEN y > 0 AND (f > 0 OR t >= 2) THEN 'High' WHEN y > 0 OR f > 0 OR t >= 3 THEN 'Medium' ELSE 'Low' END AS confidence, symbols, file_terms, shared_terms FROM c WHERE y > 0 OR f > 0 OR t >= 2"""
