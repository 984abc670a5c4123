"""A project's summary: kind, package, entry points, modules by role, and likely workflow."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from .index import Index

LISTS = ["entry_points", "core_modules", "configuration", "tests", "examples"]


def _is_rust(path):
    return F.coalesce(F.lower(paths.extension(path)) == "rs", F.lit(False))


def manifests(index: Index) -> DataFrame:
    """(root, package, has_bin, has_lib, has_workspace, targets, error) of every Cargo.toml, by a TOML parser; root is its folder."""
    schema = "root string, package string, has_bin boolean, has_lib boolean, has_workspace boolean, targets array<string>, error string"

    def run(frames):
        import tomllib

        import pandas as pd

        names = [f.split(" ")[0] for f in schema.split(", ")]
        for pdf in frames:
            rows = []
            for path, content in zip(pdf.relative_path, pdf.content, strict=True):
                root = posixpath.dirname(path)
                try:
                    m = tomllib.loads(content or "")
                except tomllib.TOMLDecodeError as e:
                    rows.append((root, None, False, False, False, [], str(e)))
                    continue
                get = lambda x, k: x.get(k) if isinstance(x, dict) else None
                bins = m.get("bin") if isinstance(m.get("bin"), list) else []
                found = [get(m.get("lib"), "path"), *(get(b, "path") for b in bins)]
                name = get(m.get("package"), "name")
                rows.append((root, name if isinstance(name, str) else None, bool(bins), "lib" in m, "workspace" in m, [posixpath.join(root, p) for p in found if isinstance(p, str)], None))
            yield pd.DataFrame(rows, columns=names)

    return index.corpus.where(paths.file_name(F.col("relative_path")) == "Cargo.toml").select("relative_path", "content").mapInPandas(run, schema)


def rust_facts(index: Index, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, has_tests, uses) of Rust files, of those in docs if given: tests of their own, and the crate's modules they use; files that can't be read have neither."""

    def run(batches):
        import pyarrow as pa

        from ..functions.rust import ParseError, parse

        for b in batches:
            out = []
            for content in b.column("content").to_pylist():
                try:
                    p = parse(content or "")
                    out.append((p.has_tests, p.uses))
                except (ParseError, RecursionError):
                    out.append((False, []))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t for t, _ in out], pa.bool_()), pa.array([u for _, u in out], pa.list_(pa.string()))], names=["doc_id", "has_tests", "uses"])

    return (index.corpus if docs is None else docs).where(_is_rust(F.col("relative_path"))).select("doc_id", "content").mapInArrow(run, "doc_id long, has_tests boolean, uses array<string>")


def entry_points(index: Index) -> DataFrame:
    """(relative_path): default and declared targets that exist."""
    found = manifests(index)
    inside = lambda tail: F.when(F.col("root") == "", tail).otherwise(F.concat_ws("/", "root", F.lit(tail)))
    named = found.select(F.explode(F.concat(F.array(inside("src/main.rs"), inside("src/lib.rs")), "targets")).alias("relative_path"))
    files = index.corpus.select("relative_path")
    exact = files.join(named.distinct(), "relative_path", "left_semi")
    # Each file lies beneath as many folders as its path has parts, so the prefix join is an equi-join on these.
    folders = found.select(inside("src/bin").alias("folder")).distinct()
    up = files.where(_is_rust(F.col("relative_path"))).select("relative_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(paths.parts(F.col("relative_path")))), lambda n: F.array_join(F.slice(paths.parts(F.col("relative_path")), F.lit(1), n), "/"))).alias("folder"))
    return exact.union(up.join(folders, "folder", "left_semi").select("relative_path")).distinct()


def sections(index: Index) -> DataFrame:
    """(section, relative_path): the long form, a row per path and role."""
    docs = index.corpus.select("doc_id", "relative_path", "category")
    entry = entry_points(index)
    # A file has tests of its own only where the word stands.
    testing = index.corpus.where(F.contains("content", F.lit("test")))
    tested = docs.join(rust_facts(index, testing).where("has_tests").select("doc_id", F.lit(True).alias("t")), "doc_id", "left")
    parts = {
        "entry_points": entry,
        "core_modules": docs.where("category = 'SourceCode'").join(entry, "relative_path", "left_anti"),
        "configuration": docs.where(F.col("category").isin("Configuration", "ProjectMetadata")),
        "tests": tested.where("category = 'Test' or t"),
        "examples": docs.where("category = 'Example'"),
    }
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("section"), "relative_path")
        out = one if out is None else out.union(one)
    return out


def overview(index: Index) -> DataFrame:
    """One row: project_kind, package_name, the lists of sections(), workflow, manifest_error."""
    # In the order of paths.order, by plain strings: with the least character for / they sort as their parts do.
    by = lambda xs: F.transform(F.sort_array(xs), lambda p: F.replace(p, F.lit("\0"), F.lit("/")))
    lists = sections(index).groupBy().agg(*(by(F.collect_list(F.when(F.col("section") == s, F.replace("relative_path", F.lit("/"), F.lit("\0"))))).alias(s) for s in LISTS))
    root = manifests(index).where("root = ''")
    fact = root.agg(F.count(F.lit(1)).alias("n"), F.max("package").alias("package_name"), *(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("has_bin", "has_lib", "has_workspace")), F.max("error").alias("manifest_error"))
    rust = index.corpus.agg(F.coalesce(F.max(_is_rust(F.col("relative_path"))), F.lit(False)).alias("has_rust"))
    one = lists.crossJoin(F.broadcast(fact)).crossJoin(F.broadcast(rust))  # one row each
    first = F.coalesce(F.get(F.filter("entry_points", lambda p: (p == "src/main.rs") | p.endswith("/src/main.rs")), 0), F.get("entry_points", 0))
    entries = index.corpus.join(entry_points(index), "relative_path", "left_semi")  # the first file is one of these
    uses = rust_facts(index, entries).join(index.corpus.select("doc_id", F.col("relative_path").alias("first")), "doc_id").select("first", "uses")
    one = one.withColumn("first", first).join(uses, "first", "left")
    main = F.col("has_bin") | F.exists("entry_points", lambda p: (p == "src/main.rs") | p.startswith("src/bin/"))
    library = F.col("has_lib") | F.array_contains("entry_points", "src/lib.rs")
    read = (F.col("n") > 0) & F.col("manifest_error").isNull()
    kind = (
        F.when(F.col("has_workspace"), "RustWorkspace").when(main & library, "RustLibraryAndCli").when(main, "RustCli").when(library, "RustLibrary")
        .when(read, "RustPackage").when(F.col("has_rust"), "RustRepository").otherwise("Unknown")
    )
    none = F.array().cast(T.ArrayType(T.StringType()))
    steps = F.when(F.col("first").isNull(), none).otherwise(F.array_distinct(F.concat(F.array(paths.stem(F.col("first"))), F.coalesce("uses", none))))
    return one.select(kind.alias("project_kind"), "package_name", *LISTS, steps.alias("workflow"), "manifest_error")
