"""Rust symbols: extraction by a parser on Arrow batches, lookup by joins."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schema import SYMBOL_KINDS

if TYPE_CHECKING:
    from .index import Index

SCHEMA = "doc_id long, line int, kind string, name string, visibility string, parent string, failure string"


def extract_symbols(corpus: DataFrame, failures: bool = True) -> DataFrame:
    """A row per symbol of each Rust file, or one with the failure of a file that can't be read. Without failures, files sure to fail may be passed over unread."""

    def run(batches):
        import pyarrow as pa

        from ..functions.rust import ParseError, hopeless, parse

        names = ["doc_id", "line", "kind", "name", "visibility", "parent", "failure"]
        kinds = [pa.int64(), pa.int32(), *[pa.string()] * 5]
        for b in batches:
            rows = []
            for doc, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                if not failures and hopeless(content or ""):
                    continue
                try:
                    rows += [(doc, *s, None) for s in parse(content or "").symbols]
                except (ParseError, RecursionError) as e:
                    rows.append((doc, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

    rust = corpus.where(F.lower(paths.extension(F.col("relative_path"))) == "rs").select("doc_id", "content")
    return rust.mapInArrow(run, SCHEMA)


@dataclass
class Lookup:
    definitions: DataFrame
    references: DataFrame


def lookup(index: Index, name: str) -> Lookup:
    """Definitions of exactly that name, and the lines that likely refer to it; without definitions there are no references.

    definitions: (doc_id, relative_path, line, kind, visibility, parent, snippet); references: (doc_id, relative_path, line, snippet).
    """
    docs = index.corpus.select("doc_id", "relative_path", "content")
    # A file that defines the name holds it, unless it is the stand-in of a type without one.
    held = F.contains(F.col("content"), F.lit(name)) if name != "<anonymous>" else F.lit(True)
    found = index.symbols_where(held).where(F.col("name") == name)
    defining = docs if name == "<anonymous>" else docs.where(held)
    shown = text.snippet(F.col("content"), F.col("line"))
    kind = paths.ordinal(F.col("kind"), SYMBOL_KINDS)
    definitions = found.join(defining, "doc_id").select("doc_id", "relative_path", "line", "kind", "visibility", "parent", shown.alias("snippet")).orderBy("doc_id", "line", kind)
    term = index.spark.createDataFrame([(name,)], "q string").select(F.lower(F.get(text.words(F.col("q")), 0)).alias("s")).first().s
    lines = index.lines_of(term).distinct()
    any_definition = found.select(F.lit(1).alias("one")).limit(1)
    others = lines.join(found.select("doc_id", "line"), ["doc_id", "line"], "left_anti").withColumn("one", F.lit(1)).join(F.broadcast(any_definition), "one", "left_semi")
    texts = docs.where(text.may_have(F.col("content"), [term] if term else []))
    references = others.join(texts, "doc_id").select("doc_id", "relative_path", "line", shown.alias("snippet")).orderBy("doc_id", "line")
    return Lookup(definitions, references)
