"""Column builders over relative paths with `/`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CATEGORIES


def parts(path: Column) -> Column:
    return F.split(path, "/", -1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Null without one; names that begin with their only dot have none."""
    found = F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(file_name(path).rlike(r"^.+\.[^.]*$"), found)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    """All but the last part; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def normalized(path: Column) -> Column:
    """Backslashes as slashes, without `.` and empty parts, `..` taking back the part before it."""
    step = lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    walked = F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(r"(^|/)\.{0,2}(/|$)"), walked).otherwise(path)


def order(path: Column) -> Column:
    """A sort key by components: `src/a` comes before `src-x`."""
    return parts(path)


def _beneath(path: Column, folder: str) -> Column:
    return F.contains(F.concat(F.lit("/"), F.lower(path)), F.lit(f"/{folder}/"))


def category(path: Column) -> Column:
    """The role of a file by its path alone; the first rule that fits wins."""
    name, ext = F.lower(file_name(path)), F.lower(extension(path))
    return (
        F.when(_beneath(path, "tests") | F.lower(stem(path)).rlike(r"(_tests?|\.test|\.spec)$"), "Test")
        .when(_beneath(path, "examples"), "Example")
        .when(name.isin("cargo.toml", "package.json", "rust-toolchain.toml"), "ProjectMetadata")
        .when(ext == "rs", "SourceCode")
        .when(ext.isin("md", "txt"), "Documentation")
        .when(ext.isin("toml", "json", "yaml", "yml"), "Configuration")
        .otherwise("Unknown")
    )


def ordinal(value: Column, names: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), value).cast("int") - 1


def category_value(value: Column, numbers: list[float]) -> Column:
    return F.get(F.array(*map(F.lit, numbers)), ordinal(value, CATEGORIES))
