import math

import pytest

from fathom.functions.markdown import events
from fathom.functions.rust import ParseError, parse
from fathom.operators import audit, overview, related, symbols
from fathom.operators.index import Index
from fathom.sources.corpus import from_rows


def test_rust_items():
    source = "pub mod tide {\n    pub(crate) static LEVEL: i8 = -3;\n    pub enum Moon { New, Full }\n}\nimpl tide::Moon { fn pull(self) {} }\nconst DAYS: u8 = 28;\npub fn main() {}\n"
    assert parse(source).symbols == [
        (1, "Module", "tide", "Public", None), (2, "Static", "LEVEL", "Crate", "tide"), (3, "Enum", "Moon", "Public", "tide"), (5, "Implementation", "Moon", "Private", None),
        (5, "Function", "pull", "Private", "Moon"), (6, "Constant", "DAYS", "Private", None), (7, "Function", "main", "Public", None),
    ]


def test_rust_corners():
    source = """#![allow(x)]
//! doc { ( [
/* nested /* comment */ " */
pub(super) const fn f<'a, const N: usize>(x: &'a str, g: fn(u8) -> u8) -> impl Fn() + 'a where [(); N]: { fn inner() { struct Deep; } let c = '{'; let s = r#"}"#; || x; }
impl<T: Fn(u8)> other::Trait<T> for some::Kind<T> where T: Copy { const A: usize = 1; type B = u8; async fn g(self) {} }
impl [u8] { fn h() {} }
extern "C" { fn foreign(); static X: u8; }
static mut COUNT: u8 = b'\\'';
thread_local! { fn hidden() {} }
union U { a: u8 }
pub unsafe trait T: Sized { fn k(); }
macro_rules! m { ($x:expr) => { struct No; } }
pub(in crate::a) type R = *const u8;
"""
    got = [s[1:] for s in parse(source).symbols]
    assert got == [
        ("Function", "f", "Restricted", None), ("Function", "inner", "Private", None), ("Struct", "Deep", "Private", None), ("Implementation", "Kind", "Private", None), ("Function", "g", "Private", "Kind"),
        ("Implementation", "<anonymous>", "Private", None), ("Function", "h", "Private", "<anonymous>"), ("Static", "COUNT", "Private", None), ("Trait", "T", "Public", None), ("Function", "k", "Private", "T"),
        ("Macro", "m", "Private", None), ("TypeAlias", "R", "Restricted", None),
    ]


@pytest.mark.parametrize("source", ["fn a( {", "let x = 1;", 'const A: &str = "open;', "Moon::rise();", "/* open", "}"])
def test_rust_failures(source):
    with pytest.raises(ParseError):
        parse(source)


@pytest.mark.parametrize("source, tests", [("#[cfg(test)] mod tests {}", True), ("#[tokio::test] async fn works() {}", True), ("#[cfg(all(test))] mod t {}", False), ("mod a { #[test] fn b() {} }", False)])
def test_own_tests(source, tests):
    assert parse(source).has_tests is tests


def test_uses():
    assert parse("use crate::{ebb, flow::{self, spring as s}};\nuse core::fmt;\npub(crate) use crate::ebb::Rate;\nuse crate::quay::*;\nmod m { use crate::deep; }").uses == ["ebb", "flow", "quay"]


def test_markdown_events():
    text = "# `head`\n\nSome ``a ` b`` and [x `in`](../p.rs \"t\") ![i](no.png)\n\n```sh\nrun --x\n```\n\n    indented\n\n- item `li`\n\n[ref]: docs/a.md\nsee [this][ref], [ref] and <http://a.b/c.d> \\`not\\`\n"
    got = list(events(text))
    assert ("code", 1, "head") in got and ("code", 3, "a ` b") in got and ("code", 3, "in") in got and ("link", 3, "../p.rs") in got
    assert ("block", 6, "run --x") in got and ("block", 9, "indented") in got and ("code", 11, "li") in got
    assert [e for e in got if e[0] == "link" and e[2] == "docs/a.md"] == [("link", 14, "docs/a.md")] * 2
    assert ("link", 14, "http://a.b/c.d") in got and not any("no.png" in e[2] or "not" == e[2] for e in got)


def test_lookup(spark):
    index = Index(from_rows(spark, [("notes.md", "Moon tables\n\nthe moon and Moon-Rise"), ("src/moon.rs", "pub trait Moon {}\nimpl Moon for u8 {}\npub fn phase(m: &dyn Moon) {}\nenum Sun { Moon }"), ("src/bad.rs", "Moon {")]))
    found = symbols.lookup(index, "Moon")
    assert [(r.doc_id, r.line, r.kind) for r in found.definitions.collect()] == [(1, 1, "Trait")]
    assert [(r.doc_id, r.line) for r in found.references.collect()] == [(0, 1), (0, 3), (1, 2), (1, 3), (1, 4), (2, 1)]
    none = symbols.lookup(index, "moon")
    assert none.definitions.count() == none.references.count() == 0
    assert index.parse_failures.first().path == "src/bad.rs"


def test_related(spark):
    index = Index(from_rows(spark, [
        ("src/tide.rs", "pub struct Gauge; pub fn new() {} fn hidden() {} // harbour basin"), ("docs/gauge.md", "A Gauge of the harbour"), ("tests/tide_check.rs", "fn t() { Gauge; }"),
        ("a.txt", "basin"), ("b.txt", "harbour basin"), ("c.txt", "new moon"),
    ]))
    got = {r.relative_path: r for r in related.ranked(index, "src//tide.rs").collect()}
    assert set(got) == {"docs/gauge.md", "tests/tide_check.rs", "b.txt"}  # one shared term is too little, generic and private symbols do not count
    assert got["docs/gauge.md"].symbols == ["Gauge"] and got["docs/gauge.md"].shared_terms == ["gauge", "harbour"] and got["docs/gauge.md"].confidence == "High"
    assert got["tests/tide_check.rs"].confidence == "Medium" and got["b.txt"].confidence == "Low"
    w = math.log(1 + 6 / 3)
    assert [round(r.score, 4) for r in got.values()] == [round(x, 4) for x in (5 + 2 * w + 1.25, 5 + w + 1.5, 2 * w + 1.25)]
    with pytest.raises(ValueError):
        related.ranked(index, "nowhere.rs")
    with pytest.raises(ValueError):
        related.ranked(index, "src/tide.rs", 0)


def audited(spark, rows, commands=("overview",), options=()):
    index = Index(from_rows(spark, rows))
    refs = audit.references(index, "tool")
    return index, refs, audit.in_order(audit.unresolved(index, refs, commands, options)).collect()


def test_audit(spark):
    index, refs, found = audited(spark, [
        ("guide/tides.md", "The `Gauge` of [the code](../src/tide.rs).\n\n- `sink()` is gone, as is `src/moon.rs`\n- `tool drain` and `tool overview`\n- `--deep`, `spring_tide = 3`, `neap_tide = 1`\n"),
        ("src/tide.rs", "pub struct Gauge;"), ("conf/a.json", '{"sea": [{"neap_tide": 2}]}'),
    ])
    assert tuple(audit.counters(index, refs).first()) == (1, 9)
    assert [(r.line, r.kind, r.value, r.confidence) for r in found] == [(3, "Path", "src/moon.rs", "High"), (3, "Symbol", "sink", "Medium"), (4, "Command", "drain", "High"), (5, "Option", "--deep", "High"), (5, "ConfigurationKey", "spring_tide", "Low")]


def test_audit_of_links_modules_and_ignored_lines(spark):
    rows = [
        ("guide/a.md", "`sea::moon` `sea::root` `sea::Gauge` `dist/x.rs` `http://x/y.rs`\n\ndeferred `src/no.rs` [l](src/gone.rs)\n\n```\ncargo run -- --bad stats\n```\n"),
        ("guide/notes.txt", "`src/never.rs`"), ("tests/x.md", "`src/never.rs`"), ("src/moon.rs", "pub struct Gauge;"), ("root.rs", "fn r() {}"),
    ]
    index, refs, found = audited(spark, rows, ["stats"], [])
    assert [(r.line, r.kind, r.value) for r in found] == [(1, "Module", "sea::root"), (3, "Path", "src/gone.rs"), (6, "Option", "--bad")]
    assert [r.kind for r in audit.in_order(audit.at_least(audit.unresolved(index, refs, [], []), "high")).collect()] == ["Path", "Option"]
    assert audit.counters(index, refs).first().documents_checked == 2


def summary(spark, *rows):
    return overview.overview(Index(from_rows(spark, list(rows)))).first()


def test_overview_of_a_cli(spark):
    got = summary(
        spark, ("src/tide.rs", "#[cfg(test)] mod tests {}"), ("examples/e.json", "{}"), ("src/main.rs", "use crate::tide;\nuse crate::moon::{rise, set};\nfn main() {}"), ("Cargo.toml", '[package]\nname = "almanac"'),
        ("tests/all.rs", "#[test] fn t() {}"), ("src/moon.rs", ""), ("set.yml", "a: 1"),
    )
    assert (got.project_kind, got.package_name, got.entry_points) == ("RustCli", "almanac", ["src/main.rs"])
    assert got.core_modules == ["src/moon.rs", "src/tide.rs"] and got.configuration == ["Cargo.toml", "set.yml"]
    assert got.tests == ["src/tide.rs", "tests/all.rs"] and got.examples == ["examples/e.json"]
    assert got.workflow == ["main", "tide", "moon"] and got.manifest_error is None


def test_overview_of_targets_workspaces_and_bad_manifests(spark):
    got = summary(spark, ("Cargo.toml", '[package]\nname = "c"\n[lib]\npath = "sea/all.rs"\n[[bin]]\npath = "tools/ebb.rs"\n[[bin]]\npath = "tools/none.rs"'), ("sea/all.rs", ""), ("tools/ebb.rs", "fn main() {}"))
    assert (got.project_kind, got.entry_points) == ("RustLibraryAndCli", ["sea/all.rs", "tools/ebb.rs"])
    got = summary(
        spark, ("Cargo.toml", '[workspace]\nmembers = ["parts/*"]'), ("parts/a/Cargo.toml", '[package]\nname = "a"'), ("parts/a/src/bin/x/y.rs", "fn main() {}"), ("parts/a/src/main.rs", "fn main() {}"),
        ("parts/b/Cargo.toml", '[lib]\npath = "sea/b.rs"'), ("parts/b/sea/b.rs", ""),
    )
    assert (got.project_kind, got.workflow) == ("RustWorkspace", ["main"])
    assert got.entry_points == ["parts/a/src/bin/x/y.rs", "parts/a/src/main.rs", "parts/b/sea/b.rs"]
    got = summary(spark, ("Cargo.toml", "= broken"), ("lib.rs", "fn a() {}"))
    assert got.project_kind == "RustRepository" and got.manifest_error
    got = summary(spark, ("a.md", "x"))
    assert (got.project_kind, got.entry_points, got.workflow) == ("Unknown", [], [])
