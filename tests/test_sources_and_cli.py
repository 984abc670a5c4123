import json
import os

import pytest

from fathom import cli, report
from fathom.operators.index import Index
from fathom.sources import directory, snapshot


@pytest.fixture
def repo(tmp_path):
    files = {
        "README.md": "Rust ownership", "Cargo.toml": '[package]\nname = "sample"\n', "src/main.rs": "fn build_search_index() {}", "src/data.JSON": '{"configuration": true}', "tests/scanner_tests.rs": "",
        "examples/basic.rs": "", "src/image.png": "x", "target/generated.rs": "fn no() {}", "vendor/deep/x.rs": "fn no() {}", "a b/odd[1].txt": "glob {name}", ".fathom.toml": 'exclude = [" vendor ", "", "target"]\n',
    }
    for name, body in files.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "src/bad.md").write_bytes(b"\xff\xfe")
    return str(tmp_path)


def test_directory(spark, repo, capsys):
    names = directory.exclusions(repo, [" generated ", " "])
    assert {"vendor", "generated"} <= set(names) and names.count("target") == 1 and "" not in names
    got = directory.read(spark, repo).orderBy("doc_id").collect()
    assert [r.relative_path for r in got] == [".fathom.toml", "Cargo.toml", "README.md", "a b/odd[1].txt", "examples/basic.rs", "src/data.JSON", "src/main.rs", "tests/scanner_tests.rs"]
    assert [r.doc_id for r in got] == list(range(8)) and got[3].content == "glob {name}"
    assert "src/bad.md" in capsys.readouterr().err
    assert Index(directory.read(spark, repo)).documents.where("relative_path = 'src/main.rs'").first().token_count == 2
    assert directory.read(spark, os.path.join(repo, "target")).count() == 0
    with pytest.raises(NotADirectoryError):
        directory.read(spark, repo + "/none")
    with open(repo + "/.fathom.toml", "w") as f:
        f.write("exclude = 3")
    with pytest.raises(ValueError):
        directory.exclusions(repo)


def test_snapshot(spark, repo, tmp_path):
    assert snapshot.load(spark, repo) is None and snapshot.clear(repo) is False
    index = Index(directory.read(spark, repo))
    snapshot.save(index, repo, ["target"])
    got = snapshot.load(spark, repo)
    assert got.meta.exclusions == ["target"] and got.index.documents.count() == 8
    os.rename(repo + "/.fathom", repo + "/kept")
    other = tmp_path / "other"
    other.mkdir()
    os.rename(repo + "/kept", other / ".fathom")
    with pytest.raises(ValueError):
        snapshot.load(spark, str(other))
    (other / ".fathom" / "mine").write_text("x")
    assert snapshot.clear(str(other)) and (other / ".fathom" / "mine").exists() and not snapshot.clear(str(other))


def call(spark, *argv):
    return cli.run(cli.parser().parse_args(argv), spark)


def test_commands(spark, repo):
    with pytest.raises(ValueError):
        call(spark, "stats", "-d", repo)
    done = call(spark, "index", repo, "--exclude", "a b,none")
    assert done["summary"]["files"] == 7 and done["summary"]["categories"]["Tests"] == 1 and "none" in done["exclusions"]
    found = call(spark, "search", "index build", "-d", repo, "--match-all", "--category", "source", "--extension", ".RS", "--limit", "3")
    assert [r["path"] for r in found["results"]] == ["src/main.rs"] and found["match"] == "all" and found["results"][0]["snippet"] == "fn build_search_index() {}"
    assert call(spark, "symbol", "build_search_index", "-d", repo)["definitions"][0]["kind"] == "Function"
    assert call(spark, "overview", "-d", repo)["project_type"] == "Rust CLI application"
    assert call(spark, "related", "src/main.rs", "-d", repo)["source"] == "src/main.rs"
    audited = call(spark, "audit-docs", "-d", repo, "--confidence", "high")
    assert audited["documents_checked"] == 1 and audited["minimum_confidence"] == "High" and {f["confidence"] for f in audited["findings"]} <= {"High"}
    figures = call(spark, "stats", "-d", repo)
    assert figures["summary"] == done["summary"]
    assert call(spark, "clear", "-d", repo)["removed"] is True
    for result in (done, found, figures):
        assert json.loads(report.as_json(result)) == result
        assert all(len(x) <= report.WIDTH for x in report.as_text(result).splitlines())


def test_arguments(capsys):
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["search", "x", "--limit", "0"])
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["index"])
    args = cli.parser().parse_args(["search", "x", "--category", "docs,test", "--category", "source"])
    assert args.category == ["docs", "test", "source"] and args.directory == "."
    about, options = cli.catalog()
    assert {"index", "search", "symbol", "overview", "related", "audit-docs", "stats", "clear", "help"} == set(about)
    assert {"--limit", "--help", "--version", "--exclude", "--confidence"} <= options
    assert cli.run(cli.parser().parse_args([]))["commands"][0]["name"] == "index"
    assert [report.count(n) for n in (0, 999, 1000, 1234567)] == ["0", "999", "1,000", "1,234,567"]
