"""Exit codes and reports of the command line, and the order of inputs."""

import json

import pytest

from quirespark import cli
from quirespark.sources import cabinet
from tests import section_writer as W
from tests.test_convert import spaces


@pytest.fixture(scope="module")
def section():
    return W.desktop(spaces(a={}), [("picture", b"p")])


def run(spark, capsys, *args):
    code = cli.main([str(a) for a in args], spark)
    told = capsys.readouterr()
    return code, told.out, told.err


def test_refused_files(spark, tmp_path, capsys, section):
    at, out = tmp_path / "one.one", tmp_path / "out"
    at.write_bytes(section)
    code, told, _ = run(spark, capsys, at, "-o", out, "--json")
    report = json.loads(told)["reports"][0]
    assert code == 0 and report["notes"] == ["My section/First page.md"] and len(report["attachments"]) == 2 and report["errors"] == []
    note = out / "My section" / "First page.md"
    note.write_text("mine")
    code, told, _ = run(spark, capsys, at, "-o", out, "--json")
    told = json.loads(told)
    report = told["reports"][0]
    assert code == 1 and told["ok"] is False and report["notes"] == [] and report["attachments"] == []
    assert [(e["name"], e["kind"]) for e in report["errors"]] == [("First page", "unknown")] and "exists" in report["errors"][0]["message"]
    assert note.read_text() == "mine" and not list(out.rglob("*.part"))
    for f in out.rglob("*.png"):
        f.unlink()
    (out / "My section" / "attachments" / "First page image.png").mkdir()  # one attachment cannot be written: nor is its page
    note.unlink()
    code, told, err = run(spark, capsys, at, "-o", out, "-q", "--overwrite")
    assert code == 1 and told == "" and err.count("! First page:") == 1 and not note.exists()


def test_usage_errors(spark, tmp_path, capsys, section):
    (tmp_path / "empty").mkdir()
    (tmp_path / "a.one").write_bytes(section)
    for args in ([tmp_path / "nothing.one"], [tmp_path / "a.one", tmp_path / "nothing"], [tmp_path / "empty"], [tmp_path / "empty", "--list"]):
        code, told, err = run(spark, capsys, *args, "-o", tmp_path / "out")
        assert code == 2 and told == "" and "usage" in err
    assert not (tmp_path / "out").exists()
    with pytest.raises(SystemExit) as e:
        cli.main(["x", "--max-asset-bytes", "9", "--max-total-asset-bytes", "8"], spark)
    assert e.value.code == 2


def test_lists_with_faults(spark, tmp_path, capsys, section):
    (tmp_path / "a.one").write_bytes(section)
    (tmp_path / "B.onepkg").write_bytes(b"MSCF broken archive")
    code, told, _ = run(spark, capsys, tmp_path, "--list", "--json")
    items = json.loads(told)
    assert code == 1 and [i["file"].rsplit("/", 1)[-1] for i in items] == ["a.one", "B.onepkg"]
    assert items[0]["sections"] == [{"name": "a.one", "title": "a", "groups": []}] and "error" not in items[0]
    assert items[1]["sections"] == [] and items[1]["error"].startswith("ONENOTE_CAB_")
    code, told, _ = run(spark, capsys, tmp_path / "a.one", "--list")
    assert code == 0 and told.endswith("a.one\n  a\ta.one\n")
    assert "  ! ONENOTE_CAB" in run(spark, capsys, tmp_path, "--list")[1]


def test_names_are_claimed_in_name_order(spark, tmp_path, capsys, section):
    for name in ("B.one", "a.one", "sub/c.one"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(section)
    code, told, err = run(spark, capsys, tmp_path, "--dry-run", "--json")
    reports = {r["input"].rsplit("/", 1)[-1]: r["notes"] for r in json.loads(told)["reports"]}
    assert code == 0 and list(reports) == ["a.one", "B.one", "c.one"]
    assert [n[0].split("/")[0] for n in reports.values()] == ["My section", "My section 1", "My section 2"]
    inputs, order = cabinet.given_inputs(spark, [str(tmp_path / "sub" / "c.one"), str(tmp_path), str(tmp_path / "B.one")])
    assert [r.input.rsplit("/", 1)[-1] for r in order.orderBy("input_ord").collect()] == ["c.one", "a.one", "B.one"]
    assert inputs.count() == 3
