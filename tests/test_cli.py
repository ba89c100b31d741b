"""The command line over written sections."""

import argparse
import json

import pytest

from quirespark import cli
from quirespark.sources import cabinet
from tests import section_writer as W
from tests.test_convert import spaces


def test_sizes_and_counts():
    assert [cli.size(x) for x in ("12", "1.5K", "2 mb", "4G")] == [12, 1536, 2 << 20, 4 << 30]
    assert cli.count("3") == 3
    for bad in ("", "x", "-1", "1T"):
        with pytest.raises(argparse.ArgumentTypeError):
            cli.size(bad)
    with pytest.raises(argparse.ArgumentTypeError):
        cli.count("0")
    limits = cli.options(cli.parser().parse_args(["a.one", "--max-asset-bytes", "1G", "--max-entries", "5", "--no-attachments"]))
    assert (limits.graph.asset_bytes, limits.graph.total_asset_bytes, limits.archive.entries, limits.attachments_dir) == (1 << 30, 1 << 30, 5, None)
    with pytest.raises(SystemExit):
        cli.options(cli.parser().parse_args(["a.one", "--max-asset-bytes", "9", "--max-total-asset-bytes", "8"]))


def test_runs(spark, tmp_path, capsys):
    at = tmp_path / "in"
    (at / "sub").mkdir(parents=True)
    (at / "b.One").write_bytes(W.desktop(spaces(a={}), [("picture", b"p")]))
    (at / "sub" / "a.one").write_bytes(b"junk")
    (at / "notes.txt").write_bytes(b"not an input")
    assert [r.input.rsplit("/", 1)[-1] for r in cabinet.listing(spark, str(at)).orderBy("input_ord").collect()] == ["b.One", "a.one"]
    assert cli.main([str(at), "--list"], spark) == 0
    assert "  b\tb.One\n" in capsys.readouterr().out
    out = tmp_path / "out"
    assert cli.main([str(at), "--out", str(out), "--json"], spark) == 1
    told = json.loads(capsys.readouterr().out)
    assert (told["ok"], told["dryRun"], len(told["reports"])) == (False, False, 2)
    assert (out / "My section" / "First page.md").read_text().startswith('---\ntitle: "First page"\nsource: onenote\n')
    assert (out / "My section" / "attachments" / "First page image.png").read_bytes() == b"p"
    assert cli.main([str(at / "b.One"), "--out", str(tmp_path / "none"), "--dry-run"], spark) == 0
    assert capsys.readouterr().out == "Would write 1 notes and 2 attachments\n" and not (tmp_path / "none").exists()
