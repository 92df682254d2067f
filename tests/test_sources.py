import json
import os
import subprocess

import pytest

from codewhiff import cli
from codewhiff.operators.scan import scan
from codewhiff.plans.config import IGNORED, Config
from codewhiff.sources import git, settings, tree
from codewhiff.streaming import scans


@pytest.fixture
def root(tmp_path):
    files = {
        "a.ts": "eval(x)\n", "src/_b.py": "exec(y)", "src/__init__.py": "", "src/.hidden.py": "exec(y)", ".venv/c.py": "exec(y)", "node_modules/d.js": "eval(x)", "x/node_modules/e.js": "eval(x)",
        "f.min.js": "eval(x)", "g.txt": "eval(x)", "bin.js": "eval(x)\0", "big.js": " " * 1_000_001, "edge.js": " " * 1_000_000, "sub dir/h.tsx": "// été\neval(x)", "bad.py": b"exec(\xff)",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    (tmp_path / "link").symlink_to(tmp_path / "src")
    return tmp_path


def test_tree(spark, root):
    got = {r.file: r for r in tree.read_tree(spark, str(root)).collect()}
    assert sorted(got) == sorted(["a.ts", "src/_b.py", "src/__init__.py", "x/node_modules/e.js", "edge.js", "sub dir/h.tsx", "bad.py"])
    assert got["bad.py"].content == "exec(�)" and got["src/__init__.py"].content == "" and got["sub dir/h.tsx"].size == 16
    assert sorted(r.file for r in tree.read_tree(spark, str(root), only=["a.ts", "g.txt"]).collect()) == ["a.ts"]
    assert "x/node_modules/e.js" not in {r.file for r in tree.read_tree(spark, str(root), anywhere=True).collect()}
    assert [r.file for r in tree.read_tree(spark, str(root), Config(include=("g.txt",))).collect()] == ["g.txt"]


def test_tree_batches(spark, root):
    reader = tree.TreeReader({"path": str(root), "include": ".*", "batchBytes": "1"})
    assert len(reader.partitions()) > 5
    assert len(tree.TreeReader({"path": str(root / "none"), "include": ".*"}).partitions()) == 1


def test_scan_of_a_tree(spark, root):
    got = sorted((r.file, r.line) for r in scan(tree.read_tree(spark, str(root))).where("rule like '%eval'").collect())
    assert got == [("a.ts", 1), ("bad.py", 1), ("src/_b.py", 1), ("sub dir/h.tsx", 2), ("x/node_modules/e.js", 1)]


def test_settings(tmp_path):
    assert settings.load_config(folder=str(tmp_path)) == Config()
    (tmp_path / ".codewhiffrc").write_text("not json")
    (tmp_path / ".codewhiffrc.json").write_text("null")
    (tmp_path / "codewhiff.config.json").write_text(json.dumps({"rules": {"no-eval": "off"}, "ignore": ["x"], "include": ["*.ts"]}))
    with pytest.warns(UserWarning):
        got = settings.load_config(folder=str(tmp_path))
    assert got == Config({"no-eval": "off"}, (*IGNORED, "x"), ("*.ts",))
    (tmp_path / "odd.json").write_text(json.dumps({"rules": 3, "ignore": "x", "include": {}}))
    assert settings.load_config(str(tmp_path / "odd.json")) == Config()
    assert settings.load_config(str(tmp_path / "missing.json")) == Config()
    assert settings.with_ignored(Config(), "y").ignore[-1] == "y"


def run(folder, *args):
    subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *args], cwd=folder, check=True, capture_output=True)


def test_git(spark, tmp_path):
    run(tmp_path, "init", "-q")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("one\ntwo\nthree\n")
    run(tmp_path, "add", ".")
    run(tmp_path, "commit", "-qm", "x")
    (tmp_path / "src/a.ts").write_text("one\neval(x)\nthree\neval(y)\n")
    (tmp_path / "new.ts").write_text("eval(z)\n")

    def lines(folder, staged=False):
        return sorted((r.file, r.line) for r in git.git_diff(spark, str(folder), staged).collect())

    assert lines(tmp_path) == [("src/a.ts", 2), ("src/a.ts", 4)]
    assert lines(tmp_path / "src") == [("a.ts", 2), ("a.ts", 4)]
    assert lines(tmp_path, True) == []
    run(tmp_path, "add", ".")
    assert lines(tmp_path, True) == [("new.ts", 1), ("src/a.ts", 2), ("src/a.ts", 4)] and lines(tmp_path) == []
    assert cli.main([str(tmp_path), "--staged", "--json"], spark) == 1
    assert cli.main([str(tmp_path), "--diff"], spark) == 0


def test_git_outside_a_repository(spark, tmp_path):
    with pytest.raises(RuntimeError, match="git repository"):
        git.git_diff(spark, str(tmp_path))


def test_command_line(spark, root, capsys):
    assert cli.main([str(root), "--json"], spark) == 1
    out = json.loads(capsys.readouterr().out)
    assert out["filesScanned"] == 7 and out["summary"]["error"] == 5
    assert cli.main([str(root), "-q", "--ignore", "a.ts", "src"], spark) == 1
    assert capsys.readouterr().out.strip() == "3 problems: 3 errors"
    assert cli.main([str(root / "g.txt")], spark) == 0
    assert "1 files scanned" in capsys.readouterr().out
    assert cli.main([str(root / "none")], spark) == 2
    assert cli.main([str(root / "a.ts"), "--severity", "loud"], spark) == 1
    assert "a.ts" in capsys.readouterr().out


def test_agent_functions(spark, root, tmp_path):
    got = cli.scan_paths(spark, [str(root / "a.ts"), str(root / "x"), "/no/such/path", str(root / "a.ts")]).collect()
    assert sorted((r.rule, r.line) for r in got) == [("missing-path", 0), ("no-eval", 1), ("no-eval", 1)]
    text = "+++ b/a.ts\n@@ -0,0 +1 @@\n+eval(x)\n"
    assert [r.file for r in cli.scan_diff(spark, text, str(root)).collect()] == ["a.ts"]
    assert cli.scan_diff(spark, "", str(root)).collect() == []


def test_stream(spark, tmp_path):
    rows = [("a.js", "eval(x)\ntry {} catch (e) {}", "2024-01-01 00:01:00"), ("b.js", "eval(x)", "2024-01-01 00:12:00"), ("c.js", "x", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "file string, content string, at string").selectExpr("file", "content", "cast(at as timestamp) as at")
    for i in range(3):
        df.where(f"file = '{'abc'[i]}.js'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = scans.scan_stream(stream).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("found").count() == scan(df).count() == 3
    q = scans.counts_by_window(stream, "at").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.severity, r.findings) for r in spark.table("counts").collect()}
    assert got <= {("error", 2), ("error", 1)} and got
    assert os.path.exists(tmp_path / "c2")
