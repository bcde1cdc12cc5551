"""Source trees that are pruned before they are read, and reports that are committed as a whole."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from groundwork.operators import surface
from groundwork.sources import reports, trees


def lines(spark, root, **more):
    got = trees.scan_tree(spark, str(root), surface.TEXT_EXTENSIONS, surface.SKIP_DIRS, **more)
    return sorted((r.file, r.line_no, r.line) for r in got.collect())


@pytest.fixture
def tree(tmp_path):
    bodies = {
        "a.py": b"x = 1\r\ny\x0cz\n", ".env": b"K=1", ".env.example": b"K=", ".env.local": b"no", ".github/w.yml": b"on: push", "c.bin": b"no", "prod.env": b"P=1", "README": b"no", "empty.md": b"",
        "sub/d.ts": b"ab\xffcd\nz", "sub/deep/er/still/e.js": "é b".encode(), "sub/big.md": b"z" * 50, "node_modules/x/b.py": b"no", "sub/dist/c.py": b"no", "distant/c.py": b"yes",
    }
    for name, body in bodies.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    return tmp_path / "tree"


WANT = [
    (".env", 1, "K=1"), (".env.example", 1, "K="), (".github/w.yml", 1, "on: push"), ("a.py", 1, "x = 1"), ("a.py", 2, "y"), ("a.py", 3, "z"), ("distant/c.py", 1, "yes"), ("prod.env", 1, "P=1"),
    ("sub/d.ts", 1, "abcd"), ("sub/d.ts", 2, "z"), ("sub/deep/er/still/e.js", 1, "é"), ("sub/deep/er/still/e.js", 2, "b"),
]


def test_tree_at_every_depth(spark, tree):
    for depth in (0, 1, 2, 9):
        assert lines(spark, tree, max_bytes=40, depth=depth) == WANT
    assert lines(spark, f"file://{tree}", max_bytes=40) == WANT
    with pytest.raises(Exception, match="no folder"):
        lines(spark, tree / "none")


def test_excluded_folders_are_not_listed(tree):
    options = {"path": str(tree), "extensions": '[".py"]', "names": "[]", "skip": '["node_modules", "dist"]', "max_bytes": "99", "depth": "2"}
    reader, asked = trees.TreeReader(options), []
    listed = reader._listed
    reader._listed = lambda where, folder: (asked.append(os.path.relpath(folder, tree)), listed(where, folder))[1]
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert {r["file"] for r in rows} == {"a.py", "distant/c.py"}
    assert not [p for p in asked if "node_modules" in p or "dist" in p.split("/")]
    assert {os.path.relpath(p.path, tree): p.whole for p in parts} == {".": False, ".github": False, "distant": False, "sub": False, "sub/deep": True}


def test_surface_of_a_tree(spark, tree):
    (tree / "sub" / "env.py").write_text("import os\nos.getenv('KEY')\n")
    found = surface.scan_surface(trees.scan_tree(spark, str(tree), surface.TEXT_EXTENSIONS, surface.SKIP_DIRS).withColumn("repo", F.lit("r")), "example.com")
    assert [(r.type, r.value, r.file, r.line_no) for r in found.collect()] == [("env_var", "KEY", "sub/env.py", 2)]


def test_ten_thousand_reports_are_as_many_files(spark, tmp_path):
    d = spark.range(10_000).select(F.format_string("r-%05d.md", "id").alias("file_name"), F.concat(F.lit("# T é\nbody "), "id").alias("body"), F.lit(1).alias("more"))
    out = tmp_path / "out"
    for _ in range(2):
        reports.write_reports(d.repartition(7), str(out))
        assert len(os.listdir(out)) == 10_000
    assert (out / "r-00042.md").read_text() == "# T é\nbody 42"
    reports.write_reports(spark.createDataFrame([("r-00042.md", None), ("new.md", "n")], "file_name string, body string"), str(out))
    assert len(os.listdir(out)) == 10_001 and (out / "r-00042.md").read_text() == ""


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    for bad in ("../x.md", "", None, ".hidden"):
        d = spark.range(200).select(F.when(F.col("id") == 199, F.lit(bad)).otherwise(F.format_string("r-%d.md", "id")).alias("file_name"), F.lit("b").alias("body"))
        with pytest.raises(Exception, match="file name"):
            reports.write_reports(d.repartition(4), str(tmp_path / "out"))
        assert os.listdir(tmp_path / "out") == [] and not (tmp_path / "x.md").exists()


def test_an_attempt_that_was_not_taken_leaves_no_double(tmp_path):
    from collections import namedtuple

    row = namedtuple("row", "file_name body")
    writer = reports.ReportWriter(str(tmp_path))
    lost, taken = (writer.write(iter([row("a.md", x), row("b.md", x)])) for x in ("lost", "taken"))
    assert Path(lost.folder) != Path(taken.folder)
    writer.commit([taken, None])
    assert sorted(os.listdir(tmp_path)) == ["a.md", "b.md"] and (tmp_path / "a.md").read_text() == "taken"
