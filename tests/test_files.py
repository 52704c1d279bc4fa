"""Folders, copies, history and the lock."""

import os

from pyspark.sql import functions as F

from partloom.operators import extract
from partloom.plans import runs
from partloom.sources import sinks, tree


def touch(root, *names, content="x"):
    for n in names:
        path = os.path.join(root, n)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(content)


def test_input_folder(spark, tmp_path):
    touch(tmp_path, "F10126106.pdf", "a/F10126106.pdf", "a/b/F10126107-A.pdf", "a/notes.pdf", "Output/F10126108.pdf", "_old/F10126109.pdf", "_F10126110.pdf", "out2/F10126111.pdf", "a/F10126112.PDF")
    got = {r["path"]: (r["stem"], r["class"]) for r in tree.input_drawings(spark, str(tmp_path), "out2").collect()}
    assert got == {
        "F10126106.pdf": ("F10126106", "index"),
        "a/F10126106.pdf": ("F10126106", "dupe"),
        "a/b/F10126107-A.pdf": ("F10126107_A", "index"),
        "a/notes.pdf": (None, "ignored"),
        "Output/F10126108.pdf": ("F10126108", "skip_output"),
        "_old/F10126109.pdf": ("F10126109", "skip_sys"),
        "out2/F10126111.pdf": ("F10126111", "skip_output"),
    }
    assert tree.too_large(tree.input_drawings(spark, str(tmp_path)), 0).count() == 7


def test_output_folder(spark, tmp_path):
    touch(tmp_path, "F10126106 PUMP/F10126106.pdf", "F10126106 PUMP/F10126107 VALVE/F10126107_A.PDF", "_superseded/F10126107.pdf", "_orphans/F10126108.pdf", "_other/F10126109.pdf", "x/F10126107 TAP/F10126107_B.pdf", "loose.pdf")
    t = tree.output_tree(spark, str(tmp_path), contents=True)
    assert {(r["path"].split("/")[-1], r["class"]) for r in t.collect()} == {("F10126106.pdf", "tree"), ("F10126107_A.PDF", "tree"), ("F10126107.pdf", "sup"), ("F10126108.pdf", "orph"), ("F10126107_B.pdf", "tree"), ("loose.pdf", "tree")}
    assert {r["base"]: r["name"] for r in tree.names_in_tree(t).collect()} == {"F10126106": "PUMP", "F10126107": "VALVE"}
    assert [r["stem"] for r in tree.parked(t).collect()] == ["F10126108"]
    assert tree.organized(t).count() == tree.in_place(t).count() == 3
    assert tree.output_tree(spark, f"{tmp_path}/none").count() == 0


def test_copies_run_twice(spark, tmp_path):
    touch(tmp_path, "a.pdf", "b.pdf")
    touch(tmp_path, "out/b.pdf", content="other")
    os.symlink(tmp_path / "out", tmp_path / "link")
    rows = [(f"{tmp_path}/a.pdf", f"{tmp_path}/out/x/a.pdf"), (f"{tmp_path}/b.pdf", f"{tmp_path}/out/b.pdf"), (f"{tmp_path}/a.pdf", f"{tmp_path}/link/a.pdf"), (f"{tmp_path}/gone.pdf", f"{tmp_path}/out/g.pdf")]
    plan = spark.createDataFrame(rows, "src string, dst string")
    status = lambda: {os.path.relpath(r["dst"], tmp_path): r["status"] for r in sinks.copy_files(plan).collect()}
    first = status()
    assert first == {"out/x/a.pdf": "copied", "out/b.pdf": "differs", "link/a.pdf": "linked", "out/g.pdf": "failed: No such file or directory"}
    assert status()["out/x/a.pdf"] == "same" and not [n for _, _, f in os.walk(tmp_path) for n in f if n.endswith(".part")]


def test_history_and_tables(spark, tmp_path):
    at = f"{tmp_path}/history"
    os.makedirs(at)
    with open(f"{at}/part.json", "w") as f:
        f.write('{"run_at": "2024", "run_id": 1, "missing": "7"}\n{broken\n')
    old = sinks.read_history(spark, at)
    assert [(r["missing"], r["version"]) for r in old.collect()] == [("pairs: 7", 2)]
    new = old.withColumns({"run_id": F.lit(2).cast("long"), "run_at": F.lit("2025"), "missing": F.lit("5")})
    sinks.write_history(old, new, at)
    assert [r["missing"] for r in sinks.read_history(spark, at).orderBy(F.desc("run_at")).collect()] == ["5", "pairs: 7"]
    sinks.write_tables({"t": spark.createDataFrame([("=1", ["a", "b"])], "x string, y array<string>")}, f"{tmp_path}/t", ("parquet", "csv"))
    assert spark.read.csv(f"{tmp_path}/t/t.csv", header=True).first().asDict() == {"x": "'=1", "y": "a,b"}
    sinks.write_lines(spark.createDataFrame([("a\x07b",)], "l string"), f"{tmp_path}/l")
    assert spark.read.text(f"{tmp_path}/l").first()[0] == "a\\x07b"


def test_lock(tmp_path):
    a, b = sinks.RunLock(str(tmp_path)), sinks.RunLock(str(tmp_path))
    assert a.take() and not b.take() and a.renew() and not b.renew()
    os.utime(a.path, (0, 0))
    assert b.take() and not a.held()
    a.release()
    assert b.held()
    b.release()
    assert a.take()


def test_lines_are_used_once(spark):
    texts = ["PARTS LIST", "1", "F10126106", "PUMP", "a note", "F10126199 IN THE NOTES", "F10126107 VALVE", "3", "F10126108", "4", "F10126109", "SCALE", "note", "F10126110 HOSE"]
    df = spark.createDataFrame([("s", 1, i, t) for i, t in enumerate(texts)], "stem string, page int, line_no int, text string")
    got = [(r["line_no"], r["ref"], r["description"]) for r in extract.page_entries(df).orderBy("line_no").collect()]
    # The note's lines go, up to the item 3; a number whose description is the next item has none.
    assert got == [(2, "F10126106", "PUMP"), (8, "F10126108", None), (13, "F10126110", "HOSE")]


def test_broken_and_half_written_history(spark, tmp_path):
    at = f"{tmp_path}/h"
    assert sinks.read_history(spark, at).count() == 0
    row = '{"version": 2, "run_at": "2024", "run_id": %d, "missing": "7"}\n'
    touch(tmp_path, "h.old/p.json", content=row % 1)
    assert [r["run_id"] for r in sinks.read_history(spark, at).collect()] == [1]
    touch(tmp_path, "h.new/p.json", content=row % 2)
    assert [r["run_id"] for r in sinks.read_history(spark, at).collect()] == [2]
    touch(tmp_path, "h/p.json", content=row % 3 + "{broken\n")
    assert [r["run_id"] for r in sinks.read_history(spark, at).collect()] == [3]
    aside = [n for n in os.listdir(tmp_path) if n.startswith("h.broken-")]
    assert len(aside) == 1 and "{broken" in (tmp_path / aside[0] / "p.json").read_text()


def test_earlier_runs_and_leftovers(spark, tmp_path):
    assert sinks.prior_names(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame([("a", "PUMP"), ("b", ""), (None, "x")], "stem string, name string").write.parquet(f"{tmp_path}/files")
    assert [tuple(r) for r in sinks.prior_names(spark, f"{tmp_path}/files").collect()] == [("a", "PUMP")]
    assert sinks.latest_report(spark, str(tmp_path)) == (None, None)
    touch(tmp_path, "report_2024.txt", content="Active: 3\n")
    touch(tmp_path, "report_2025.txt", content="x\nActive drawings: 5\n")
    found, line = sinks.latest_report(spark, str(tmp_path))
    assert found.endswith("report_2025.txt") and line == "Active drawings: 5"
    touch(tmp_path, "out/a/x.part", "out/b/new.part", "out/c/F1.pdf")
    os.utime(tmp_path / "out/a/x.part", (0, 0))
    os.makedirs(tmp_path / "out/d/e")
    gone = {os.path.relpath(p, tmp_path / "out") for p in sinks.sweep(str(tmp_path / "out"))}
    assert gone == {"a/x.part", "a", "d/e", "d"} and os.path.exists(tmp_path / "out/b/new.part")
    pages = spark.createDataFrame([("a.pdf", 201), ("b.pdf", 200)], "path string, pages int")
    assert [r["issue"] for r in tree.too_many_pages(pages).collect()] == ["file has 201 pages"]


def test_labels_of_runs():
    assert [runs.mode_label(d, i, r) for d, i, r in ((True, False, False), (False, False, False), (True, True, False), (False, False, True))] == ["DRY-RUN", "EXECUTE", "INCREMENTAL (DRY-RUN)", "REPAIR"]
