"""Plans carried out on files: guards, a killed task, swaps that stop."""

import os

import pytest

from partloom.operators import repair
from partloom.sources import moves

PLAN = "level int, seq long, action string, src string, dst string"


def tree_of(root):
    return {os.path.relpath(os.path.join(top, f), root): open(os.path.join(top, f)).read() for top, _, files in os.walk(root) for f in files}


def fill(root, files):
    for path, said in files.items():
        at = os.path.join(root, path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w") as f:
            f.write(said)


STEPS = [(1, 1, "move", "A", "X/A"), (1, 2, "move", "B", "Y"), (2, 3, "move", "X/A/c", "C"), (2, 4, "copy", "Y", "Z/Y"), (3, 5, "delete", "Z/Y/old", None), (3, 6, "move", "nothing", "N")]
FILES = {"A/a.pdf": "a", "A/c/c.pdf": "c", "B/b.pdf": "b", "B/old/o.pdf": "o"}
AFTER = {"X/A/a.pdf": "a", "C/c.pdf": "c", "Y/b.pdf": "b", "Y/old/o.pdf": "o", "Z/Y/b.pdf": "b"}


def test_levels_run_in_order(spark, tmp_path):
    root, log = str(tmp_path / "t"), str(tmp_path / "j")
    fill(root, FILES)
    plan = spark.createDataFrame(STEPS, PLAN)
    for _ in range(2):  # the second time everything is done already
        got = {r["seq"]: r["status"] for r in moves.execute(plan, root, log).collect()}
        assert got == {1: "done", 2: "done", 3: "done", 4: "done", 5: "done", 6: "failed: no source"} and tree_of(root) == AFTER


@pytest.mark.parametrize("when", ["begun", "acted"])
@pytest.mark.parametrize("seq", [1, 3, 4, 5])
def test_a_step_stopped_anywhere_is_finished(tmp_path, when, seq):
    root, log = str(tmp_path / "t"), moves.Journal(str(tmp_path / "j"))
    fill(root, FILES)

    def stop(what, k):
        if (what, k) == (when, seq):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        for _, k, action, src, dst in STEPS:
            moves.step(action, src, dst, k, root, log, 250, stop)
    said = [moves.step(action, src, dst, k, root, log, 250) for _, k, action, src, dst in STEPS]
    assert said == ["done"] * 5 + ["failed: no source"] and tree_of(root) == AFTER


def test_a_killed_task_and_another_run_give_the_same_tree(spark, tmp_path):
    root, log, mark = str(tmp_path / "t"), str(tmp_path / "j"), str(tmp_path / "mark")
    fill(root, FILES)

    def kill(what, seq):
        if (what, seq) == ("acted", 3) and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)

    plan = spark.createDataFrame(STEPS, PLAN)
    with pytest.raises(Exception):
        moves.execute(plan, root, log, at=kill).collect()
    assert os.path.exists(mark) and tree_of(root) != AFTER
    assert {r["status"] for r in moves.execute(plan, root, log, at=kill).collect()} == {"done", "failed: no source"} and tree_of(root) == AFTER


def test_guards_leave_the_tree_alone(spark, tmp_path):
    root = str(tmp_path / "t")
    fill(root, {"A/" + "d" * 40 + "/a.pdf": "a", "B/b.pdf": "b", "C/c.pdf": "c", "D/d.pdf": "d", "E/e.pdf": "e"})
    os.symlink(os.path.join(root, "B"), os.path.join(root, "C", "link"))
    os.symlink(str(tmp_path), os.path.join(root, "out"))
    before = tree_of(root)
    steps = [(1, 1, "move", "A", "long" * 5), (1, 2, "move", "B", "D"), (1, 3, "move", "C", "G"), (1, 4, "move", "E", "out/E"), (1, 5, "delete", "C", None)]
    limit = len(root) + 60
    got = {r["seq"]: r["status"] for r in moves.execute(spark.createDataFrame(steps, PLAN), root, str(tmp_path / "j"), limit).collect()}
    assert got == {1: "review: path too long", 2: "review: destination exists", 3: "review: link or unreadable below", 4: "review: link", 5: "review: link or unreadable below"}
    assert tree_of(root) == before


def test_a_repair_plan_is_carried_out(spark, tmp_path):
    root = str(tmp_path / "t")
    files = {"OLD/FA.pdf": "a", "OLD/FB N/FB.pdf": "b", "dup/FB.pdf": "b"}
    fill(root, files)
    rows = [(p, p.rsplit("/", 1)[1][:-4], c) for p, c in files.items()]
    planned = [("FA", "FA N"), ("FB", "FA N/FB N")]
    actions, tree = repair.reconcile_tree(spark.createDataFrame(rows, "path string, stem string, content string"), spark.createDataFrame(planned, "stem string, folder string"))
    assert {r["status"] for r in moves.execute(moves.plan_of(actions), root, str(tmp_path / "j")).collect()} == {"done"}
    assert set(tree_of(root)) == {r["path"] for r in tree.collect()} == {"FA N/FA.pdf", "FA N/FB N/FB.pdf"}


def test_swaps_stop_at_a_drawings_first_failure(spark, tmp_path):
    root, archive = str(tmp_path / "t"), str(tmp_path / "t/_superseded")
    at = lambda p: os.path.join(root, p)
    fill(root, {"x/FA.pdf": "a0", "y/FA.pdf": "a1", "z/FA.pdf": "a0", "x/FB.pdf": "b0", "in/FA_A.pdf": "a2", "in/FB_A.pdf": "b2", "_superseded/FB.pdf": "b-before"})
    os.rename(at("y/FA.pdf"), at("y/real.pdf"))
    os.symlink(at("y/real.pdf"), at("y/FA.pdf"))
    plan = [("FA", k, at(f"{d}/FA.pdf"), at("in/FA_A.pdf")) for k, d in enumerate("xyz")] + [("FB", 0, at("x/FB.pdf"), at("in/FB_A.pdf"))]
    run = lambda: {(r["stem"], r["seq"]): r["status"] for r in moves.swap_revisions(spark.createDataFrame(plan, "stem string, seq long, old string, new string"), archive).collect()}
    assert run() == {("FA", 0): "swapped", ("FA", 1): "failed: link", ("FA", 2): "not tried", ("FB", 0): "swapped"}
    got = tree_of(root)
    assert got["x/FA_A.pdf"] == "a2" and got["z/FA.pdf"] == "a0" and "z/FA_A.pdf" not in got and "x/FA.pdf" not in got
    assert got["_superseded/FA.pdf"] == "a0" and got["_superseded/FB.pdf"] == "b-before" and got["_superseded/FB.1.pdf"] == "b0"
    os.remove(at("y/FA.pdf"))
    os.rename(at("y/real.pdf"), at("y/FA.pdf"))
    assert set(run().values()) == {"swapped"}
    got = tree_of(root)
    assert got["_superseded/FA.1.pdf"] == "a1" and got["z/FA_A.pdf"] == "a2" and not any(p.endswith((".part", "/FA.pdf")) for p in got if not p.startswith("_"))
