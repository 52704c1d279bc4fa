"""Trees of placements: their statuses, repair, cycles of any depth."""

import random

import pytest

from partloom.operators import graph, placement, repair
from partloom.plans import runs


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "parent string, child string")


@pytest.mark.parametrize("n", [499, 500, 501, 1500])
def test_cycles_are_cut_at_any_depth(spark, n):
    chain = [(f"n{k:04d}", f"n{k + 1:04d}") for k in range(n)]
    loops = [(f"n{n:04d}", f"n{n - 1:04d}"), ("n0003", "n0001"), (f"n{n // 2 + 2:04d}", f"n{n // 2:04d}")]
    cut = {tuple(r) for r in graph.cycle_edges(edges_of(spark, chain + loops)).collect()}
    assert cut == set(loops)


def test_every_cut_lies_on_a_cycle_and_none_is_left(spark):
    draw = random.Random(4)
    pairs = sorted({(f"s{draw.randint(0, 40):02d}", f"s{draw.randint(0, 40):02d}") for _ in range(90)})
    cut = {tuple(r) for r in graph.cycle_edges(edges_of(spark, pairs)).collect()}
    after = {}
    for a, b in pairs:
        if a != b:
            after.setdefault(a, set()).add(b)

    def reaches(a, b, without=()):
        todo, seen = [a], set()
        while todo:
            x = todo.pop()
            for y in after.get(x, ()):
                if (x, y) not in without and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return b in seen

    assert cut and all(reaches(b, a) for a, b in cut)
    assert not any(reaches(a, a, cut) for a in after)


@pytest.mark.parametrize("limit,dir_limit,depth,seen", [(24, 18, 1, {"placed", "refused", "too-long", "truncated"}), (44, 40, 4, {"placed", "refused", "linked"})])
def test_statuses_are_those_of_a_walk(spark, limit, dir_limit, depth, seen):
    draw = random.Random(7)
    pairs = sorted({(f"F{a}", f"F{b}") for a, b in ((draw.randint(0, 12), draw.randint(1, 25)) for _ in range(40)) if a < b})
    folders = {f"F{k}": f"F{k}" + "x" * draw.randint(0, 9) for k in range(26)}
    kids, refused = {}, {"F5", "F9", "F0"}
    for a, b in pairs:
        kids.setdefault(a, []).append(b)

    def count(s):
        return 1 + sum(count(c) for c in kids.get(s, ()))

    def walk(root, path, up):
        stem = path[-1]
        at = f"{up}/{folders[stem]}" if up else folders[stem]
        whole = len("T/" + at)
        if len(path) - 1 > depth:
            status = "truncated"
        elif stem in refused:
            status = "refused"
        elif whole > dir_limit or whole + 1 + len(stem + ".pdf") > limit:
            status = "too-long"
        elif at in links:
            status = "linked"
        else:
            status = "placed"
        blocked = status in placement.BLOCKED
        want.append((root, tuple(path), at, status, count(stem) if blocked else int(status == "refused")))
        for c in () if blocked else kids.get(stem, ()):
            walk(root, [*path, c], at)

    tops = sorted({a for a, _ in pairs} - {b for _, b in pairs})
    links, want = {f"{folders[tops[0]]}/{folders[kids[tops[0]][0]]}"}, []
    for r in tops:
        walk(r, [r], "")
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    e = edges_of(spark, pairs)
    s = placement.placement_statuses(e, of([(r,) for r in tops], "stem string"), of(list(folders.items()), "stem string, folder string"), "T", None, of([(r,) for r in refused], "stem string"), of([(x,) for x in links], "dir string"), limit, dir_limit, depth)
    got = s.collect()
    assert sorted((r["root"], tuple(r["path"]), r["dir"], r["status"], int(r["pruned"])) for r in got) == sorted(want)
    assert {r["status"] for r in got} == seen
    t = placement.status_totals(s).first()
    assert sum(t) == sum(count(r) for r in tops)
    placed = {p[-1] for _, p, _, st, _ in want if st == "placed"}
    lost, todo = set(), [p[-1] for _, p, _, st, _ in want if st in placement.BLOCKED]
    while todo:
        x = todo.pop()
        lost.add(x)
        todo += kids.get(x, [])
    assert {r["stem"] for r in placement.unplaced_stems(s, e).collect()} == (lost | {p[-1] for _, p, _, st, _ in want if st == "refused"}) - placed
    assert {r["stem"] for r in placement.placed_roots(s).collect()} == {r for r, _, _, st, _ in want if st == "placed"}


def in_turn(files, planned, limit, dir_limit):
    """The same repair, one drawing after another; files: path to (stem, content)."""
    files, told = dict(files), []
    folder = lambda p: p.rsplit("/", 1)[0]
    stands = lambda f: any(p.startswith(f + "/") for p in files)
    for stem in sorted(planned, key=lambda s: (min(f.count("/") for f in planned[s]), s)):
        current = sorted({folder(p) for p, (s, _) in files.items() if s == stem}, key=lambda f: f.split("/"))
        if not current:
            continue
        targets = sorted(planned[stem], key=lambda f: f.split("/"))
        keep, extra, missing = [f for f in current if f in targets], [f for f in current if f not in targets], [f for f in targets if f not in current]
        told += [(stem, f, "keep", None) for f in keep]
        for f in extra:
            if missing and not stands(missing[0]):
                to = missing.pop(0)
                if max(len(to + p[len(f) :]) for p in files if p.startswith(f + "/")) > limit:
                    told.append((stem, f, "review", to))
                    continue
                files = {(to + p[len(f) :] if p.startswith(f + "/") else p): x for p, x in files.items()}
                keep.append(to)
                told.append((stem, f, "move", to))
                continue
            inside = {p: x for p, x in files.items() if p.startswith(f + "/")}
            ok = keep and all(s is not None and any(t != p and files.get(t) == (s, c) for t in (f"{g}/{p.rsplit('/', 1)[1]}" for g in planned.get(s, ()))) for p, (s, c) in inside.items())
            told.append((stem, f, "delete" if ok else "review", None))
            if ok:
                files = {p: x for p, x in files.items() if p not in inside}
        for to in missing:
            if not stands(to):
                src = min((p for p, (s, _) in files.items() if s == stem), key=lambda p: (p.count("/"), p))
                fits = len(to) <= dir_limit and len(to + "/" + src.rsplit("/", 1)[1]) <= limit
                told.append((stem, None, "copy" if fits else "skip", to))
                if fits:
                    files[f"{to}/{src.rsplit('/', 1)[1]}"] = files[src]
    return told, files


def some_tree(seed):
    """A planned tree, and files that stand as planned but for renamed, doubled, displaced and missing folders."""
    draw = random.Random(seed)
    planned, files = {}, {}

    def grow(stem, at, depth):
        planned.setdefault(stem, set()).add(at)
        for k in range(draw.randint(1, 2) if depth < 3 else 0):
            child = f"{stem}{k}"
            grow(child, f"{at}/{child} " + "n" * draw.randint(1, 6), depth + 1)

    for r in "AB":
        grow(f"F{r}", f"F{r} ROOT", 0)
    wrong = {}
    for s in sorted(planned, key=len):
        f = next(iter(planned[s]))
        if draw.random() < 0.3:
            wrong[f] = f.rsplit("/", 1)[0] + f"/OLD{s}" if "/" in f else f"OLD{s}"
    for s, (f,) in ((s, tuple(fs)) for s, fs in planned.items()):
        at = f
        for old in sorted(wrong, key=len, reverse=True):  # the deepest first, so that every wrong name shows once
            if at == old or at.startswith(old + "/"):
                at = wrong[old] + at[len(old) :]
        rule = draw.randint(0, 7)
        if rule == 0 and not any(g.startswith(f + "/") for x in planned.values() for g in x):
            planned[s].add(f"FA ROOT/second/{s}")
        files[f"{at}/{s}.pdf"] = (s, "1")
        if rule in (1, 2, 3):
            files[f"dup/{s}/{s}.pdf"] = (s, "1" if rule != 2 else "2")
        if rule == 3:
            files[f"dup/{s}/notes.txt"] = (None, "x")
    return files, planned


@pytest.mark.parametrize("seed", [1, 3])
def test_repair_is_that_of_one_drawing_after_another(spark, seed):
    files, planned = some_tree(seed)
    want, after = in_turn(files, planned, 60, 50)
    f = spark.createDataFrame([(p, s, c) for p, (s, c) in files.items()], "path string, stem string, content string")
    p = spark.createDataFrame([(s, x) for s, fs in planned.items() for x in fs], "stem string, folder string")
    actions, tree = repair.reconcile_tree(f, p, "", 60, 50)
    assert {r["path"]: (r["stem"], r["content"]) for r in tree.collect()} == after
    done = lambda rows: sorted(((s, a, t) for s, _, a, t in rows), key=str)
    assert done((r["stem"], r["folder"], r["action"], r["target"]) for r in actions.collect()) == done(want)


def test_two_folders_never_vouch_for_each_other(spark):
    """A holds the only planned copy of what is in B, and B of what is in A: neither goes."""
    files = [("x/FA.pdf", "FA", "1"), ("x/p/FB.pdf", "FB", "1"), ("y/FB.pdf", "FB", "1"), ("y/p/FA.pdf", "FA", "1")]
    planned = [("FA", "y/p"), ("FB", "x/p")]
    actions, tree = repair.reconcile_tree(spark.createDataFrame(files, "path string, stem string, content string"), spark.createDataFrame(planned, "stem string, folder string"))
    assert {r["action"] for r in actions.collect()} == {"keep", "review"} and tree.count() == 4


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "path string, stem string, content string")
    actions, tree = repair.reconcile_tree(none, spark.createDataFrame([("FA", "x")], "stem string, folder string"))
    assert actions.count() == 0 and tree.count() == 0 and tuple(repair.counted(actions).first()) == (0, 0, 0, 0)


def test_a_right_tree_of_named_folders_is_kept(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    stems = one([("F10000001",), ("F10000002",)], "stem string")
    data = runs.Inputs(
        stems,
        one([("F10000001", "F10000002", 1, "table", "BRACKET")], "stem string, ref string, page int, method string, description string"),
        one([], "stem string, ref string"),
        one([("F10000001", "F10000001", "F10000001", "-", "FRAME", False), ("F10000002", "F10000002", "F10000002", "-", "BRACKET", False)], "stem string, file_name string, number string, rev string, name string, scanned boolean"),
        one([], "stem string, page int, line_no int, text string"),
    )
    tree = [("F10000001 FRAME/F10000001.pdf", "F10000001", "a"), ("F10000001 FRAME/F10000002 BRACKET/F10000002.pdf", "F10000002", "b")]
    archive = one([("F10000000_A", "_superseded/F10000000_A.pdf", "c")], "stem string, path string, content string")
    out = runs.repair_run(data, stems, archive.limit(0), one(tree, "path string, stem string, content string"), target="/srv/out")
    assert {r["action"] for r in out["repair"].collect()} == {"keep"} and out["repair"].count() == 2
    assert tuple(out["repair_counts"].first()) == (0, 0, 0, 0) and runs.exit_code(out) == 0 and out["promoted_files"].count() == 0
    wrong = [(p.replace(" FRAME", ""), s, c) for p, s, c in tree]
    out = runs.repair_run(data, stems, archive.limit(0), one(wrong, "path string, stem string, content string"), target="/srv/out")
    assert {(r["stem"], r["action"], r["target"]) for r in out["repair"].collect()} == {("F10000001", "move", "F10000001 FRAME"), ("F10000002", "keep", None)}
    assert {r["path"] for r in out["tree"].collect()} == {p for p, *_ in tree}
