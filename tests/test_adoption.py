"""New drawings under organized parents, and organized folders under new ones."""

import pytest

from partloom.operators import adoption, graph
from partloom.plans import runs


@pytest.fixture
def made(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def placed(made, new, inner, under, above, bom, skipped=None):
    pair, one = "parent string, child string", "stem string"
    rows = adoption.claimant_placements(made([(s,) for s in new], one), made(inner, pair), made(under, pair), made(above, pair), made([(s,) for s in bom], one), None if skipped is None else made([(s,) for s in skipped], one))
    return {tuple(r) for r in rows.collect()}


def test_every_claimant_gets_its_copy(made):
    got = placed(made, ["R", "S", "T", "U", "P"], [("R", "S"), ("S", "T")], [("O1", "R"), ("O2", "R"), ("O2", "S"), ("O3", "T")], [("U", "O9")], [])
    # S is below R under O2 already; T comes with R under O1 and O2, and goes under its own parent too; P is parked.
    assert got == {("R", "O1", "root"), ("R", "O2", "root"), ("T", "O3", "cross"), ("U", None, "top")}
    assert placed(made, ["R", "S"], [("R", "S")], [("O", "S")], [], ["R"], skipped=["R"]) == set()


def test_claimants_weigh_in_the_cap(made):
    places = made([("R", "O1", "root"), ("R", "O2", "root"), ("R", "O3", "root"), ("S", "O1", "root"), ("U", None, "top")], "stem string, claimant string, kind string")
    counted = made([("R", 4), ("S", 9), ("U", 2)], "stem string, copies long")
    more = adoption.claimant_weights(places, counted)
    assert {r["stem"]: int(r["copies"]) for r in more.collect()} == {"R": 8, "S": 0}
    kept = graph.fit_roots(counted, 12, weights=more)
    assert {r["stem"]: r["kept"] for r in kept.collect()} == {"R": False, "S": True, "U": True}


def test_folders_below_a_claimant(made):
    places = made([("R", "O", "root"), ("U", None, "top"), ("X", "gone", "root")], "stem string, claimant string, kind string")
    files = made([("a/O/O.pdf", "O"), ("a/b/O/O.pdf", "O")], "path string, stem string")
    folders = made([(s, f"{s} N") for s in "RSUX"], "stem string, folder string")
    got = adoption.new_folders(places, made([("R", "S"), ("U", "S")], "parent string, child string"), folders, files)
    assert {tuple(r) for r in got.collect()} == {("R", "a/O/R N"), ("S", "a/O/R N/S N"), ("U", "U N"), ("S", "U N/S N")}


def adopted(made, claims, files, names, limit=60):
    rows = adoption.adoptions(made(claims, "claimant string, dir string, child string"), made(files, "path string, stem string"), made(list(names.items()), "stem string, folder string"), "", limit)
    return {(r["child"], r["dir"]): (r["action"], r["source"], r["target"], r["reason"], r["copies"]) for r in rows.collect()}


def test_the_first_claimant_moves_and_others_copy(made):
    files = [("A/A.pdf", "A"), ("A/B/B.pdf", "B"), ("A/B/C/C.pdf", "C")]
    got = adopted(made, [("N", "N", "A"), ("M", "M", "A"), ("N", "N", "C"), ("Z", "Z", "nothing")], files, {"A": "A NAME"})
    assert got["A", "M"] == ("move", "A", "M/A NAME", None, 0)
    assert got["A", "N"] == ("copy", "M/A NAME", "N/A NAME", None, 3)
    # C stays with A, wherever that has gone, and is copied from there.
    assert got["C", "N"] == ("copy", "M/A NAME/B/C", "N/C", None, 1)
    assert len(got) == 3


def test_what_keeps_a_folder_where_it_is(made):
    files = [("A/A.pdf", "A"), ("A/X.pdf", "X"), ("B/B.pdf", "B"), ("B/deep/" + "d" * 30 + ".pdf", "D"), ("C/C.pdf", "C"), ("N/C/C.pdf", "C"), ("E/E.pdf", "E"), ("F/F.pdf", "F")]
    claims = [("N", "N", "A"), ("N", "N" * 25, "B"), ("M", "M", "B"), ("N", "N", "C"), ("N", "N", "E"), ("N", "N", "F")]
    got = adopted(made, claims, files, {"E": "SAME", "F": "SAME"}, 60)
    assert got["A", "N"][0::3] == ("skip", "shared folder")
    assert got["B", "N" * 25][0::3] == ("skip", "path too long") and got["B", "M"][0] == "move"
    assert got["C", "N"][0::3] == ("skip", "destination exists")
    assert got["E", "N"][0] == "move" and got["F", "N"][0::3] == ("skip", "destination exists")


def test_nothing_to_adopt(made):
    assert adopted(made, [], [("A/A.pdf", "A")], {"A": "A"}) == {} and adopted(made, [("N", "N", "A")], [], {"A": "A"}) == {}


def data(made, stems, entries):
    return runs.Inputs(
        made([(s,) for s in stems], "stem string"),
        made([(a, b, 1, "table", None) for a, b in entries], "stem string, ref string, page int, method string, description string"),
        made([], "stem string, ref string"),
        made([(s, s, s, "-", f"PART {s[-1]}", False) for s in stems], "stem string, file_name string, number string, rev string, name string, scanned boolean"),
        made([], "stem string, page int, line_no int, text string"),
    )


def test_a_batch_is_placed_and_adopts(made):
    stems = ["F10000001", "F10000002", "F10000003", "F10000004"]
    org = made([("F10000001",), ("F10000002",)], "stem string")
    none = org.limit(0)
    # 1 lists the new 3, and the new 4 lists 2, which stands at the top.
    tree = made([("F10000001 PART 1/F10000001.pdf", "F10000001"), ("F10000002 PART 2/F10000002.pdf", "F10000002")], "path string, stem string")
    d = data(made, stems, [("F10000001", "F10000003"), ("F10000004", "F10000002")])
    out = runs.incremental_run(d, org, none, none, tree=tree)
    assert {tuple(r) for r in out["claimants"].collect()} == {("F10000003", "F10000001", "root"), ("F10000004", None, "top")}
    assert [(r["child"], r["action"], r["target"]) for r in out["adoptions"].collect()] == [("F10000002", "move", "F10000004 PART 4/F10000002 PART 2")]


def test_a_batch_of_nothing_has_every_table(made):
    org = made([("F10000001",), ("F10000002",)], "stem string")
    d = data(made, ["F10000001", "F10000002"], [("F10000001", "F10000002")])
    tree = made([], "path string, stem string")
    idle = runs.incremental_run(d, org, org.limit(0), org.limit(0), tree=tree)
    busy = runs.incremental_run(d, org.limit(0), org.limit(0), org.limit(0), tree=tree)
    assert set(idle) == set(busy) and all(idle[k].columns == busy[k].columns for k in idle if k != "live")
    kept = {"live", "counters", "placement_refused"}
    assert all(idle[k].isEmpty() for k in set(idle) - kept) and idle["live"].count() == 2 and sum(idle["counters"].first()) == 0
