"""Golden cases and invariants of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from partloom.functions import identity, text
from partloom.operators import checks, extract, graph, incremental, naming, ranking, report, resolve
from partloom.plans import runs
from partloom.plans.reports import inputs
from partloom.plans.views import views


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def stems(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "stem string")


@pytest.mark.parametrize(
    "name, stem, title",
    [
        ("F10126106", "F10126106", None),
        ("2.20.3.9 F10196150--CHK", "F10196150__CHK", None),
        ("f10187622-b-chk", "F10187622_B_CHK", None),
        ("F10137913 KIT, MAGNETIC", "F10137913", "KIT, MAGNETIC"),
        ("FC10012345 - bolt.", "FC10012345", "bolt"),
        ("XF10126106", None, None),
        ("F1234", None, None),
        ("F123456789", None, None),
        ("notes", None, None),
        (None, None, None),
    ],
)
def test_names_of_files(spark, name, stem, title):
    assert one(spark, name, identity.canonical_stem) == stem
    assert one(spark, name, identity.filename_title) == title


@pytest.mark.parametrize("stem, rank", [("F10126106", 0), ("F10126106_A", 1), ("F10126106_a", 1), ("F10126106_B", 2), ("F10126106_Z", 26), ("F10126106_AA", 27), ("F10126106_AB_CHK", -972), ("F10126106__CHK", -1000), ("F10126106___DWG1", 0)])
def test_revision_ranks(spark, stem, rank):
    assert one(spark, stem, identity.revision_rank) == rank


def test_sheets_and_text(spark):
    assert one(spark, "F10126107_B___DWG2_XML7", identity.sheet_token) == "DWG2"
    assert one(spark, "F10126107", identity.sheet_token) is None
    assert one(spark, 'a/b: "c"  d. ', text.sanitize) == "a-b- c d"
    assert one(spark, "(FIOI26IO6)", text.ocr_token) == "F10126106"
    assert one(spark, "a🙂", lambda c: text.path_units(c, utf16=True)) == 3
    assert one(spark, "=1+1", text.inert) == "'=1+1"


KNOWN = ("F10126106", "F10126107_A", "F10126107_B", "F10126107_B___DWG1", "F10126107_B___DWG2", "F10126107_B_XML2347", "F10126108", "F10126108_CHK", "F10126999_A", "FC10012345")


@pytest.mark.parametrize(
    "ref, found",
    [
        ("F10126106", {"F10126106"}),
        ("F10126107", {"F10126107_B", "F10126107_B___DWG1", "F10126107_B___DWG2"}),
        ("F10126107_A", {"F10126107_A"}),
        ("F10126108", {"F10126108"}),
        ("F10126108_CHK", {"F10126108_CHK"}),
        ("F10126999", {"F10126999_A"}),
        ("F1012610", set()),
        ("F10126107_C", set()),
    ],
)
def test_matching(spark, ref, found):
    refs = spark.createDataFrame([(ref,)], "ref string")
    assert {r["stem"] for r in resolve.match_refs(refs, stems(spark, *KNOWN)).collect()} == found


def test_snapping(spark):
    refs = spark.createDataFrame([("F101261066",), ("F1012610",), ("F10116106",), ("F1O1261O6",), ("FC1012610",)], "ref string")
    got = {r["ref"]: r["snapped"] for r in resolve.snap_refs(refs, stems(spark, "F10126106", "F10126107", "F10126108")).collect()}
    assert got == {"F101261066": "F10126106", "F1O1261O6": "F10126106"}


def test_deletion_neighbourhoods_find_all_at_distance_one(spark):
    draw = random.Random(1)
    words = ["".join(draw.choice("ab1") for _ in range(draw.randint(1, 5))) for _ in range(120)]
    df = spark.createDataFrame([(w,) for w in set(words)], "a string")
    keys = df.withColumn("key", F.explode(resolve._neighbourhood(F.col("a"))))
    pairs = keys.join(keys.withColumnRenamed("a", "b"), "key").where(text.edit_distance_one(F.col("a"), F.col("b"))).select("a", "b").distinct()
    every = df.crossJoin(df.withColumnRenamed("a", "b")).where(F.levenshtein("a", "b") == 1)
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in every.collect()}


def test_title_blocks(spark):
    rows = [
        ("F10126106", "F10126106", "F10126107", "A", "X", False),
        ("F10126107_A", "F10126107_A", "F10126107", None, "X", False),
        ("F10126108_A", "F10126108_A", "F10126108", "-", "X", False),
        ("F10126109", "F10126109 red valve", "F10126109", "-", "Blue pump", False),
        ("F10126110", "F10126110 red valve", "F10126110", "-", "VALVE, large", False),
        ("F10126111", "F10126111", "F10126112", "-", None, True),
    ]
    df = spark.createDataFrame(rows, "stem string, file_name string, number string, rev string, name string, scanned boolean")
    got = {(r["stem"], r["field"]) for r in checks.titleblock_mismatches(df).collect()}
    assert got == {("F10126106", "number"), ("F10126108_A", "revision"), ("F10126109", "name")}


def test_votes_and_fallbacks(spark):
    e = spark.createDataFrame([("a", "F1", "x"), ("b", "F1", "y"), ("c", "F1", "y"), ("a", "F2", "q"), ("b", "F2", "p"), ("a", "F3", " ")], "stem string, ref string, description string")
    assert {r["ref"]: r["name"] for r in naming.vote_winners(e).collect()} == {"F1": "y", "F2": "p"}
    names = spark.createDataFrame([("F10126107_A", "valve"), ("F10126107_B", "pump")], "stem string, name string")
    got = naming.family_fallback(stems(spark, "F10126107_A___DWG1", "F10126107_CHK", "F10126107_B", "F10126107_A_XML2"), names)
    assert {r["stem"]: r["name"] for r in got.collect()} == {"F10126107_CHK": "pump", "F10126107_A_XML2": "valve"}


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs) or [("", "")], "parent string, child string").where("parent <> ''")


def test_cycles(spark):
    assert graph.cycle_edges(edges(spark, ("A", "B"), ("B", "A"))).count() == 1
    assert graph.cycle_edges(edges(spark, ("A", "B"), ("B", "C"), ("A", "C"))).count() == 0
    draw = random.Random(8)
    for _ in range(4):
        pairs = {(f"n{draw.randrange(9)}", f"n{draw.randrange(9)}") for _ in range(16)}
        pairs = {p for p in pairs if p[0] != p[1]}
        got = {tuple(r) for r in graph.cycle_edges(edges(spark, *pairs)).collect()}
        assert got == set(graph._depth_first_back_edges(sorted(pairs)))
        assert graph._depth_first_back_edges(sorted(pairs - got)) == []


def test_counts_and_caps(spark):
    ladder = [(f"{k}{s}", f"{k + 1}{t}") for k in range(100, 117) for s in "ab" for t in "ab"]
    counted = {r["stem"]: int(r["copies"]) for r in graph.path_counts(edges(spark, *ladder), stems(spark, "100a")).collect()}
    assert counted["100a"] == 2**18 - 1
    roots = spark.createDataFrame([("r1", 2), ("r2", 2)], "stem string, copies long").withColumn("copies", F.col("copies").cast(graph.COUNT))
    assert {r["stem"]: r["kept"] for r in graph.fit_roots(roots, 3).collect()} == {"r1": False, "r2": True}
    with pytest.raises(ValueError):
        graph.planned_paths(edges(spark, *ladder), stems(spark, "100a"))
    assert graph.planned_paths(edges(spark), stems(spark, "x")).count() == 1


def test_archive_and_reconcile(spark):
    files = spark.createDataFrame([(1, "n", "a"), (2, "n", "b"), (3, "n", "a"), (4, "m", "b"), (5, "n", "c")], "seq long, name string, content string")
    assert {r["seq"]: r["suffix"] for r in incremental.archive_targets(files).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 2}
    at = lambda *rows: spark.createDataFrame(list(rows), "stem string, folder string")
    held = lambda *rows: spark.createDataFrame(list(rows), "stem string, folder string, content string")
    actual = held(("a", "1", "x"), ("a", "9", "x"), ("b", "2", "x"), ("b", "8", "x"), ("b", "8b", "y"), ("b", "8c", None), ("c", "7", "x"), ("e", "4", "p"), ("e", "5", "q"), ("e", "6", "p"))
    got = incremental.reconcile(actual, at(("a", "1"), ("a", "3"), ("a", "5"), ("b", "2"), ("d", "4"), ("e", "1")))
    assert {(r["stem"], r["folder"], r["action"], r["target"]) for r in got.collect()} == {
        ("a", "1", "keep", None), ("a", "9", "move", "3"), ("a", None, "copy", "5"),
        ("b", "2", "keep", None), ("b", "8", "delete", None), ("b", "8b", "review", None), ("b", "8c", "review", None),
        ("e", "4", "move", "1"), ("e", "5", "review", None), ("e", "6", "delete", None),
    }
    plan = incremental.reconcile(held(("a", "1", "x")), at(("a", "1")))
    assert {r["action"] for r in plan.collect()} == {"keep"}
    marked = spark.createDataFrame([("a", "p", "x", True), ("b", "p", "x", True), ("c", "p", "z", False), ("d", "p", "z", True)], "stem string, path string, content string, watermarked boolean")
    live = spark.createDataFrame([("a", "y", False), ("b", "y", True), ("c", "y", False)], "stem string, content string, watermarked boolean")
    old = spark.createDataFrame([("c", "z"), ("d", "w")], "stem string, content string")
    assert {(r["stem"], r["identical"]) for r in incremental.retired(marked, live, old).collect()} == {("a", False), ("c", True)}
    gone = incremental.promoted_sources(stems(spark, "a", "b"), spark.createDataFrame([("a", "1", "y"), ("b", "2", "n"), ("c", "3", "y")], "stem string, path string, content string"), live)
    assert {(r["stem"], r["action"]) for r in gone.collect()} == {("a", "remove"), ("b", "keep")}


def test_scalar_repairs(spark):
    said = {"FLO|44633": "F10144633", "|F10126513]SSR2": "F10126513", "(FIOI26IO6)": "F10126106", "FC1234567": None, "xF12345": None, "F1234": None}
    for word, want in said.items():
        assert one(spark, word, text.ocr_token) == want, word
    assert [one(spark, w, text.ocr_number_rank) for w in ("F12345", "FC12345", "F1O345", "12345678")] == [0, 0, 1, 2]
    assert one(spark, "a\u00a0b\u2003 c", text.normalize) == "ABC"
    assert one(spark, "a\u00a0\u2003b ", text.sanitize) == "a b"
    assert one(spark, "a\x1bb\u202ec\x9fd", text.visible) == "a\\x1bb\\u202ec\\x9fd"
    sizes = spark.createDataFrame([(7152.0, 5000.0), (595.0, 842.0), (0.0, 10.0), (1684.0, 1191.0)], "w double, h double")
    got = sizes.select(F.round(text.iso_scale(F.col("w"), F.col("h")), 2), text.render_dpi(F.col("w"), F.col("h"))).collect()
    assert [tuple(r) for r in got] == [(2.12, 208), (1.0, 300), (1.0, 300), (1.0, 300)]
    blocks = spark.createDataFrame([("F1_A", "F1_A", "", "A", None, False)], "stem string, file_name string, number string, rev string, name string, scanned boolean")
    assert checks.titleblock_mismatches(blocks).count() == 0


def test_fit_roots_with_weights_and_extra(spark):
    counted = spark.createDataFrame([(f"s{k}", c) for k, c in enumerate((5, 5, 5, 3, 1))], "stem string, copies long").withColumn("copies", F.col("copies").cast("decimal(38,0)"))
    keeps = lambda *a, **k: {r["stem"] for r in graph.fit_roots(counted, *a, **k).where("kept").collect()}
    assert keeps(19) == {"s0", "s1", "s2", "s3", "s4"}
    assert keeps(18) == {"s1", "s2", "s3", "s4"} and keeps(9) == {"s2", "s3", "s4"}
    assert keeps(19, extra=10) == {"s2", "s3", "s4"} and keeps(0) == set()
    more = spark.createDataFrame([("s4", 10)], "stem string, copies long")
    assert keeps(19, weights=more) == {"s1", "s2", "s3"} or keeps(19, weights=more) == {"s0", "s1", "s2", "s3"}
    with pytest.raises(ValueError):
        graph.path_counts(spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string"), stems(spark, "a"), depth=9)


def test_extraction(spark):
    def lines(*texts):
        return spark.createDataFrame([("s", 1, i, t) for i, t in enumerate(texts)], "stem string, page int, line_no int, text string")

    used = extract.used_on_values(lines("x", "USED ON", "F1012 f", "", "FC12345a", "SCALE", "F999"))
    assert [r["ref"] for r in used.orderBy("line_no").collect()] == ["F1012", "FC12345A"]
    assert extract.used_on_values(lines("F1", "none")).count() == 0
    assert extract.drawing_names(lines("PART", "NAME", "cell", "Name", "Valve")).first()["name"] == "Valve"
    assert extract.drawing_names(lines("NAME", "SHEET")).count() == 0
    assert extract.watermark_phrases(lines("Drafting", "for  review only")).first()["evidence"] == "watermark text: FOR REVIEW ONLY"
    assert extract.join_split_numbers(lines("F", "1234567", "8")).count() == 2


def test_report_helpers(spark):
    rows = spark.createDataFrame([(f"l{k:02d}",) for k in range(13)], "line string")
    assert [r["line"] for r in report.first_lines(rows, "line").collect()][-1] == "... 3 more"
    links = spark.createDataFrame([("s", "b/p", 1), ("s", "a/p", 0), ("t", "x" * 300, 0)], "stem string, path string, class_rank int")
    assert {r["stem"]: r["link"] for r in report.links(links).collect()} == {"s": "a/p", "t": None}


def test_modes_agree(spark, data):
    """A batch on top of an organized catalogue ends where a full run does, in whatever order drawings came."""
    v = views(spark, data)
    full = runs.full_run(inputs(v))
    data_in = inputs(v)
    nothing = v.organized.select("stem").limit(0)
    later = runs.incremental_run(runs.Inputs(v.incoming.select("stem").union(v.archive.select("stem")), data_in.bom_entries, data_in.used_on, data_in.title_blocks, data_in.lines), v.organized.select("stem"), nothing, nothing)
    rows = lambda df: sorted(map(str, df.collect()))
    for key in ("live", "missing", "chk", "orphans", "roots", "used_on_mismatches", "used_on_bugs", "titleblock_mismatches", "names", "skipped_roots", "counters"):
        a, b = full[key], later[key]
        assert rows(a.select(sorted(a.columns)) if key != "live" else a.select("stem")) == rows(b.select(sorted(b.columns)) if key != "live" else b.select("stem")), key


def test_repair_converges(spark, data):
    v = views(spark, data)
    actual = v.active.where("p % 4 = 0 and p < 60").select(F.concat(F.lit("x/"), "stem", F.lit("/"), "stem", F.lit(".pdf")).alias("path"), "stem", F.lit("c").alias("content"))
    run = runs.repair_run(inputs(v), v.organized.select("stem"), v.archive.select("stem"), actual)
    assert {r["action"] for r in run["repair"].collect()} >= {"move"}
    again = runs.repair_run(inputs(v), run["live"].select("stem"), v.archive.select("stem").limit(0), run["tree"].select("path", "stem", "content"))
    assert {r["action"] for r in again["repair"].collect()} <= {"keep", "review", "skip"} and {r["path"] for r in again["tree"].collect()} == {r["path"] for r in run["tree"].collect()}


def test_ranking_ignores_order_and_repeats(spark):
    names = [*KNOWN, *KNOWN]
    random.Random(3).shuffle(names)
    once = {r["stem"] for r in ranking.active(stems(spark, *KNOWN)).collect()}
    assert {r["stem"] for r in ranking.active(stems(spark, *names).repartition(7)).collect()} == once
    assert once | {r["stem"] for r in ranking.superseded(stems(spark, *names)).collect()} == set(KNOWN)


def test_lone_numbers(spark):
    texts = ["PARTS LIST", "1", "F10126106", "F10126107", "USED ON", "F10126108", "F10126109", "see also", "F10126110", "x"]
    df = spark.createDataFrame([("s", 1, i, t) for i, t in enumerate(texts)], "stem string, page int, line_no int, text string")
    got = {r["ref"]: (r["title_block"], r["listed"]) for r in extract.lone_numbers(df).collect()}
    assert got == {"F10126106": (False, True), "F10126107": (True, True), "F10126108": (True, False), "F10126109": (True, False), "F10126110": (False, False)}


def test_positions(spark):
    rows = [(0, 10.0, 5.0, "ITEM"), (1, 50.0, 5.5, extract.OWNER), (2, 90.0, 5.0, "NAME"), (3, 50.0, 90.0, extract.OWNER), (4, 10.0, 15.0, "1"), (5, 50.0, 16.0, "F10126106"), (6, 90.0, 15.0, "PUMP"), (7, 120.0, 15.0, "RED"), (8, 52.0, 25.0, "F10126107"), (9, 200.0, 35.0, "F10126108"), (10, 5.0, 45.0, "SCALE"), (11, 51.0, 45.0, "F10126109")]
    df = spark.createDataFrame([("s", 1, *r) for r in rows], "stem string, page int, word_no int, x double, y double, text string")
    anchor = extract.list_anchor(df.withColumns({"x1": F.col("x") + 30, "y1": F.col("y") + 3})).first()
    assert (anchor["x"], anchor["y"], anchor["score"], anchor["item_x"], anchor["side"]) == (50.0, 5.5, 5, 10.0, "below")
    assert [one(spark, w, extract.is_list_label) for w in (f"_{extract.OWNER}#", extract.OWNER.lower().replace("i", "1"), "ITEM", extract.OWNER + "X")] == [True, True, False, False]
    got = {(r["item"], r["ref"], r["description"]) for r in extract.positional_entries(df.withColumns({"x1": F.col("x") + 30, "y1": F.col("y") + 3})).collect()}
    assert got == {(1, "F10126106", "PUMP RED")}  # the second number has no item


def test_captions(spark):
    yes = ["USED ON", "used  on F10126107", "USED ON 2 A", "SCALE 1:1", "SHEET 1 OF 2", "REV", "SIZE A3", "DRAWING NUMBER F10126107", "NUMBER F10126107a", "NEXT ASSY FC1234567", "REV B"]
    no = ["ITEM 1 F10126107", "SHEET METAL BRACKET", "BRACKET USED ON ASSY", "", "USED", "SCALE TO FIT", "F10126107", "USED ON ASSY"]
    assert all(one(spark, w, extract.is_caption) for w in yes) and not any(one(spark, w, extract.is_caption) for w in no)
    assert [one(spark, w, extract.is_used_on) for w in ("USED ON F1", "SCALE 1:1", "USED ON", "BRACKET USED ON")] == [True, False, True, False]


def test_used_on_labels_in_rows(spark):
    rows = {
        ("USED ON", "NAME"): 0.0, ("BREAK EDGES", "USED ON", "NAME"): 10.0, ("2", "USED", "ON", "F10126107"): 10.0, ("BRACKET", "USED", "ON", "ASSY"): None,
        ("USED", "FOR"): None, ("USED ON F10126107", "WASHER"): None, ("used", "on"): 0.0, ("USED",): None,
    }
    df = spark.createDataFrame([(k, [(10.0 * i, w) for i, w in enumerate(row)]) for k, row in enumerate(rows)], "k int, tokens array<struct<x:double,text:string>>")
    got = {r["k"]: r["x"] for r in df.select("k", extract.used_on_x(F.col("tokens")).alias("x")).collect()}
    assert got == dict(enumerate(rows.values()))


def test_entries_of_a_whole_document(spark):
    cells = spark.createDataFrame([("s", 2, 0, 0, ["ITEM", extract.OWNER + "#"]), ("s", 2, 0, 1, ["1", "F10126101"])], "stem string, page int, table_no int, row_no int, cells array<string>")
    lines = spark.createDataFrame([("s", 1, k, t) for k, t in enumerate(["PARTS LIST", "1", "F10126101", "PUMP", "2", "F10126102", "PLATE"])], "stem string, page int, line_no int, text string")
    at = [(0, 10.0, 10.0, "ITEM"), (1, 50.0, 10.0, extract.OWNER), (2, 10.0, 80.0, "3"), (3, 50.0, 80.0, "F10126103"), (4, 90.0, 80.0, "BOLT"), (5, 10.0, 90.0, "1"), (6, 50.0, 90.0, "F10126101")]
    words = spark.createDataFrame([("s", 1, n, x, y, x + 30, y + 3, t) for n, x, y, t in at], "stem string, page int, word_no int, x double, y double, x1 double, y1 double, text string")
    got = {(r["ref"], r["page"], r["method"], r["description"]) for r in extract.document_entries(cells, lines, words).collect()}
    assert got == {("F10126101", 2, "table", "PUMP"), ("F10126102", 1, "text-fallback", "PLATE"), ("F10126103", 1, "positional", "BOLT")}
