"""Every query against its SQL twin, and the queries without one against plain loops."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from partloom.operators import graph
from partloom.plans import registry
from partloom.plans.core import TARGET, TIGHT
from partloom.plans.views import views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def canonical(names, rows):
    def cell(v):
        return "~" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, data, sql, name):
    df = registry.QUERIES[name](spark, data)
    result = sql.execute(registry.ORACLES[name])
    want = canonical([d[0] for d in result.description], result.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


def test_reconcile_plan_has_every_placement(spark, tmp_path):
    """More copies below one root than the caps on placing them (10,000 copies, 80,000 paths) let through."""
    c = duckdb.connect()
    c.execute("CREATE TABLE part AS SELECT i AS p_partkey, 'bolt ' || i AS p_name, 'STEEL' AS p_type, CAST(1 + i % 5 AS INTEGER) AS p_size FROM range(1100) t(i)")
    c.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    got = registry.QUERIES["reconcile_plan"](spark, str(tmp_path))
    want = c.execute(registry.ORACLES["reconcile_plan"])
    names, rows = canonical([d[0] for d in want.description], want.fetchall())
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == (names, rows)
    v = views(spark, str(tmp_path))
    planned = v.counted_roots.agg(F.sum("copies").cast("long").alias("n")).first()["n"]
    assert planned > graph.PATH_CAP and len(rows) > graph.PATH_CAP
    action, target = names.index("action"), names.index("target")
    assert {r[action] for r in rows} == {"keep", "move", "copy", "delete", "review"}
    in_place = sum(r[action] == "keep" or r[target] != "~" for r in rows)
    assert planned - in_place == v.every_placement.join(got.select("stem").distinct(), "stem", "left_anti").count()


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["root", "n_children"]
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_cycles_are_cut_as_a_plain_walk_does(spark, data):
    v = views(spark, data)
    from partloom.operators import resolve

    edges = [tuple(r) for r in resolve.graph_edges(resolve.snapped(v.bom_cyclic, v.snaps), v.active).collect()]
    got = {tuple(r) for r in registry.QUERIES["break_cycles"](spark, data).collect()}
    assert got == set(graph._depth_first_back_edges(edges)) and got


def test_rows_by_y_is_first_fit(spark, data):
    from partloom.sources import pages

    words = pages.page_words(views(spark, data)).orderBy("stem", "word_no").collect()
    want, tops, last = {}, [], None
    for w in words:
        if w["stem"] != last:
            tops, last = [], w["stem"]
        i = next((k for k, t in enumerate(tops) if abs(t - w["y"]) <= 3), len(tops))
        if i == len(tops):
            tops.append(w["y"])
        want[w["stem"], w["word_no"]] = i
    assert {(r["stem"], r["word_no"]): r["row_no"] for r in registry.QUERIES["rows_by_y"](spark, data).collect()} == want


def test_folders_are_trimmed_until_paths_fit(spark, data):
    before = {r["stem"]: r["folder"] for r in registry.QUERIES["folder_names"](spark, data).collect()}
    after = {r["stem"]: r["folder"] for r in registry.QUERIES["shortened_folders"](spark, data).collect()}
    assert before.keys() == after.keys()
    units = lambda names, p: len("/".join([TARGET, *(names[s] for s in p), f"{p[-1]}.pdf"]))
    paths = [r["path"].split("/") for r in registry.QUERIES["planned_paths"](spark, data).collect()]
    assert any(units(before, p) > TIGHT for p in paths)
    for p in paths:
        assert units(after, p) <= TIGHT or all(len(after[s]) <= len(s.split("_")[0]) for s in p)
    on_long = {s for p in paths if units(before, p) > TIGHT for s in p}
    for s, name in after.items():
        assert before[s].startswith(name) and len(name) >= len(s.split("_")[0]) and (name == before[s] or s in on_long)
