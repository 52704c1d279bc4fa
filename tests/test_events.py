"""Events of scans, merged from any parts."""

import random
from functools import reduce

from partloom.operators import events

EVENT = "stem string, seq long, page int, used_on array<string>, name string, bom array<string>, seconds double"


def expected(rows):
    out = {}
    for stem, _, page, used, name, bom, secs in sorted(rows, key=lambda r: r[1]):
        e = out.setdefault(stem, [set(), [], None, [], 0])
        if page is not None:
            e[0].add(page)
        e[1] = e[1] or list(used or [])
        e[2] = e[2] or name or None
        e[3] += [v for k, v in enumerate(bom or []) if v not in e[3] and v not in bom[:k]]
        e[4] += round((secs or 0) * 8)
    return {s: (sorted(p), u, n, b, x / 8) for s, (p, u, n, b, x) in out.items()}


def told(state):
    return {r["stem"]: (list(r["pages"]), list(r["used_on"]), r["name"], list(r["bom"]), float(r["seconds"])) for r in events.read(state).collect()}


def test_any_parts_give_one_state(spark):
    draw = random.Random(2)
    some = lambda: draw.choice([None, [], draw.choices("abcd", k=draw.randint(1, 4))])
    rows = [(draw.choice("xyz"), k, draw.choice([None, 1, 2, 3]), some(), draw.choice([None, "", "N1", "N2"]), some(), draw.choice([None, 0.125, 0.5])) for k in range(60)]
    every = events.states(spark.createDataFrame(rows, EVENT))
    want = expected(rows)
    assert told(events.merged(every)) == want
    for parts in (2, 7):
        cut = [[r for r in rows if (r[1] * 13 + r[1] // 3) % parts == k] for k in range(parts)]
        made = [events.merged(events.states(spark.createDataFrame(c, EVENT))) for c in cut if c]
        assert told(events.merged(reduce(lambda a, b: a.unionByName(b), made))) == want
    t = {r["stem"]: (r["files"], r["pages"], float(r["seconds"])) for r in events.totals(events.merged(every)).collect()}
    assert t == {s: (1, len(p), x) for s, (p, *_, x) in want.items()} | {None: (3, sum(len(p) for p, *_ in want.values()), sum(x for *_, x in want.values()))}
    lines = {r["stem"]: r["line"] for r in events.report_lines(events.merged(every)).collect()}
    p, u, n, b, _ = want["x"]
    assert lines["x"] == f"x: page(s) {', '.join(map(str, p))}: USED ON={','.join(u)}; NAME={n}; BOM={','.join(b)}"


def test_no_events(spark):
    none = events.merged(events.states(spark.createDataFrame([], EVENT)))
    assert told(none) == {} and events.scanned_stems(none).count() == 0
    assert [tuple(r)[:2] for r in events.totals(none).collect()] in ([], [(None, 0)])
