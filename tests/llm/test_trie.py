"""The prefix trie against sets of prefixes."""

import hashlib
import random
import zlib

import pytest

from partloom.llm import trie

ROWS = "conv_id long, turn long, role string, text string, depth long, node string"


def said(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def expected(rows, rebuild=True):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, said(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = own.get(family, [])[:h] + turns[h:] if rebuild else turns
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = lambda a: [b for b in members if b[: len(a)] == a]
    kids = {a: [b for b in members if len(b) == len(a) + 1 and b[: len(a)] == a] for a in members}
    out = []
    for a, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(a))
        saved = sum((len(members[b]) - 1) * len(b[-1][1]) for b in below(a) if b)
        out.append((min(cs), len(a), min(members[a[:-1]]) if a else None, len(cs), len(kids[a]), sum(not kids[b] for b in below(a)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def sample(seed, n, most):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-250, 1300), n):
        for k in range(draw.choice([0, 1, 2, 3, most])):
            rows.append((c, draw.choice([k, k, k, None]), draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", "ccc", "", None, "é🙂"]), 1, "x"))
    return rows + [(None, 1, "user", "lost", 1, "x")] + draw.sample(rows, 10)


@pytest.mark.parametrize("seed,n,most,block", [(1, 60, 9, 1024), (2, 150, 3, 2), (3, 40, 30, 4)])
def test_nodes_are_those_of_all_prefixes(spark, monkeypatch, seed, n, most, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = sample(seed, n, most)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    assert sorted((tuple(r) for r in trie.digest(df).collect()), key=str) == expected(rows)
    assert sorted((tuple(r) for r in trie.summary(*trie.sequences(df)).collect()), key=str) == expected(rows, rebuild=False)


def test_one_long_and_one_common_conversation(spark):
    rows = [(7, k, "user", f"t{k % 5}", 0, "") for k in range(3000)] + [(c, k, "user", f"same {k}", 0, "") for c in range(100, 200) for k in range(3)] + [(0, 0, "user", "same 0", 0, "")]
    got = {(r["conv_id"], r["depth"]): r for r in trie.summary(*trie.sequences(spark.createDataFrame(rows, ROWS))).collect()}
    assert got[7, 3000]["n_leaves"] == 1 and got[7, 1]["saved_tokens"] == 0 and got[0, 0]["n_convs"] == 102 and got[0, 0]["n_leaves"] == 2
    assert got[0, 1]["n_convs"] == 101 and got[100, 3]["saved_tokens"] == 99 * 6 and got[0, 0]["saved_tokens"] == 100 * 6 + 2 * 99 * 6
    assert got[100, 3]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(100, 200))).encode()).hexdigest()


def test_few_rounds_of_light_edges(spark):
    rows = [(c, k, "user", f"{c >> (8 - k)}", 0, "") for c in range(256) for k in range(1, 9)]
    tree, named = trie.trie(*trie.sequences(spark.createDataFrame(rows, ROWS)))
    paths = trie.heavy_paths(tree, named)
    assert paths.count() == tree.count() == 511 and paths.agg({"level": "max"}).first()[0] == 8


def test_no_rows_no_nodes(spark):
    assert trie.digest(spark.createDataFrame([], ROWS)).collect() == []
    assert trie.digest(spark.createDataFrame([(None, 1, "a", "b", 1, "")], ROWS)).collect() == []
    # The only turn of a conversation whose family has none: 1 has h = 5, so it is a member of the root alone.
    assert [tuple(r) for r in trie.digest(spark.createDataFrame([(1, 0, "a", "b", 1, "")], ROWS)).collect()] == expected([(1, 0, "a", "b")])
