"""Sample sizes, label numbers and crafted texts that must not change results or cost too much."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import langid, topk, toxicity


def voices(seed, n=4):
    """Texts in invented languages that share an alphabet and half of their syllables."""
    draw = random.Random(seed)
    common = ["".join(draw.choice("bcdfgklmnprst") + draw.choice("aeiou") for _ in range(1)) for _ in range(12)]
    out = []
    for k in range(n):
        own = common + ["".join(draw.choice("bcdfgklmnprst") + draw.choice("aeiou") + draw.choice("nrsl")) for _ in range(12)]
        words = ["".join(draw.choices(own, k=draw.randint(1, 3))) for _ in range(600)]
        weights = [1 / (r + 1) for r in range(len(words))]
        out.append(lambda size, d=random.Random(seed * 31 + k), w=words, p=weights: " ".join(d.choices(w, p, k=size)))
    return out


@pytest.mark.parametrize("letters", [500, 2_000, 8_000, 32_768])
def test_a_small_sample_neither_wins_nor_loses(letters):
    speak = voices(2)
    samples = [(f"l{k}", s(12_000)[:40_000]) for k, s in enumerate(speak)]
    small = [(lang, text[: letters if lang == "l0" else 40_000]) for lang, text in samples]
    cut = [(lang, text[:letters]) for lang, text in samples]
    asked = [(f"l{k}", s(12)) for k, s in enumerate(speak) for _ in range(150)]
    right = lambda model, lang: np.mean([p == want for (want, _), p in zip(asked, langid.Model(model).predict([t for _, t in asked])[0]) if want == lang])
    assert right(small, "l0") >= right(cut, "l0") - 0.02
    assert all(right(small, f"l{k}") >= right(cut, f"l{k}") - 0.02 for k in (1, 2, 3))


def test_groups_of_sample_lengths():
    m = langid.Model([("a", "ab " * 400), ("b", "cd " * 390), ("c", "ef " * 100), ("d", "gh " * 20), ("e", "")])
    assert [(n, [m.langs[i] for i in who]) for n, who in m.groups] == [(1170, ["a", "b"]), (300, ["c"]), (60, ["d"])]
    assert m.predict(["ab ab", "cd cd cd", "ef", "gh gh", "zz", "", None, "12"])[0] == ["a", "b", "c", "d", "a", "und", "und", "und"]


def test_many_labels_fit_a_worker(monkeypatch):
    monkeypatch.setattr(langid, "DENSE_BYTES", 1 << 20)
    draw = random.Random(3)
    text = lambda k: " ".join("".join(draw.choices("abcdefghij"[k % 7 :], k=4)) for _ in range(300))
    samples = [(f"l{k:03d}", text(k)) for k in range(40)]
    m = langid.Model(samples)
    found = m.predict([t[:200] for _, t in samples])[0]
    assert m.dense <= 1 << 20 and any(isinstance(x, langid._Hashed) for _, x in m.machines.values()) and any(isinstance(x, langid._Dense) for _, x in m.machines.values())
    assert np.mean([a == b for a, (b, _) in zip(found, samples)]) > 0.9
    monkeypatch.setattr(langid, "DENSE_BYTES", 1 << 40)
    assert langid.Model(samples).predict([t[:200] for _, t in samples]) == m.predict([t[:200] for _, t in samples])


def test_many_exceptions_in_one_text():
    lexicon = toxicity.Lexicon({" stupid ": 2.0, " trash": 1.0}, ("trash can", "can stupid thing"))
    began = time.time()
    assert lexicon.density("trash can stupid " * 100_000) == pytest.approx(2.0 / 3, rel=1e-4)
    assert time.time() - began < 5
    assert lexicon.density("trash can stupid thing stupid") == lexicon.density("a b c d stupid") > 0


def test_queries_go_only_to_shards_that_can_reach_them(spark):
    """Sixteen far clouds at the corners of a cube of four sides: a query's best stand in its own."""
    rng = np.random.default_rng(4)
    corner = 80 * (np.arange(3200)[:, None] >> np.arange(4) & 1) - 40
    x = np.floor(256 * (np.hstack([corner, np.zeros((3200, 4))]) + rng.normal(size=(3200, 8))))
    df = spark.createDataFrame([(k, [float(e) for e in v]) for k, v in enumerate(x)], "vec_id long, v array<double>")
    points = topk.sharded(df, 32, 3200).cache()
    of = topk.boxes(points)
    shards = len(of[8][0])
    assert shards > 8 and points.groupBy("shard").count().agg({"count": "max"}).first()[0] < 3200 / 4
    asked = df.where("vec_id % 50 = 0")
    best = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, 100)
    floors = best.where("rank = 5").selectExpr("query_id as vec_id", "cast(score as double) as floor")
    met = sum(topk.routed(asked.withColumn("copy", F.col("vec_id")).join(floors, "vec_id"), of, wave).count() for wave in (0, 1, 2))
    assert met < 0.25 * 64 * shards
    want = {(q, r + 1): (i, s) for q in range(0, 3200, 50) for r, (s, i) in enumerate(sorted(((-int(x[q] @ x[i]), i) for i in range(3200) if i != q))[:5])}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], -r["score"]) for r in best.collect()} == want
