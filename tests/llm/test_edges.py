"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partloom.llm import bpe, chat, decontaminate, langid, lmscore, neardup, secrets, tokenbin, topk, toxicity

LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, "the cat sat on the mat and looked at the moon over the hill", "en", "a", 59),
    (2, None, "en", "a", None),
    (3, "", "en", "a", 0),
    (4, "   \n\t ", "fr", "b", 6),
    (5, "12345 --- !!!", "fr", "b", 13),
    (6, LONG, "la", "c", len(LONG)),
    (7, "x" * 70_000, None, "c", 70_000),
    (8, "le chat est sur le tapis et regarde la lune sur la colline", "fr", "b", 58),
    (8, "le chat est sur le tapis et regarde la lune sur la colline", "fr", "b", 58),
    (9, "the cat sat on the mat and looked at the moon over the hill", None, None, 59),
    (10, "漢字 かな \u0000 🙂 é   \x1c <|endoftext|> Ⅷ İ", "ja", "d", 30),
    (11, 'token = "1a19e9019a7ceca6f2adb7b9e012196032067fe2"', "en", "a", 50),
    (11, "another text stands under the id of the one before it", "en", "a", 53),
    (None, "la lune regarde le tapis et le chat sur la colline", "fr", "b", 50),
    (None, None, None, None, None),
]
KEY = lambda i: (i is None, i or 0)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    clash = ["score", "lang_pred", "row", "node", "held", "block", "label", "part", "h", "n", "component_id", "sig", "key", "spans", "ids"]
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "looked at the moon"), (1, "looked at the moon"), (2, None), (3, ""), (4, "ipsum " * 3)], "item_id bigint, text string").withColumn("row", F.lit(1))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (6, 1, 0), (8, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")


def digests(docs, bench, labels):
    return {
        "op1": lambda d: langid.digest(d),
        "op2": lambda d: lmscore.digest(d),
        "op3": lambda d: bpe.round_trip(d),
        "op5": lambda d: neardup.digest(d),
        "op7": lambda d: decontaminate.digest(d, bench),
        "op8": lambda d: tokenbin.digest(d),
        "op9": lambda d: toxicity.digest(d, labels),
        "op10": lambda d: secrets.digest(d),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op7", "op8", "op9", "op10"])
def test_each_row_gets_its_row(docs, bench, labels, name):
    rows = digests(docs, bench, labels)[name](docs).collect()
    assert sorted((r["doc_id"] for r in rows), key=KEY) == sorted((r[0] for r in ROWS), key=KEY)
    same = [r for r in rows if r["doc_id"] == 8]
    assert {k: v for k, v in same[0].asDict().items() if k != "start"} == {k: v for k, v in same[1].asDict().items() if k != "start"}


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op7", "op8", "op9", "op10"])
def test_empty_tables(docs, bench, labels, name):
    assert digests(docs, bench.limit(0), labels.limit(0))[name](docs.limit(0)).collect() == []


def test_empty_side_tables(docs, bench, labels):
    assert {r["n_hit"] for r in decontaminate.digest(docs, bench.limit(0)).collect()} == {0}
    assert {r["score"] for r in toxicity.digest(docs, labels.limit(0)).collect()} == {0.0}


def test_texts_without_letters_have_no_language(docs):
    got = {r["doc_id"]: r for r in langid.digest(docs).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2, 3, 4, 5))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    unlabelled = langid.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_unlabelled_documents_are_accepted(docs):
    got = langid.accepted(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert sorted((r["doc_id"] for r in got), key=KEY) == [1, 6, 7, 8, 8, 9, 10, 11, 11, None] and {r["lang"] for r in got} == {None}
    assert [r["doc_id"] for r in langid.accepted(docs.where("doc_id = 5 or doc_id = 9")).collect()] == [9]


def test_null_and_empty_texts_are_alike(docs, bench):
    got = {r["doc_id"]: r for r in lmscore.digest(docs).collect()}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == got[4]["n_tokens"] == 1
    assert got[2]["score"] == got[3]["score"]
    hit = {r["doc_id"]: r for r in decontaminate.digest(docs, bench).collect()}
    assert (hit[1]["n_hit"], hit[1]["n_items"], hit[9]["contaminated"], hit[2]["n_words"]) == (4, 1, True, 0)
    near = {r["doc_id"]: r for r in neardup.digest(docs).collect()}
    assert near[9]["component_id"] == 1 and not near[9]["kept"]
    assert [near[k]["n_shingles"] for k in (2, 3, 4)] == [0, 0, 0] and near[3]["component_id"] == 3


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "a"), (2, 5, "assistant", ""), (2, 1, "user", "<|end|>\n" * 1000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"head": F.lit(1), "size": F.lit(2), "at": F.lit(3), "prompt": F.lit("p")})
    got = {r["conv_id"]: r for r in chat.digest(df).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 2, -1: 2}
    assert got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == 0
    assert [r["conv_id"] for r in chat.digest(df.limit(0)).collect()] == [-1]


def test_topk_edges(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, []), (100, []), (9, [-1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"v": F.lit(1), "shard": F.lit(1), "block": F.lit(1)})
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.digest(df).collect()]
    assert sorted(x for x in got if x[0] == 0) == [(0, 1, 50, 5 * 65536), (0, 2, 50, 5 * 65536), (0, 3, 9, -5 * 65536)]
    assert {x[0] for x in got} == {0, 50}
    assert topk.digest(df.limit(0)).collect() == []


def test_pipeline_stages_keep_columns_and_clean_rows(spark, docs, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at = at.cache()
    kept = {r["doc_id"]: r for r in at.collect()}
    assert sorted((r["doc_id"] for r in at.collect()), key=KEY) == [6, 7, 8, 10, 11, 11, None]
    kept |= {r["text"][:5]: r for r in at.collect() if r["doc_id"] == 11}
    assert kept[6]["text"] == LONG and kept[7]["lang"] in ("en", "fr", "la", "ja")
    assert all("1a19" not in r["text"] for r in kept.values())
    assert kept["anoth"]["n_chars"] == 53 and kept["[ASSI"]["n_chars"] == len(kept["[ASSI"]["text"])
    last = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert all(r["restored"] for r in last) and len(last) == 7
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
