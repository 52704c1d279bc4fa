"""Token alignment against a plain two-pointer loop."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from partloom.llm import align, bpe

DOCS = "doc_id long, text string, count long, place string"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(bpe.VOCAB))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.PIECES))


def plain(text, libraries):
    """Ids of both sides, groups and links of one text, token by token."""
    a, b = libraries
    own, chars = [], bpe._byte_chars()
    if text:
        e = a.encode(" " + text, add_special_tokens=False)
        x = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in e.ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        own = [x, y]
    raw = (" " + (text or "")).encode()
    if not own or any(b"".join(t for _, t in side) != raw for side in own):
        return [], [], [], []
    links, groups, i, j, end_i, end_j, begin = [], [], 0, 0, len(x[0][1]), len(y[0][1]), (0, 0)
    while i < len(x):
        links.append((x[i][0], y[j][0]))
        if end_i == end_j:
            groups.append(([t for t, _ in x[begin[0] : i + 1]], [t for t, _ in y[begin[1] : j + 1]]))
            i, j = i + 1, j + 1
            begin = (i, j)
            if i < len(x):
                end_i, end_j = end_i + len(x[i][1]), end_j + len(y[j][1])
        elif end_i < end_j:
            i += 1
            end_i += len(x[i][1])
        else:
            j += 1
            end_j += len(y[j][1])
    return [t for t, _ in x], [t for t, _ in y], groups, links


def expected(texts, libraries):
    got = [plain(t, libraries) for t in texts]
    count = Counter(p for *_, links in got for p in set(links))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for a, b, groups, links in got:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if a else ""))
    return out, count, top


def odd_texts():
    draw = random.Random(6)
    letters = [*"ab cd  \n\tX1é漢🙂▁.,'\x00", "  ", "<s>", "<0x41>", "<|endoftext|>", " \n", "word", " the", "</s>"]
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 20))) for _ in range(3000)] + [None, "", " ", "  ", "\n", "a " * 4000, "the the"] * 2


def test_pieces_are_the_library(libraries):
    texts = [t for t in odd_texts() if t and "▁" not in t]
    ids, counts = align.tokenizers().b.encode_many([" " + t for t in texts])
    want = libraries[1].encode(texts)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("most", [200, align.CHUNK])
def test_every_column_is_that_of_a_loop(spark, libraries, most):
    texts = odd_texts()
    want, count, top = expected(texts, libraries)
    rows = [(k if k % 7 else None, t, k, str(k)) for k, t in enumerate(texts)]
    got = align.digest(spark.createDataFrame(rows, DOCS).repartition(3, "place"), most=most).collect()
    key = lambda k, w: (rows[k][0] is not None, rows[k][0] or 0, *w)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got) == sorted(key(k, w) for k, w in enumerate(want))
    if most == align.CHUNK:
        lex = {(r["a"], r["b"]): (r["count"], r["best"]) for r in align.lexicon(spark.createDataFrame(rows, DOCS)).collect()}
        assert lex == {p: (n, n == top[p[0]]) for p, n in count.items()}


def test_groups_are_those_of_a_loop(spark, libraries):
    texts = odd_texts()[:400]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: [(list(g["a"]), list(g["b"])) for g in r["groups"]] for r in align.aligned_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: plain(t, libraries)[2] for k, t in rows}


def test_an_empty_table_gives_none(spark):
    assert align.digest(spark.createDataFrame([], DOCS)).collect() == []
    assert align.lexicon(spark.createDataFrame([(1, None, 1, ""), (2, "", 1, "")], DOCS)).collect() == []


def test_long_texts_and_repeated_rows(spark, libraries):
    text = " ".join(f"w{k % 977} état" for k in range(60_000))
    rows = [(1, text, 1, ""), (1, text, 1, ""), (2, "short", 1, "")]
    got = align.digest(spark.createDataFrame(rows, DOCS)).orderBy(F.desc("n_a")).collect()
    want, *_ = expected([t for _, t, *_ in rows], libraries)
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)
