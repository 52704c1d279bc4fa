"""Language-model scores by subword lattice likelihood.

A word is a lattice: every piece of an existing subword vocabulary that fits is an arc, and a word that the training texts
have is one more arc, from its begin to its end. The word's probability is the sum over all ways through the lattice, by a
forward recursion in log space over words of any length.

The pieces have unigram weights for each class of training texts (their language labels, used in learning only): a prior
from the vocabulary's own scores (its merge ranks), plus how often its segmentation uses a piece in the distinct words of the
class. The first piece carries the word mark, and after each piece the word ends with the probability that a marked piece
comes next, so words sum to 1. The whole-word arcs weigh the words' counts, discounted by an absolute amount, and what the
discount sets free goes to the pieces; without whole words (an argument of score) there are pieces only, whose weights then
count all training tokens. A share SHARED of each class is that of all classes together. The end of a text is a token of its
own. A document's probability is the sum over the classes. lattice_score is that of the pieces alone, all classes together.

Documents are cut into blocks. A block yields its distinct words and, for each document, indices into them, so that words
(not tokens) meet the table of all words in a join, and each block is scored with its own words only. Between the join and
the sums a word's logarithms have 24 bits (an error of at most 1e-6 a word); the recursion and the sums have 53.

Defined cases: null and empty texts are just the end; without training texts every word has the pieces' probability and the
end has one half; characters without a piece go by their bytes; repeated rows count each, and a null doc_id keeps its row
and counts as training; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import crc_mod, kept, slices, stored
from partloom.llm.shingles import word_spans

VOCAB = "piece_bpe_32k.model"
MARK = "▁"
#: Places of words in the lattices that are summed side by side.
PLACES = 1 << 15
#: Bytes of the texts of a block, to the batch.
BLOCK_BYTES = 16_000_000
#: Weight of the prior, in counts, and the rank by which it falls by half.
PRIOR, HALF = 300.0, 500.0
#: Components of the mixture: the commonest labels, and one for all others, whose texts are learned from and scored alike.
#: And what each component takes from all together.
CLASSES, SHARED = 8, 0.05


class Lattice:
    """Unigram weights of the vocabulary's pieces in each class, and the forward recursion over them."""

    def __init__(self, counts: np.ndarray, path: str | None = None):
        """counts: uses of each piece of the vocabulary (rows) in each class (columns)."""
        sp = tokenizer(path)
        own = [i for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
        pieces = [sp.id_to_piece(i) for i in own]
        prior = np.array([1 / (HALF + max(0.0, -sp.get_score(i))) for i in own])
        prior[np.array([sp.get_score(i) < -1e6 for i in own])] = 1e-12  # unused pieces of the vocabulary
        weight = counts[own].astype(float) + (PRIOR * prior / prior.sum())[:, None]
        weight /= weight.sum(0)
        marked = np.array([p.startswith(MARK) for p in pieces])
        end = weight[marked].sum(0)
        self.classes, self.end = counts.shape[1], np.log(end)
        # Every beginning of a piece leads on; those that are pieces have a row of weights, others -1.
        self.rows = np.log(np.concatenate([weight, weight / end]))
        self.first: dict[str, int] = {}
        self.next: dict[str, int] = {}
        for i, (p, m) in enumerate(zip(pieces, marked)):
            if m and MARK in p[1:] or sp_byte(p):
                continue
            table, p, row = (self.first, p[1:], i + len(pieces)) if m else (self.next, p, i)
            for k in range(1, len(p)):
                table.setdefault(p[:k], -1)
            table[p] = row
        self.mark = self.first.pop("", -1)
        byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp_byte(p)}
        self.byte = [byte[k] for k in range(256)]

    def by_bytes(self, char: str) -> np.ndarray:
        """The log weight of a character without a piece."""
        return self.rows[[self.byte[b] for b in char.encode("utf-8", "surrogatepass")]].sum(0)

    def arcs(self, word: str, base: int, begin: list[int], end: list[int], row: list[int], odd: dict[str, int]) -> None:
        """Adds the arcs of a word whose places stand from base on; rows of characters without a piece are numbered in odd."""
        n, get, first = len(word), self.next.get, self.first.get
        if self.mark >= 0:
            begin.append(base)
            end.append(base + 1)
            row.append(self.mark)
        for j in range(1, n + 1):
            r = first(word[:j])
            if r is None:
                break
            if r >= 0:
                begin.append(base)
                end.append(base + 1 + j)
                row.append(r)
        base += 1
        for i in range(n):
            alone = True
            for j in range(i + 1, n + 1):
                r = get(word[i:j])
                if r is None:
                    break
                if r >= 0:
                    alone &= j > i + 1
                    begin.append(base + i)
                    end.append(base + j)
                    row.append(r)
            if alone:
                begin.append(base + i)
                end.append(base + i + 1)
                row.append(odd.setdefault(word[i], len(self.rows) + len(odd)))

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """The natural logarithm of each word's probability in each class, over all segmentations into pieces."""
        out = np.zeros((len(words), self.classes))
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for lo, hi in slices([len(words[k]) + 2 for k in order], PLACES):
            own = order[lo:hi]
            out[own] = self._side_by_side([words[k] for k in own])
        return out

    def _side_by_side(self, words: list[str]) -> np.ndarray:
        """The recursion in log space: place p of all words at once, each the sum over the arcs that end there."""
        begin: list[int] = []
        end: list[int] = []
        row: list[int] = []
        odd: dict[str, int] = {}
        size = np.array([len(w) + 2 for w in words])  # before the mark, after it, after each character
        base = np.concatenate([[0], np.cumsum(size)])
        for word, at in zip(words, base.tolist()):
            self.arcs(word, at, begin, end, row, odd)
        rows = np.concatenate([self.rows, [self.by_bytes(c) for c in odd]]) if odd else self.rows
        b, e, r = np.array(begin, np.int64), np.array(end, np.int64), np.array(row, np.int64)
        place = e - np.repeat(base[:-1], size)[e]
        by = np.lexsort((e, place))
        b, e, r, place = b[by], e[by], r[by], place[by]
        sums = np.full((base[-1], self.classes), -np.inf)
        sums[base[:-1]] = 0
        cuts = np.searchsorted(place, np.arange(1, int(size.max()) + 1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            x, to = sums[b[lo:hi]] + rows[r[lo:hi]], e[lo:hi]
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(x, heads, axis=0)
            top[np.isneginf(top)] = 0  # a place that nothing leads to
            many = np.repeat(top, np.diff(np.append(heads, hi - lo)), axis=0)
            with np.errstate(divide="ignore"):
                sums[to[heads]] = top + np.log(np.add.reduceat(np.exp(x - many), heads, axis=0))
        return sums[base[1:] - 1] + self.end


def sp_byte(piece: str) -> bool:
    return len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")


def tokenizer(path: str | None = None) -> sentencepiece.SentencePieceProcessor:
    path = path or public_tokenizers.path(VOCAB)
    return kept(("pieces", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


WORDS = pa.schema([("word", pa.list_(pa.string())), ("uses", pa.list_(pa.list_(pa.int32())))])
TEXTS = pa.schema([("doc_id", pa.int64()), ("held", pa.bool_()), ("n_words", pa.int64()), ("ids", pa.binary()), ("times", pa.binary())])
BLOCKS = pa.schema([("block", pa.int64()), ("at", pa.int64()), *WORDS, *TEXTS])
BLOCKS_SQL = "block bigint, at bigint, word array<string>, uses array<array<int>>, doc_id bigint, held boolean, n_words bigint, ids binary, times binary"
#: Words in one row of a block.
CHUNK = 16_384


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """data[start:end] of every pair, as one Arrow array without Python objects."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def pack(owner: np.ndarray, ids: np.ndarray, times: np.ndarray, docs: int) -> tuple[pa.Array, pa.Array]:
    """Of each of docs owners, its ids in three bytes each (four where they need it) and their counts in one; a count over 255 is
    several entries."""
    reps = (times - 1) // 255 + 1
    last = np.cumsum(reps) - 1
    count = np.full(int(reps.sum()), 255, np.uint8)
    count[last] = times - 255 * (reps - 1)
    ids, owner = np.repeat(ids, reps), np.repeat(owner, reps)
    width = 3 if not len(ids) or ids.max() < 1 << 24 else 4
    raw = np.ascontiguousarray(ids.astype("<u4")[:, None].view(np.uint8)[:, :width])
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=docs))])
    of = lambda w, data: pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer((w * ends).astype(np.int32)), pa.py_buffer(data)])
    return of(width, raw), of(1, count)


def unpack(ids: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    count = np.frombuffer(times, np.uint8)
    raw = np.frombuffer(ids, np.uint8).reshape(len(count), -1).astype(np.int64) if len(count) else np.zeros((0, 3), np.int64)
    return sum(raw[:, k] << 8 * k for k in range(raw.shape[1])), count


class _Block:
    """Texts that are collected until they are numbered together."""

    def __init__(self, name: int, classes: int):
        self.name, self.classes, self.size = name, classes, 0
        self.docs, self.tokens, self.known, self.words = [], [], [], []

    def add(self, doc: list, text: list, held: list, kind: list) -> None:
        data, starts, ends, h, counts = word_spans(text)
        own, first = np.unique(h, return_index=True)
        self.docs += zip(doc, held, kind, counts.tolist())
        self.tokens.append(h)
        self.known.append(own)
        self.words.append(gathered(data, starts[first], ends[first], pa.string()))
        self.size += len(data)

    def rows(self, n: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
        columns = {"block": pa.array([self.name] * n, pa.int64()), **given}
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in BLOCKS], schema=BLOCKS)

    def closed(self):
        """The rows of the documents, with indices into the block's distinct words, and rows of these, each with the pairs
        (class, training count) that it has."""
        known, first = np.unique(np.concatenate(self.known), return_index=True)
        words = pa.concat_arrays(self.words).take(pa.array(first))
        tokens = np.searchsorted(known, np.concatenate(self.tokens))
        n = max(1, len(known))
        doc, held, kind, counts = zip(*self.docs)
        owner = np.repeat(np.arange(len(doc)), counts)
        pairs, times = np.unique(owner * n + tokens, return_counts=True)
        ids, packed = pack(pairs // n, pairs % n, times, len(doc))
        given = {"doc_id": doc, "held": held, "n_words": counts, "ids": ids, "times": packed}
        yield self.rows(len(doc), {f.name: x if isinstance(x := given[f.name], pa.Array) else pa.array(x, f.type) for f in TEXTS})
        if not len(known):
            return
        learned = ~np.repeat(np.array(held, bool), counts)
        uses, number = np.unique(tokens[learned] * self.classes + np.repeat(np.array(kind), counts)[learned], return_counts=True)
        ends = np.concatenate([[0], np.cumsum(np.bincount(uses // self.classes, minlength=n))])
        flat = np.stack([uses % self.classes, number], 1).ravel()
        lists = pa.ListArray.from_arrays(pa.array(2 * ends, pa.int32()), pa.array(flat, pa.int32()))
        cuts = [*range(0, n, CHUNK), n]
        offsets = pa.array(cuts, pa.int32())
        yield self.rows(len(cuts) - 1, {"at": pa.array(cuts[:-1], pa.int64()), "word": pa.ListArray.from_arrays(offsets, words), "uses": pa.ListArray.from_arrays(offsets, lists)})


def _blocks(classes: int):
    """For mapInArrow: the rows of blocks of about BLOCK_BYTES of texts."""

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        block = _Block(task << 32, classes)
        for batch in batches:
            for lo, hi in slices(batch.column("size").to_pylist()):
                part = batch.slice(lo, hi - lo)
                block.add(*(part.column(c).to_pylist() for c in ("doc_id", "text", "held", "class")))
                if block.size >= BLOCK_BYTES:
                    yield from block.closed()
                    seq += 1
                    block = _Block((task << 32) + seq, classes)
        if block.docs:
            yield from block.closed()

    return run


def _piece_counts(classes: int, path: str | None, tokens: bool):
    """For mapInArrow: how often the vocabulary's segmentation of the distinct words (or all tokens) of each class uses a piece."""

    def count(batches):
        sp = tokenizer(path)
        total = np.zeros((sp.get_piece_size(), classes), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                part = b.slice(lo, CHUNK)
                found = sp.encode(part.column("word").to_pylist(), num_threads=1)
                uses = np.array(part.column("c").to_pylist(), np.int64).reshape(-1, classes)
                np.add.at(total, np.concatenate([np.array(x, np.int64) for x in found]), np.repeat(uses if tokens else uses > 0, [len(x) for x in found], axis=0))
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_pydict({"piece": used.astype(np.int32), "n": pa.array(total[used].tolist(), pa.list_(pa.int64()))})

    return count


def _each(name: str, classes: int, of) -> list:
    return [of(F.get(name, F.lit(k))) for k in range(classes)]


def score(docs: DataFrame, path: str | None = None, whole_words: bool = True) -> DataFrame:
    """Per row of doc_id, text, held and label: token counts, the base score, the model's log10 probability of the text, and
    that of the pieces alone.

    whole_words: whether training words are arcs of the lattice; without, there are pieces only.
    """
    per = docs.where(~F.col("held")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(CLASSES + 1).collect()
    per, classes = per[:CLASSES], max(1, min(len(per), CLASSES + 1))
    kind = F.lit(classes - 1)
    for k, r in enumerate(per):
        kind = F.when(F.col("label").eqNullSafe(F.lit(r["label"])), k).otherwise(kind)
    n_docs = np.zeros(classes)
    for r in docs.where(~F.col("held")).groupBy(kind.alias("class")).agg(F.count("*").alias("n")).collect():
        n_docs[r["class"]] = r["n"]
    size = F.coalesce(F.length("text"), F.lit(0)).alias("size")
    found = stored(docs.select("doc_id", "text", "held", kind.alias("class"), size).mapInArrow(_blocks(classes), BLOCKS_SQL), "blocks")
    texts = found.where(F.col("at").isNull()).select(F.col("block").alias("of"), "doc_id", "held", "n_words", "ids", "times")
    chunks = found.where(F.col("at").isNotNull())
    each = chunks.select(F.explode(F.arrays_zip("word", "uses")).alias("w")).select(F.col("w.word").alias("word"), F.col("w.uses").alias("u"))
    # A word has few classes as a rule: a row for its first, and one for each further one.
    first = F.struct(F.coalesce(F.get("u", F.lit(0)), F.lit(0)).alias("k"), F.coalesce(F.get("u", F.lit(1)), F.lit(0)).alias("n"))
    more = F.when(F.size("u") > 2, F.transform(F.sequence(F.lit(2), F.size("u") - 2, F.lit(2)), lambda i: F.struct(F.get("u", i).alias("k"), F.get("u", i + 1).alias("n"))))
    used = each.select("word", F.explode(F.when(F.size("u") > 2, F.concat(F.array(first), more)).otherwise(F.array(first))).alias("x")).select("word", "x.k", "x.n")
    sums = [F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(classes)]
    counts = stored(used.groupBy("word").agg(*sums).select("word", F.array(*[f"c{k}" for k in range(classes)]).alias("c")), "words")

    both = F.concat("c", F.array(F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)))  # the last: all classes
    stats = counts.select(both.alias("c")).agg(F.array(*_each("c", classes + 1, lambda c: F.coalesce(F.sum(c), F.lit(0)))).alias("n"), *[F.array(*_each("c", classes + 1, lambda c, t=t: F.count(F.when(t(c), 1)))).alias(name) for name, t in (("v", lambda c: c > 0), ("n1", lambda c: c == 1), ("n2", lambda c: c == 2))]).first()
    n, v, n1, n2 = (np.array(stats[x], float) for x in ("n", "v", "n1", "n2"))
    discount = np.clip(np.where(n1 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5), 0.05, 0.95)
    counted = n if whole_words else np.zeros_like(n)  # tokens that the whole-word arcs rest on
    spread = np.where(counted > 0, discount * v / np.maximum(counted, 1), 1.0)
    used = counts.mapInArrow(_piece_counts(classes, path, not whole_words), "piece int, n array<bigint>").groupBy("piece").agg(F.array(*_each("n", classes, F.sum)).alias("n"))
    pieces = np.zeros((tokenizer(path).get_piece_size(), classes), np.int64)
    for r in used.collect():  # a row for each piece of the vocabulary at most
        pieces[r["piece"]] = r["n"]

    total_docs, train_tokens, distinct = n_docs.sum(), int(n[-1] + n_docs.sum()), int(v[-1] + (n_docs.sum() > 0))
    end = (total_docs + 0.5) / (train_tokens + 1)
    share = (n_docs + 0.5 / classes) / (total_docs + 0.5)
    total = math.log10(train_tokens + 0.1 * (distinct + 1))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # one number for each piece and class
    # What a word brings along: its training count, and its logarithms in each class and by the pieces alone.
    value = np.dtype([("c", "<i8"), ("lp", "<f4", (classes + 1,))])

    def weigh(batches):
        lattice = _lattice(shared.value, path)
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                part = b.slice(lo, CHUNK)
                c = np.array(part.column("c").to_pylist(), float).reshape(-1, classes)
                c = np.concatenate([c, c.sum(1, keepdims=True)], 1)
                sub = lattice.log_probabilities(part.column("word").to_pylist())
                sub = np.concatenate([sub, np.logaddexp.reduce(sub + np.log(share), axis=1)[:, None]], 1)
                with np.errstate(divide="ignore"):
                    whole = np.log(np.where(counted > 0, np.maximum(c - discount, 0) / np.maximum(counted, 1), 0))
                own = np.logaddexp(whole, sub + np.log(spread))  # the last step of the recursion: the arc over the whole word
                own = np.logaddexp(own[:, :-1] + math.log(1 - SHARED), own[:, -1:] + math.log(SHARED))
                row = np.zeros(len(c), value)
                row["c"] = c[:, -1]
                row["lp"] = (np.concatenate([own, sub[:, -1:]], 1) + math.log(1 - end)) / math.log(10)
                yield pa.RecordBatch.from_arrays([part.column("h"), _fixed(row)], names=["h", "value"])

    # From here on 64-bit hashes stand for the words, as rows are many and only equality matters.
    weights = stored(counts.select(F.xxhash64("word").alias("h"), "word", "c").mapInArrow(weigh, "h bigint, value binary"), "weights")
    pairs = chunks.select("block", "at", F.posexplode("word").alias("i", "word")).select("block", (F.col("at") + F.col("i")).cast("int").alias("i"), F.xxhash64("word").alias("h"))
    met = pairs.join(weights, "h").select("block", "i", "value")
    end_base = math.log10((total_docs + 0.1) / (train_tokens + 0.1 * (distinct + 1)))
    end_known = int(total_docs > 0)
    out = pa.schema([("doc_id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("lattice_score", pa.float64())])

    def totals(words: pa.Table, own: pa.Table) -> pa.Table:
        """The sums of a block's documents; columns of the table: whether known, base score, then the logarithms."""
        table = np.zeros((words.num_rows, classes + 3))
        for b in words.to_batches():
            row, at = _values(b.column("value"), value), b.column("i").to_numpy()
            table[at, 0], table[at, 1], table[at, 2:] = row["c"] > 0, np.log10(row["c"] + 0.1) - total, row["lp"]
        sums = np.zeros((own.num_rows, classes + 3))
        for k, (ids, times) in enumerate(zip(own.column("ids"), own.column("times"))):
            i, t = unpack(ids.as_py(), times.as_py())
            for lo in range(0, len(i), CHUNK):
                sums[k] += t[lo : lo + CHUNK].astype(float) @ table[i[lo : lo + CHUNK]]
        lp = np.logaddexp.reduce(sums[:, 2:-1] * math.log(10) + np.log(share), axis=1) / math.log(10)
        tokens = np.array(own.column("n_words").to_pylist(), np.int64) + 1
        columns = [own.column("doc_id"), own.column("held"), tokens, np.round(sums[:, 0]).astype(np.int64) + end_known, sums[:, 1] + end_base, lp + math.log10(end), sums[:, -1] + math.log10(end)]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in columns], schema=out)

    schema = "doc_id bigint, held boolean, n_tokens bigint, n_known bigint, base_score double, score double, lattice_score double"
    scored = met.groupBy("block").cogroup(texts.groupBy("of")).applyInArrow(totals, schema)
    return scored.withColumn("train_tokens", F.lit(train_tokens).cast("long"))


def _fixed(rows: np.ndarray) -> pa.Array:
    """Records as values of a binary column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def _values(column: pa.Array, value: np.dtype) -> np.ndarray:
    """The records of a binary column, read where they lie."""
    begin = np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0] if len(column) else 0
    return np.frombuffer(column.buffers()[2], value, len(column), int(begin)) if len(column) else np.zeros(0, value)


def _lattice(pieces: np.ndarray, path: str | None) -> Lattice:
    key = ("lattice", path, pieces.shape, hashlib.sha256(pieces.tobytes()).hexdigest())
    return kept(key, lambda: Lattice(pieces, path))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: learned from the nine folds that aren't held out."""
    held = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False))
    out = score(docs.select("doc_id", "text", held.alias("held"), F.col("lang").alias("label")))
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")
