"""Alignment of two tokenizers over the same texts, with corpus-wide counts of the token pairs that meet.

Each text is encoded by a byte-level BPE (A) and a piece BPE (B). Inside mapInPandas the cumulative byte ends of both token
sequences are merged with two pointers: every end moves the pointer of the side that ends there, so each stretch between two
ends lies in one token of A and one of B and is one link, and an end that both sides share closes a group. Texts are taken in
chunks of about CHUNK characters; a chunk tells its distinct pairs and in how many of its documents each is linked, and a
document refers to its chunk's pairs by their places. Spark sums the counts of all chunks, takes each A id's highest count,
joins both back to the pairs of every chunk, and brings a chunk's counts and its documents together. So what is shuffled are
the pairs of chunks, not links, and no table is ever whole in one place.

Defined cases: texts that are null or empty, and those that a tokenizer doesn't give back byte for byte behind their space,
have no tokens: zeros and an empty digest. Special tokens' strings are plain text. Repeated rows and rows without an id each
get their row and count as documents of their own. A text is taken whole, a long one in a chunk of its own. Other columns,
whatever they are called, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.bpe import VOCAB, ForcedCutBPE, _rendered, _table
from partloom.llm.common import kept, stored

PIECES = "piece_bpe_32k.model"
#: Characters of the texts that share a table of pairs.
CHUNK = 4 << 20
SHIFT = 32
# Fixed value: how pieces write a space.
SPACE = "\u2581"


class PieceBPE(ForcedCutBPE):
    """The piece tokenizer. A text begins with the space that the library adds of itself.

    No piece has a space behind anything else, so nothing is ever merged across the place before one: texts are cut there (but
    not behind the sign that stands for a space, where the text itself has it), and fragments that the worker hasn't met go to
    the library.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        every = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            plain = not (self.pieces.is_unknown(i) or self.pieces.is_control(i))
            every.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace(SPACE, " ").encode() if plain else b"")
        self.bytes_of, self.special = _table(every), None
        inside = {b[k : k + 2] for b in every for k in range(len(b) - 1)}
        ok = np.zeros((256, 256), bool)
        ok[[a for a in range(256) if a != 0x20 and a != SPACE.encode()[-1] and bytes([a, 0x20]) not in inside], 0x20] = True
        self.alone = self.pieces.piece_to_id(SPACE)
        self.certain = ok.ravel()
        self._forget()

    def _learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = self.pieces.encode([raw[a + 1 : b].decode() for a, b in zip(starts.tolist(), ends.tolist())], num_threads=1)
        got = [x or [self.alone] for x in got]  # the library adds no space to an empty text
        count = np.array([len(x) for x in got], np.int64)
        return np.fromiter((i for x in got for i in x), np.uint32, int(count.sum())), count


class Pair:
    """Both tokenizers, and the pieces of text that tell a group in a digest."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ForcedCutBPE(a, plain=True), PieceBPE(b)
        n, m = len(self.a.bytes_of[1]), len(self.b.bytes_of[1])
        self.said = _table([b"%d," % i for i in range(n)] + [b"%d|" % i for i in range(n)] + [b"%d," % i for i in range(m)] + [b"%d;" % i for i in range(m)])
        self.n, self.m = n, m


def tokenizers(a: str | None = None, b: str | None = None) -> Pair:
    """The pair of this process; tables are built once."""
    a, b = a or public_tokenizers.path(VOCAB), b or public_tokenizers.path(PIECES)
    return kept(("align", a, b), lambda: Pair(a, b))


@dataclass
class Alignment:
    """Tokens, groups and links of some texts, one after another; texts that don't come back whole have none."""

    pair: Pair
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray

    def __post_init__(self):
        size_a, size_b = self.pair.a.bytes_of[2][self.a], self.pair.b.bytes_of[2][self.b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        total = int(end_a[-1]) if len(end_a) else 0
        in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        in_a[end_a], in_b[end_b] = True, True
        ends = np.flatnonzero(in_a | in_b)  # the merged ends; each closes the link that began at the one before
        stop_a, stop_b = in_a[ends], in_b[ends]
        self.link_a, self.link_b = np.cumsum(stop_a) - stop_a, np.cumsum(stop_b) - stop_b  # where each pointer stands
        both = stop_a & stop_b
        self.group = np.cumsum(both) - both  # of each link
        self.doc_ends = np.cumsum(self._per_doc(size_a, self.n_a))
        self.n_links = np.diff(np.searchsorted(ends, self.doc_ends, side="right"), prepend=0)
        self.n_groups = np.diff(np.searchsorted(ends[both], self.doc_ends, side="right"), prepend=0)

    @staticmethod
    def _per_doc(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        at = np.concatenate([[0], np.cumsum(counts)])
        return total[at[1:]] - total[at[:-1]]

    @cached_property
    def links(self) -> np.ndarray:
        """The pair of ids of every link."""
        return (self.a[self.link_a].astype(np.int64) << SHIFT) | self.b[self.link_b]

    def _group_of(self, link: np.ndarray, n: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[link] = self.group  # every token has a link, and all its links are in one group
        return out

    def told(self) -> Iterator[bytes]:
        """The groups of each text, as the digests tell them."""
        group_a, group_b = self._group_of(self.link_a, len(self.a)), self._group_of(self.link_b, len(self.b))
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        code_a = self.a + np.where(last(group_a), self.pair.n, 0)
        code_b = 2 * self.pair.n + self.b + np.where(last(group_b), self.pair.m, 0)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        codes = np.concatenate([code_a, code_b])[order]
        return (x[:-1] for x in _rendered(self.pair.said, codes, self.n_a + self.n_b))

    def groups(self) -> list[list[tuple[list[int], list[int]]]]:
        """The groups of each text, as ids of both sides."""
        split = lambda link, ids: np.split(ids, np.flatnonzero(np.diff(self._group_of(link, len(ids)))) + 1) if len(ids) else []
        both = [(x.tolist(), y.tolist()) for x, y in zip(split(self.link_a, self.a), split(self.link_b, self.b))]
        ends = np.cumsum(self.n_groups).tolist()
        return [both[lo:hi] for lo, hi in zip([0, *ends], ends)]


def align(texts: list[str | None], pair: Pair) -> Alignment:
    spaced = [" " + t if t else "" for t in texts]
    (a, n_a), (b, n_b) = pair.a.encode_many(spaced), pair.b.encode_many(spaced)
    raw = [t.encode() for t in spaced]
    same = lambda side, ids, n: np.array([x == r for x, r in zip(_rendered(side.bytes_of, ids, n), raw)], bool)
    whole = same(pair.a, a, n_a) & same(pair.b, b, n_b) & np.array([bool(r) for r in raw], bool)
    return Alignment(pair, a[np.repeat(whole, n_a)].astype(np.int64), b[np.repeat(whole, n_b)].astype(np.int64), np.where(whole, n_a, 0), np.where(whole, n_b, 0))


def _chunks(batches: Iterator[pd.DataFrame], most: int = CHUNK) -> Iterator[pd.DataFrame]:
    rows, size = [], 0
    for pdf in batches:
        for row in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
            n = len(row[1] or "")
            if rows and size + n > most:
                yield pd.DataFrame(rows, columns=["doc_id", "text"])
                rows, size = [], 0
            rows.append(row)
            size += n
    if rows:
        yield pd.DataFrame(rows, columns=["doc_id", "text"])


SCHEMA = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, steps binary, times binary, place long, pair long, docs long"
_COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]


def _rows_of(chunk: int, ids: pd.Series, got: Alignment) -> Iterator[pd.DataFrame]:
    """A chunk's rows: one for each document, and one for each of its distinct pairs.

    A document holds the places of its distinct pairs in order, as steps from each to the next, and how often it links each,
    both as 32-bit integers.
    """
    pairs, place = np.unique(got.links, return_inverse=True)
    width = max(1, len(pairs))
    own, times = np.unique(np.repeat(np.arange(len(ids)), got.n_links) * width + place, return_counts=True)
    doc, place = own // width, own % width
    at = np.searchsorted(doc, np.arange(len(ids) + 1))
    steps = np.diff(place, prepend=0)
    begins = at[:-1][at[:-1] < at[1:]]
    steps[begins] = place[begins]
    cut = lambda x: [x[lo:hi].tobytes() for lo, hi in zip(at.tolist(), at[1:].tolist())]
    shas = [hashlib.sha256(x).hexdigest() if n else "" for x, n in zip(got.told(), got.n_a)]
    none = {c: pd.array([pd.NA] * len(ids), "Int64") for c in ("place", "pair", "docs")}
    yield pd.DataFrame({"chunk": chunk, "doc_id": ids, "n_a": got.n_a, "n_b": got.n_b, "n_groups": got.n_groups, "n_links": got.n_links, "groups_sha256": shas, "steps": cut(steps.astype("<i4")), "times": cut(times.astype("<i4"))} | none, columns=_COLUMNS)
    if len(pairs):
        known = {"chunk": chunk, "place": np.arange(len(pairs)), "pair": pairs, "docs": np.bincount(place, minlength=len(pairs))}
        none = {c: pd.array([pd.NA] * len(pairs), "Int64") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        yield pd.DataFrame(known | none | {c: [None] * len(pairs) for c in ("groups_sha256", "steps", "times")}, columns=_COLUMNS)


def chunked(docs: DataFrame, a: str | None = None, b: str | None = None, most: int = CHUNK) -> DataFrame:
    """The rows of all chunks (SCHEMA): documents with the places of their pairs, and the pairs with their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        for k, part in enumerate(_chunks(batches, most)):
            yield from _rows_of(first + k, part["doc_id"], align(part["text"].tolist(), tokenizers(a, b)))

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best (whether no other pair of its A id has more) of chunks' pairs."""
    counts = stored(pairs.groupBy("pair").agg(F.sum("docs").alias("count")), "pairs").withColumn("a", F.shiftright("pair", SHIFT))
    tops = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(tops, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def lexicon(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """a, b, count and best of every pair of ids that any document holds linked."""
    t = pair_counts(_pairs(stored(chunked(docs, a, b), "aligned")))
    return t.select(F.shiftright("pair", SHIFT).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b"), "count", "best")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.where("pair is not null").select("chunk", "place", "pair", "docs")


def aligned_groups(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id and groups (the ids of either side, in order) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _chunks(batches):
            got = align(part["text"].tolist(), tokenizers(a, b)).groups()
            yield pd.DataFrame({"doc_id": part["doc_id"], "groups": [[{"a": x, "b": y} for x, y in g] for g in got]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """One chunk: its documents' links looked up in its pairs' counts."""
    place = counts["place"].to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = counts["count"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
    steps, times = docs["steps"].to_pylist(), docs["times"].to_pylist()
    size = np.array([len(x) // 4 for x in steps], np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    run = np.cumsum(np.frombuffer(b"".join(steps), "<i4").astype(np.int64))
    before = np.concatenate([[0], run])[total[:-1]]  # what earlier documents' steps come to
    at, n = run - np.repeat(before, size), np.frombuffer(b"".join(times), "<i4").astype(np.int64)
    per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[total])
    more = {"n_best": per(best[at] * n), "count_sum": per(count[at] * n)}
    return pa.Table.from_arrays([pa.array(more[f.name]) if f.name in more else docs[f.name] for f in DIGEST], schema=DIGEST)


def digest(docs: DataFrame, a: str | None = None, b: str | None = None, most: int = CHUNK) -> DataFrame:
    """The contract's columns."""
    rows = stored(chunked(docs, a, b, most), "aligned")
    pairs = _pairs(rows)
    scored = stored(pair_counts(pairs), "scored")
    back = pairs.select(F.col("chunk").alias("of"), "place", "pair").join(scored, "pair").select("of", "place", "count", "best")
    texts = rows.where("pair is null").drop("place", "pair", "docs")
    schema = ", ".join(f"{f.name} {'string' if f.name == 'groups_sha256' else 'long'}" for f in DIGEST)
    return texts.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_summed, schema)
