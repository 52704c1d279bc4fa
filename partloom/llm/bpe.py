"""Byte-level BPE by forced-boundary splitting.

A byte pair that stands inside no vocabulary token is never merged across, so merging alone never needs both its sides. The
pre-tokenizer must not see the cut either: it goes on from any place without looking back, and looks ahead only in white
space and after an apostrophe. So a cut between two characters is certain if their bytes are such a pair, the left one is
no white space, and no apostrophe that could begin a contraction is set free or torn from it. A text is cut at every such
place, the fragments are encoded independently by the tokenizers library, and their ids are concatenated. Most fragments
come again and again: a slice of texts is cut, hashed and numbered in arrays, those met lately by one lookup in a table of
hashes, and only fragments that the worker hasn't met go to the library. A 64-bit hash stands for a fragment of up to LONGEST bytes; longer ones are encoded where they stand.

Defined cases: null text is empty and has no ids; special tokens' strings become their ids, as in the library; repeated
rows each get their row, and a null doc_id keeps its row; texts of any length are encoded whole, in pieces that end at
certain cuts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from partloom.llm.common import arrow_rows, kept
from partloom.llm.shingles import hashed

VOCAB = "byte_bpe_50k.json"
#: Fragments a worker keeps, and the most bytes of one; beyond CACHE it starts anew.
CACHE, LONGEST = 500_000, 64
#: Places, by a hash's lower bits, of the fragments that an array lookup finds; those that share one are looked up singly.
PLACES = 1 << 20
#: Bytes that are cut and numbered together.
PIECE = 1 << 20
# Letters with which the pre-tokenizer's contractions go on after the apostrophe ('s 't 're 've 'm 'll 'd).
CONTRACTED = "strvmld"
#: The last bytes of characters that are white space, and what stands before them.
WIDE_SPACES = ((b"\xc2", (0x85, 0xA0)), (b"\xe1\x9a", (0x80,)), (b"\xe1\xa0", (0x8E,)), (b"\xe2\x80", (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (b"\xe2\x81", (0x9F,)), (b"\xe3\x80", (0x80,)))
SPACES = frozenset((*range(0x09, 0x0E), *range(0x1C, 0x20), 0x20))


def _byte_chars() -> dict[str, int]:
    """The vocabulary's printable stand-ins for bytes: printable Latin-1 as itself, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, begin and length of each."""
    size = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every range, one after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class ForcedCutBPE:
    """The encoder of a vocabulary; plain: special tokens' strings are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.library.encode_special_tokens = plain
        raw = _byte_chars()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token = {i: bytes(raw[c] for c in s) for s, i in spec["model"]["vocab"].items() if s not in special} | {i: s.encode() for s, i in special.items()}
        self.inside_set = {b[k : k + 2] for i, b in token.items() if i not in special.values() for k in range(len(b) - 1)}
        every = [token.get(i, b"") for i in range(max(token) + 1)]
        self.bytes_of, self.digits_of = _table(every), _table([b"%d," % i for i in range(len(every))])
        self.special = regex.compile(b"|".join(regex.escape(s.encode()) for s in sorted(special, key=len, reverse=True))) if special and not plain else None
        self.certain = self._certain().ravel()
        self._forget()

    def _certain(self) -> np.ndarray:
        """Whether a character that ends with byte a and one that begins with byte b are certainly cut apart, as far as two bytes tell."""
        ok = np.ones((256, 256), bool)
        for pair in self.inside_set:
            ok[pair[0], pair[1]] = False
        ok[:, 0x80:0xC0] = False  # inside a character
        ok[sorted(SPACES)] = False
        ok[ord("'"), [ord(c) for c in CONTRACTED]] = False
        for pair in ("re", "ve", "ll"):
            ok[ord(pair[0]), ord(pair[1])] = False
        plain = [a for a in range(128) if chr(a).isalnum()]
        ok[[a for a in range(256) if a not in plain], ord("'")] = False  # signs take a following apostrophe into their run
        return ok

    def _forget(self) -> None:
        self.number: dict[int, int] = {}
        self.lately, self.place = np.zeros(PLACES, np.uint64), np.full(PLACES, -1, np.int32)
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Marks the places before bytes of a text at which it is cut; special tokens stand alone."""
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.certain[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        if len(data) and data.max() >= 0x80:
            for lead, last in WIDE_SPACES:
                at = np.flatnonzero(data[: -len(lead)] == lead[0])
                for k, b in enumerate(lead):
                    at = at[data[at + k] == b]
                at += len(lead)
                cut[at[np.isin(data[at], last)] + 1] = False
        if self.special is not None:
            for m in self.special.finditer(data.tobytes()):
                cut[m.start() + 1 : m.end()] = False
                cut[[m.start(), m.end()]] = True
        cut[[0, -1]] = True
        return cut

    def fragments(self, text: str) -> list[str]:
        raw = text.encode()
        at = np.flatnonzero(self.cuts(np.frombuffer(raw, np.uint8))).tolist() if raw else []
        return [raw[a:b].decode() for a, b in zip(at, at[1:])]

    def _pieces(self, raw: bytes):
        """A long text in pieces of about PIECE bytes that end at certain cuts, before a space after a letter or digit."""
        while len(raw) > 2 * PIECE:
            for m in regex.finditer(rb"(?<=[0-9A-Za-z])(?= )", raw, pos=PIECE):
                if self.certain[raw[m.start() - 1] << 8 | 0x20]:
                    yield raw[: m.start()]
                    raw = raw[m.start() :]
                    break
            else:
                break
        yield raw

    def _learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of fragments, one after another, and how many each has.

        Fragments that begin with a space and end with a letter or digit are certainly apart from each other, so they go to
        the library as one text; its ids' bytes tell where each ends.
        """
        data = np.frombuffer(raw, np.uint8)
        last = data[ends - 1]
        joined = (data[starts] == 0x20) & ((last >= 0x30) & (last <= 0x39) | (last >= 0x41) & (last <= 0x5A) | (last >= 0x61) & (last <= 0x7A)) & self.certain[(last.astype(np.int64) << 8) | 0x20]
        own, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
        count = np.zeros(len(starts), np.int64)
        parts: list[np.ndarray] = []
        if len(own):
            size = ends[own] - starts[own]
            text = data[_spread(starts[own], size)].tobytes().decode()
            got = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            reach = np.searchsorted(np.cumsum(self.bytes_of[2][got]), np.cumsum(size), side="left") + 1
            count[own] = np.diff(reach, prepend=0)
            parts.append(got)
        for e in self.library.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts[alone].tolist(), ends[alone].tolist())], add_special_tokens=False) if len(alone) else ():
            parts.append(np.array(e.ids, np.uint32))
        count[alone] = [len(p) for p in parts[len(parts) - len(alone) :]]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        order = np.concatenate([own, alone])
        where = np.empty(len(order), np.int64)
        where[order] = np.cumsum(count[order]) - count[order]
        return ids[_spread(where, count)], count

    def _kept(self, raw: bytes, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers under which fragments are kept; those not met before are learned."""
        keys = h.tolist()
        get = self.number.get
        at = np.array([get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            ids, count = self._learn(raw, starts[new], ends[new])
            base, total = len(self.number), len(self.number) + len(new)
            if total > len(self.begin):
                self.begin, self.size = (np.concatenate([x, np.zeros(total, np.int64)]) for x in (self.begin, self.size))
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(self.used + len(ids), np.uint32)])
            self.begin[base:total], self.size[base:total] = self.used + np.cumsum(count) - count, count
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            at[new] = np.arange(base, total)
            self.number.update(zip((keys[k] for k in new.tolist()), range(base, total)))
        return at

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        pieces, owner = [], []
        for k, t in enumerate(texts):
            for p in self._pieces((t or "").encode()):
                if p:
                    pieces.append(p)
                    owner.append(k)
        got, counts, lo = [], np.zeros(len(texts), np.int64), 0
        while lo < len(pieces):
            hi, size = lo + 1, len(pieces[lo])
            while hi < len(pieces) and size + len(pieces[hi]) <= PIECE:
                size += len(pieces[hi])
                hi += 1
            ids, n = self._encode(pieces[lo:hi])
            got.append(ids)
            np.add.at(counts, owner[lo:hi], n)
            lo = hi
        return np.concatenate(got) if got else np.zeros(0, np.uint32), counts

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(pieces)
        data = np.frombuffer(raw, np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        # Texts meet without anything between them: special strings across their bounds are none, so each is cut alone.
        cut = self.cuts(data) if self.special is None or not self.special.search(raw) else np.concatenate([*(self.cuts(np.frombuffer(p, np.uint8))[:-1] for p in pieces), [True]])
        cut[bounds] = True
        places = np.flatnonzero(cut)
        starts, ends = places[:-1], places[1:]
        h = hashed(data, starts, ends)
        long = np.flatnonzero(ends - starts > LONGEST)
        at = (h & np.uint64(PLACES - 1)).astype(np.int64)
        number = self.place.take(at)
        number[self.lately.take(at) != h] = -1
        number[long] = 0
        left = np.flatnonzero(number < 0)
        own, first, inverse = np.unique(h[left], return_index=True, return_inverse=True)
        if len(self.number) + len(own) > CACHE:
            self._forget()
            left = np.flatnonzero(ends - starts <= LONGEST)
            own, first, inverse = np.unique(h[left], return_index=True, return_inverse=True)
        if len(own):
            got = self._kept(raw, own, starts[left[first]], ends[left[first]])
            number[left] = got[inverse]
            self.lately[at[left[first]]], self.place[at[left[first]]] = own, got
        begin, size, store = self.begin[number], self.size[number], self.ids
        if len(long):
            ids, count = self._learn(raw, starts[long], ends[long])
            store = np.concatenate([self.ids[: self.used], ids])
            begin[long], size[long] = self.used + np.cumsum(count) - count, count
        total = np.concatenate([[0], np.cumsum(size)])
        return store[_spread(begin, size)], np.diff(total[np.searchsorted(starts, bounds)])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes that the ids of each text stand for, in UTF-8; broken characters become marks."""
        return [b.decode("utf-8", "replace").encode() for b in _rendered(self.bytes_of, ids, counts)]

    def decode(self, ids) -> str:
        return self.decode_many(np.asarray(ids, np.int64), np.array([len(ids)]))[0].decode()

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The decimal ids of each text, joined by commas."""
        return [b[:-1] for b in _rendered(self.digits_of, ids, counts)]


def _rendered(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, counts: np.ndarray):
    """The table's bytes of each text's ids, for some texts at a time."""
    data, begin, size = table
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        first = int(ends[lo] - counts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, first + PIECE // 2, side="right")))
        own = ids[first : ends[hi - 1]]
        made = data[_spread(begin[own], size[own])].tobytes()
        at = np.concatenate([[0], np.cumsum(size[own])])[np.concatenate([[0], ends[lo:hi] - first])].tolist()
        yield from (made[a:b] for a, b in zip(at, at[1:]))
        lo = hi


def encoder(path: str | None = None) -> ForcedCutBPE:
    """The encoder of this process; tables are built once."""
    path = path or public_tokenizers.path(VOCAB)
    return kept(("bpe", path), lambda: ForcedCutBPE(path))


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every row's whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def step(c: dict) -> dict:
        return {"doc_id": c["doc_id"], "ids": _lists(*encoder(path).encode_many(c["text"]))}

    return docs.select("doc_id", "text").mapInArrow(arrow_rows(["doc_id", "text"], schema, step), "doc_id bigint, ids array<int>")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding them gives the text back, of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("restored", pa.bool_())])

    def step(c: dict) -> dict:
        bpe = encoder(path)
        ids, counts = bpe.encode_many(c["text"])
        back = bpe.decode_many(ids, counts)
        return {"doc_id": c["doc_id"], "n_tokens": counts, "ids": _lists(ids, counts), "restored": [b == (t or "").encode() for b, t in zip(back, c["text"])]}

    return docs.select("doc_id", "text").mapInArrow(arrow_rows(["doc_id", "text"], schema, step), "doc_id bigint, n_tokens bigint, ids array<int>, restored boolean")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of the text decoded from them."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def step(c: dict) -> dict:
        bpe = encoder(path)
        ids, counts = bpe.encode_many(c["text"])
        digest = lambda parts: [hashlib.sha256(x).hexdigest() for x in parts]
        return {"doc_id": c["doc_id"], "n_tokens": counts, "ids_sha256": digest(bpe.decimals(ids, counts)), "decoded_sha256": digest(bpe.decode_many(ids, counts))}

    return docs.select("doc_id", "text").mapInArrow(arrow_rows(["doc_id", "text"], schema, step), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
