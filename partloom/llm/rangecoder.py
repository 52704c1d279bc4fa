"""A context-mixing range coder for token ids, over many blocks side by side.

A sequence of ids is cut into blocks of BLOCK ids, each with its own code and checksums. Block k is lane k of the arrays below,
and all lanes take a step together, so one array operation serves them all.

Model. The frame's head has what its ids have in common: the frequencies of its frequent ids (order 0), the likeliest next id
after each of them (order 1) and after pairs of them, by a hash (order 2, where it pays), each with a level of how often it
held. Two ids are thus foreseen, one by the longest context known and one by order 1 where it differs. One decision of three
ways tells whether the first holds, the second, or neither. Its chances mix what the head tells of a level with what the lane
has seen of it; what was seen, and the mix's weight, which moves toward whichever was nearer, change after every CHUNK ids.
Where neither holds, the id is coded by its order-0 frequency. Rare ids share one symbol and follow at the end of their block,
with equal chances. Every id goes through the arithmetic coder; none is stored beside it.

The coder narrows an interval of 48 bits; when it is no longer than 2^32 the upper 16 bits of its begin are written, and what
is added to it later may carry into them. All of it is integer arithmetic (a quotient is taken in floats whose precision
gives the integer one), so that any machine decodes what another one encoded.

Defined cases: no ids make a frame without blocks; ids below 0 or from 2^29 on raise ValueError, as do damaged frames.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TKB3"
BLOCK = 2048
#: Blocks that are coded side by side; bounds the memory of the arrays (about 10 kB a block).
LANES = 4096
#: Ids of a lane after which its mix changes, and those of all lanes that are prepared together.
CHUNK, TOGETHER = 128, 1 << 14
#: Chances of a decision add up to 2^WAYS, frequencies of symbols to 2^BITS.
WAYS, BITS = 15, 16
ONE = 1 << WAYS
#: Bounds of a chance; within them an interval keeps room for a symbol after both decisions.
LEAST, MOST = ONE >> 7, ONE - (ONE >> 6)
#: Bits of a symbol and of the hash of two; an id has a symbol if it came OFTEN times at least, and so often that all have room.
SYMBOL, PAIR, OFTEN = 15, 17, 4
#: Bits of a level; level k stands for the chances from (k / LEVELS)^2 on.
LEVEL = 3
LEVELS = 1 << LEVEL
TOLD = np.clip((2 * np.arange(LEVELS) + 1) ** 2 * ONE >> 2 * LEVEL + 2, LEAST, MOST)
#: What a lane sees apart: the first id by its level where both are the same and where not, the second by its level.
KINDS = 3 * LEVELS
MARK = 1 << SYMBOL + LEVEL
LIMIT = 1 << 29
HEAD = struct.Struct("<QIII")
M32 = (1 << 32) - 1
I = np.int64


def _at(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The table's values at places, which are inside it (those of wrong codes may not be); numpy looks up faster unchecked."""
    return table.take(places, mode="clip")


class _Interval:
    """The lanes' intervals, as how long they are, and where the next word of each is in `words`."""

    def __init__(self, words: np.ndarray):
        self.range, self.words = np.full(len(words), 1 << 48, I), words.ravel()
        self.begin = np.arange(len(words)) * words.shape[1]
        self.next = self.begin.copy()

    @staticmethod
    def ends(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first two of three ways end, by the chance of the first and that of the second where the first fails."""
        first = y >> WAYS
        first *= a
        second = y - first
        second >>= WAYS
        second *= b
        second += first
        return first, second

    @staticmethod
    def bounds(y: np.ndarray, first: np.ndarray, second: np.ndarray, missed: np.ndarray, neither: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the way taken begins, and how long it is."""
        begin, end = second * missed, np.where(missed, y, first)
        other = np.flatnonzero(missed ^ neither)
        begin[other], end[other] = _at(first, other), _at(second, other)
        end -= begin
        return begin, end


class _Writer(_Interval):
    def __init__(self, lanes: int):
        # Carries stay above a word's 16 bits until the end.
        super().__init__(np.zeros((lanes, BLOCK), np.uint32))
        self.low = np.zeros(lanes, I)

    def room(self, words: int) -> None:
        """For so many more words of every lane."""
        lanes = len(self.begin)
        width, size = len(self.words) // lanes, self.next - self.begin
        if size.max() + words > width:
            self.words = np.concatenate([self.words.reshape(lanes, width), np.zeros((lanes, max(width, words)), np.uint32)], 1).ravel()
            self.begin = np.arange(lanes) * (len(self.words) // lanes)
            self.next = self.begin + size

    def put(self, n: int, a: np.ndarray, b: np.ndarray, missed: np.ndarray, neither: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        """The ways taken by the first n lanes, and parts of the symbols' share."""
        x, y = self.low[:n], self.range[:n]
        begin, length = self.bounds(y, *self.ends(y, a[:n], b[:n]), missed[:n], neither[:n])
        x += begin
        length >>= BITS
        x += length * start[:n]
        np.multiply(length, width[:n], out=y)
        out = np.flatnonzero(y <= M32)
        while len(out):
            out = self._shift(out)

    def flat(self, lanes: np.ndarray, bits: int, value: np.ndarray) -> None:
        self.room(4)
        step = self.range[lanes] >> bits
        self.low[lanes] += step * value
        self.range[lanes] = step
        out = lanes[step <= M32]
        while len(out):
            out = self._shift(out)

    def _shift(self, lanes: np.ndarray) -> np.ndarray:
        """Writes a word of each of the lanes, and tells which need another one."""
        low, length, at = _at(self.low, lanes), _at(self.range, lanes) << 16, _at(self.next, lanes)
        self.words[at] = low >> 32
        self.next[lanes] = at + 1
        self.low[lanes], self.range[lanes] = (low & M32) << 16, length
        return lanes[length <= M32]

    def codes(self) -> list[bytes]:
        """Each lane's code: the words written, and the three that hold where its interval begins."""
        self.room(3)
        for low in (self.low >> 32, self.low >> 16 & 0xFFFF, self.low & 0xFFFF):
            self.words[self.next] = low
            self.next += 1
        size = self.next - self.begin
        words = self.words.reshape(len(size), -1)[:, : size.max()]
        while (over := words >> np.uint32(16)).any():
            words &= np.uint32(0xFFFF)
            words[:, :-1] += over[:, 1:]
        return [w[:n].astype("<u2").tobytes() for w, n in zip(words, size.tolist())]


class _Reader(_Interval):
    def __init__(self, codes: list[bytes]):
        words = np.zeros((len(codes), max(map(len, codes)) // 2 + 4), np.uint16)
        for row, c in zip(words, codes):
            row[: len(c) // 2] = np.frombuffer(c, "<u2", len(c) // 2)
        super().__init__(words)
        self.next += 3
        self.offset = (words[:, :3].astype(I) << np.array([32, 16, 0])).sum(1)

    def get(self, n: int, a: np.ndarray, b: np.ndarray, model: _Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ways taken by the first n lanes, and their symbols."""
        y, z = self.range[:n], self.offset[:n]
        first, second = self.ends(y, a, b)
        missed, neither = z >= first, z >= second
        begin, length = self.bounds(y, first, second, missed, neither)
        z -= begin
        length >>= BITS
        place = (z / length).astype(I)
        s = _at(model.at, place)
        share = np.where(neither, s, model.foreseen)
        z -= length * _at(model.start, share)
        np.multiply(length, _at(model.width, share), out=y)
        out = np.flatnonzero(y <= M32)
        while len(out):
            out = self._shift(out)
        return missed, neither, s

    def flat(self, lanes: np.ndarray, bits: int) -> np.ndarray:
        step = self.range[lanes] >> bits
        value = np.minimum((self.offset[lanes] / step).astype(I), (1 << bits) - 1)
        self.offset[lanes] -= step * value
        self.range[lanes] = step
        out = lanes[step <= M32]
        while len(out):
            out = self._shift(out)
        return value

    def _shift(self, lanes: np.ndarray) -> np.ndarray:
        length, at = _at(self.range, lanes) << 16, _at(self.next, lanes)
        self.range[lanes], self.next[lanes] = length, at + 1
        self.offset[lanes] = _at(self.offset, lanes) << 16 | _at(self.words, at)
        return lanes[length <= M32]


def _likeliest(contexts: np.ndarray, symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By context, of n: the symbol that followed it most often, how often it did, and how often any did."""
    runs = contexts << np.uint32(SYMBOL)
    runs |= symbols
    runs.sort()
    at = np.flatnonzero(runs[1:] != runs[:-1]) + 1
    at = np.concatenate([[0], at])
    count, pair = np.diff(at, append=len(runs)), runs[at].astype(I)
    context = pair >> SYMBOL
    at = np.concatenate([[0], np.flatnonzero(context[1:] != context[:-1]) + 1])
    likeliest, held, every = (np.zeros(n, I) for _ in range(3))
    best = np.maximum.reduceat(count << SYMBOL | pair & ((1 << SYMBOL) - 1), at)
    likeliest[context[at]], held[context[at]], every[context[at]] = best & ((1 << SYMBOL) - 1), best >> SYMBOL, np.add.reduceat(count, at)
    return likeliest, held, every


def _level(held: np.ndarray, every: np.ndarray) -> np.ndarray:
    """The level of a chance, as held of every."""
    return np.searchsorted(np.arange(1, LEVELS) ** 2, (held << 2 * LEVEL) // np.maximum(every, 1), side="right")


def _hashed(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    kind = last.dtype.type
    return before * kind(30011) + last * kind(40503) & kind((1 << PAIR) - 1)


class _Model:
    """What the ids of a frame have in common.

    The symbol of the rare ids follows those of the frequent ones, and stands for what is before a block, too; the next one
    stands for an id that was foreseen. Foreseen symbols are kept with the level of their chance, as symbol << LEVEL | level.
    """

    def __init__(self, often: np.ndarray, freq: np.ndarray, one: np.ndarray, pairs: np.ndarray, two: np.ndarray, bits: int):
        self.often, self.bits, self.rare, self.foreseen = often, bits, len(often), np.int32(len(often) + 1)
        self.head, self.one = (often, freq, one, pairs, two), one.astype(np.int32)
        # Marked, so that the greater of both is that of order 2 where there is one.
        self.two = np.zeros(1 << PAIR, np.int32)
        self.two[pairs] = two + MARK
        self.start = np.append(np.cumsum(freq, dtype=I) - freq, 0)
        self.width = np.append(freq.astype(I), 1 << BITS)
        self.at = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    @classmethod
    def learned(cls, ids: np.ndarray) -> tuple[_Model, np.ndarray]:
        """The model of ids, and their symbols."""
        top, enough = int(ids.max()), max(OFTEN, len(ids) // ((1 << SYMBOL) - 2) + 1)
        if top < 1 << 17:
            count = np.bincount(ids)
            often = np.flatnonzero(count >= enough)
            number = np.full(top + 1, len(often), np.uint32)
            number[often] = np.arange(len(often))
            symbols, count = number.take(ids), count[often]
        else:
            own, place, count = np.unique(ids, return_inverse=True, return_counts=True)
            kept = count >= enough
            symbols = np.where(kept, np.cumsum(kept) - 1, kept.sum()).astype(np.uint32)[place]
            often, count = own[kept].astype(I), count[kept]
        rare = len(often)
        count = np.append(count, len(ids) - count.sum())
        known = np.concatenate([np.full(2, rare, np.uint32), symbols])
        next_one, held, every = _likeliest(known[1:-1], symbols, rare + 1)
        one = next_one << LEVEL | _level(held, every)
        next_two, held, every = _likeliest(_hashed(known[:-2], known[1:-1]), symbols, 1 << PAIR)
        pairs = np.flatnonzero((held >= 2 * OFTEN) & (held * 10 >= every))
        next_two, held, every = next_two[pairs], held[pairs], every[pairs]
        # What order 2 foresees needs no order-0 frequency; every symbol keeps the least one, as blocks begin without context.
        count = np.maximum(count - np.bincount(next_two, held, rare + 1).astype(I), 0)
        freq = 1 + count * ((1 << BITS) - len(count)) // max(int(count.sum()), 1)
        freq[np.argmax(freq)] += (1 << BITS) - freq.sum()
        return cls(often, freq, one, pairs, next_two << LEVEL | _level(held, every), top.bit_length()), symbols

    def packed(self) -> bytes:
        often, freq, one, pairs, two = self.head
        columns = (np.diff(often, prepend=0), "<u4"), (freq - 1, "<u2"), (one, "<u4"), (np.diff(pairs, prepend=0), "<u4"), (two, "<u4")
        planes = (c.astype(t).view("u1").reshape(len(c), int(t[2])).T.tobytes() for c, t in columns)
        return struct.pack("<III", len(often), len(pairs), self.bits) + zlib.compress(b"".join(planes))

    @classmethod
    def unpacked(cls, data: bytes) -> _Model:
        n, m, bits = struct.unpack_from("<III", data)
        raw, at, columns = np.frombuffer(zlib.decompress(data[12:]), "u1"), 0, []
        for size, kind, width in ((n, "<u4", 4), (n + 1, "<u2", 2), (n + 1, "<u4", 4), (m, "<u4", 4), (m, "<u4", 4)):
            planes = np.ascontiguousarray(raw[at : at + size * width].reshape(width, size).T)
            columns.append(planes.view(kind).ravel().astype(I))
            at += size * width
        often, freq, one, pairs, two = columns
        return cls(np.cumsum(often), freq + 1, one, np.cumsum(pairs), two, bits)


class _Mix:
    """The chances of each lane."""

    def __init__(self, model: _Model, lanes: int):
        self.model, self.at = model, np.arange(0, lanes * KINDS, KINDS, np.int32)
        self.told = np.tile(TOLD, 3)
        self.seen, self.weight = np.tile(self.told, (lanes, 1)), np.full((lanes, 1), 32, I)
        self.mixed = self.seen.ravel()

    def foresee(self, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both symbols foreseen after two others, whether they differ, and which chances of the lane are theirs."""
        one, two = _at(self.model.one, last), _at(self.model.two, _hashed(before, last))
        np.maximum(one, two, out=two)
        two &= MARK - 1
        p, p1 = two >> LEVEL, one >> LEVEL
        differ = p != p1
        two &= LEVELS - 1
        two += self.at[: last.shape[-1]]
        two += differ * np.int32(LEVELS)
        one &= LEVELS - 1
        one += self.at[: last.shape[-1]] + np.int32(2 * LEVELS)
        return p, p1, differ, two, one

    def chances(self, differ: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where both foresee the same id, the second way is none."""
        return _at(self.mixed, first), _at(self.mixed, second) * differ

    def learn(self, differ: np.ndarray, first: np.ndarray, second: np.ndarray, missed: np.ndarray, neither: np.ndarray) -> None:
        """Takes in what came of the decisions."""
        asked = differ & missed
        n = np.bincount((first << 1 | missed).ravel(), minlength=2 * self.seen.size)
        n += np.bincount(second[asked] << 1 | neither[asked], minlength=2 * self.seen.size)
        held, failed = n[0::2].reshape(self.seen.shape), n[1::2].reshape(self.seen.shape)
        # How much farther from what came the told chances were than the seen ones; a chance is as far as the odds it gave to the other end.
        farther = ((failed - held) * (self.told - self.seen)).sum(1, keepdims=True)
        self.weight = np.clip(self.weight - 4 * np.sign(farther), 4, 60)
        self.seen = np.clip((self.seen * 16 + held * ONE) // (held + failed + 16), LEAST, MOST)
        self.mixed = (self.seen + ((self.told - self.seen) * self.weight >> 6)).ravel()


def _write(model: _Model, coder: _Writer, steps: np.ndarray, counts: list[int]) -> None:
    """Codes the symbols of each step, below two rows of what was before."""
    mix, rows = _Mix(model, steps.shape[1]), max(1, TOGETHER // steps.shape[1])
    for lo in range(0, len(counts), CHUNK):
        coder.room(4 * CHUNK)  # an id never takes more than 4
        seen = []
        for at in range(lo, min(lo + CHUNK, len(counts)), rows):
            to = min(at + rows, lo + CHUNK, len(counts))
            own = steps[at + 2 : to + 2]
            p, p1, differ, first, second = mix.foresee(steps[at:to], steps[at + 1 : to + 1])
            missed = own != p
            neither = missed & (own != p1)
            s = np.where(neither, own, model.foreseen)
            for n, *step in zip(counts[at:to], *mix.chances(differ, first, second), missed, neither, _at(model.start, s), _at(model.width, s)):
                coder.put(n, *step)
            seen.append((differ, first, second, missed, neither))
        mix.learn(*map(np.concatenate, zip(*seen)))


def _read(model: _Model, coder: _Reader, lanes: int, counts: list[int]) -> np.ndarray:
    """The symbols of each step."""
    mix, steps = _Mix(model, lanes), np.full((len(counts) + 2, lanes), model.rare, np.int32)
    first, second = (np.tile(mix.at, (CHUNK, 1)) for _ in range(2))  # a lane that has ended learns for itself alone
    differ, missed, neither = (np.zeros((CHUNK, lanes), bool) for _ in range(3))
    for t, n in enumerate(counts):
        k = t % CHUNK
        p, p1, differ[k, :n], first[k, :n], second[k, :n] = mix.foresee(steps[t, :n], steps[t + 1, :n])
        missed[k, :n], neither[k, :n], s = coder.get(n, *mix.chances(differ[k, :n], first[k, :n], second[k, :n]), model)
        steps[t + 2, :n] = np.where(neither[k, :n], s, np.where(missed[k, :n], p1, p))
        if k == CHUNK - 1:
            mix.learn(differ, first, second, missed, neither)
    return steps[2:]


def _rare(model: _Model, symbols: np.ndarray, sizes: np.ndarray):
    """The rare ids of the lanes' rows: the first one of each lane that has any, then the second ones, and so on: lanes, places."""
    found = symbols == model.rare
    found[-1, sizes[-1] :] = False  # only the last block can be short
    lane, place = np.divmod(np.flatnonzero(found), found.shape[1])
    nth = np.arange(len(lane)) - np.searchsorted(lane, lane)
    order = np.argsort(nth, kind="stable")
    return [(lane[own], place[own]) for own in np.split(order, np.cumsum(np.bincount(nth))[:-1])] if len(lane) else []


def _digits(model: _Model) -> list[tuple[int, int]]:
    return [(low, min(15, model.bits - low)) for low in range(0, model.bits, 15)]


def _sizes(n: int) -> np.ndarray:
    return np.minimum(BLOCK, n - BLOCK * np.arange(-(-n // BLOCK)))


def _groups(blocks: int):
    """Ranges of blocks that are coded together, of like size."""
    n = -(-blocks // LANES)
    cuts = [blocks * k // n for k in range(n + 1)] if n else [0]
    return zip(cuts, cuts[1:])


def _counts(sizes: np.ndarray) -> list[int]:
    """How many lanes have an id, by step; only the last block can be short."""
    return [len(sizes) if t < sizes[-1] else len(sizes) - 1 for t in range(int(sizes.max()))]


def encode(ids: np.ndarray) -> bytes:
    """A frame: magic, number of ids, size of a block, size and crc32 of the model, the model, then for each block the size and
    crc32 of its code and the crc32 of its ids, then the codes."""
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() >= LIMIT):
        raise ValueError("ids must fit in 29 bits")
    raw, sizes, codes, head = ids.astype("<u4"), _sizes(len(ids)), [], b""
    if len(ids):
        model, symbols = _Model.learned(raw)
        head = model.packed()
    for lo, hi in _groups(len(sizes)):
        size, own = sizes[lo:hi], np.zeros((hi - lo) * BLOCK, np.int32)
        own[: size.sum()] = symbols[lo * BLOCK : hi * BLOCK]
        own, coder = own.reshape(-1, BLOCK), _Writer(len(size))
        _write(model, coder, np.concatenate([np.full((2, len(size)), model.rare, np.int32), own.T]), _counts(size))
        for lane, place in _rare(model, own, size):
            for low, bits in _digits(model):
                coder.flat(lane, bits, raw[(lo + lane) * BLOCK + place].astype(I) >> low & ((1 << bits) - 1))
        codes += coder.codes()
    heads = [struct.pack("<III", len(c), zlib.crc32(c), zlib.crc32(raw[k * BLOCK : (k + 1) * BLOCK].tobytes())) for k, c in enumerate(codes)]
    return MAGIC + HEAD.pack(len(ids), BLOCK, len(head), zlib.crc32(head)) + head + b"".join(heads) + b"".join(codes)


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame; a block whose code or ids don't have their checksum raises ValueError."""
    if frame[:4] != MAGIC or len(frame) < 4 + HEAD.size:
        raise ValueError("not a frame of token ids")
    n, block, size, crc = HEAD.unpack_from(frame, 4)
    if block != BLOCK:
        raise ValueError(f"blocks of {block} ids")
    begin = 4 + HEAD.size + size
    if len(frame) < begin + 12 * -(-n // BLOCK):
        raise ValueError("the frame is cut short")
    head = frame[4 + HEAD.size : begin]
    if zlib.crc32(head) != crc:
        raise ValueError("the model is damaged")
    sizes = _sizes(n)
    heads = [struct.unpack_from("<III", frame, begin + 12 * k) for k in range(len(sizes))]
    at, codes = begin + 12 * len(sizes), []
    for size, crc, _ in heads:
        codes.append(frame[at : at + size])
        at += size
        if zlib.crc32(codes[-1]) != crc or len(codes[-1]) != size:
            raise ValueError(f"block {len(codes) - 1} is damaged")
    out = np.zeros(len(sizes) * BLOCK, "<u4")
    model = _Model.unpacked(head) if n else None
    for lo, hi in _groups(len(sizes)):
        size, coder = sizes[lo:hi], _Reader(codes[lo:hi])
        symbols = np.ascontiguousarray(_read(model, coder, len(size), _counts(size)).T)
        own = np.zeros((len(size), BLOCK), "<u4")
        own[:, : symbols.shape[1]] = _at(np.append(model.often, 0).astype("<u4"), symbols)
        for lane, place in _rare(model, symbols, size):
            for low, bits in _digits(model):
                own[lane, place] |= (coder.flat(lane, bits) << low).astype("<u4")
        out[lo * BLOCK : hi * BLOCK] = own.ravel()
    ids = out[:n]
    for k, (_, _, crc) in enumerate(heads):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].tobytes()) != crc:
            raise ValueError(f"the ids of block {k} don't have their checksum")
    return ids
