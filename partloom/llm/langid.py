"""Language identification by cross-parsing entropy.

For each learned language a suffix automaton holds every substring of a bounded sample of its labelled text. A text is
parsed greedily into longest matches against each automaton, from its first letter to its last, and the language that needs
the fewest phrases wins. Phrases get longer as samples grow, so numbers of phrases are normalised: languages are compared only
by automata of samples of one length. Languages of about one sample length are a group, cut to its shortest; the best of the
group with the longest samples meets those of the next one by an automaton of its own sample cut to their length, and so on.
So a language with a small sample has to beat one rival, at its own length, and those with large samples use all of them.

Texts are parsed side by side in segments of SEGMENT letters. A segment's phrases depend on where the one before it ends, so
each parse goes on into the next segment until both are in the same state, and what lies before that place is counted anew; a
text in which they don't meet within a segment is parsed letter by letter. The counts are thus those of one parse.

Letters are lower-cased, and any run of other characters counts as one space. Each automaton has a class for every letter of
its own sample; a letter that the sample lacks is a phrase of its own.

Defined cases: null texts and texts without a letter are `und` with score 0; with one learned language the score is 1, with
none every text is `und`; ties go to the language with more labelled rows, then by name; null labels are not learned from,
nor are labels whose drawn texts have no letter; a null doc_id keeps its row and is drawn like any other; repeated rows each
get their row; texts of any length are parsed whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.llm.common import annotated, arrow_rows, crc_mod, fresh, kept

#: Letters of sample text a language is learned from; the bound of the model.
SAMPLE_CHARS = 32_768
#: Labelled documents of a language that are drawn, by a hash, to fill the sample.
SAMPLE_DOCS = 96
#: Characters that one drawn document adds to a sample: a window at a place that the hash decides.
DOC_CHARS = 1024
#: Letters that are parsed side by side.
SEGMENT = 512
#: Classes up to which an automaton's transitions are a dense table, and most bytes of a worker's dense tables; beyond either
#: they are hashed, which takes some 3 MB a language.
DENSE, DENSE_BYTES = 160, 256 << 20
#: Samples of a group are at most so many times as long as its shortest.
ALIKE = 1.25
NONE = "und"

_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def letters(text: str) -> np.ndarray:
    """The code points of a text's letters, each run of other characters as one 0."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    a = np.where(_is_letter()[a], a, 0)
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 0) | (a[:-1] != 0)
    return a[keep]


def automaton(seq: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of the suffix automaton of seq. State 0 is the root."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in seq:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


class _Dense:
    """An automaton as a table of next states by state and class; the low bit tells that a phrase ends before the letter."""

    def __init__(self, step: list[dict[int, int]], size: int):
        t = np.full((len(step) + 1, size), -1, np.int32)
        for s, d in enumerate(step):
            if d:
                t[s, list(d)] = list(d.values())
        # Where the match ends, the next phrase begins with the same letter. The last row stands before a text and after a
        # letter that the sample lacks, so whatever follows begins a phrase.
        self.begin = len(step)
        missing = t < 0
        t = np.where(missing, np.where(t[0] < 0, self.begin, t[0])[None, :], t)
        self.size, self.table = size, ((t << 1) | missing).ravel()

    def next(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        return self.table.take(state * self.size + letter)

    def count(self, seq: np.ndarray) -> int:
        """The phrases of one sequence, letter by letter."""
        state, total = self.begin, 0
        for c in seq.tolist():
            got = int(self.table[state * self.size + c])
            total += got & 1
            state = got >> 1
        return total


class _Hashed:
    """The same for large alphabets: transitions in an open hash table."""

    def __init__(self, step: list[dict[int, int]], size: int):
        self.begin, self.size = len(step), size
        self.root = np.full(size, self.begin << 1 | 1, np.int64)
        for c, to in step[0].items():
            self.root[c] = to << 1 | 1
        pairs = [(s * size + c, to << 1) for s, d in enumerate(step) for c, to in d.items()]
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift = 64 - bits
        self.key, self.to = np.full((1 << bits) + len(pairs) + 1, -1, np.int64), np.zeros((1 << bits) + len(pairs) + 1, np.int32)
        for slot, (k, to) in zip(self._slot(np.array([k for k, _ in pairs], np.int64)).tolist(), pairs):
            while self.key[slot] >= 0:
                slot += 1
            self.key[slot], self.to[slot] = k, to

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def next(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.size + letter
        slot = self._slot(key)
        found = self.key.take(slot)
        while len(more := np.flatnonzero((found != key) & (found >= 0))):
            slot[more] += 1
            found[more] = self.key.take(slot[more])
        return np.where(found == key, self.to.take(slot), self.root.take(letter))

    def count(self, seq: np.ndarray) -> int:
        state, total = np.array([self.begin]), 0
        for k in range(len(seq)):
            got = self.next(state, seq[k : k + 1])
            total += int(got[0]) & 1
            state = got >> 1
        return total


class Model:
    def __init__(self, samples: list[tuple[str, str]]):
        """samples: language and text, in the order in which ties are decided; those without a letter are left out."""
        seqs = [(lang, letters(text)[:SAMPLE_CHARS]) for lang, text in samples]
        seqs = [(lang, seq) for lang, seq in seqs if seq.any()]
        self.langs = [lang for lang, _ in seqs]
        # Classes over all samples, the last for letters that none has.
        self.known = np.unique(np.concatenate([seq for _, seq in seqs])) if seqs else np.zeros(0, np.int32)
        self.of = np.full(0x110000, len(self.known), np.int32)
        self.of[self.known] = np.arange(len(self.known))
        self.seqs = [seq for _, seq in seqs]
        self.groups: list[tuple[int, list[int]]] = []  # common length of the samples, and the languages
        for i in sorted(range(len(seqs)), key=lambda i: (-len(self.seqs[i]), i)):
            n = len(self.seqs[i])
            if self.groups and len(self.seqs[self.groups[-1][1][0]]) <= ALIKE * n:
                self.groups[-1] = (n, [*self.groups[-1][1], i])
            else:
                self.groups.append((n, [i]))
        self.machines: dict[tuple[int, int], tuple] = {}
        self.dense = 0

    def machine(self, lang: int, size: int) -> tuple:
        """The classes of a language's own letters (0: one that its sample lacks) and its automaton, of so many letters."""
        if (lang, size) not in self.machines:
            seq = self.seqs[lang][:size]
            mine = np.unique(seq)
            own = np.zeros(len(self.known) + 1, np.int64)
            own[np.searchsorted(self.known, mine)] = np.arange(1, len(mine) + 1)
            step = automaton((np.searchsorted(mine, seq) + 1).tolist())
            cost = 4 * (len(step) + 1) * (len(mine) + 1)
            small = len(mine) < DENSE and self.dense + cost <= DENSE_BYTES
            self.dense += cost if small else 0
            self.machines[lang, size] = own, (_Dense if small else _Hashed)(step, len(mine) + 1)
        return self.machines[lang, size]

    def classes(self, text: str) -> np.ndarray:
        """The classes of a text's letters."""
        return self.of[letters(text)]

    def phrases(self, seqs: list[np.ndarray], which: list[tuple[int, int]] | None = None) -> np.ndarray:
        """Phrases of each sequence by each automaton (language and sample length; all, of whole samples, if not given)."""
        which = [(i, len(s)) for i, s in enumerate(self.seqs)] if which is None else which
        sizes = np.array([-(-len(s) // SEGMENT) for s in seqs])
        owner = np.repeat(np.arange(len(seqs)), sizes)
        flat = np.concatenate(seqs)
        first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])[:-1]])
        begin = np.concatenate([f + SEGMENT * np.arange(n) for f, n in zip(first, sizes)])
        size = np.minimum(SEGMENT, np.repeat(first + [len(s) for s in seqs], sizes) - begin)
        follows = np.concatenate([[False], owner[1:] == owner[:-1]]) if len(owner) else np.zeros(0, bool)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        padded = np.concatenate([flat, np.zeros(SEGMENT, flat.dtype)])
        grid = padded[begin[order][:, None] + np.arange(SEGMENT)].T.copy()
        active = np.searchsorted(-size[order], -np.arange(1, SEGMENT + 1), side="right")
        steps = int(size.max()) if len(size) else 0
        # Lanes whose segment follows another one, and the lanes of those.
        later = np.flatnonzero(follows)
        lane, before = place[later], place[later - 1]
        out = np.zeros((len(seqs), len(which)), np.int64)
        for i, key in enumerate(which):
            own, machine = self.machine(*key)
            letter = own[grid]
            state = np.full(len(order), machine.begin, np.int64)
            ends = np.zeros(len(order), np.int64)
            states, marks = np.zeros((SEGMENT, len(order)), np.int32), np.zeros((SEGMENT, len(order)), np.int8)
            for t in range(steps):
                k = active[t]
                got = machine.next(state[:k], letter[t, :k])
                marks[t, :k] = got & 1
                state[:k] = states[t, :k] = got >> 1
            ends += marks.sum(0, dtype=np.int64)
            apart = self._go_on(machine, letter, state, states, marks, ends, lane, before, size[order])
            out[:, i] = np.bincount(owner, ends[place], len(seqs))
            for k in np.unique(owner[later[apart]]):
                out[k, i] = machine.count(own[seqs[k]])
        return out

    @staticmethod
    def _go_on(machine, letter, state, states, marks, ends, lane, before, size) -> np.ndarray:
        """Corrects ends of segments by the parses that come into them; returns which whole segments of `lane` they go through
        without meeting the fresh parse."""
        on, met = np.arange(len(lane)), np.zeros(len(lane), bool)
        now = state[before]
        for t in range(SEGMENT):
            on = on[size[lane[on]] > t]
            if not len(on):
                break
            at = lane[on]
            got = machine.next(now[on], letter[t, at])
            ends[at] += (got & 1) - marks[t, at]
            now[on] = got >> 1
            same = now[on] == states[t, at]
            met[on[same]] = True
            on = on[~same]
        return np.flatnonzero(~met & (size[lane] == SEGMENT))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [NONE] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        seqs = [letters(t or "") for t in texts]
        known = [i for i, s in enumerate(seqs) if s.any()]
        if not known:
            return langs, scores
        best, share = self._best([self.of[seqs[i]] for i in known])
        for i, b, x in zip(known, best.tolist(), share.tolist()):
            langs[i], scores[i] = self.langs[b], x
        return langs, scores

    def _best(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The language of each sequence, and the least share of phrases by which it has won over a rival."""
        best, share = np.full(len(seqs), -1), np.ones(len(seqs))
        for size, members in self.groups:
            cost = self.phrases(seqs, [(i, size) for i in members])
            who = np.broadcast_to(members, cost.shape)
            if best[0] >= 0:
                mine = np.zeros((len(seqs), 1), np.int64)
                for i in np.unique(best):
                    at = np.flatnonzero(best == i)
                    mine[at] = self.phrases([seqs[k] for k in at], [(int(i), size)])
                cost, who = np.hstack([mine, cost]), np.hstack([best[:, None], who])
            # Of equal costs the language that stands first wins.
            won = np.lexsort((who, cost), axis=1)[:, 0]
            rows = np.arange(len(seqs))
            least, winner = cost[rows, won], who[rows, won]
            if cost.shape[1] > 1:
                others = cost.copy()
                others[rows, won] = np.iinfo(np.int64).max
                other = others.min(1)
                now = other / (other + least)
                share = np.where(winner == best, np.minimum(share, now), now)
            best = winner
        return best, share


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text.lower())


def samples(labelled: DataFrame, chars: int = SAMPLE_CHARS, docs: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """For each label a bounded sample: of about `docs` documents drawn by a hash, a window of DOC_CHARS each, 4 * docs at most.

    Labels can be wrong, so each half of what was drawn is judged by models of the other half, and documents that these take
    for another language are left out, unless that leaves a language with none.
    """
    kept = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 20, -(-(docs << 20) // n)))]), F.col("lang"))
    drawn = kept.withColumn("h", F.xxhash64("doc_id", "text")).where(F.pmod("h", F.lit(1 << 20)) < share)
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - DOC_CHARS, F.lit(0)) + 1).cast("int") + 1
    drawn = drawn.select("lang", "h", F.substring("text", begin, DOC_CHARS).alias("text"))
    # Repeated rows have one hash and may be many; a language needs no more than so many of them.
    few = F.row_number().over(W.partitionBy("lang").orderBy("h", "text")) <= 4 * docs
    rows = sorted(drawn.withColumn("few", few).where("few").select("lang", "h", "text").collect(), key=lambda r: (r["h"], r["text"]))
    order = sorted(counts, key=lambda x: (-counts[x], x))
    pool: dict[str, list[str]] = {lang: [] for lang in order}
    for r in rows:
        pool[r["lang"]].append(r["text"])
    join = lambda texts: " ".join(texts)[: 2 * chars]
    agreed: dict[str, list[tuple[int, str]]] = {lang: [] for lang in order}
    for half in (0, 1):
        other = Model([(lang, join(pool[lang][1 - half :: 2])) for lang in order])
        for lang in order:
            own = pool[lang][half::2]
            found = other.predict(own)[0] if lang in other.langs else [lang] * len(own)
            agreed[lang] += [(2 * k + half, t) for k, (t, p) in enumerate(zip(own, found)) if p == lang]
    found = [(lang, join([t for _, t in sorted(agreed[lang])] or pool[lang])) for lang in order]
    return [(lang, text) for lang, text in found if has_letter(text)]


def _model(learned: list[tuple[str, str]]) -> Model:
    key = hashlib.sha256(repr(learned).encode("utf-8", "surrogatepass")).hexdigest()
    return kept(("language", key), lambda: Model(learned))


def identify(docs: DataFrame, learned: list[tuple[str, str]]) -> DataFrame:
    """doc_id, lang_pred and score of every row's whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # at most 2 * SAMPLE_CHARS letters a language

    def step(c: dict) -> dict:
        langs, scores = _model(shared.value).predict(c["text"])
        return {"doc_id": c["doc_id"], "lang_pred": langs, "score": scores}

    return docs.select("doc_id", "text").mapInArrow(arrow_rows(["doc_id", "text"], schema, step), "doc_id bigint, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: learned from the three folds that aren't held out."""
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    found = identify(docs, samples(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a letter; missing labels are filled in with the language learned from docs itself.

    No text with a letter is rejected, whatever its cost. Where no row has a label, nothing is learned and labels stay null.
    """
    learned = samples(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    name = fresh(docs, "lang_pred")
    if learned:
        step = lambda texts: [_model(shared.value).predict(texts)[0]]
    else:
        step = lambda texts: [[None if has_letter(t or "") else NONE for t in texts]]
    found = annotated(docs, [(name, "string", pa.string())], step)
    return found.where(~F.col(name).eqNullSafe(F.lit(NONE))).select(*[F.coalesce("lang", name).alias("lang") if c == "lang" else F.col(c) for c in docs.columns])
