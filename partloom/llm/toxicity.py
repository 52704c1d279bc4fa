"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, drops accents and invisible characters, maps look-alike letters of other scripts and digit or sign
substitutions to the Latin letters they stand for, and turns every other character into a space. Lexicon entries are words or beginnings of words whose documents
are labelled toxic far more often than others; their weights are log odds. Words inside an exception phrase don't count.
A document's density is the weight of its matches over its words, so long texts need more than short ones; a logistic
curve, fitted to the same sample, makes it a probability.

The lexicon and the curve are learned from at most about SAMPLE_ROWS labelled rows, drawn by a hash of the id. An entry
stands in a share of the toxic rows, so there are at most the features of a toxic row, on average, over that share.

Defined cases: null texts are empty; an empty text has density 0 and gets that probability; several labels of one document
count as the largest; without labels of both kinds the score is the share of toxic labels (0 without any); repeated rows
each get their row, and rows with a null doc_id, which no label can have; texts of any length are matched whole; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import arrow_rows, crc_mod, kept, stored

#: Labelled rows that are learned from, at most (in expectation); the bound of the model.
SAMPLE_ROWS = 8192
#: Lengths of word beginnings that may become entries; whole words may at any length.
PREFIXES = range(4, 9)
#: An entry stands in so many toxic documents of the sample at least, and in this share of them.
LEAST_TOXIC, LEAST_SHARE, LEAST_ODDS, LEAST_G2 = 4, 0.02, 2.0, 12.0

# Letters of other scripts and signs that are read as Latin letters.
LOOKALIKES = dict(zip("асеорхуіјѕԁһкмтвнαορτυνικχеοΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХУІ", "aceopxyijsdhkmtbhaoptuvikxeoabezhikmnoptyxabekmhopctxyi"))
SIGNS = dict(zip("013457@$!8", "oieastasib"))
# Phrases in which a word of abuse is used otherwise, unless the caller gives others.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "scum layer", "pond scum", "sore loser", "stupid question", "class clown")


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        if unicodedata.category(c) in ("Mn", "Me", "Cf"):  # marks on letters, and characters that can't be seen
            folded = ""
        else:
            whole = LOOKALIKES.get(c) or SIGNS.get(c) or c
            parts = (x for x in unicodedata.normalize("NFKD", whole) if not unicodedata.combining(x))
            letters = "".join(LOOKALIKES.get(x) or SIGNS.get(x) or x for x in parts).lower()
            folded = "".join(x if x.isalpha() else " " for x in letters) or " "
        self[code] = folded
        return folded


_FOLD = _Fold()


def fold(text: str) -> str:
    """The folded text, with one space before each word and one at the end."""
    return " " + " ".join(text.translate(_FOLD).split()) + " "


def features(folded: str) -> set[str]:
    """The possible lexicon entries in a folded text: a leading space marks a word's begin, a trailing one its end."""
    out = set()
    for w in set(folded.split()):
        out.update(" " + w[:k] for k in PREFIXES if k <= len(w))
        out.add(f" {w} ")
    return out


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.machine = ahocorasick.Automaton()
        for phrase in map(fold, exceptions):
            self.machine.add_word(phrase, (len(phrase), None))
        for entry, w in weights.items():
            self.machine.add_word(entry, (len(entry), w))
        self.machine.make_automaton()

    def density(self, text: str) -> float:
        """Weight of the matched words over the number of words; a word counts once, by its heaviest entry."""
        folded = fold(text)
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, w) in self.machine.iter(folded):
            start = end - size + 1
            if w is None:
                spared.append((start, end))
            elif w > found.get(start, 0.0):
                found[start] = w
        if spared:
            spared.sort()
            begins, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))  # how far the spans up to each go
            found = {s: w for s, w in found.items() if not ((k := bisect_right(begins, s)) and s < reach[k - 1])}
        return sum(found.values()) / (folded.count(" ") + 1) if found else 0.0


def _curve(x: np.ndarray) -> np.ndarray:
    return np.log(x + 1e-3) - math.log(1e-3)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a small ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        move = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def entries(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the entries kept of (feature, toxic documents, clean documents)."""

    def g2(t: int, c: int) -> float:
        n, both = n_toxic + n_clean, t + c
        cells = ((t, both * n_toxic / n), (c, both * n_clean / n), (n_toxic - t, (n - both) * n_toxic / n), (n_clean - c, (n - both) * n_clean / n))
        return 2 * sum(o * math.log(o / e) for o, e in cells if o and e)

    odds = {f: math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1)) for f, t, c in counts if t >= max(LEAST_TOXIC, LEAST_SHARE * n_toxic)}
    strong = {f: g2(t, c) for f, t, c in counts if odds.get(f, 0) >= LEAST_ODDS}
    strong = {f: g for f, g in strong.items() if g >= LEAST_G2}
    # A longer entry goes where a beginning of it is one already, unless that one is much the weaker.
    out = {f: g for f, g in strong.items() if not any(odds[b] >= odds[f] - 1.5 for k in range(5, len(f)) if (b := f[:k]) in strong)}
    return {f: odds[f] for f in sorted(out, key=lambda f: (-out[f], f))}


class Model:
    def __init__(self, weights: dict[str, float], slope: float, offset: float, flat: float | None = None, exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.slope, self.offset, self.flat, self.exceptions = weights, slope, offset, flat, exceptions


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """A model of labels.toxic, from about `bound` labelled rows of docs."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    total = known.count()
    share = min(1 << 20, -(-(bound << 20) // max(total, 1)))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share
    rows = docs.select("doc_id", "text").where(drawn).join(known.where(drawn), "doc_id").select("text", "toxic")
    rows = stored(rows, "toxicity-sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, 0.0, 0.0, n_toxic / max(1, n_toxic + n_clean), exceptions)

    def count(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                for f in features(fold(text or "")):
                    seen.setdefault(f, [0, 0])[y] += 1
        names = list(seen)
        yield pa.RecordBatch.from_pydict({"f": names, "clean": [seen[x][0] for x in names], "toxic": [seen[x][1] for x in names]})

    counts = rows.mapInArrow(count, "f string, clean bigint, toxic bigint").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    kept = counts.where((F.col("toxic") >= max(LEAST_TOXIC, LEAST_SHARE * n_toxic)) & (odds >= LEAST_ODDS))
    weights = entries([(r["f"], r["toxic"], r["clean"]) for r in kept.collect()], n_toxic, n_clean)

    schema = pa.schema([("x", pa.float64()), ("toxic", pa.int32())])

    def densities(c: dict) -> dict:
        lexicon = _lexicon(weights, exceptions)
        return {"x": [lexicon.density(t or "") for t in c["text"]], "toxic": c["toxic"]}

    seen = rows.mapInArrow(arrow_rows(["text", "toxic"], schema, densities), "x double, toxic int").toPandas()
    slope, offset = logistic(_curve(seen["x"].to_numpy()), seen["toxic"].to_numpy(float))
    return Model(weights, slope, offset, None, exceptions)


def _lexicon(weights: dict[str, float], exceptions: tuple[str, ...]) -> Lexicon:
    return kept(("toxicity", tuple(weights.items()), exceptions), lambda: Lexicon(weights, exceptions))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of label 1 of every row's whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    weights, slope, offset, flat, exceptions = model.weights, model.slope, model.offset, model.flat, model.exceptions

    def step(c: dict) -> dict:
        if flat is not None:
            return {"doc_id": c["doc_id"], "score": [float(flat)] * len(c["doc_id"])}
        lexicon = _lexicon(weights, exceptions)
        x = np.array([lexicon.density(t or "") for t in c["text"]])
        return {"doc_id": c["doc_id"], "score": 1 / (1 + np.exp(-(slope * _curve(x) + offset)))}

    return docs.select("doc_id", "text").mapInArrow(arrow_rows(["doc_id", "text"], schema, step), "doc_id bigint, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: learned from the four folds that aren't held out."""
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = learn(docs.where(~held), labels.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
