"""Plain versions of the operators, for tests only."""

import re
from collections import Counter

from partloom.llm import secrets

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def near_groups(texts: dict, width: int, percent: int) -> dict:
    """The smallest id that each id is linked with, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    of = {i: i for i in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                of[y] = x
    return {i: find(i) for i in ids}, sets


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits(text, items: dict):
    """Hit words and ids of the items that a text shares a window with."""
    w, marked, found = item_words(text), set(), set()
    for i, t in items.items():
        own = item_words(t)
        n = min(10, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k : k + n]) in windows:
                marked.update(range(k, k + n))
                found.add(i)
    return len(w), len(marked), found


def base_counts(texts: dict, learned: set):
    count = Counter()
    for i, t in texts.items():
        if i in learned:
            count.update([*words(t), None])
    return count


def pipeline(rows, benchmark, languages):
    """The rows that all stages keep, and their texts: one after another, each by its plain version."""
    kept = {i: t for i, t in rows.items() if languages[i] != "und"}
    group, _ = near_groups(kept, 5, 80)
    kept = {i: t for i, t in kept.items() if group[i] == i}
    kept = {i: t for i, t in kept.items() if not hits(t, benchmark)[1]}
    return {i: secrets.redact(t, (b := secrets.base_spans(t)) + secrets.linked(t, b)) for i, t in kept.items()}


def linked(text: str, base: list) -> set:
    """The weak parts that something completes, by looking at all pairs."""
    weak = [w for w in secrets.weak_parts(text) if all(e <= w[1] or s >= w[2] for _, s, e in base)]
    near = lambda a, b: (a[2] <= b[1] <= a[2] + secrets.SCOPE) or (b[2] <= a[1] <= b[2] + secrets.SCOPE)
    some = lambda kinds, spans: [x for x in spans if x[0] in kinds]
    ids = some(("account",), weak) + some(("access",), base)
    words = [w for w in some(("entropy",), weak) if any(near(w, x) for x in ids + some(("endpoint",), weak))]
    strong = some(("assign", "hex"), base) + words
    out = set(words) | {w for w in some(("account",), weak) if any(near(w, x) for x in strong)}
    return out | {w for w in some(("endpoint",), weak) if any(near(w, x) for x in strong + some(("access",), base))}


def density(text: str, weights: dict, exceptions: tuple) -> float:
    """Weight of the words that an entry begins, by looking at every word and entry."""
    from partloom.llm import toxicity

    folded = toxicity.fold(text or "")
    # The space after a phrase is the one before the next word, which isn't spared.
    spared = [(k, k + len(x) - 1) for x in map(toxicity.fold, exceptions) for k in range(len(folded)) if folded.startswith(x, k)]
    total = 0.0
    for m in re.finditer(" (?=[^ ])", folded):
        at = m.start()
        best = max((w for e, w in weights.items() if folded.startswith(e, at)), default=0.0)
        if not any(a <= at < b for a, b in spared):
            total += best
    return total / (folded.count(" ") + 1)
