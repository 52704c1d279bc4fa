"""Plans carried out on a file system that all machines mount: guarded moves with a journal, and swaps of revisions.

Tasks can be killed at any point and plans run again: every step looks at what is there before it acts, so it is done once.
"""

from __future__ import annotations

import filecmp
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.operators.naming import MAX_PATH
from partloom.sources.sinks import _above
from partloom.sources.storage import stored

DONE = "level int, seq long, action string, src string, dst string, status string"


def _linked(path: str, root: str) -> bool:
    """Whether a path, or a folder above it below root, is a link."""
    return any(os.path.islink(p) for p in (path, *_above(path)) if p.startswith(root.rstrip("/") + "/"))


def longest_below(folder: str) -> int | None:
    """The length of the longest path below a folder, counted from it; None if it holds a link or can't be listed."""
    errors: list[OSError] = []
    longest = 0
    for top, folders, files in os.walk(folder, onerror=errors.append):
        for name in (*folders, *files):
            at = os.path.join(top, name)
            if os.path.islink(at):
                return None
            longest = max(longest, len(at) - len(folder) - 1)
    return None if errors else longest


class Journal:
    """What a plan has begun and done: an empty file for a step that began, and one with its status once it is done."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _at(self, seq: int, what: str) -> str:
        return os.path.join(self.folder, f"{seq}.{what}")

    def status(self, seq: int) -> str | None:
        try:
            with open(self._at(seq, "done"), encoding="utf-8") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def begin(self, seq: int) -> bool:
        """Whether the step was begun before."""
        try:
            os.close(os.open(self._at(seq, "begun"), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return True
        return False

    def end(self, seq: int, status: str) -> str:
        staged = self._at(seq, uuid.uuid4().hex)
        with open(staged, "w", encoding="utf-8") as f:
            f.write(status)
            f.flush()
            os.fsync(f.fileno())
        os.replace(staged, self._at(seq, "done"))
        return status


def _refusal(action: str, src: str, dst: str, root: str, limit: int) -> str | None:
    if not os.path.exists(src):
        return "failed: no source"
    if _linked(src, root) or (dst and _linked(dst, root)):
        return "review: link"
    below = longest_below(src) if os.path.isdir(src) else 0
    if below is None:
        return "review: link or unreadable below"
    if action in ("move", "copy"):
        if os.path.exists(dst):
            return "review: destination exists"
        if len(dst) + (1 + below if below else 0) > limit:
            return "review: path too long"
    return None


def step(action: str, src: str, dst: str, seq: int, root: str, journal: Journal, limit: int, at: Callable[[str, int], None] | None = None) -> str:
    """Carries out one step, or what is left of it, and returns its status. at: told "begun" and "acted", for tests."""
    if (known := journal.status(seq)) is not None:
        return known
    again = journal.begin(seq)
    src, dst = os.path.join(root, src), os.path.join(root, dst) if dst else ""
    if at:
        at("begun", seq)
    acted = again and (not os.path.exists(src) if action in ("move", "delete") else os.path.exists(dst))
    if not (acted and (action == "delete" or os.path.exists(dst))):
        if (no := _refusal(action, src, dst, root, limit)) is not None:
            return journal.end(seq, no)
        try:
            if action == "delete":
                shutil.rmtree(src) if os.path.isdir(src) else os.remove(src)
            else:
                os.makedirs(os.path.dirname(dst), exist_ok=True)
                if action == "move":
                    os.rename(src, dst)
                else:
                    _copied_beside(src, dst)
        except OSError as e:
            if os.path.exists(src) or not (dst and os.path.exists(dst)):  # else another attempt of this step has done it
                return journal.end(seq, f"failed: {e.strerror}")
    if at:
        at("acted", seq)
    return journal.end(seq, "done")


def _copied_beside(src: str, dst: str) -> None:
    """A copy that stands whole or not at all; what a killed attempt has left beside it is swept with other staged copies."""
    staged = f"{dst}.{uuid.uuid4().hex}.part"
    shutil.copytree(src, staged) if os.path.isdir(src) else shutil.copy2(src, staged)
    os.rename(staged, dst)


def execute(plan: DataFrame, root: str, journal: str, limit: int = MAX_PATH, at: Callable[[str, int], None] | None = None) -> DataFrame:
    """plan (level, seq, action move, copy or delete, src, dst below root) with the status of every step.

    Levels run one after another, as folders that move have moved before what they hold is touched; the steps of a level run
    side by side. A plan that was stopped is run again with the same journal: what is done is skipped, and what was begun is
    finished. A step that its guards refuse (a link, a destination that exists, a path beyond the limit) is for review and
    changes nothing.
    """
    rows = stored(plan.select("level", "seq", "action", "src", "dst"), "plan")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log = Journal(journal)
        for b in batches:
            said = [step(r.action, r.src, r.dst, r.seq, root, log, limit, at) for r in b.itertuples()]
            yield b.assign(status=said)

    out = plan.sparkSession.createDataFrame([], DONE)
    for level in sorted(r["level"] for r in rows.select("level").distinct().collect()):
        out = out.unionByName(stored(rows.where(F.col("level") == level).repartition("seq").mapInPandas(run, DONE), "done"))
    return out


def plan_of(actions: DataFrame) -> DataFrame:
    """A plan for execute() of the moves and removals of a repair (level, stem, folder, action, target)."""
    src = F.col("folder")
    seq = F.xxhash64("level", "action", "folder", F.coalesce("target", F.lit("")))
    t = actions.where("action in ('move', 'delete')").select((2 * F.col("level") + (F.col("action") == "delete").cast("int")).alias("level"), seq.alias("seq"), "action", src.alias("src"), F.col("target").alias("dst"))
    return t.dropDuplicates(["seq"])


def _archived(old: str, archive: str) -> tuple[str, bool]:
    """Where an old revision goes in the archive, and whether the same bytes are there already; other content of its name makes
    room by a number."""
    name, end = os.path.splitext(os.path.basename(old))
    k = 0
    while True:
        at = os.path.join(archive, f"{name}.{k}{end}" if k else f"{name}{end}")
        if not os.path.lexists(at):
            return at, False
        if not os.path.islink(at) and filecmp.cmp(old, at, shallow=False):
            return at, True
        k += 1


def _swap(old: str, new: str, archive: str) -> str:
    """Puts a new revision where an old one stands, once that is in the archive."""
    target = os.path.join(os.path.dirname(old), os.path.basename(new))
    if os.path.islink(old) or os.path.islink(target) or os.path.islink(archive):
        return "failed: link"
    if not os.path.exists(old):
        same = os.path.exists(target) and os.path.exists(new) and filecmp.cmp(new, target, shallow=False)
        return "swapped" if same else "failed: no old file"
    staged = f"{target}.{uuid.uuid4().hex}.part"
    try:
        shutil.copy2(new, staged)
        os.makedirs(archive, exist_ok=True)
        at, there = _archived(old, archive)
        if not there:
            kept = f"{at}.{uuid.uuid4().hex}.part"
            shutil.copy2(old, kept)
            os.rename(kept, at)
        os.replace(staged, target)
        if target != old:
            os.remove(old)
    except OSError as e:
        if os.path.exists(staged):
            os.remove(staged)
        return f"failed: {e.strerror}"
    return "swapped"


def swap_revisions(plan: DataFrame, archive: str) -> DataFrame:
    """plan (stem, seq, old, new) with the status of each swap: `swapped`, `failed: ...` or `not tried`.

    The swaps of one drawing run in order of seq and stop at its first failure, so that its later copies stay as they are and
    the old revision is still found whole; other drawings go on. Run again, what is swapped is left alone. A drawing's copies
    are one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, said = pdf.sort_values("seq"), []
        for old, new in zip(pdf["old"], pdf["new"]):
            said.append("not tried" if said and said[-1] != "swapped" else _swap(old, new, archive))
        return pdf.assign(status=said)

    return plan.select("stem", "seq", "old", "new").groupBy("stem").applyInPandas(run, "stem string, seq long, old string, new string, status string")
