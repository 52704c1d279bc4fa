"""Full, incremental and repair runs: each gives the result tables of a run, as plans over its inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.operators import adoption, checks, extract, graph, incremental, naming, placement, ranking, repair, resolve
from partloom.sources.storage import stored


@dataclass
class Inputs:
    """The relations a run reads; columns as in the README's data model."""

    drawings: DataFrame
    bom_entries: DataFrame
    used_on: DataFrame
    title_blocks: DataFrame
    lines: DataFrame
    #: What watermarks show in beside phrases; None where it wasn't read.
    layers: DataFrame | None = None
    spans: DataFrame | None = None
    notes: DataFrame | None = None


def _decisions(live: DataFrame, data: Inputs, cap: int) -> dict[str, DataFrame]:
    """What all runs decide in the same way for the drawings that are live.

    Cross-checks look at the graph before cycles are cut, roots are split off after.
    """
    own = lambda df: df.join(live.select("stem"), "stem", "left_semi")
    entries, used_on, blocks = own(data.bom_entries), own(data.used_on), own(data.title_blocks)
    listed = entries.select("stem", "ref").distinct()
    found = stored(resolve.match_refs(listed, live), "matched")
    snaps = stored(resolve.snap_refs(listed, live, found), "snaps")
    found = stored(resolve.repaired_matches(found, snaps, live), "matched")
    bom = stored(resolve.snapped(listed, snaps), "bom")
    edges = stored(resolve.graph_edges(bom, live, found), "edges")
    cut = stored(graph.cycle_edges(edges), "cut")
    dag = stored(edges.join(cut, ["parent", "child"], "left_anti"), "dag")
    tops = stored(graph.roots_and_orphans(live, dag, bom), "tops")
    roots = tops.where("kind = 'root'").select("stem")
    counted = stored(graph.path_counts(dag, live).join(roots, "stem"), "counted")
    fit = stored(graph.fit_roots(counted, cap), "fit")
    said = used_on.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("used_on"))
    names = naming.prefer_list_names(blocks, naming.vote_winners(entries, snaps))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counters = one(live, "scanned").crossJoin(one(roots, "roots")).crossJoin(fit.where("kept").agg(F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("copies"))).crossJoin(one(cut, "cycles"))
    return {
        "counters": counters,
        "missing": resolve.missing_refs(bom, live, found),
        "chk": checks.unapproved(live),
        "orphans": tops.where("kind = 'orphan'").select("stem"),
        "roots": roots.join(said, "stem", "left").select("stem", F.coalesce("used_on", F.lit("")).alias("used_on")),
        "used_on_mismatches": checks.used_on_mismatches(edges, used_on),
        "used_on_bugs": checks.used_on_bugs(edges, used_on, live),
        "titleblock_mismatches": checks.titleblock_mismatches(blocks),
        "scanned": extract.scanned_pages(own(data.lines)),
        "watermarks": _watermarks(data, own),
        "names": names,
        "placement_refused": fit.agg(F.coalesce(F.max(~F.col("kept")), F.lit(False)).alias("refused")),
        "skipped_roots": fit.where("not kept").select("stem", "copies"),
        "edges": edges,
        "kept_roots": fit.where("kept").select("stem"),
        "counted": counted,
        "dag": dag,
    }


def _watermarks(data: Inputs, own) -> DataFrame:
    if data.layers is None or data.spans is None:
        return extract.watermark_phrases(own(data.lines))
    return extract.watermark_evidence(own(data.lines), own(data.layers), own(data.spans), None if data.notes is None else own(data.notes))


def full_run(data: Inputs, cap: int = graph.COPY_CAP) -> dict[str, DataFrame]:
    """Everything from scratch."""
    live = stored(ranking.active(data.drawings.select("stem")), "live")
    return _decisions(live, data, cap) | {"live": live, "superseded": ranking.superseded(data.drawings.select("stem")).select("stem")}


def _placed_batch(fresh: DataFrame, organized: DataFrame, bom: DataFrame, dag: DataFrame, cap: int) -> dict[str, DataFrame]:
    """Where the subtrees of a batch's drawings go: the roots that count are cut to the cap, with their further claimants'
    copies, and the others go under every organized parent of theirs."""
    held = stored(organized.select("stem").distinct().join(fresh, "stem", "left_anti"), "held")
    ends = lambda df, c: df.select(F.col("stem").alias(c))
    side = lambda up, down: dag.join(ends(up, "parent"), "parent", "left_semi").join(ends(down, "child"), "child", "left_semi").select("parent", "child")
    inner, under, above = (stored(side(a, b), n) for a, b, n in ((fresh, fresh, "inner"), (held, fresh, "under"), (fresh, held, "above")))
    tops = fresh.join(inner.select(F.col("child").alias("stem")).distinct(), "stem", "left_anti")
    related = inner.unionByName(under).unionByName(above)
    counted = stored(graph.path_counts(inner, fresh).join(incremental.placeable(tops, bom, related, held), "stem"), "counted")
    first = adoption.claimant_placements(fresh, inner, under, above, bom)
    fit = stored(graph.fit_roots(counted, cap, adoption.claimant_weights(first, counted)), "fit")
    skipped = fit.where("not kept")
    return {"claimants": adoption.claimant_placements(fresh, inner, under, above, bom, skipped), "batch_skipped": skipped.select("stem", "copies"), "inner": inner, "above": above}


def incremental_run(data: Inputs, organized: DataFrame, archive: DataFrame, parked: DataFrame, cap: int = graph.COPY_CAP, tree: DataFrame | None = None, target: str = "", limit: int = naming.MAX_PATH) -> dict[str, DataFrame]:
    """A batch on top of what is organized; the merged catalogue is decided as a full run would.

    tree: path and stem of the organized files, where what new parents adopt of them is asked for too (`adoptions`). A batch
    that brings nothing decides nothing: all its tables are there, and empty, and what is organized stays as it is.
    """
    new = stored(incremental.candidates(data.drawings, organized, archive, parked), "new")
    decisions = incremental.supersede_decisions(new, organized)
    idle = new.isEmpty()
    live = stored(incremental.merged_stems(new, organized).limit(0) if idle else incremental.merged_stems(new, organized), "live")
    out = _decisions(live, data, cap)
    fresh = stored(live.select("stem").join(new.select("stem"), "stem", "left_semi"), "fresh")
    placed = incremental.placement_decisions(fresh, out["dag"], organized, data.bom_entries)
    out |= {"live": organized.select("stem") if idle else live, "candidates": new, "supersede": decisions, "placements": placed}
    out |= _placed_batch(fresh, organized, data.bom_entries, out["dag"], cap)
    if tree is not None:
        folders = naming.folder_names(live, out["names"])
        made = stored(adoption.new_folders(out["claimants"], out["inner"], folders, tree), "made")
        claims = made.join(out["above"], made["stem"] == out["above"]["parent"]).select(F.col("stem").alias("claimant"), "dir", "child")
        out["adoptions"] = adoption.adoptions(claims, tree, folders, target, limit)
    return out


def named_tree(out: dict[str, DataFrame], live: DataFrame, target: str, limit: int = naming.MAX_PATH) -> tuple[DataFrame, DataFrame]:
    """Folder names of the drawings, shortened where paths below target would be too long, and stem and folder of each placement."""
    paths = stored(graph.planned_paths(out["dag"], out["kept_roots"], counted=out["counted"]), "paths")
    folders = stored(naming.shortened_folders(paths, naming.folder_names(live, out["names"]), target, limit), "folders")
    return folders, naming.placed_folders(paths, folders).select("stem", F.col("dir").alias("folder"))


def repair_run(data: Inputs, organized: DataFrame, archive: DataFrame, actual: DataFrame, cap: int = graph.COPY_CAP, target: str = "", limit: int = naming.MAX_PATH) -> dict[str, DataFrame]:
    """What is organized, with archived drawings promoted where they rank higher, and what makes the tree stand as planned.

    actual: path below target, stem (null for what is no drawing) and content (a hash) of every file in the tree; archive: stem,
    and path and content where its files are to be judged too. Folders are planned by their names, which fit the path limit.
    `repair` has the actions, `repair_counts` their numbers, `review` a line for each that is left for review, `tree` the files
    after it, and `promoted_files` the archive's files of promoted drawings with what becomes of them.
    """
    promoted = stored(ranking.repair_candidates(archive, organized).select("stem"), "promoted")
    live = stored(incremental.merged_stems(promoted, organized), "live")
    out = _decisions(live, data, cap)
    folders, planned = named_tree(out, live, target, limit)
    actions, tree = repair.reconcile_tree(actual, planned, target, limit, min(limit, placement.MAX_DIR))
    actions = stored(actions, "repair")
    out |= {"live": live, "promoted": promoted, "folders": folders, "planned": planned, "repair": actions, "tree": tree}
    out["repair_counts"] = repair.counted(actions)
    out["review"] = repair.review_lines(actions)
    if {"path", "content"} <= set(archive.columns):
        out["promoted_files"] = incremental.promoted_sources(promoted, archive, tree.where("stem is not null"))
    return out


def mode_label(dry_run: bool, incremental: bool = False, repair: bool = False) -> str:
    """How a run is called in its log and report."""
    name = "REPAIR" if repair else "INCREMENTAL" if incremental else ""
    if not name:
        return "DRY-RUN" if dry_run else "EXECUTE"
    return f"{name} (DRY-RUN)" if dry_run else name


def exit_code(tables: dict[str, DataFrame]) -> int:
    """2 for a run that places nothing because of the cap, or a repair that leaves something for review; else 0."""
    refused = "placement_refused" in tables and bool(tables["placement_refused"].first()["refused"]) and tables["kept_roots"].isEmpty()
    review = "repair" in tables and not tables["repair"].where("action = 'review'").isEmpty()
    return 2 if refused or review else 0
