"""The derived relations that several queries share, worked out once for each session and folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from partloom.operators import graph, resolve
from partloom.sources.catalogue import Catalogue
from partloom.sources.storage import stored, unpacked


class Views(Catalogue):
    """The catalogue with its drawings and parts lists as tables, and what is derived from them."""

    @cached_property
    def active(self) -> DataFrame:
        return stored(super().active, "active")

    @cached_property
    def bom_entries(self) -> DataFrame:
        return stored(super().bom_entries, "entries")

    @cached_property
    def bom(self) -> DataFrame:
        return stored(super().bom, "bom")

    @cached_property
    def repaired_bom(self) -> DataFrame:
        return stored(resolve.snapped(self.bom, self.snaps), "repaired")

    @cached_property
    def snaps(self) -> DataFrame:
        return stored(resolve.snap_refs(self.bom, self.active, self.matched), "snaps")

    @cached_property
    def matched(self) -> DataFrame:
        """Each reference is matched once; edges, what is missing and repairs read it."""
        return stored(resolve.match_refs(self.bom, self.active), "matched")

    @cached_property
    def repaired_matched(self) -> DataFrame:
        return stored(resolve.repaired_matches(self.matched, self.snaps, self.active), "matched")

    @cached_property
    def edges(self) -> DataFrame:
        """Written once: checks, roots and paths all read it."""
        return stored(resolve.graph_edges(self.repaired_bom, self.active, self.repaired_matched), "edges")

    @cached_property
    def tops(self) -> DataFrame:
        return stored(graph.roots_and_orphans(self.active, self.edges, self.repaired_bom), "tops")

    @cached_property
    def roots(self) -> DataFrame:
        return self.tops.where("kind = 'root'").select("stem")

    @cached_property
    def path_counts(self) -> DataFrame:
        return stored(graph.path_counts(self.edges, self.active), "counts")

    @cached_property
    def counted_roots(self) -> DataFrame:
        return stored(self.path_counts.join(self.roots, "stem"), "counted")

    @cached_property
    def kept_roots(self) -> DataFrame:
        return graph.fit_roots(self.counted_roots).where("kept").select("stem")

    @cached_property
    def placements(self) -> DataFrame:
        return stored(graph.planned_paths(self.edges, self.kept_roots, counted=self.counted_roots), "placements")

    @cached_property
    def every_placement(self) -> DataFrame:
        """folder and stem of all placements below all roots, without any cap; a cycle is an error before the first is made."""
        _ = self.counted_roots
        return graph.every_folder(self.edges, self.roots)


_OPEN: dict[tuple[str, str], Views] = {}


def views(spark: SparkSession, sf_dir: str) -> Views:
    """The views of a folder; kept, so that what several queries read is stored once in a session."""
    unpacked(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Views(spark, sf_dir)
    return _OPEN[key]


def forget() -> None:
    """Lets the next query work everything out anew."""
    _OPEN.clear()
