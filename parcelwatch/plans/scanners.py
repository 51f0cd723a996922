"""The scanners that take part in a run: built-in ones and one's own, by name.

A scanner is a function of package files and manifests that gives findings.  Findings of all are stacked;
counts, scores, summaries and reports follow from the names, so a scanner that is added takes part everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..operators import binaries, manifest, scoring, typosquat
from ..operators.hits import as_findings
from ..sources import registry
from . import scan

#: ``find(files, manifests)``: files as (pkg, version, path, content), manifests as ``registry.package_versions`` gives them.
Find = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Scanner:
    """One scanner, or several that share a pass: their ``names`` and the function that finds.

    Findings need ``pkg, version, severity, rule_id, message``; ``file, line, evidence`` are null where they
    are absent, and so may ``scanner`` be where there is one name.
    """

    names: tuple[str, ...]
    find: Find


class Scanners:
    """Scanners by name, in the order they were added.  Adding gives a new collection."""

    def __init__(self, scanners: Iterable[Scanner] = (), weights: scoring.Weights | None = None):
        self._scanners = tuple(scanners)
        self.names = tuple(name for s in self._scanners for name in s.names)
        self.weights = dict(rules.CATEGORY_WEIGHTS if weights is None else weights)
        if len(set(self.names)) < len(self.names):
            raise ValueError(f"scanner named twice: {self.names}")
        if not self.names or not all(s.names for s in self._scanners):
            raise ValueError("a scanner has a name, and a run a scanner")
        # What no scanner here can find is worth nothing in this run.
        self.weights = {name: w for name, w in self.weights.items() if name in self.names}

    def add(
        self, name: str, find: Find, weight: tuple[float, float, float, float] | None = None
    ) -> Scanners:
        """With one more scanner; ``weight`` as in ``rules.CATEGORY_WEIGHTS``, none for findings without points."""
        weights = self.weights | ({name: weight} if weight else {})
        return Scanners((*self._scanners, Scanner((name,), find)), weights)

    def weighted(self, table: DataFrame) -> Scanners:
        """With the weights of ``table(scanner, most, critical, warning, info)`` in place of the present ones.

        The table has a row per scanner, so no more rows than scanners of this run are read; scanners that
        are not listed earn no points.
        """
        rows = table.filter(F.col("scanner").isin(*self.names)).limit(len(self.names) + 1).collect()
        weights = {r["scanner"]: tuple(float(r[c]) for c in ("most", "critical", "warning", "info")) for r in rows}
        if len(weights) < len(rows):
            raise ValueError("a scanner has one weight")
        if not weights:
            raise ValueError("no scanner of this run has a weight")
        return Scanners(self._scanners, weights)

    def findings(self, files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
        """Findings of all scanners, in the shared layout."""
        stacked = None
        for scanner in self._scanners:
            found = scanner.find(files, manifests)
            if len(scanner.names) == 1:
                found = found.withColumn("scanner", F.lit(scanner.names[0]))
            found = as_findings(found)
            stacked = found if stacked is None else stacked.unionByName(found)
        return stacked

    def runs(self, releases: DataFrame) -> DataFrame:
        return scoring.scan_runs(releases, self.names)

    def score(
        self, findings: DataFrame, releases: DataFrame, flags: DataFrame | None = None, **parts: DataFrame
    ) -> DataFrame:
        """Score of every release by this run's weights; further arguments as for ``scoring.score``."""
        return scoring.score(findings, self.runs(releases), flags, weights=self.weights, **parts)


def content_scanners(names: tuple[str, ...] = scan.CONTENT_SCANNERS) -> Scanner:
    """Those that share the one pass over contents."""
    return Scanner(names, lambda files, _: scan.scan_contents(files, names))


def builtin(popular: DataFrame) -> Scanners:
    """All eight built-in scanners; ``popular(name)`` is what package names are held against."""

    def names(_: DataFrame, manifests: DataFrame) -> DataFrame:
        named = manifests.select("pkg", "version", F.col("pkg").alias("name"))
        return typosquat.scan_typosquatting(named, popular)

    return Scanners((
        content_scanners(),
        Scanner(("ioc",), lambda files, _: scan.scan_ioc(files)),
        Scanner(("hooks",), lambda _, manifests: manifest.scan_hooks(registry.scripts(manifests))),
        Scanner(("binaries",), lambda files, _: binaries.scan_binaries(files)),
        Scanner(("dependencies",), lambda _, manifests: manifest.scan_dependencies(registry.dependencies(manifests))),
        Scanner(("typosquatting",), names),
    ))
