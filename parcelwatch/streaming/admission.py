"""Releases admitted to scoring as their manifests and files arrive, in any order and more than once.

A release is announced by a manifest: its files, lifecycle scripts, dependencies and name.  Files are
scanned when they arrive and reduced to one narrow row each; contents neither shuffle nor wait.  A release
is scored with the last file its manifest lists.  Which files have been counted is kept as a bitmap over
the manifest's file numbers, a row for 64 of them, so a file delivered again, in the same batch or later, does
not count twice.  Files that come before their manifest wait for it.

With ``max_delay`` a release that is still incomplete that long after its publication, measured by the
latest publication seen, comes out as failed, and what arrives for it later is dropped, as with any
watermark.  ``published_at`` belongs to the release: its files and its manifest carry the same.

All steps read what earlier batches left (:class:`BatchLog`), so a batch that is run again gives the same.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import binaries, ioc, manifest, scoring, typosquat
from ..operators.hits import as_findings, union_findings
from ..operators.static_rules import relax_for_cli_tools
from ..plans.scan import scan_hits
from . import feed, indicators
from .log import BatchLog, by_keys

_KEY = ["pkg", "version"]
_FILE = [*_KEY, "path"]
#: Scanners that a manifest answers.
MANIFEST_SCANNERS = ("hooks", "dependencies", "typosquatting")

#: Layout of the ``manifest`` column of an arriving row; null for a file.
MANIFEST = (
    "struct<name: string, is_cli: boolean, paths: array<string>, "
    "scripts: array<struct<name: string, command: string>>, "
    "dependencies: array<struct<name: string, spec: string, kind: string>>>"
)


def arrivals(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """One stream of both kinds: ``files(pkg, version, published_at, path, content)`` and
    ``manifests(pkg, version, published_at, manifest)``."""
    none = F.lit(None)
    as_file = files.select(*_KEY, "published_at", "path", "content", none.cast(MANIFEST).alias("manifest"))
    as_manifest = manifests.select(
        *_KEY, "published_at", none.cast("string").alias("path"), none.cast("string").alias("content"),
        F.col("manifest").cast(MANIFEST).alias("manifest"),
    )
    return as_file.unionByName(as_manifest)


#: Files of a manifest that one row of receipts stands for: the bits of a BIGINT.
_WORD = 64


def _place(file_no: Column) -> tuple[Column, Column]:
    """The row of receipts that a file number belongs to, and its bit there."""
    return F.floor((file_no - 1) / _WORD), F.pmod(file_no - 1, F.lit(_WORD)).cast("int")


def _bit_set(bits: Column, position: Column) -> Column:
    """Whether a bit is set; a row that is not there has none."""
    return F.coalesce(F.getbit(bits, position) == 1, F.lit(False))


class Admission:
    """State and results, below ``path``, of one stream of arrivals.

    ``popular`` are the names that new ones are compared with, ``others`` the totals
    (:func:`scoring.totals`) of what neither files nor manifests tell: repositories and comparisons.
    """

    def __init__(
        self, spark: SparkSession, path: str, popular: DataFrame, max_delay: str | None = None,
        others: DataFrame | None = None, every: int = 16,
    ) -> None:
        self.spark, self.path, self.popular, self.max_delay, self.others = spark, path, popular, max_delay, others
        empty = scoring.run_rows(spark.createDataFrame([], "pkg string, version string, scanner string"))
        self.facts = dict(empty.agg(*scoring.total_columns()).dtypes)
        facts = ", ".join(f"`{name}` {kind}" for name, kind in self.facts.items())
        stamp = "pkg string, version string, published_at timestamp"
        delivered = f"{stamp}, path string, batch bigint, delivery bigint"
        finding = (
            "scanner string, severity string, rule_id string, message string, file string, line int, evidence string"
        )

        def log(name: str, schema: str, merge=None) -> BatchLog:
            return BatchLog(f"{path}/{name}", schema, merge, every)

        self.clock = log("clock", "latest timestamp", lambda c: c.agg(F.max("latest").alias("latest")))
        self.headers = log("headers", f"{stamp}, file_count bigint, is_cli boolean", self._live)
        self.expected = log("expected", f"{stamp}, path string, file_no bigint", self._live)
        self.found = log("found", f"{delivered}, {finding}")
        self.told = log("told", f"pkg string, version string, {finding}")
        self.arrived = log("arrived", f"{delivered}, {facts}")
        self.counted = log("counted", f"{delivered}, {facts}, file_no bigint")
        self.receipts = log("receipt_words", f"{stamp}, word bigint, bits bigint", lambda r: self._live(self._united(r)))
        self.totals = log("totals", f"{stamp}, n_files bigint, {facts}", lambda t: self._live(self._summed(t)))
        self.sightings = indicators.sighting_log(f"{path}/sightings", every)

    # --- state ----------------------------------------------------------------------------

    def _edge(self, latest: Column) -> Column:
        return latest - F.expr(f"INTERVAL '{self.max_delay}'")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Without the releases that lie before the watermark of these rows: they are settled."""
        if self.max_delay is None:
            return rows
        edge = rows.agg(self._edge(F.max("published_at"))).scalar()
        return rows.filter(F.col("published_at").isNull() | (F.col("published_at") >= edge))

    def _united(self, receipts: DataFrame) -> DataFrame:
        return receipts.groupBy(*_KEY, "word").agg(
            F.max("published_at").alias("published_at"), F.bit_or("bits").alias("bits")
        )

    def _summed(self, totals: DataFrame) -> DataFrame:
        added = [(F.max if kind == "boolean" else F.sum)(name).alias(name) for name, kind in self.facts.items()]
        return totals.groupBy(*_KEY).agg(
            F.max("published_at").alias("published_at"), F.sum("n_files").alias("n_files"), *added
        )

    def watermark(self, batch_id: int) -> datetime | None:
        """Publications before this time are late in batch ``batch_id``."""
        if self.max_delay is None:
            return None
        return self.clock.before(self.spark, batch_id).agg(self._edge(F.max("latest"))).first()[0]

    def _waiting(self, batch_id: int) -> str:
        """All files that wait for their manifest after a batch."""
        return f"{self.path}/waiting/batch={batch_id}"

    # --- one batch ------------------------------------------------------------------------

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one batch of arrivals; write the scores it completes and the releases it times out."""
        self.clock.append(batch.agg(F.max("published_at").alias("latest")), batch_id)
        edge, next_edge = self.watermark(batch_id), self.watermark(batch_id + 1)
        published = F.col("published_at")
        rows = batch.withColumn("delivery", F.monotonically_increasing_id())
        if edge is not None:
            rows = rows.filter(published.isNull() | (published >= F.lit(edge)))
        arrived = self._scan(rows.filter(F.col("manifest").isNull()), batch_id)
        known = self.headers.before(self.spark, batch_id)
        new, of_manifests = self._announce(rows.filter(F.col("manifest").isNotNull()), known, batch_id)
        headers = known.unionByName(new)
        alone, fresh = self._count(arrived, headers, batch_id)

        of_files = fresh.withColumn("n_files", F.lit(1).cast("bigint")).select(*of_manifests.columns)
        before = self.totals.before(self.spark, batch_id)
        now = self.totals.append(self._summed(of_files.unionByName(of_manifests)), batch_id)
        touched = before.join(by_keys(now.select(*_KEY)), _KEY, "left_semi").withColumn("had", F.col("n_files")).unionByName(
            now.withColumn("had", F.lit(0).cast("bigint"))
        )
        had = touched.groupBy(*_KEY).agg(F.sum("had").alias("had"))
        is_new = new.select(*_KEY, F.lit(True).alias("is_new"))
        done = (
            self._summed(touched).join(by_keys(headers.select(*_KEY, "file_count")), _KEY).join(by_keys(had), _KEY)
            .join(by_keys(is_new), _KEY, "left").filter(F.col("n_files") == F.col("file_count"))
            .filter(F.coalesce("is_new", F.col("had") < F.col("file_count")))
        )
        self._score(done).write.mode("overwrite").parquet(f"{self.path}/scores/batch={batch_id}")

        # A release is late in the one batch that moves the watermark past it.
        late = F.lit(False) if next_edge is None else F.coalesce(published < F.lit(next_edge), F.lit(False))
        if edge is not None:
            late = late & (published >= F.lit(edge))
        alone.filter(~late).write.mode("overwrite").parquet(self._waiting(batch_id))
        sums = self.totals.before(self.spark, batch_id).unionByName(now).groupBy(*_KEY).agg(F.sum("n_files").alias("n_files"))
        n_files = F.coalesce("n_files", F.lit(0)).alias("n_files")
        short = headers.filter(late).join(sums, _KEY, "left").filter(n_files < F.col("file_count"))
        orphans = alone.filter(late).groupBy(*_KEY).agg(F.count("*").alias("n_files"))
        failed = short.select(*_KEY, "file_count", n_files, F.lit("files missing").alias("error")).unionByName(
            orphans.select(*_KEY, F.lit(None).cast("bigint").alias("file_count"), "n_files", F.lit("no manifest").alias("error"))
        )
        failed.write.mode("overwrite").parquet(f"{self.path}/failed/batch={batch_id}")

    def _first(self, rows: DataFrame) -> DataFrame:
        """The first delivery of every file."""
        rest = [c for c in rows.columns if c not in _FILE]
        first = rows.groupBy(*_FILE).agg(F.min_by(F.struct(*rest), F.struct("batch", "delivery")).alias("r"))
        return first.select(*_FILE, "r.*")

    def _scan(self, files: DataFrame, batch_id: int) -> DataFrame:
        """One pass over the contents of a batch: hits are written, and one row of facts a file."""
        carry = ["published_at", "path", "delivery"]
        hits_path = f"{self.path}/hits/batch={batch_id}"
        scan_hits(files, carry=carry).write.mode("overwrite").parquet(hits_path)
        hits = self.spark.read.parquet(hits_path)
        indicators.add_sightings(self.sightings, hits, batch_id)
        told = as_findings(hits.filter(F.col("scanner") != ioc.SCANNER), carry)
        told = told.unionByName(binaries.scan_binaries(files, carry))
        number = F.lit(batch_id).cast("bigint")
        found = self.found.append(told.withColumn("batch", number), batch_id)
        receipts = files.select(*_KEY, *carry, F.lit(None).cast("string").alias("scanner"))
        stacked = scoring.run_rows(receipts, carry).unionByName(scoring.finding_rows(found, carry=carry))
        facts = stacked.groupBy(*_KEY, *carry).agg(*scoring.total_columns()).withColumn("batch", number)
        return self.arrived.append(self._first(facts), batch_id)

    def _announce(self, rows: DataFrame, known: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """New manifests: their files are numbered, and what they tell by themselves is summed up."""
        first = F.min_by(F.struct("published_at", "manifest"), "delivery").alias("m")
        new = rows.join(by_keys(known.select(*_KEY)), _KEY, "left_anti").groupBy(*_KEY).agg(first).select(*_KEY, "m.*")
        paths = F.array_sort(F.array_distinct(F.coalesce("manifest.paths", F.array().cast("array<string>"))))
        listed = new.select(*_KEY, "published_at", paths.alias("paths"), F.col("manifest.is_cli").alias("is_cli"))
        headers = self.headers.append(listed.withColumn("file_count", F.size("paths").cast("bigint")), batch_id)
        numbered = listed.select(*_KEY, "published_at", F.posexplode("paths").alias("place", "path"))
        self.expected.append(numbered.withColumn("file_no", F.col("place").cast("bigint") + 1), batch_id)

        if headers.isEmpty():  # no need to plan the scanners
            self.told.append(self.told.before(self.spark, 0), batch_id)
            return headers, self.totals.before(self.spark, 0)
        scripts = new.select(*_KEY, F.explode("manifest.scripts").alias("s")).select(*_KEY, "s.*")
        depends = new.select(*_KEY, F.explode("manifest.dependencies").alias("d")).select(*_KEY, "d.*")
        names = new.select(*_KEY, F.col("manifest.name").alias("name")).filter(F.col("name").isNotNull())
        told = union_findings(
            manifest.scan_hooks(scripts), manifest.scan_dependencies(depends),
            typosquat.scan_typosquatting(names, self.popular),
        )
        told = self.told.append(told, batch_id)
        totals = scoring.totals(told, scoring.scan_runs(headers, MANIFEST_SCANNERS), headers)
        totals = totals.join(by_keys(headers.select(*_KEY, "published_at")), _KEY).withColumn("n_files", F.lit(0).cast("bigint"))
        return headers, totals.select(*_KEY, "published_at", "n_files", *self.facts)

    def _count(self, arrived: DataFrame, headers: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """Files without a manifest so far, and those that count for the first time."""
        there = arrived
        if batch_id:
            held = self.spark.read.schema(self.arrived.schema).parquet(self._waiting(batch_id - 1))
            there = self._first(held.unionByName(arrived))
        expected = self.expected.before(self.spark, batch_id + 1).drop("published_at")
        word, position = _place(F.col("file_no"))
        receipts = self.receipts.before(self.spark, batch_id).drop("published_at")
        matched = there.join(by_keys(expected), _FILE).withColumn("word", word)
        fresh = matched.join(by_keys(receipts), [*_KEY, "word"], "left").filter(~_bit_set(F.col("bits"), position))
        fresh = self.counted.append(fresh, batch_id)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), position)
        marks = fresh.groupBy(*_KEY, word.alias("word")).agg(
            F.max("published_at").alias("published_at"), F.bit_or(bit).alias("bits")
        )
        self.receipts.append(marks, batch_id)
        return there.join(by_keys(headers.select(*_KEY)), _KEY, "left_anti"), fresh

    def _score(self, done: DataFrame) -> DataFrame:
        ran = {f"ran_{s}": F.lit(True) for s in feed.FILE_SCANNERS}
        whole = done.withColumns({**ran, "any_run": F.lit(True)}).select(*_KEY, *self.facts)
        if self.others is None:
            return scoring.score_totals(whole)
        rest = self.others.join(by_keys(whole.select(*_KEY)), _KEY, "left_semi")
        return scoring.score_totals(scoring.only_found(scoring.merge_totals(whole, rest.select(*whole.columns))))

    # --- results --------------------------------------------------------------------------

    def scores(self) -> DataFrame:
        """Scores of all complete releases."""
        return self.spark.read.parquet(f"{self.path}/scores").drop("batch")

    def failed(self) -> DataFrame:
        """``pkg, version, file_count, n_files, error`` of the releases that timed out."""
        return self.spark.read.parquet(f"{self.path}/failed").drop("batch")

    def findings(self) -> DataFrame:
        """Findings of all eight scanners: of counted files, of manifests, and indicators."""
        told = self.found.rows(self.spark).drop("published_at")
        first = self.counted.rows(self.spark).select(*_FILE, "batch", "delivery")
        flags = self.headers.rows(self.spark).select(*_KEY, "is_cli")
        of_counted = told.join(by_keys(first), [*_FILE, "batch", "delivery"], "left_semi")
        of_files = relax_for_cli_tools(as_findings(of_counted), flags)
        return union_findings(
            of_files, self.told.rows(self.spark), indicators.indicator_findings(self.spark, self.sightings)
        )


def admit(stream: DataFrame, admission: Admission, checkpoint: str, **trigger) -> StreamingQuery:
    """Run a stream of :func:`arrivals` through an admission."""
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(admission.add)
        .trigger(**trigger)
        .start()
    )
