"""Package archives (gzipped tar) to package files."""

from __future__ import annotations

import gzip
import hashlib
import io
import tarfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BATCH_BYTES = 4 << 20
_DAMAGE = (tarfile.TarError, zlib.error, EOFError, OSError)
_ROWS = pa.schema(
    [(c, pa.string()) for c in ("pkg", "version", "path", "content", "sha256")] + [("n_files", pa.int64()), ("error", pa.string())]
)


def bounded(rows: Iterable[tuple], schema: pa.Schema, limit: int = _BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``rows`` as Arrow batches that end with the row that brings them to ``limit`` bytes, however many rows come.

    A batch is all that Python holds besides one batch of Spark's, which Spark limits by bytes too.
    """
    batch, held = [], 0
    for row in rows:
        batch.append(row)
        held += 64 + sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if held >= limit:
            yield _batch(batch, schema)
            batch, held = [], 0
    if batch:
        yield _batch(batch, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def values(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches one at a time; a batch as a whole never turns into Python objects."""
    for batch in batches:
        for cells in zip(*batch.columns):
            yield tuple(cell.as_py() for cell in cells)


def read_archives(archives: DataFrame, root: str | None = "package") -> DataFrame:
    """``archives(pkg, version, content BINARY)`` to its files and one outcome row each, in one pass.

    A file row has ``path``, decoded ``content`` and the ``sha256`` of its bytes.  An archive's outcome row
    comes after its files, with a null path: ``n_files`` that were read, and the ``error`` that ended it, null
    for an archive read to its end.  Write the rows once, and take :func:`files_of` and :func:`failures_of` from
    them, so that archives are unpacked a single time and what cannot be read is never passed over.

    Only regular files below the ``root`` directory are kept, relative to it; ``None`` keeps every
    file as it is.  An archive is one cell, read as a stream by the task that holds it, and files
    leave in batches of limited size.
    """
    prefix = "" if root is None else root.rstrip("/") + "/"

    def members(data: bytes) -> Iterator[tuple]:
        n_files, error = 0, None
        try:
            raw = io.BytesIO(data or b"")
            # The module for compressed files, unlike tarfile, notices a stream that ends too soon.
            packed = gzip.GzipFile(fileobj=raw) if raw.getvalue()[:2] == b"\x1f\x8b" else None
            with tarfile.open(fileobj=packed or raw, mode="r|" if packed else "r|*") as tar:
                for entry in tar:
                    name = entry.name.removeprefix("./")
                    if entry.isfile() and name.startswith(prefix):
                        body = tar.extractfile(entry).read()
                        if len(body) < entry.size:
                            raise EOFError
                        n_files += 1
                        yield name[len(prefix) :], body.decode("utf-8", "replace"), hashlib.sha256(body).hexdigest(), None, None
                    elif entry.isfile():
                        tar.extractfile(entry).read()
            while packed and packed.read(1 << 20):
                pass
        except _DAMAGE:
            error = "damaged archive"
        yield None, None, None, n_files, error

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = ((pkg, version, *row) for pkg, version, data in values(batches) for row in members(data))
        return bounded(unpacked, _ROWS)

    return archives.select("pkg", "version", "content").mapInArrow(
        expand,
        "pkg string, version string, path string, content string, sha256 string, n_files bigint, error string",
    )


def files_of(rows: DataFrame) -> DataFrame:
    """``pkg, version, path, content, sha256`` of the files of :func:`read_archives`."""
    return rows.filter(F.col("path").isNotNull()).select("pkg", "version", "path", "content", "sha256")


def failures_of(rows: DataFrame) -> DataFrame:
    """``pkg, version, n_files, error`` of the archives that :func:`read_archives` could not read to their end."""
    return rows.filter(F.col("error").isNotNull()).select("pkg", "version", "n_files", "error")


def expand_archives(archives: DataFrame, root: str | None = "package") -> DataFrame:
    """The files alone; a damaged archive gives those before the damage (see :func:`read_archives`)."""
    return files_of(read_archives(archives, root))


def damaged_archives(archives: DataFrame) -> DataFrame:
    """``pkg, version, error`` for every archive that can't be read to its end.

    Their releases count as failed: part of the files is no basis for a score.
    """
    return failures_of(read_archives(archives)).drop("n_files")
