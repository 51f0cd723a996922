"""Merkle manifests of datasets by time-forward processing over sorted tables.

Every tree is cut into layers of ``LEVELS`` levels, and every layer into blocks of ``FAN_OUT ** LEVELS``
consecutive nodes.  A node's label is its tree, layer and block and, within the block, the place of its last
leaf and its level: children have smaller labels than their parents.

Upwards, digests are sent as messages to the label of the parent.  Between layers the queue that orders them
is Spark's sorted shuffle, which spills to disk; within a block it is a heap that never holds more than a few
messages a level.  Downwards, the sweep is reversed: a node takes the proof from itself to the root off the
queue and sends each child that proof behind the digests of the child's siblings.

A tree may have any number of leaves: no task holds more than one block, and a block's proof from above
travels as one row.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parcelwatch.llm.common import written

FAN_OUT = 3
LEVELS = 5
_HEX = 64
_BLOCK = f"idx div {FAN_OUT ** LEVELS}"


def _sha(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN_OUT), levels + 1
    return levels


def _field(value: Column, size: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.concat(size.cast("string"), F.lit(":"), value))


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of the columns' values, each with its length in bytes before it; a null is ``-``."""
    fields = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(_field(f, F.octet_length(f)) for f in fields)).cast("binary"), 256)


# --- places in the tree ---------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``n``, the rows of their ``tree``, and ``idx``, the place in it, from 0.

    Rows are sorted once over the whole cluster, and a tree's rows are counted in each sorted part: no
    tree needs to fit a task.  Equal rows keep the order in which they are read.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "read_at"]
    sorted_rows = (
        written(rows).withColumn("read_at", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("read_at")
    )
    at = F.monotonically_increasing_id()
    placed = written(sorted_rows.select("*", at.alias("at"))).withColumn("part", F.shiftright("at", 33))
    # A tree has one run in each part at most.
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("start"), F.count("*").alias("size"))
    tree = W.partitionBy("tree")
    ahead = F.coalesce(F.sum("size").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = written(runs.select("tree", "part", (ahead - F.col("start")).alias("shift"), F.sum("size").over(tree).alias("n")))
    return placed.join(shifts, ["tree", "part"]).select(*rows.columns, "n", (F.col("at") + F.col("shift")).alias("idx"))


# --- one block ------------------------------------------------------------------------------


class Block:
    """Consecutive nodes, swept up through ``levels`` levels and down again.

    The label of a node is (place of its last leaf, level): in this order, children come first.
    """

    def __init__(self, digests: list[str], levels: int) -> None:
        self.levels, self.last = levels, len(digests) - 1
        self.nodes: list[tuple[int, list[str]]] = []  # first child and children, in order of labels
        self.top = ""
        queue: list[tuple[int, int, int, str]] = []
        for leaf, own in enumerate(digests):
            self._send(queue, 0, leaf, own)
            while queue and queue[0][0] == leaf:
                level, children = queue[0][1], []
                while queue and queue[0][:2] == (leaf, level):
                    children.append(heapq.heappop(queue)[3])
                index = leaf // FAN_OUT**level
                self.nodes.append((index * FAN_OUT, children))
                self._send(queue, level, index, _sha("".join(children)))

    def _end(self, level: int, index: int) -> int:
        return min((index + 1) * FAN_OUT**level - 1, self.last)

    def _send(self, queue: list, level: int, index: int, digest: str) -> None:
        """A node's digest to its parent, in order of the parent's label."""
        if level == self.levels:
            self.top = digest
        else:
            heapq.heappush(queue, (self._end(level + 1, index // FAN_OUT), level + 1, index, digest))

    def proofs(self, above: str) -> list[str]:
        """The proof of every leaf: steps parted by commas, each the own place and the siblings."""
        out = [""] * (self.last + 1)
        # The reversed sweep: labels fall, each node sends to its children.
        queue, nodes = [(-self.last, -self.levels, above)], iter(reversed(self.nodes))
        while queue:
            leaf, level, proof = heapq.heappop(queue)
            if level == 0:
                out[-leaf] = proof
                continue
            first, children = next(nodes)
            for i in range(len(children)):
                step = str(i) + "".join(children[:i] + children[i + 1 :])
                message = f"{step},{proof}" if proof else step
                heapq.heappush(queue, (-self._end(-level - 1, first + i), level + 1, message))
        return out


def siblings(proof: str) -> str:
    """Digests of a proof, from the leaf to the root, left to right."""
    return "".join(step[1:] for step in proof.split(","))


def fold(digest: str, proof: str) -> str:
    """The root that a leaf and its proof give."""
    for step in proof.split(",") if proof else ():
        at = 1 + _HEX * int(step[0])
        digest = _sha(step[1:at] + digest + step[at:])
    return digest


# --- layers ---------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Columns of one block after the other; rows come in order of their first two columns."""
    key, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        held = held or [[] for _ in columns]
        start = 0
        for i, here in enumerate(zip(columns[0], columns[1])):
            if here != key:
                whole = [h + c[start:i] for h, c in zip(held, columns)]
                if whole[0]:
                    yield whole
                key, start, held = here, i, [[] for _ in columns]
        held = [h + c[start:] for h, c in zip(held, columns)]
    if held and held[0]:
        yield held


def _swept(rows: DataFrame, solve: Callable[[list[list]], list[list]], schema: T.StructType) -> DataFrame:
    """``solve`` for every block; ``rows`` have ``tree, idx, block`` first."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in target]
        for block in _blocks(batches):
            for have, more in zip(out, solve(block)):
                have += more
            if len(out[0]) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target)], schema=target)
                out = [[] for _ in target]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target)], schema=target)

    dealt = rows.repartition(n, "tree", "block").sortWithinPartitions("tree", "block", "idx")
    return dealt.mapInArrow(run, schema)


def _steps(n: int, layer: int) -> int:
    return max(0, min(LEVELS, height(n) - layer * LEVELS))


def _up(nodes: DataFrame, layer: int) -> DataFrame:
    """Tops of all blocks of a layer: the nodes of the next one."""

    def solve(block: list[list]) -> list[list]:
        tree, number, _, n, digest = block
        return [tree[:1], number[:1], n[:1], [Block(digest, _steps(n[0], layer)).top]]

    rows = nodes.select("tree", F.expr(_BLOCK).alias("block"), "idx", "n", "digest")
    return _swept(rows, solve, T._parse_datatype_string("tree string, idx bigint, n bigint, digest string"))


def layers(leaves: DataFrame, order: list[str]) -> list[DataFrame]:
    """Numbered leaves of all trees, and the nodes of every ``LEVELS`` levels above; the last are roots."""
    out = [written(numbered(leaves, order))]
    most = out[0].agg(F.max("n")).first()[0] or 0
    for layer in range(max(1, -(-height(most) // LEVELS))):
        out.append(written(_up(out[-1].select("tree", "idx", "n", "digest"), layer)))
    return out


def _down(nodes: DataFrame, above: DataFrame, layer: int, solve: Callable, schema: T.StructType) -> DataFrame:
    """``solve(block, proof, subroot, root, proofs)`` for every block, ``above`` being what its top gets."""
    known = ["proof", "subroot", "root"]
    own = [c for c in nodes.columns if c not in ("tree", "idx", "n", "digest")]
    # What comes from above stands before the nodes of its block.
    first = above.select(
        "tree", F.col("idx").alias("block"), F.lit(-1).cast("bigint").alias("idx"),
        F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("digest"), *known,
        *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in own),
    )
    rest = nodes.select(
        "tree", F.expr(_BLOCK).alias("block"), "idx", "n", "digest",
        *(F.lit(None).cast("string").alias(c) for c in known), *own,
    )

    def swept(block: list[list]) -> list[list]:
        proof, subroot, root = (c[0] for c in block[5:8])
        block = [c[1:] for c in block]
        proofs = Block(block[4], _steps(block[3][0], layer)).proofs(proof)
        return solve(block, subroot, root, proofs)

    return _swept(first.unionByName(rest), swept, schema)


_ABOVE = "tree string, idx bigint, proof string, subroot string, root string"


def _passed_on(block: list[list], subroot: str, root: str, proofs: list[str]) -> list[list]:
    n = len(proofs)
    return [block[0], block[2], proofs, [subroot] * n, [root] * n]


def _of_sources(block: list[list], subroot: str, root: str, proofs: list[str]) -> list[list]:
    """Above the root of a source's tree: its digest is the source's own root, its name the tree."""
    n = len(proofs)
    return [block[8], [0] * n, proofs, block[4], [root] * n]


def _verified(block: list[list], subroot: str, root: str, proofs: list[str]) -> list[list]:
    n, (leaf, doc_id, changed) = len(proofs), (block[4], *block[8:10])
    folded = [fold(c or d, p) for c, d, p in zip(changed, leaf, proofs)]
    return [
        doc_id, leaf, [subroot] * n, [root] * n, [_sha(siblings(p)) for p in proofs], folded,
        [f == root for f in folded], proofs,
    ]


def _descend(levels: list[DataFrame], above: DataFrame, solve: Callable, schema: T.StructType) -> DataFrame:
    """From the roots to the leaves, whose results ``solve`` makes."""
    passed = T._parse_datatype_string(_ABOVE)
    for layer in range(len(levels) - 2, 0, -1):
        above = written(_down(levels[layer], above, layer, _passed_on, passed))
    return _down(levels[0], above, 0, solve, schema)


def manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id", source_col: str = "source",
    tampered: Callable[[DataFrame], dict[str, Column]] | None = None,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof`` of every row.

    A leaf is the digest of the row's ``columns``.  Leaves of a source stand in order of ``doc_id`` (nulls
    first; of equal ids by digest), sources in byte order of their names (null first).  ``subroot`` is
    the root of the source's tree and ``root`` that of the tree over all subroots.  ``proof`` has the
    siblings on the way up, ``proof_sha256`` their digest, and ``folded_root`` is what the leaf and its
    proof give.  ``tampered`` maps a table to replaced columns: the leaf is then folded from these.

    Repeated rows are leaves of their own.  Empty and very long texts are like others: a text is hashed
    in its row, and only digests move.  An empty table has no rows and no root.
    """
    own = docs.select(
        F.when(docs[source_col].isNull(), "0").otherwise(F.concat(F.lit("1"), docs[source_col].cast("string"))).alias("tree"),
        docs[id_col].alias("doc_id"), leaf_digest([docs[c] for c in columns]).alias("digest"),
        (_changed_digest(docs, columns, tampered) if tampered else F.lit(None).cast("string")).alias("changed"),
    )
    trees = layers(own, ["doc_id", "digest"])
    roots = trees[-1].select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name"))
    top = layers(roots, ["name"])
    root = top[-1].select("tree", "idx", F.lit("").alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    above = written(_descend(top, root, _of_sources, T._parse_datatype_string(_ABOVE)))
    schema = T.StructType(
        [
            T.StructField("doc_id", own.schema["doc_id"].dataType),
            *T._parse_datatype_string(
                "leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
                "verified boolean, proof string"
            ).fields,
        ]
    )
    return _descend(trees, above, _verified, schema)


def _changed_digest(docs: DataFrame, columns: Sequence[str], tampered: Callable) -> Column:
    """Digest of the replaced columns."""
    new = tampered(docs)
    return leaf_digest([new.get(c, docs[c]) for c in columns])


def without_line_ends(docs: DataFrame) -> dict[str, Column]:
    """Texts of every id with an even CRC lose their line ends."""
    even = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(even, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])}
