"""A Merkle manifest of a dataset by time-forward processing.

Every node of the tree has a label: its round, its tree and its block. A node's digest is a message to its parent, and a
proof suffix (all siblings from a node up to the root) is a message to its children. Messages wait in an external priority
queue: tables in the shared folder that Spark sorts by the receiver's label, so neither the queue nor the tree is ever held
in one task. A round takes the messages of a block, BLOCK consecutive nodes, off the queue, passes LEVELS levels with a
small queue of its own, and sends one digest to the next round. The reversed sweep goes through the same tables from the
root: each block receives one suffix and hands it on, longer by the siblings, until it reaches the leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.places import placed
from daybook.llm.text import Tables
from daybook.session import small_side

FAN = 16
LEVELS = 2
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGEST = 32
_OUT = (
    "doc_id long, leaf string, subroot string, root string, place long, n_siblings int, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values, each `-` if null, else its length in bytes, a colon and itself, so that no two rows of
    values are written alike."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def node_digest(run: list[bytes]) -> bytes:
    """The digest of a node: of its children's digests as hexadecimal text, one after the other."""
    return sha256(b"".join(run).hex().encode()).digest()


def sweep_up(digests: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each level over a block's digests, these first. Nodes are made in the order of their labels (level,
    index); the queue brings each the digests of its children."""
    made = [digests, *([] for _ in range(levels))]
    queue = [((1, at // FAN), at, digest) for at, digest in enumerate(digests)] if levels else []
    heapify(queue)
    while queue:
        (level, index), run = queue[0][0], []
        while queue and queue[0][0] == (level, index):
            run.append(heappop(queue)[2])
        made[level].append(node_digest(run))
        if level < levels:
            heappush(queue, ((level + 1, index // FAN), index, made[level][-1]))
    return made


def sweep_down(made: list[list[bytes]], suffix: bytes, shape: bytes) -> list[tuple[bytes, bytes]]:
    """Suffix and shape of each of a block's first nodes, given those of its last one. A shape holds, level by level, the
    place of a node in its run and the length of the run."""
    above = [(suffix, shape)]
    for nodes in reversed(made[:-1]):
        below = []
        for at in range(len(nodes)):
            run, slot = nodes[at - at % FAN : at - at % FAN + FAN], at % FAN
            own_suffix, own_shape = above[at // FAN]
            below.append((b"".join(run[:slot] + run[slot + 1 :]) + own_suffix, bytes((slot, len(run))) + own_shape))
        above = below
    return above


def fold(digest: bytes, suffix: bytes, shape: bytes) -> bytes:
    """The root that a leaf's digest and its proof lead to."""
    at = 0
    for slot, size in zip(shape[::2], shape[1::2], strict=True):
        left, end = at + _DIGEST * slot, at + _DIGEST * (size - 1)
        digest = node_digest([suffix[at:left], digest, suffix[left:end]])
        at = end
    return digest


def _levels(nodes: int) -> int:
    """The levels a block passes, of a tree with so many nodes."""
    levels = 0
    while levels < LEVELS and nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def _packed(nodes: DataFrame, *columns: str) -> DataFrame:
    """nodes(tree, n, place, digest, …) -> one row per block, with its nodes in order."""
    entry = F.struct("place", "digest", *columns)
    block = F.floor(F.col("place") / BLOCK).alias("block")
    return nodes.groupBy("tree", "n", block).agg(F.array_sort(F.collect_list(entry)).alias("nodes"))


def _sent_up(blocks: DataFrame) -> DataFrame:
    """The nodes of the next round: (tree, n, place, digest)."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_pylist()
            tops = [sweep_up(d, _levels(n))[-1][0] for n, d in zip(sizes, batch.column("digests").to_pylist(), strict=True)]
            sizes = [-(-n // BLOCK) for n in sizes]
            columns = [batch.column("tree"), pa.array(sizes, pa.int64()), batch.column("block"), pa.array(tops, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "n", "place", "digest"])

    narrow = blocks.select("tree", "n", "block", F.col("nodes.digest").alias("digests"))
    return narrow.mapInArrow(climb, "tree long, n long, place long, digest binary")


def _rounds(nodes: DataFrame, n: int, tables: Tables, label: str, *columns: str) -> tuple[list[DataFrame], DataFrame]:
    """The staged blocks of each round until every tree has one node, and these nodes; n nodes in the largest tree."""
    rounds = []
    while n > 1 or not rounds:
        blocks = tables.write(_packed(nodes, *([] if rounds else columns)), f"{label}{len(rounds)}")
        rounds.append(blocks)
        nodes = _sent_up(blocks)
        n = -(-n // BLOCK)
    return rounds, nodes


_MESSAGE = "tree long, place long, digest binary, suffix binary, shape binary, subroot binary, root binary"


def _handed_down(blocks: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages for the nodes in the blocks, from those for the blocks."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                digests = row["digests"]
                sent = sweep_down(sweep_up(digests, _levels(row["n"])), row["suffix"], row["shape"])
                same = {c: [row[c]] * len(digests) for c in ("tree", "subroot", "root")}
                first = row["block"] * BLOCK
                rows = same | {"place": range(first, first + len(digests)), "digest": digests}
                rows |= {"suffix": [s for s, _ in sent], "shape": [s for _, s in sent]}
                kinds = {"tree": pa.int64(), "place": pa.int64()}
                yield pa.RecordBatch.from_pydict({c: pa.array(rows[c], kinds.get(c, pa.binary())) for c in _NAMES})

    return _met(blocks, messages, F.col("nodes.digest").alias("digests")).mapInArrow(descend, _MESSAGE)


_NAMES = [part.split()[0] for part in _MESSAGE.split(", ")]


def _met(blocks: DataFrame, messages: DataFrame, *columns: Column) -> DataFrame:
    sent = messages.select("tree", F.col("place").alias("block"), "suffix", "shape", "subroot", "root")
    return blocks.select("tree", "n", "block", *columns).join(sent, ["tree", "block"])


def _told_leaves(blocks: DataFrame, messages: DataFrame, proofs: bool) -> DataFrame:
    """The result rows of the leaves in the blocks."""
    schema = _OUT + ", proof array<string>" * proofs
    names = [part.split()[0] for part in schema.split(", ")]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaves = row["leaves"]
                sent = sweep_down(sweep_up(leaves, _levels(row["n"])), row["suffix"], row["shape"])
                root, first = row["root"], row["block"] * BLOCK
                folded = [fold(d, *s) for d, s in zip(row["claims"], sent, strict=True)]
                columns = {
                    "doc_id": pa.array(row["ids"], pa.int64()),
                    "leaf": pa.array([d.hex() for d in leaves], pa.string()),
                    "subroot": pa.array([row["subroot"].hex()] * len(leaves), pa.string()),
                    "root": pa.array([root.hex()] * len(leaves), pa.string()),
                    "place": pa.array(range(first, first + len(leaves)), pa.int64()),
                    "n_siblings": pa.array([len(s) // _DIGEST for s, _ in sent], pa.int32()),
                    "proof_sha256": pa.array([sha256(s.hex().encode()).hexdigest() for s, _ in sent], pa.string()),
                    "folded_root": pa.array([d.hex() for d in folded], pa.string()),
                    "verified": pa.array([d == root for d in folded], pa.bool_()),
                }
                if proofs:
                    cut = [[s[at : at + _DIGEST].hex() for at in range(0, len(s), _DIGEST)] for s, _ in sent]
                    columns["proof"] = pa.array(cut, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    nodes = [F.col(f"nodes.{c}").alias(to) for c, to in (("digest", "leaves"), ("claim", "claims"), ("doc_id", "ids"))]
    return _met(blocks, messages, *nodes).mapInArrow(tell, schema)


def manifest(
    docs: DataFrame,
    claim: Column | None = None,
    proofs: bool = True,
    fields: tuple[str, ...] = FIELDS,
    doc_id: str = "doc_id",
    group: str = "source",
) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, subroot (of its group's tree), root, place (in the group, from 0),
    n_siblings, proof_sha256, folded_root, verified and, with `proofs`, the proof: all siblings up to the root.

    A leaf is the digest of the row's `fields`. The leaves of a group stand by ascending doc_id (nulls first, then by leaf);
    runs of FAN consecutive nodes become their parent until one node is left. The groups' roots, null group first, then
    by their bytes, are joined likewise. `claim` is an expression over `docs` for the leaf digest (hexadecimal) to be checked
    against the proof, by default the row's own leaf: folded_root is where it leads to, and `verified` tells if that is root.

    Nulls count in a digest as such. Rows that are repeated are leaves of their own. A table of one row has its leaf as root and
    an empty proof; an empty table gives no rows. Columns that are not named are not read.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "merkle")
    leaf = leaf_digest(*(F.col(f"`{f}`") for f in fields))
    # No group comes before the group of an empty name.
    key = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))
    checked = leaf if claim is None else F.coalesce(claim, leaf)
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        key.alias("key"),
        F.unhex(leaf).alias("digest"),
        F.unhex(checked).alias("claim"),
    )
    rows = tables.write(rows, "leaves")
    groups = tables.write(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "groups")
    n_groups, largest = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    numbered = placed(groups, [], [F.col("key")], tables, "trees").withColumnRenamed("place", "tree")
    numbered = tables.write(numbered, "numbered")
    leaves = rows.join(small_side(numbered), "key").select("tree", "n", "doc_id", "digest", "claim")
    leaves = tables.write(leaves, "numbered-leaves")
    leaves = placed(leaves, ["tree"], [F.col("doc_id"), F.col("digest"), F.col("claim")], tables, "places")

    below, subroots = _rounds(leaves, largest, tables, "leaves", "claim", "doc_id")
    joined = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("n"), F.col("tree").alias("place"), "digest")
    above, top = _rounds(joined, n_groups, tables, "subroots")

    empty = F.lit(b"").alias
    messages = top.select("tree", "place", "digest", empty("suffix"), empty("shape"), empty("subroot"), F.col("digest").alias("root"))
    for blocks in reversed(above):
        messages = _handed_down(blocks, messages)
    messages = messages.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "digest", "suffix", "shape", F.col("digest").alias("subroot"), "root")
    for n, blocks in enumerate(reversed(below[1:])):
        messages = tables.write(_handed_down(blocks, messages), f"suffixes{n}")
    return _told_leaves(below[0], messages, proofs)
