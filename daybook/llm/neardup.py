"""Near copies by an LSH forest, confirmed on full sets.

Texts with one set of shingles form a class; the forest holds a signature of each class. Every tree sorts the classes by
its own part of the signature. Classes with a common prefix stand together, and each is paired with the next ones in that
order. A region, the classes with one prefix, is as deep as its density asks for: where many classes share a prefix, a
longer one divides them, and each is also paired with the first class of the region that was divided.

Pairs that are similar by a sketch join classes to clusters. Within a cluster all classes are compared on their full
sets, block against block, whatever order the trees had them in: a group of copies that have little in common but their
origin is thus searched as a whole, which neighbours alone would not do. Only a block's spanning links leave its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.links import components
from daybook.llm.text import Memory, Tables, whole_text
from daybook.session import small_side

WORDS = 4
SIMILARITY = 80  # per cent of the union
TREES = 16
DEPTH = 8
# Regions start at this depth. Two texts of similarity 0.8 miss each other in all trees with probability 1e-5.
DEPTHS = (3, 5, 8)
REGION = 256
NEIGHBOURS = 4
# Classes are in one cluster if so many of the sketch's bits agree: about 0.55 of the shingles. A pair of similarity 0.8
# falls below with probability 1e-6.
_BITS = TREES * DEPTH
LOOSE_BITS = 99
BLOCK = 256
MARKS = 1 << 20
SEED = 7
_CHUNK = 8192

_random = np.random.default_rng(SEED)
_MULTIPLY = _random.integers(0, 1 << 63, _BITS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, _BITS, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(Memory):
    # Longer words are not remembered, so that the room is bounded in bytes.
    longest = 64

    def compute(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def __missing__(self, word: bytes) -> int:
        return super().__missing__(word) if len(word) <= self.longest else self.compute(word)


def shingles(raw: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles of so many words (A-Z in lower case); of a shorter text, one hash
    of all its words; none without words."""
    found = raw.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(own))
    mixed = np.full(len(own) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = mixed * _STEP + own[k : len(own) - width + 1 + k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(found: np.ndarray) -> np.ndarray:
    """The least value of each of the forest's hash functions over a set."""
    least = np.full(_BITS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048, None] * _MULTIPLY
        part += _ADD
        part >>= np.uint64(32)
        np.minimum(least, part.min(0).astype(np.uint32), out=least)
    return least


def signed(docs: DataFrame, words: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature (big-endian numbers) and its sketch of one bit per number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                sets = [shingles(raw, words, hashes) for raw in part.column("raw").to_pylist()]
                signatures = [signature(s) for s in sets]
                sketch = np.packbits(np.array(signatures).astype(np.uint8) & 1, axis=1).view("<i8").reshape(-1, 2)
                columns = [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s.astype(">u4").tobytes() for s in signatures], pa.binary()),
                    pa.array(np.ascontiguousarray(sketch[:, 0])),
                    pa.array(np.ascontiguousarray(sketch[:, 1])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "signature", "s1", "s2"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("raw"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles int, digest binary, signature binary, s1 long, s2 long")


def _regions(forest: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame | None]:
    """forest(tree, key, node, s1, s2) with `region`, no larger than REGION; and (node, leader) for the regions that
    were divided."""
    leaders = None
    level = forest.withColumn("region", _prefix(DEPTHS[0]))
    done = None
    for k, depth in enumerate(DEPTHS):
        large = level.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
        large = tables.write(large.filter(F.col("n") > REGION), f"large{depth}")
        if large.isEmpty():
            break
        joined = level.join(small_side(large), "region", "left")
        fits = joined.filter("n IS NULL").drop("n")
        done = fits if done is None else done.unionByName(fits)
        rest = tables.write(joined.filter("n IS NOT NULL"), f"rest{depth}")
        leader = rest.groupBy("region").agg(F.min(F.struct("node", "s1", "s2")).alias("leader"))
        led = rest.join(leader, "region").filter(_agree("s1", "s2", "leader.s1", "leader.s2")).select(F.col("node").alias("a"), F.col("leader.node").alias("b"))
        leaders = led if leaders is None else leaders.unionByName(led)
        # Beyond the last depth all keys are the same: any division will do.
        salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / REGION))
        deeper = _prefix(DEPTHS[k + 1]) if depth < DEPTH else F.xxhash64("region", salt)
        level = rest.withColumn("region", deeper).drop("n")
    return (level if done is None else done.unionByName(level)), leaders


def _prefix(depth: int) -> Column:
    return F.xxhash64("tree", F.substring("key", 1, 4 * depth))


def _agree(a1: str, a2: str, b1: str, b2: str) -> Column:
    apart = F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) + F.bit_count(F.col(a2).bitwiseXOR(F.col(b2)))
    return apart <= _BITS - LOOSE_BITS


def loose_pairs(classes: DataFrame) -> DataFrame:
    """classes(node, signature, s1, s2) -> distinct pairs (a, b) of neighbours in the forest with similar sketches."""
    tables = Tables(classes.sparkSession, "forest")
    width = 4 * DEPTH
    keys = F.array(*(F.expr(f"substring(signature, {1 + width * t}, {width})") for t in range(TREES)))
    forest = classes.select("node", "s1", "s2", F.posexplode(keys).alias("tree", "key"))
    regions, leaders = _regions(forest, tables)
    order = Window.partitionBy("region").orderBy("key", "node")
    ahead = [F.lead(F.struct("node", "s1", "s2"), k).over(order).alias(f"next{k}") for k in range(1, NEIGHBOURS + 1)]
    rows = regions.select("node", "s1", "s2", *ahead)
    near = [F.when(_agree("s1", "s2", f"next{k}.s1", f"next{k}.s2"), F.col(f"next{k}.node")) for k in range(1, NEIGHBOURS + 1)]
    pairs = rows.select(F.col("node").alias("a"), F.explode(F.array_compact(F.array(*near))).alias("b"))
    pairs = pairs if leaders is None else pairs.unionByName(leaders)
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def spanning_links(sets: list[np.ndarray], first: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is connected by similar pairs, each pair being of one set marked in `first` and one that is
    not, or of any two if all are marked."""
    left = np.flatnonzero(first)
    right = np.flatnonzero(~first) if not first.all() else left
    sizes = np.array([len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # Shingles of one set alone are in no intersection.
    often = np.bincount(place) > 1
    number = np.cumsum(often) - 1
    held = often[place]
    owner, place = owner[held], number[place[held]]
    by_place = np.argsort(place, kind="stable")
    owner, place = owner[by_place], place[by_place]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(often.sum()), _CHUNK):
        a, b = np.searchsorted(place, [at, at + _CHUNK])
        marks = np.zeros((len(sets), min(_CHUNK, int(often.sum()) - at)), np.float32)
        marks[owner[a:b], place[a:b] - at] = 1
        common += marks[left] @ marks[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    parent = list(range(len(sets)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    links = []
    for i, j in zip(*np.nonzero(100 * common >= SIMILARITY * union), strict=True):
        a, b = root(int(left[i])), root(int(right[j]))
        if a != b:
            parent[a] = b
            links.append((int(left[i]), int(right[j])))
    return links


def confirmed_links(docs: DataFrame, clusters: DataFrame, words: int, text: str, doc_id: str) -> DataFrame:
    """clusters(node, component) -> links (a, b) between nodes of one cluster whose sets are similar enough, as many as
    join what belongs together. A cluster of several blocks is compared block by block."""
    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = clusters.join(sizes, "component")
    rows = docs.select(F.col(doc_id).cast("long").alias("node"), whole_text(text).cast("binary").alias("raw"))
    # Most texts are in no cluster. A table of at most MARKS numbers, whatever the input, keeps those back from the shuffle.
    mark = F.pmod(F.xxhash64("node"), F.lit(MARKS))
    marked = clusters.select(mark.alias("mark")).distinct()
    rows = rows.withColumn("mark", mark).join(F.broadcast(marked), "mark", "left_semi").drop("mark")
    rows = rows.join(members, "node").select("component", "blocks", "node", "raw")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                sets = [shingles(raw, words, hashes).tobytes() for raw in part.column("raw").to_pylist()]
                kept = [part.column(n) for n in ("component", "blocks", "node")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sets, pa.binary())], names=["component", "blocks", "node", "found"])

    rows = rows.mapInArrow(cut, "component long, blocks int, node long, found binary").filter("length(found) > 0")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "found")

    def compare(rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").to_numpy()
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in rows.column("found")]
        first = rows.column("own").to_numpy() == rows.column("low")[0].as_py()
        links = spanning_links(sets, first)
        return pa.table({"a": pa.array([nodes[i] for i, _ in links], pa.int64()), "b": pa.array([nodes[j] for _, j in links], pa.int64())})

    return rows.groupBy("component", "low", "high").applyInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, words: int = WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    A text's set holds its distinct shingles of `words` words; a shorter text has one, of all its words. Texts are linked
    if their sets have at least SIMILARITY per cent of their union in common; component_id is the smallest id that can be
    reached, and the row with that id is kept. Texts without words (null, empty) are linked with nothing. Rows that share
    an id are one document. A row without id is linked with nothing and kept, its component_id is null. An empty table
    gives no rows; other columns are not read.
    """
    tables = Tables(docs.sparkSession, "neardup")
    rows = tables.write(signed(docs, words, text, doc_id), "signatures")
    real = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    of_class = tables.write(real.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    classes = real.join(of_class, "digest").filter("doc_id = node").dropDuplicates(["digest"]).select("node", "signature", "s1", "s2")
    classes = tables.write(classes, "signed-classes")
    clusters = tables.write(components(loose_pairs(classes)), "clusters")
    tables.drop(classes)
    links = tables.write(confirmed_links(docs, clusters, words, text, doc_id), "links")
    # Ids that stand on several texts join their classes.
    shared = real.select("doc_id", "digest").distinct().join(of_class, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    repeated = real.select("doc_id", "digest").distinct().groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("a"))
    found = components(links.unionByName(shared.join(repeated, "a", "left_semi")))
    narrow = rows.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node", "doc_id")).otherwise(F.col("doc_id"))
    result = narrow.join(found, "node", "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), own.alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that `near_copies` keeps, with all their columns."""
    gone = near_copies(docs, words, text, doc_id).filter("NOT kept").select(F.col("doc_id").alias("__near_id")).distinct()
    return docs.join(gone, F.col(doc_id) == F.col("__near_id"), "left_anti")
