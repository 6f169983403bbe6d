"""Similarity join of texts on n-grams by rare-first prefixes.

The n-grams of a set are ordered by the number of sets that hold them, rarest first. Two sets of a Jaccard similarity of at
least SIMILARITY per cent differ so little that their first n-grams in this order, the prefixes, must share one. So sets are
joined on the n-grams of their prefixes only, and the more n-grams of a set are in no other one, the fewer are left to join on: a set
whose whole prefix is unique has no partner. Most sets are seen to be so by a part of their n-grams, which spares counting
all of them.

Sets that meet on an n-gram are candidates if length, position and suffix allow the overlap that is asked for. Only as many
candidates leave a task as hold together what belongs together. Sets held together by candidates are then compared with
each other on whole sets, block by block, every pair in exactly one block pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.links import components
from daybook.llm.text import Memory, Tables, whole_text

WORDS = 3
SIMILARITY = 90  # per cent of the union
# One n-gram in so many is counted first.
SHARE = 5
# Suffixes are compared by how many n-grams they have in each of so many parts of the hash range.
PARTS = 64
# Sets, and n-grams, in one block.
BLOCK, BLOCK_GRAMS = 256, 1 << 20
MARKS = 1 << 20
_CHUNK = 8192
_TURN = np.uint64(0x9FB21C651E98DF25)


class Words(Memory):
    """Hashes of words. Long words are not kept, so that the room is bounded in bytes."""

    longest = 64

    def compute(self, key: bytes) -> int:
        return xxhash.xxh3_64_intdigest(key)

    def all(self, found: list[bytes]) -> np.ndarray:
        longest = self.longest
        each = (self[w] if len(w) <= longest else self.compute(w) for w in found)
        return np.fromiter(each, np.uint64, len(found))


def grams(raw: bytes, words: int, hashes: Words) -> np.ndarray:
    """Sorted hashes of a text's distinct n-grams of so many words, A-Z in lower case; of a text with fewer words, one hash of
    all of them; none without words."""
    found = raw.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    own = hashes.all(found)
    width = min(words, len(own))
    mixed = np.full(len(own) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ own[k : len(own) - width + 1 + k]) * _TURN
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def least_overlap(n: Column) -> Column:
    """The n-grams that a set of n shares with any partner, at least."""
    return F.ceil(n * SIMILARITY / 100).cast("int")


def prefix_length(n: Column) -> Column:
    return n - least_overlap(n) + 1


def _cut(docs: DataFrame, words: int, text: str, doc_id: str, whole: bool) -> DataFrame:
    """doc_id, n, digest of the set and `some` of its n-grams; with whole, all of them and their number in each part."""
    schema = "doc_id long, n int, digest binary, some array<long>" + ", parts binary" * whole

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for batch in batches:
            for part in (batch.slice(at, 128) for at in range(0, batch.num_rows, 128)):
                sets = [grams(raw, words, hashes) for raw in part.column("raw").to_pylist()]
                some = [s if whole else s[s % np.uint64(SHARE) == 0] for s in sets]
                ends = np.cumsum([0, *map(len, some)])
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n": pa.array([len(s) for s in sets], pa.int32()),
                    "digest": pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    "some": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(some).view(np.int64))),
                }
                if whole:
                    counts = [np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PARTS) for s in sets]
                    columns["parts"] = pa.array([np.minimum(c, 255).astype(np.uint8).tobytes() for c in counts], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole_text(f"`{text}`").cast("binary").alias("raw"))
    return rows.mapInArrow(cut, schema)


def _by_group(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """work() on the rows of each group. Groups are small and many, so a task passes through them in order."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            values = [table.column(k).to_numpy() for k in keys]
            starts = np.flatnonzero(np.any([np.diff(v) != 0 for v in values], axis=0)) + 1
            bounds = [0, *starts.tolist()]
            # The last group may go on in the next batch.
            done = [work(table.slice(a, b - a)) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield from _together(done)
            held = table.slice(bounds[-1]).combine_chunks().to_batches()
        if held:
            yield from _together([work(pa.Table.from_batches(held))])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(through, schema)


def _together(tables: list[pa.Table]) -> list[pa.RecordBatch]:
    tables = [t for t in tables if t.num_rows]
    return pa.concat_tables(tables).combine_chunks().to_batches() if tables else []


def _spanning(pairs: Iterator[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Of pairs among n nodes, as many as connect what they connect."""
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    kept = []
    for i, j in pairs:
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[a] = b
            kept.append((int(i), int(j)))
    return kept


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two blocks that are compared; twice the same if a block is compared with itself."""
    own, low, high = (table.column(c).to_numpy() for c in ("own", "low", "high"))
    if low[0] == high[0]:
        return np.arange(len(own)), np.arange(len(own))
    return np.flatnonzero(own == low[0]), np.flatnonzero(own == high[0])


def _asked(n: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths summed, and the overlap that is asked for: 100 * overlap >= SIMILARITY * union."""
    both = n[left][:, None] + n[right][None, :]
    return both, -(-SIMILARITY * both // (100 + SIMILARITY))


def _parted(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("parts").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16)


def _possible(n: np.ndarray, parts: np.ndarray, left: np.ndarray, right: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Suffix filter: the pairs marked in ok whose parts do not differ by more than the sets may."""
    both, asked = _asked(n, left, right)
    i, j = np.nonzero(ok)
    for at in range(0, len(i), 1 << 14):
        a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        apart = np.abs(parts[left[a]] - parts[right[b]]).sum(1)
        ok[a, b] = apart <= (both - 2 * asked)[a, b]
    return ok


def candidates(table: pa.Table) -> pa.Table:
    """Links between rows that share an n-gram at the places `pos` of their order, by the filters on length, position and
    suffix: as many as hold the candidates together."""
    left, right = _sides(table)
    n, pos, node = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "node"))
    _, asked = _asked(n, left, right)
    # Shared at most: what stands before in both, the n-gram itself, and what follows in both.
    before = np.minimum(pos[left][:, None], pos[right][None, :])
    after = np.minimum((n - pos)[left][:, None], (n - pos)[right][None, :])
    short = np.minimum(n[left][:, None], n[right][None, :])
    long = np.maximum(n[left][:, None], n[right][None, :])
    ok = (before + after >= asked) & (100 * short >= SIMILARITY * long) & (left[:, None] < right[None, :] if len(left) == len(table) else True)
    ok = _possible(n, _parted(table), left, right, ok)
    links = _spanning(((left[i], right[j]) for i, j in zip(*np.nonzero(ok), strict=True)), len(table))
    return pa.table({"a": pa.array([node[i] for i, _ in links], pa.int64()), "b": pa.array([node[j] for _, j in links], pa.int64())})


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams each set of one side shares with each of the other."""
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # N-grams of one set alone are shared with none.
    often = np.bincount(place) > 1
    number, held = np.cumsum(often) - 1, often[place]
    owner, place = owner[held], number[place[held]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(often.sum()), _CHUNK):
        a, b = np.searchsorted(place, [at, at + _CHUNK])
        marks = np.zeros((len(sets), min(_CHUNK, int(often.sum()) - at)), np.float32)
        marks[owner[a:b], place[a:b] - at] = 1
        out += marks[left] @ marks[right].T
    return out.astype(np.int64)


def verified(table: pa.Table) -> pa.Table:
    """Links between rows whose whole sets are similar, as many as hold them together, and for each row how many documents
    it is linked with here (b is null)."""
    left, right = _sides(table)
    n, node, docs = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "node", "docs"))
    sets = [np.frombuffer(s, np.int64) if isinstance(s, bytes) else np.array(s.values) for s in table.column("some")]
    common = _common(sets, left, right)
    linked = 100 * common >= SIMILARITY * (n[left][:, None] + n[right][None, :] - common)
    same = len(left) == len(table)
    if same:
        np.fill_diagonal(linked, False)
    counts = np.zeros(len(table), np.int64)
    counts[left] = linked @ docs[right]
    if not same:
        counts[right] = linked.T @ docs[left]
    links = _spanning(((left[i], right[j]) for i, j in zip(*np.nonzero(linked), strict=True)), len(table))
    some = np.flatnonzero(counts)
    a, b = [node[i] for i, _ in links] + node[some].tolist(), [node[j] for _, j in links] + [None] * len(some)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "linked": pa.array([0] * len(links) + counts[some].tolist(), pa.int64())})


def _blocked(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """rows with `own` block and, once per block they are compared with, `low` and `high`."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "other")


def _open_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that may have a partner, by the part of the n-grams in rows(mark, some): a class is out if so many
    of them are in no other class that too few are left to share."""
    each = rows.select("mark", F.explode("some").alias("gram"))
    held = each.groupBy("gram").agg(F.min("mark").alias("mark"), F.max("mark").alias("last"))
    unique = held.filter("mark = last").groupBy("mark").agg(F.count(F.lit(1)).alias("own"))
    return classes.join(unique, "mark", "left").filter(F.coalesce("own", F.lit(0)) < prefix_length(F.col("n"))).drop("own")


def _prefixes(sets: DataFrame) -> DataFrame:
    """sets(node, n, some, …) -> (node, gram, pos): the n-grams of each set's prefix that are in another set too. Unique ones
    come first in the order and are joined with nothing; they are only counted."""
    often = sets.select(F.explode("some").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    shared = sets.select("node", "n", F.explode("some").alias("gram")).join(often, "gram")
    order = F.array_sort(F.collect_list(F.struct("sets", "gram"))).alias("order")
    of_set = shared.groupBy("node", "n").agg(order).withColumn("first", F.col("n") - F.size("order"))
    length = F.greatest(F.lit(0), prefix_length(F.col("n")) - F.col("first"))
    of_set = of_set.select("node", "first", F.slice("order", F.lit(1), length).alias("order"))
    return of_set.select("node", "first", F.posexplode("order").alias("at", "x")).select("node", F.col("x.gram").alias("gram"), (F.col("first") + F.col("at")).alias("pos"))


def jaccard_classes(docs: DataFrame, words: int = WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, class_id, n_links.

    A text's set holds its distinct n-grams of `words` words; a shorter text has one, of all its words. Documents are linked
    if 100 * intersection >= SIMILARITY * union; component_id is the smallest id that can be reached by links, class_id the
    smallest id with the same set, n_links the number of other documents linked. Texts without words (null, empty) are linked
    with nothing. Rows that share an id are one document in components; each row counts as a document in n_links. A row without
    id is linked with nothing; its component_id and class_id are null. An empty table gives no rows; other columns are not read.
    """
    tables = Tables(docs.sparkSession, "jaccard")
    rows = tables.write(_cut(docs, words, text, doc_id, whole=False), "sets")
    mark = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long").alias("mark")
    real = rows.filter("n > 0 AND doc_id IS NOT NULL")
    of_class = real.groupBy("digest", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("docs"))
    of_class = tables.write(of_class.select("digest", "n", "node", "docs", mark), "classes")
    opened = tables.write(_open_classes(real.select(mark, "some"), of_class), "open")
    narrow = tables.write(rows.select("doc_id", "n", "digest"), "narrow")
    tables.drop(rows)

    # A table of at most MARKS numbers, whatever the input, keeps most texts back from the shuffle.
    spot = F.pmod(F.xxhash64("node"), F.lit(MARKS)).alias("spot")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("node"), F.col(f"`{text}`").alias("text"))
    texts = texts.withColumn("spot", spot).join(F.broadcast(opened.select(spot).distinct()), "spot", "left_semi")
    texts = texts.join(opened.select("node").distinct(), "node", "left_semi").select("node", "text")
    cut = _cut(texts, words, "text", "node", whole=True).withColumnRenamed("doc_id", "node")
    sets = cut.join(opened.select("node", "digest", "docs"), ["node", "digest"]).dropDuplicates(["node", "digest"])
    sets = tables.write(sets.select("node", "n", "docs", "some", "parts"), "open-sets")

    prefixes = tables.write(_prefixes(sets), "prefixes")
    meeting = prefixes.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    meeting = prefixes.join(meeting, "gram").join(sets.select("node", "n", "parts"), "node")
    meeting = _blocked(meeting, "gram", F.ceil(F.col("rows") / BLOCK)).drop("rows")
    found = _by_group(meeting, ["gram", "low", "high"], candidates, "a long, b long")
    clusters = tables.write(components(tables.write(found.distinct(), "candidates")), "clusters")

    sized = clusters.join(sets.select("node", "n"), "node").groupBy("component")
    sized = sized.agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).alias("blocks"))
    members = clusters.join(sets, "node").join(sized, "component")
    members = _blocked(members, "component", F.col("blocks")).drop("parts")
    links = tables.write(_by_group(members, ["component", "low", "high"], verified, "a long, b long, linked long"), "links")

    # Ids that stand on several texts join their classes.
    ids = narrow.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "digest").distinct()
    several = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("doc_id")
    joined = ids.join(several, "doc_id").join(of_class.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    reached = components(links.filter("b IS NOT NULL").select("a", "b").unionByName(joined))
    linked = links.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    found = of_class.select("digest", "node", "docs").join(reached, "node", "left").join(linked, "node", "left")
    found = found.select("digest", "node", F.coalesce("component", "node").alias("component"), (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    result = narrow.join(found, "digest", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    own = [F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(to) for c, to in (("component", "component_id"), ("node", "class_id"))]
    links_of = F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links")
    return result.select("doc_id", F.col("n").cast("long").alias("n_shingles"), *own, links_of)
