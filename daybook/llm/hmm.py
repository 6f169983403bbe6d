"""Hidden Markov language model over words.

A word's probability in a state is that of its class in the state times that of the word in its class. Frequent words
are classes of their own; all others share classes by their last bytes. So the learnt tables have a fixed size (states x
classes), while the counts of words, which grow with the corpus, stay in a table that is joined and never collected.

Words reach their counts by blocks of texts: a block numbers its distinct words, only these are shuffled, joined with
the counts and sent back to their block. Texts become sequences of class numbers once; each pass of Baum-Welch reads
those, and its expected counts are added up over all partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.text import Tables, training_part, whole_text

STATES = 8
FREQUENT = 3000
ENDINGS = 1024
# Passes go on until one adds at most so much to the log10 probability of a token.
TOLERANCE = 1e-3
ADDED = 0.1
SEED = 4
# A block is closed when it has so many distinct words, bytes of them, or tokens, so that it fits a task at any partition size.
BLOCK_WORDS = 600_000
BLOCK_BYTES = 64 << 20
BLOCK_TOKENS = 6_000_000
# A word of its own class stands at least so often in training texts.
LEAST_FREQUENT = 50
# Tokens whose forward and backward values are held at a time, and tokens whose texts are sorted by length together.
HELD_TOKENS = 300_000
GATHERED_TOKENS = 4_000_000
# A lattice of long texts has more tokens than are held, so that a step has many texts; so many texts, or tokens at most.
WIDE, WIDE_TOKENS = 256, 2_000_000
# Texts of one length class differ by a factor of 2 ** (1 / CLASSES_PER_OCTAVE).
CLASSES_PER_OCTAVE = 2
# Backward values are scaled anew every so many steps.
RESCALED = 64
# The end of a text; no word has a space.
END = b" "
_CODEC = "zstd"


def tokens_of(raw: bytes) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z in lower case, and the end."""
    words = raw.lower().split()
    words.append(END)
    return words


class Block:
    """Numbers for the words of some texts, and how often each stands in training texts."""

    def __init__(self, name: int) -> None:
        self.name = name
        self.numbers: dict[bytes, int] = {}
        self.learnt: list[np.ndarray] = []
        self.tokens = self.bytes = 0

    def add(self, raw: bytes, held_out: bool) -> tuple[int, bytes]:
        """The number of tokens, and their numbers."""
        words, numbers = tokens_of(raw), self.numbers
        for word in words:
            if word not in numbers:
                numbers[word] = len(numbers)
                self.bytes += len(word)
        ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        self.tokens += len(ids)
        if not held_out:
            self.learnt.append(ids)
        return len(ids), pa.compress(ids.tobytes(), _CODEC, asbytes=True)

    def full(self) -> bool:
        return len(self.numbers) >= BLOCK_WORDS or self.bytes >= BLOCK_BYTES or self.tokens >= BLOCK_TOKENS

    def words(self) -> pa.RecordBatch:
        n = len(self.numbers)
        seen = np.bincount(np.concatenate([*self.learnt, np.zeros(0, np.int32)]), minlength=n)
        columns = [pa.array(list(self.numbers), pa.binary()), pa.array(np.arange(n), pa.int32()), pa.array(seen, pa.int64())]
        return _block_rows(self.name, n, words=columns)


def _block_rows(block: int, n: int, texts: list[pa.Array] | None = None, words: list[pa.Array] | None = None) -> pa.RecordBatch:
    texts = texts or [pa.nulls(n, kind) for kind in (pa.int64(), pa.bool_(), pa.int64(), pa.binary())]
    words = words or [pa.nulls(n, kind) for kind in (pa.binary(), pa.int32(), pa.int64())]
    names = ["block", "doc_id", "held_out", "n_tokens", "sequence", "word", "number", "seen"]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int64)), *texts, *words], names=names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = Block(TaskContext.get().partitionId() << 24)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            held = part.column("held_out").to_pylist()
            sequences = [block.add(raw, h) for raw, h in zip(part.column("raw").to_pylist(), held, strict=True)]
            sizes, packed = zip(*sequences, strict=True)
            texts = [part.column("doc_id"), part.column("held_out"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
            yield _block_rows(block.name, part.num_rows, texts=texts)
            if block.full():
                yield block.words()
                block = Block(block.name + 1)
    if block.numbers:
        yield block.words()


@dataclass
class Model:
    """Probabilities of the first state, of the next state by state, and of classes by state."""

    first: np.ndarray
    after: np.ndarray
    classes: np.ndarray

    def single(self) -> Model:
        return Model(*(np.ascontiguousarray(x, np.float32) for x in (self.first, self.after, self.classes)))

    @staticmethod
    def start(shares: np.ndarray, states: int, seed: int) -> Model:
        random = np.random.default_rng(seed)
        classes = shares * random.uniform(0.5, 1.5, (states, len(shares)))
        after = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Model(np.full(states, 1 / states), after, classes / classes.sum(1, keepdims=True))

    @staticmethod
    def of_counts(counts: Counts, shares: np.ndarray) -> Model:
        """The most likely tables for expected counts, with one more token per state dealt as `shares`."""
        first, after = counts.first + ADDED, counts.after + ADDED
        classes = counts.classes + shares
        return Model(first / first.sum(), after / after.sum(1, keepdims=True), classes / classes.sum(1, keepdims=True))


@dataclass
class Counts:
    """Expected counts, and the log10 probability of what was counted."""

    first: np.ndarray
    after: np.ndarray
    classes: np.ndarray
    logs: float = 0.0

    @staticmethod
    def none(states: int, classes: int) -> Counts:
        return Counts(np.zeros(states), np.zeros((states, states)), np.zeros((states, classes)))


class Lattice:
    """Some sequences side by side: all first tokens, then all second tokens, and so on, the longest in front. Of `seen`, step t
    has active[t] tokens. Values are held for HELD_TOKENS tokens at a time, however long the sequences are."""

    def __init__(self, seen: np.ndarray, active: np.ndarray) -> None:
        self.seen, self.active = seen, active
        self.begin = np.concatenate([[0], np.cumsum(active)])

    @staticmethod
    def of(sequences: list[np.ndarray]) -> tuple[Lattice, np.ndarray]:
        """The lattice, and for each of its columns which sequence it is."""
        sizes = np.array([len(s) for s in sequences], np.int32)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        active = np.bincount(place)
        begin = np.concatenate([[0], np.cumsum(active)])
        seen = np.empty(len(place), np.uint16)
        seen[begin[place] + np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)] = np.concatenate([sequences[k] for k in order])
        return Lattice(seen, active), order

    def parts(self) -> list[tuple[int, int]]:
        """Runs of steps with HELD_TOKENS tokens at most, or of one step."""
        cuts = [0]
        while cuts[-1] < len(self.active):
            fits = int(np.searchsorted(self.begin, self.begin[cuts[-1]] + HELD_TOKENS, "right")) - 1
            cuts.append(max(cuts[-1] + 1, min(fits, len(self.active))))
        return list(zip(cuts, cuts[1:], strict=False))

    def steps(self, model: Model, part: tuple[int, int], now: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per step of a part: scaled forward values (states x active) and their scales; `now` are those of the step before."""
        low = self.begin[part[0]]
        given = model.classes[:, self.seen[low : self.begin[part[1]]]]
        after = np.ascontiguousarray(model.after.T)
        for t in range(*part):
            n, a = self.active[t], self.begin[t] - low
            now = (model.first[:, None] if now is None else after @ now[:, :n]) * given[:, a : a + n]
            sums = np.add.reduce(now, 0)
            now /= sums
            yield now, sums

    def scores(self, model: Model) -> np.ndarray:
        """log10 of each column's probability."""
        logs, now = np.zeros(self.active[0]), None
        for part in self.parts():
            for now, sums in self.steps(model, part, now):
                logs[: len(sums)] += np.log10(sums)
        return logs

    def count(self, model: Model, counts: Counts) -> None:
        """Add the expected counts of the sequences. Of all parts but the one at hand only the first step's predecessor is
        kept; its forward values are computed again."""
        parts, entering, now = self.parts(), [], None
        for part in parts:
            entering.append(now)
            if part is not parts[-1]:
                for now, _ in self.steps(model, part, now):
                    pass
        pairs, beta = np.zeros(model.after.shape), None
        for part, before in zip(reversed(parts), reversed(entering), strict=True):
            beta = self._count_part(model, counts, part, before, beta, pairs)
        counts.after += pairs * model.after

    def _count_part(self, model: Model, counts: Counts, part: tuple[int, int], before, beta, pairs: np.ndarray) -> np.ndarray:
        low, high = self.begin[part[0]], self.begin[part[1]]
        given = model.classes[:, self.seen[low:high]]
        alpha, scale = np.empty_like(given), np.empty(high - low, given.dtype)
        for t, (now, sums) in zip(range(*part), self.steps(model, part, before), strict=True):
            a = self.begin[t] - low
            alpha[:, a : a + len(sums)] = now
            scale[a : a + len(sums)] = sums
        # What a token and all after it add, seen from each state before it.
        given /= scale
        for t in range(part[1] - 1, part[0] - 1, -1):
            n, a = self.active[t], self.begin[t] - low
            own = alpha[:, a : a + n]
            ahead = given[:, a : a + n]
            if beta is not None:
                wide = beta.shape[1]
                own[:, :wide] *= beta
                ahead[:, :wide] *= beta
            if t:
                earlier = before if t == part[0] else alpha[:, self.begin[t - 1] - low : a]
                pairs += earlier[:, :n] @ ahead.T
                beta = model.after @ ahead
                if t % RESCALED == 0:
                    # What single precision loses does not add up over a long text.
                    beta /= np.add.reduce(earlier[:, :n] * beta, 0)
        if part[0] == 0:
            counts.first += alpha[:, : self.active[0]].sum(1)
        counts.logs += float(np.log10(scale, dtype=np.float64).sum())
        seen = self.seen[low:high].astype(np.int64)
        for state, own in enumerate(counts.classes):
            own += np.bincount(seen, alpha[state], len(own))
        return beta


def _lattices(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Lattices over sequences of about the same length, of HELD_TOKENS tokens, or more if they are long, and the sequence in each
    column."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    held: list[int] = []
    tokens = 0
    for k in order:
        if held and tokens + len(sequences[k]) > max(HELD_TOKENS, min(WIDE * len(sequences[held[0]]), WIDE_TOKENS)):
            lattice, columns = Lattice.of([sequences[j] for j in held])
            yield np.array(held)[columns], lattice
            held, tokens = [], 0
        held.append(int(k))
        tokens += len(sequences[k])
    if held:
        lattice, columns = Lattice.of([sequences[j] for j in held])
        yield np.array(held)[columns], lattice


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with a column `sequence`, several batches at a time until they have GATHERED_TOKENS tokens."""
    held, tokens = [], 0
    for batch in batches:
        held.append(batch)
        tokens += batch.column("sequence").nbytes // 2
        if tokens >= GATHERED_TOKENS:
            yield pa.Table.from_batches(held)
            held, tokens = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _numbers(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(s, "<u2") for s in column.to_pylist()]


def _by_length(sequences: DataFrame) -> DataFrame:
    """The column `sequence` of the rows, those of one length class together in groups of about GATHERED_TOKENS / 2 tokens: a step of a
    lattice costs the same for few texts as for many, and a task of its own would have few long ones. The driver learns the
    tokens of each class."""
    tokens = F.octet_length("sequence") / 2
    rows = sequences.select("sequence", F.floor(F.log2(tokens) * CLASSES_PER_OCTAVE).cast("int").alias("length"), F.monotonically_increasing_id().alias("row"))
    sizes = rows.groupBy("length").agg(F.sum(F.octet_length("sequence") / 2).alias("tokens")).collect()  # a few dozen
    if not sizes:
        return sequences.select("sequence")
    parts = {r.length: max(1, round(2 * r.tokens / GATHERED_TOKENS)) for r in sizes}
    of = F.create_map(*(F.lit(x) for p in parts.items() for x in p))
    part = F.pmod(F.col("row"), of[F.col("length")])
    return rows.repartition(2 * sum(parts.values()), "length", part).select("sequence")


def laid_out(sequences: DataFrame) -> DataFrame:
    """One row per lattice over the rows' sequences: seen and active. What every pass reads."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            for _, lattice in _lattices(_numbers(table.column("sequence"))):
                columns = [pa.array([x.tobytes()], pa.binary()) for x in (lattice.seen, lattice.active.astype("<i4"))]
                yield pa.RecordBatch.from_arrays(columns, names=["seen", "active"])

    return _by_length(sequences).mapInArrow(lay, "seen binary, active binary")


def expected_counts(lattices: DataFrame, model: Model) -> Counts:
    """One pass of Baum-Welch over all rows of `laid_out`: the counts of all partitions, added up. Values of tokens are single,
    sums are double. What comes to the driver has the size of the model."""
    states, classes = model.classes.shape

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, single = Counts.none(states, classes), model.single()
        for batch in batches:
            for seen, active in zip(batch.column("seen"), batch.column("active"), strict=True):
                lattice = Lattice(np.frombuffer(seen.as_buffer(), np.uint16), np.frombuffer(active.as_buffer(), "<i4"))
                lattice.count(single, counts)
        values = np.concatenate([counts.first, counts.after.ravel(), counts.classes.ravel(), [counts.logs]])
        some = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(values[some])], names=["entry", "value"])

    rows = lattices.mapInArrow(count, "entry long, value double")
    rows = rows.groupBy("entry").agg(F.sum("value").alias("value")).toPandas()
    values = np.zeros(states + states * states + states * classes + 1)
    values[rows["entry"].to_numpy(np.int64)] = rows["value"].to_numpy(float)
    first, after, own, logs = np.split(values, np.cumsum([states, states * states, states * classes]))
    return Counts(first, after.reshape(states, states), own.reshape(states, classes), float(logs[0]))


def learnt_from(lattices: DataFrame, shares: np.ndarray, states: int, tolerance: float) -> Model:
    """Baum-Welch from the seeded start. Every pass reads all rows of `laid_out`; the last adds at most `tolerance` to the log10
    probability of a token."""
    model, last, gain = Model.start(shares, states, SEED), -np.inf, np.inf
    while gain > tolerance:
        counts = expected_counts(lattices, model)
        model = Model.of_counts(counts, shares)
        now = counts.logs / max(counts.classes.sum(), 1.0)
        last, gain = now, now - last
    return model


def _frequent(words: DataFrame, most: int) -> list[bytes]:
    """The `most` words (word, n) with greatest n, of equal ones the smallest; no more come to the driver."""
    return [bytes(r.word) for r in words.orderBy(F.desc("n"), "word").limit(most).collect()]


def language_scores(
    docs: DataFrame, states: int = STATES, frequent: int = FREQUENT, endings: int = ENDINGS, tolerance: float = TOLERANCE,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32 of the id as text is not 0 modulo 10 (a null id counts as the empty text) and scores
    all. Tokens are words with A-Z in lower case and one end per text; null and empty texts have the end only. n_known
    counts tokens that training texts have. base_score is the log10 probability by word counts, `score` that of the
    hidden Markov model: the scaled forward recursion over the classes, plus each word's share of its class. Repeated
    rows are scored, and counted, each; an empty table gives no rows; other columns are not read.
    """
    tables = Tables(docs.sparkSession, "hmm")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (training_part(doc_id, 10) == 0).alias("held_out"), whole_text(text).cast("binary").alias("raw")
    )
    schema = "block long, doc_id long, held_out boolean, n_tokens long, sequence binary, word binary, number int, seen long"
    blocks = tables.write(rows.mapInArrow(_blocks, schema), "blocks")
    # A word's rows, one per block that has it, get the sum of their counts. Classes: 0 is the end, then the frequent words,
    # then the endings.
    by_word = Window.partitionBy("word")
    words = blocks.filter("word IS NOT NULL").select("block", "word", "number", "seen").select(
        F.col("block").alias("of"),
        "number",
        F.sum("seen").over(by_word).alias("n"),
        (F.col("block") == F.min("block").over(by_word)).alias("once"),
        "word",
        ((F.crc32(F.expr("substring(word, -3)")) % endings).cast("int") + 1 + frequent).alias("ending"),
    )
    known = (F.col("n") >= LEAST_FREQUENT) | (F.col("word") == F.lit(END))
    words = located = tables.write(words.withColumn("word", F.when(known, F.col("word"))), "words")
    candidates = words.filter(F.col("once") & F.col("word").isNotNull() & (F.col("word") != F.lit(END))).select("word", "n")
    top = _frequent(candidates, frequent)
    listed = docs.sparkSession.createDataFrame([(END, 0), *((w, k + 1) for k, w in enumerate(top))], "word binary, own int")
    words = words.join(F.broadcast(listed), "word", "left").withColumn("class", F.coalesce("own", "ending"))
    size = 1 + frequent + endings
    counted = words.filter("once").groupBy("class").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("words"))
    per_class = counted.toPandas()
    n_of, words_of = np.zeros(size), np.zeros(size)
    n_of[per_class["class"]], words_of[per_class["class"]] = per_class["n"], per_class["words"]
    total = float(n_of.sum())
    room = total + ADDED * (float(words_of.sum()) + 1)
    shares = (n_of + ADDED) / (n_of + ADDED).sum()
    shared = np.log10(n_of + ADDED * (words_of + 1))
    shared[: 1 + frequent] = np.nan  # a class of one word

    def number(texts: pa.Table, words: pa.Table) -> pa.Table:
        at = words.column("number").to_numpy()
        n, kind = np.zeros(len(at)), np.zeros(len(at), np.int64)
        n[at], kind[at] = words.column("n").to_numpy(), words.column("class").to_numpy()
        base = np.log10(n + ADDED)
        inside = np.where(np.isnan(shared[kind]), 0.0, base - shared[kind])
        base -= np.log10(room)
        kinds, found, known = kind.astype("<u2"), n > 0, []
        for packed, size in zip(texts.column("sequence"), texts.column("n_tokens").to_pylist(), strict=True):
            ids = np.frombuffer(pa.decompress(packed.as_py(), 4 * size, _CODEC, asbytes=True), "<i4")
            known.append((int(found[ids].sum()), float(base[ids].sum()), float(inside[ids].sum()), kinds[ids].tobytes()))
        columns = dict(zip(("n_known", "base_score", "inside", "sequence"), zip(*known, strict=True), strict=True))
        kept = {name: texts.column(name) for name in ("doc_id", "held_out", "n_tokens")}
        return pa.table({**kept, **columns})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, sequence binary"
    texts = blocks.filter("sequence IS NOT NULL").select("block", "doc_id", "held_out", "n_tokens", "sequence")
    of_block = words.select("of", "number", "n", "class").groupBy("of")
    sequences = tables.write(texts.groupBy("block").cogroup(of_block).applyInArrow(number, schema), "sequences")
    tables.drop(blocks)
    tables.drop(located)

    lattices = tables.write(laid_out(sequences.filter(~F.col("held_out"))), "lattices")
    model = learnt_from(lattices, shares, states, tolerance)
    tables.drop(lattices)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            values = np.zeros(table.num_rows)
            for rows, lattice in _lattices(_numbers(table.column("sequence"))):
                values[rows] = lattice.scores(model)
            values += table.column("inside").to_numpy()
            kept = table.select(["doc_id", "held_out", "n_tokens", "n_known", "base_score"])
            yield from kept.append_column("score", pa.array(values)).to_batches()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    rows = sequences.mapInArrow(score, schema).withColumn("train_tokens", F.lit(int(total)).cast("long"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
