"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting with shallow trees learns one lookup table per feature and one per chosen pair of features. A score is
the sum of table entries, read for all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import training_part, whole_text

# At most so many labelled rows are learnt from, those with the least hash of the id.
TRAINING_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 60
PAIR_ROUNDS = 30
PAIRS = 6
RATE = 0.2
PENALTY = 1.0
SEED = 6

FEATURES = (
    "words", "word_length", "short_words", "long_words", "distinct", "adjacent", "upper", "digits", "symbols", "bars",
    "shouts", "stops", "commas", "capitals", "lines", "dup_lines", "line_words", "not_ascii", "longest",
)
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&<>@~^=_{}[]\\/", bytes(range(65, 91)), b"0123456789"
_HIGH = bytes(range(128, 256))


def features_of(raw: bytes) -> tuple[float, ...]:
    """The values of FEATURES of one text in UTF-8; all are 0 without words."""
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    sizes = np.fromiter(map(len, words), np.int64, n)
    size = int(sizes.sum())
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    return (
        np.log1p(n),
        size / n,
        np.count_nonzero(sizes <= 3) / n,
        np.count_nonzero(sizes > 12) / n,
        len(set(words)) / n**0.9,
        sum(map(eq, words, words[1:])) / n,
        share(_UPPER),
        share(_DIGITS),
        share(_SYMBOLS),
        share(b"|"),
        share(b"!?"),
        share(b"."),
        share(b",;"),
        sum(map(bytes.istitle, words)) / n,
        np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        share(_HIGH),
        np.log1p(sizes.max()),
    )


def features(raws: list[bytes | None]) -> np.ndarray:
    return np.array([features_of(raw or b"") for raw in raws], float).reshape(len(raws), len(FEATURES))


@dataclass
class AdditiveModel:
    """Bin edges per feature, a lookup table per feature, and coarse tables for pairs of features."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    intercept: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]
        total = np.full(len(x), self.intercept)
        for table, b in zip(self.tables, bins, strict=True):
            total += table[b]
        for (i, j), table in self.pairs.items():
            total += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-total))


def _cuts(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The step of a shallow tree over ordered bins with sums of gradients g and second derivatives h: per bin the
    value of its leaf. The best cut is taken until there are so many leaves."""
    gain = lambda a, b: a * a / (b + PENALTY)
    bounds = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(bounds) <= leaves:
        found = (1e-9, None)
        for a, b in zip(bounds, bounds[1:]):
            at = np.arange(a + 1, b)
            if len(at):
                left, right = gain(cg[at] - cg[a], ch[at] - ch[a]), gain(cg[b] - cg[at], ch[b] - ch[at])
                better = left + right - gain(cg[b] - cg[a], ch[b] - ch[a])
                k = int(np.argmax(better))
                found = max(found, (float(better[k]), int(at[k])), key=lambda x: x[0])
        if found[1] is None:
            break
        bounds = sorted([*bounds, found[1]])
    step = np.zeros(len(g))
    for a, b in zip(bounds, bounds[1:]):
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + PENALTY)
    return step


def _pair_step(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The step of a tree that cuts one axis, then the other on each side; and what it gains."""
    best, most = np.zeros_like(g), 0.0
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            step = np.zeros_like(a)
            for part in (slice(None, cut), slice(cut, None)):
                step[part] = _cuts(a[part].sum(0), b[part].sum(0), 2)
            gain = float((step * a).sum() - 0.5 * (step * step * b).sum())
            if gain > most:
                best, most = (step.T if turned else step), gain
    return best, most


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Learn from rows x with labels y (0 or 1). Without rows every score is 0.5, with one label it is near that one."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    coarse = [(np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1)) for e in edges]
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges], coarse)
    if not len(y):
        return model
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for table, b in zip(model.tables, bins, strict=True):
            g, h = (np.bincount(b, s, len(table)) for s in slopes())
            step = RATE * _cuts(g, h, 3)
            table += step
            total += step[b]
    cells = {p: coarse[p[0]][bins[p[0]]] * PAIR_BINS + coarse[p[1]][bins[p[1]]] for p in combinations(range(len(edges)), 2)}
    grid = lambda p: [np.bincount(cells[p], s, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for s in slopes()]
    gains = {p: _pair_step(*grid(p))[1] for p in cells}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pairs = {p: np.zeros((PAIR_BINS, PAIR_BINS)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for p, table in model.pairs.items():
            step = RATE * _pair_step(*grid(p))[0]
            table += step
            total += step.ravel()[cells[p]]
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [pa.array(c) for c in features(batch.column("raw").to_pylist()).T]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *values], names=["doc_id", "quality", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> AdditiveModel:
    """Learn labels.quality from the texts of `docs`, from at most `rows` labels whose id's crc32 is not 1 modulo 3.
    Labels without id or quality, or without a document, are left out; a repeated id counts as often as it stands. Where ids stand on
    so many documents that there are more than `rows` of them, those with the least hash of their values are taken."""
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(training_part("doc_id", 3) != 1)
    chosen = chosen.select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "quality").limit(rows)
    texts = docs.select(F.col("doc_id").alias("doc_id"), whole_text().cast("binary").alias("raw"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "raw")
    schema = "doc_id bigint, quality int, " + ", ".join(f"{n} double" for n in FEATURES)
    values = joined.mapInArrow(_feature_rows, schema)
    columns = ["doc_id", "quality", *FEATURES]
    known = values.orderBy(F.xxhash64(F.lit(SEED), *columns), *columns).limit(rows).toPandas().sort_values(columns)
    return fit(known[list(FEATURES)].to_numpy(float), (known["quality"].to_numpy() > 0).astype(float))


def scored(docs: DataFrame, model: AdditiveModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted. Null texts are empty; an empty table gives no
    rows; other columns are not read."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.score(features(batch.column("raw").to_pylist()))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(values), pa.array((values >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (training_part(doc_id, 3) == 1).alias("held_out"), whole_text(text).cast("binary").alias("raw")
    )
    return rows.mapInArrow(score, rows.drop("raw").schema.add("score", "double").add("predicted", "integer"))


def accepted(docs: DataFrame, model: AdditiveModel, text: str = "text") -> DataFrame:
    """The rows of `docs` that the model does not reject, with all their columns."""
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(place).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(model.score(features(raws)) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
