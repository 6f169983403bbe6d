"""Line dedup by winnowing: later repeats of long runs of lines are deleted.

A window is the shortest run of lines from a line on with at least `least` words. Of each window the line with the
smallest hash is its fingerprint, so two texts that share a run of that many words share a fingerprint. Only windows
whose fingerprint occurs at several places are compared further. Matches are then extended both ways: a run is covered
by the windows that begin in it and by those that end in it, and each of these is looked up by its whole line sequence.
A sequence is compared with its first occurrence only, never pairwise, which finds the same lines: any run that stood
anywhere earlier is made of windows that stood earlier.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import Tables, whole_text

LEAST_WORDS = 50


def lines_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with a word: place among all lines, hash, number of words. White space around a line is ignored."""
    places, hashes, sizes = [], [], []
    for place, line in enumerate(raw.split(b"\n")):
        if n := len(line.split()):
            places.append(place)
            hashes.append(xxhash.xxh3_64_intdigest(line.strip()))
            sizes.append(n)
    return np.array(places, np.int64), np.array(hashes, np.uint64), np.array(sizes, np.int64)


def windows_of(raw: bytes, least: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(first line, last line, fingerprint, its line, sequence) of each window of a text, those that begin at a line and
    those that end at one; lines are places among all lines."""
    places, hashes, sizes = lines_of(raw)
    n = len(places)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    # ends[i]: the last line of the shortest window from i on; n if the text ends before.
    ends = np.searchsorted(upto, upto[:-1] + least) - 1
    starts = np.searchsorted(upto, upto[1:] - least, "right") - 1
    marks: dict[int, tuple[int, int]] = {}
    made: set[tuple[int, int]] = set()
    runs = [(i, int(e)) for i, e in enumerate(ends) if e < n]
    runs += [(int(b), j) for j, b in enumerate(starts) if b >= 0]
    for i, j in runs:
        if (i, j) in made:
            continue
        made.add((i, j))
        if i not in marks:
            at = i + int(hashes[i : ends[i] + 1].argmin())
            marks[i] = int(hashes[at].astype(np.int64)), int(places[at])
        yield int(places[i]), int(places[j]), *marks[i], blake2b(hashes[i : j + 1].tobytes(), digest_size=16).digest()


def _key(doc_id: str, whole: Column) -> Column:
    return F.concat_ws(":", F.col(doc_id).cast("string"), F.xxhash64(whole).cast("string"))


def repeated_windows(docs: DataFrame, least: int = LEAST_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(key, first, last) of the windows that stand earlier too, by id (null last), then by place in the text."""
    tables = Tables(docs.sparkSession, "lines")
    whole = whole_text(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _key(doc_id, whole).alias("key"), whole.cast("binary").alias("raw"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, owners = [], []
                for k, raw in enumerate(part.column("raw").to_pylist()):
                    own = list(windows_of(raw, least))
                    found += own
                    owners += [k] * len(own)
                first, last, mark, marked, sequence = zip(*found, strict=True) if found else ((),) * 5
                picked = part.select(["doc_id", "key"]).take(pa.array(owners, pa.int64()))
                columns = [pa.array(x, pa.int32()) for x in (first, last, marked)]
                columns += [pa.array(mark, pa.int64()), pa.array(sequence, pa.binary())]
                names = ["doc_id", "key", "first", "last", "marked", "mark", "sequence"]
                yield pa.RecordBatch.from_arrays([*picked.columns, *columns], names=names)

    windows = rows.mapInArrow(cut, "doc_id long, key string, first int, last int, marked int, mark long, sequence binary")
    # Where a line stands, as one number: id, then a part of the key (ids may repeat), then the line.
    large = F.lit("9223372036854775808").cast("decimal(20,0)")
    by_id = F.coalesce(F.col("doc_id").cast("decimal(20,0)") + large, F.lit("18446744073709551616").cast("decimal(20,0)"))
    tie = F.pmod(F.xxhash64("key"), F.lit(100_000)).cast("decimal(5,0)")
    text_stands = by_id * F.lit(10**15).cast("decimal(16,0)") + tie * F.lit(10**10).cast("decimal(11,0)")
    stands = (text_stands + F.col("first")).cast("decimal(38,0)")
    marked = (text_stands + F.col("marked")).cast("decimal(38,0)")
    windows = windows.select("key", "first", "last", "mark", "sequence", stands.alias("stands"), marked.alias("marked"))
    windows = tables.write(windows, "windows")
    # What is joined is staged first: adaptive execution can then split a line that very many texts share.
    marks = windows.groupBy("mark").agg(F.min("marked").alias("a"), F.max("marked").alias("b")).filter("a < b").select("mark")
    marks = tables.write(marks, "marks")
    again = tables.write(windows.join(marks, "mark", "left_semi").select("key", "first", "last", "sequence", "stands"), "again")
    tables.drop(windows)
    tables.drop(marks)
    origin = again.groupBy("sequence").agg(F.min("stands").alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    origin = tables.write(origin, "origins")
    return again.join(origin, "sequence").filter("stands > origin").select("key", "first", "last")


def deduplicated(docs: DataFrame, least: int = LEAST_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, text (without later repeats), n_lines, n_deleted, n_words_deleted, deleted
    (first-last of each deleted run, lines counted from 0, ends included; comma-joined).

    Every line with a word is deleted if it lies in a run of lines with at least `least` words that stands earlier as a
    whole: in a document with a smaller id (null ids come last), or earlier in the same text; the runs may overlap.
    Lines are equal when equal but for white space around them. Lines without words do not interrupt a run; those inside
    a deleted run go with it. Null texts are empty and stay so; repeated rows get the same result, as one document;
    an empty table gives no rows; other columns are not read.
    """
    found = repeated_windows(docs, least, text, doc_id)
    found = found.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    whole = whole_text(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), _key(doc_id, whole).alias("key"), whole.alias("text"))
    rows = rows.join(found, "key", "left").select("doc_id", "text", "runs")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_without, f"doc_id {kind}, text string, n_lines long, n_deleted long, n_words_deleted long, deleted string")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                lines = text.split("\n")
                joined: list[list[int]] = []
                for run in sorted((r["first"], r["last"]) for r in runs or ()):
                    if joined and run[0] <= joined[-1][1] + 1:
                        joined[-1][1] = max(joined[-1][1], run[1])
                    else:
                        joined.append(list(run))
                gone = {k for a, b in joined for k in range(a, b + 1)}
                left = "\n".join(line for k, line in enumerate(lines) if k not in gone) if gone else text
                words = sum(len(lines[k].encode().split()) for k in gone)
                rows.append((left, len(lines), len(gone), words, ",".join(f"{a}-{b}" for a, b in joined)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            names = ["doc_id", "text", "n_lines", "n_deleted", "n_words_deleted", "deleted"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=names)
