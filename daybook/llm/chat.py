"""Chat formatting: reply trees are cut into root-to-leaf paths, branches ranked, each chosen path formatted."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.text import Tables

START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"


def escape(text: str) -> str:
    """`text` without any `<|`: a backslash goes between, and one more where backslashes stand between already."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def format_turns(turns: Sequence[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The conversation, and where the loss mask starts and ends: around each text of the assistant (code points, ends
    exclusive). A null role or text is empty."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role or '')}\n", escape(text or "")
        if role == LEARNT:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), starts, ends


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that `format_turns` has formatted."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, body = part.partition("\n")
        turns.append((_unescape_role(role), unescape(body.removesuffix(f"{END}\n"))))
    return turns


def reply_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """messages(id, parent, score) -> (path, root, rank, place, id): the `best` branches of each reply tree, one row per
    message on them. A path is named by its leaf; places count from 1 at the root.

    A branch's score is the sum of its messages' scores (null: 0); ties go to the smaller leaf id. A null or unknown
    parent makes a root, a row without id is left out, a repeated id counts once (its least parent and score).
    Messages whose parents form a circle, and replies to them, hang from no root and are on no path.

    Self-joins double the distance to the known ancestor in each round, so depth d takes log2(d) joins.
    """
    tables = Tables(messages.sparkSession, "replies")
    nodes = messages.filter("id IS NOT NULL").groupBy("id").agg(
        F.min(F.struct("parent", "score")).alias("m")
    ).select("id", "m.parent", F.coalesce("m.score", F.lit(0)).cast("double").alias("score"))
    known = nodes.select(F.col("id").alias("known"))
    # Rows without parent would all meet in one task of the join.
    replies = nodes.filter("parent IS NOT NULL").join(known, F.col("parent") == F.col("known"), "left")
    linked = replies.unionByName(nodes.filter("parent IS NULL").withColumn("known", F.col("parent")))
    state = linked.select("id", F.col("known").alias("ancestor"), F.col("id").alias("top"), "score", F.lit(1).cast("long").alias("place"))
    # What is known of a message: its 2^k-th ancestor, and of the messages below that one, itself included, the highest, the
    # sum of scores and the number. Without such an ancestor the message is done. Only the others are joined again.
    done, levels = [], []
    state = tables.write(state, "0")
    rounds = max(1, state.count()).bit_length()
    while True:
        done.append(state.filter("ancestor IS NULL"))
        level = state.filter("ancestor IS NOT NULL")
        if len(levels) > rounds or level.isEmpty():
            break
        levels.append(level)
        known = reduce(DataFrame.unionByName, done, level)
        high = known.select(*(F.col(c).alias(f"_{c}") for c in known.columns))
        joined = level.join(high, level["ancestor"] == high["_id"])
        state = joined.select(
            "id",
            F.col("_ancestor").alias("ancestor"),
            F.col("_top").alias("top"),
            (F.col("score") + F.col("_score")).alias("score"),
            (F.col("place") + F.col("_place")).alias("place"),
        )
        state = tables.write(state, f"{len(levels)}")
    whole = reduce(DataFrame.unionByName, done)
    inner = linked.filter("known IS NOT NULL").select(F.col("known").alias("id")).distinct()
    leaves = whole.join(inner, "id", "left_anti")
    order = Window.partitionBy("top").orderBy(F.desc("score"), "id")
    leaves = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    paths = leaves.select(F.col("id").alias("path"), F.col("top").alias("root"), "rank", "id")
    # Each distance from the leaf is one sum of powers of two, so every ancestor is reached once.
    for k in range(len(levels) - 1, -1, -1):
        up = levels[k].select("id", "ancestor")
        paths = tables.write(paths, f"paths{k}")
        paths = paths.unionByName(paths.join(up, "id").drop("id").withColumnRenamed("ancestor", "id"))
    return paths.join(whole.select("id", "place"), "id").select("path", "root", "rank", "place", "id")


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            turns = row.column("turns").to_pylist()[0]
            text, starts, ends = format_turns([(t["role"], t["text"]) for t in turns])
            yield pa.RecordBatch.from_arrays(
                [row.column("path"), row.column("tree"), pa.array([text]), pa.array([starts], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))],
                names=["path", "tree", "formatted", "loss_starts", "loss_ends"],
            )


def format_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """messages(tree, id, parent, score, role, text) -> one row per chosen path: path, tree, formatted, loss_starts,
    loss_ends. See `reply_paths` and `format_turns`. A conversation is one value, so its turns meet in one row. Null roles and
    texts are empty, texts are whole whatever their length; of rows with one id one counts; an empty table gives no rows; other
    columns are not read."""
    paths = reply_paths(messages.select("id", "parent", "score"), best)
    turns = messages.select("id", "tree", "role", "text").dropDuplicates(["id"])
    rows = paths.join(turns, "id")
    rows = rows.groupBy("path").agg(
        F.first("tree").alias("tree"), F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns")
    )
    kinds = dict(messages.dtypes)
    return rows.mapInArrow(
        _formatted, f"path {kinds['id']}, tree {kinds['tree']}, formatted string, loss_starts array<bigint>, loss_ends array<bigint>"
    )


def as_trees(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text), each row a reply to the one before it in its conversation, as messages. Rows of
    one turn follow each other by role and text, nulls first; null conv_ids form one conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "role", "text", F.row_number().over(order).alias("n"))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return rows.select(
        F.col("conv_id").alias("tree"),
        F.concat_ws(":", tree, "n").alias("id"),
        F.when(F.col("n") > 1, F.concat_ws(":", tree, F.col("n") - 1)).alias("parent"),
        F.length("text").alias("score"),
        "role",
        "text",
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        columns = (batch.column(n).to_pylist() for n in ("formatted", "loss_starts", "loss_ends"))
        for text, starts, ends in zip(*columns, strict=True):
            turns = read_turns(text)
            whole = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode())
            learnt = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
            rows.append((len(turns), whole.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), *columns], names=["conv_id", *DIGESTS])


DIGESTS = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, one row per row: conv_id (the tree, null included) and the columns of
    DIGESTS. A conversation without turns has counts of 0; an empty table gives no rows."""
    kind = dict(formatted.dtypes)["tree"]
    return formatted.mapInArrow(
        _digest, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
