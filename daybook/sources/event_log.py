"""The append-only event log as JSON lines and as a typed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions import jsonval as J
from daybook.operators.dedup import least_by
from daybook.operators.ordered import OrderedRows, total
from daybook.schema import FIELDS, LOG_COLUMNS, PAYLOADS, as_log
from daybook.session import present, stage


def _payload_ddl() -> str:
    fields = {}
    for key, kind in FIELDS.values():
        fields[key] = "string" if kind == "timestamp" else "double" if kind == "bigint" else kind
    return ",".join(f"`{k}`:{t}" for k, t in fields.items())


EVENT_JSON = (
    "array<struct<eventId:variant,ts:string,project:string,branch:string,sessionId:string,type:variant,"
    f"payload:struct<{_payload_ddl()}>>>"
)


def decode_events(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Log rows from JSON lines with ingest_seq (or with the columns to keep instead); blank or broken
    lines and lines without a textual event id and type are dropped."""
    beside = keep or ["ingest_seq"]
    J.accept_repeated_keys(lines.sparkSession)
    read = lines.selectExpr(*beside, f"from_json({J.listed(f'trim({line})')}, '{EVENT_JSON}') as _all")
    one = read.selectExpr(*beside, "if(size(_all) = 1, _all[0], null) as _e")
    event_id, kind = J.text("_e.eventId"), J.text("_e.type")
    named = one.selectExpr(*beside, "_e", f"named_struct('event_id', {event_id}, 'type', {kind}) as _id")
    known = F.expr("if(_id.event_id is not null and _id.type is not null, _id, null)")
    events = present(named.select(*beside, "_e", known.alias("_known")), F.col("_known"))
    values = {"string": "{}", "timestamp": "try_to_timestamp({})"}
    payload = [
        values.get(kind, "try_cast({} as " + kind + ")").format(f"_e.payload.{key}") + f" as {name}"
        for name, (key, kind) in FIELDS.items()
    ]
    head = ["try_to_timestamp(_e.ts) as ts", "_e.project", "_e.branch", "_e.sessionId as session_id"]
    rows = events.selectExpr("event_id", "type", *beside, *head, *payload)
    return rows if keep else as_log(rows)


def iso_text(ts: Column) -> Column:
    """UTC text with milliseconds and Z."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def encode_events(log: DataFrame, *keep: str) -> DataFrame:
    """One JSON line (column value) per log row, beside the columns to keep."""

    def payload(names: list[str]) -> Column:
        cols = []
        for name in names:
            key, kind = FIELDS[name]
            cols.append((iso_text(F.col(name)) if kind == "timestamp" else F.col(name)).alias(key))
        return F.to_json(F.struct(*cols))

    body = F.coalesce(
        *[F.when(F.col("type") == t, payload(names)) for t, names in PAYLOADS.items()], F.lit("{}")
    )
    head = F.to_json(
        F.struct(
            F.col("event_id").alias("eventId"),
            iso_text(F.col("ts")).alias("ts"),
            "project",
            "branch",
            F.col("session_id").alias("sessionId"),
            "type",
        )
    )
    line = F.concat(F.rtrim(head, F.lit("}")), F.lit(',"payload":'), body, F.lit("}"))
    return log.select(*keep, line.alias("value"))


# Where a line stands in the log: older files first, then by place in the file.
LOG_ORDER = ["_mtime", "_file", "_block", "_place"]


def placed_lines(raw: DataFrame) -> DataFrame:
    """Lines of a text scan with the file and block they stand in."""
    return raw.select(
        "value",
        F.col("_metadata.file_modification_time").alias("_mtime"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def decode_placed(lines: DataFrame, after: int = -1, chunks: int | None = None) -> DataFrame:
    """Log rows of `placed_lines` in a batch, numbered in log order from after + 1 on."""
    lines = lines.withColumn("_place", F.monotonically_increasing_id())
    rows = decode_events(lines, keep=LOG_ORDER).withColumn("_log", F.lit(0))
    numbered = OrderedRows(rows, ["_log"], LOG_ORDER, chunks, "log").carry(_n=total(F.lit(1).cast("bigint")))
    return as_log(numbered.withColumn("ingest_seq", F.col("_n") + F.lit(after + 1)))


def read_log(spark: SparkSession, path: str, chunks: int | None = None) -> DataFrame:
    """The log decoded and numbered in log order: older files first, then by place in the file."""
    raw = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    return decode_placed(placed_lines(raw), chunks=chunks)


def last_number(log: DataFrame) -> int:
    """The greatest ingest_seq, -1 without rows."""
    return log.agg(F.coalesce(F.max("ingest_seq"), F.lit(-1))).first()[0]


def numbered(rows: DataFrame, after: int | None = None) -> DataFrame:
    """Log rows of which those without ingest_seq get one, from after + 1 on (default: after the greatest there is), by
    time, type and id. For rows that the library makes itself, when they enter the log."""
    rows = as_log(rows)
    known, new = rows.where("ingest_seq IS NOT NULL"), rows.where("ingest_seq IS NULL")
    after = last_number(known) if after is None else after
    whole = F.xxhash64(*_comparable(rows, ()))
    new = new.withColumns({"_log": F.lit(0), "_whole": whole})
    ordered = OrderedRows(new, ["_log"], ["ts", "type", "event_id", "_whole"], label="numbered")
    placed = ordered.carry(_n=total(F.lit(1).cast("bigint")))
    return known.unionByName(as_log(placed.withColumn("ingest_seq", F.col("_n") + F.lit(after + 1))))


# Rows that Spark numbers in a partition at most, as a power of two.
PLACE_BITS = 33


def numbered_by_time(rows: DataFrame, first: int, room: int) -> DataFrame:
    """Log rows numbered anew by time, type and id, range-partitioned by these. Numbers begin at `first` and stay below first + room; they
    ascend without being dense, as each partition has a share of the room, so the rows are shuffled once and not staged."""
    rows = as_log(rows).drop("ingest_seq")
    by = ["ts", "type", "event_id", "_whole"]
    rows = rows.withColumn("_whole", F.xxhash64(*_comparable(rows, ())))
    spread = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    share = room >> int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length()
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    number = F.shiftright("_at", PLACE_BITS) * F.lit(share) + place
    fits = (place < share) & (number < room)
    return as_log(spread.withColumn("ingest_seq", F.when(fits, number + F.lit(first)).otherwise(F.raise_error(F.lit("too many rows for a batch")))))


def _comparable(log: DataFrame, without: tuple[str, ...]) -> list[str]:
    """Columns that can be hashed: maps cannot."""
    return [c for c in log.columns if c not in without and not LOG_COLUMNS.get(c, "").startswith("map")]


def append_events(log: DataFrame, path: str) -> None:
    encode_events(log).write.mode("append").text(path)


def first_per_event(log: DataFrame, stored: bool = False) -> DataFrame:
    """First row in log order per (type, event id); rows without a number come after those with one, and equal ones by
    their content. The first number of each event is found first, and its row looked up, so a group of copies of any size is never
    gathered nor sorted. The log is read several times: unless it is `stored` it is staged."""
    keys = ["type", "event_id"]
    rows = log if stored else stage(log, "log")
    numbered_rows, rest = rows.where("ingest_seq IS NOT NULL"), rows.where("ingest_seq IS NULL")
    first = least_by(numbered_rows, keys, F.col("ingest_seq")).select(*log.columns)
    # A stored table knows if all its rows have a number.
    if rest.select("ingest_seq").isEmpty():
        return first
    rest = rest.join(numbered_rows.select(*keys).distinct(), keys, "left_anti")
    wide = [c for c in log.columns if c not in keys]
    least = F.min_by(F.struct(*wide), F.xxhash64(*_comparable(log, ("type", "event_id"))))
    rest = rest.groupBy(*keys).agg(least.alias("_first")).select(*keys, "_first.*")
    return first.unionByName(rest.select(*log.columns))


def compact_log(log: DataFrame, compacted: DataFrame, snapshot_seq: Column | int) -> DataFrame:
    """The compacted rows plus every row appended after the snapshot they were made from."""
    tail = log.where(F.col("ingest_seq") > snapshot_seq)
    return as_log(compacted).unionByName(as_log(tail))
