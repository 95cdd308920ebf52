"""Reading logs, spans and agent traces from files and tables."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.values import first_truthy, parse_time, with_times
from spanloom.operators.normalise import RUNTIME_LINE_IN_FILE, is_json, json_map, normalise_records
from spanloom.schema import SPAN_COLUMNS, SPAN_FILE_NAMES, TRACE_EVENT_SCHEMA
from spanloom.sources.arrays import array_elements
from spanloom.sources.positions import numbered_lines


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(seq, file, number, line) of all non-blank lines.

    `number` is the line's number in its file and `seq` its place over all files, in the
    order of their paths (blank lines count); both are the same into however many
    blocks the files are cut.
    """
    lines = numbered_lines(spark, path).withColumn("line", F.trim("value"))
    return lines.filter(F.col("line") != "").select("seq", "file", "number", "line")


def scan_log_lines(lines: DataFrame) -> DataFrame:
    """Lenient scan: (seq, timestamp, message, json). Objects with a message are kept,
    others become the message themselves; text lines are wrapped."""
    record = json_map(F.col("line"))
    valid = F.coalesce(is_json(F.col("line")), F.lit(False)) & record.isNotNull()
    has_message = valid & F.map_contains_key(record, "message")
    wrapped = F.to_json(
        F.struct(
            F.col("line").alias("message"),
            F.when(valid, F.coalesce(record["timestamp"], F.lit(""))).otherwise("").alias("timestamp"),
        )
    )
    return lines.select(
        "seq",
        F.when(has_message, record["timestamp"])
        .when(valid, F.coalesce(record["timestamp"], F.lit("")))
        .otherwise("")
        .alias("timestamp"),
        F.when(has_message, record["message"]).otherwise(F.col("line")).alias("message"),
        F.when(has_message, F.col("line")).otherwise(wrapped).alias("json"),
    )


def _first_characters(spark: SparkSession, path: str) -> dict[str, str]:
    """First non-blank character of each file, read through the Hadoop file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    # The content column is pruned: this only lists files.
    for row in spark.read.format("binaryFile").load(path).select("path").toLocalIterator():
        name = row["path"]
        where = hadoop(name)
        stream = where.getFileSystem(conf).open(where)
        try:
            byte = stream.read()
            while byte in (9, 10, 13, 32):
                byte = stream.read()
            out[name] = chr(byte) if byte >= 0 else ""
        finally:
            stream.close()
    return out


def scan_json_records(spark: SparkSession, path: str, form: str = "auto") -> DataFrame:
    """(seq, json) out of files that hold a JSON array or JSON lines.

    `lines` and `array` state the form. `auto` looks at the first character of each
    file, on the driver, which suits up to some thousand files. Array elements and
    lines that are no object are dropped. Lines are numbered on from file to file in
    the order of the paths, then array elements; see `array_elements`.
    """
    if form == "auto":
        firsts = _first_characters(spark, path)
        arrays = [f for f, c in firsts.items() if c == "["]
        lines = [f for f, c in firsts.items() if c != "["]
    else:
        arrays, lines = ([path], []) if form == "array" else ([], [path])
    parts = []
    if lines:
        rows = read_lines(spark, lines)
        parts.append(
            rows.filter(json_map(F.col("line")).isNotNull() & is_json(F.col("line"))).select(
                "seq", F.col("line").alias("json")
            )
        )
    if arrays:
        items = array_elements(spark, arrays).filter(json_map(F.col("json")).isNotNull())
        # After all lines.
        parts.append(items.select((F.lit(1 << 61) + F.col("seq")).alias("seq"), "json"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _span_column(record: Column, name: str, house_prefix: str | None) -> Column:
    names = [SPAN_FILE_NAMES.get(name, name), name]
    if name == "trace_id" and house_prefix:
        names.insert(0, f"{house_prefix}_trace_id")
    return F.coalesce(*[record[n] for n in dict.fromkeys(names)])


def spans_from_records(records: DataFrame, house_prefix: str | None = None, strict: bool = False) -> DataFrame:
    """Canonical spans out of (seq, json). A missing required field fails the job;
    with `strict` so does a field no span has."""
    rec = json_map(F.col("json"))
    known = set(SPAN_COLUMNS) | set(SPAN_FILE_NAMES.values())
    if house_prefix:
        known.add(f"{house_prefix}_trace_id")
    base = records.select("seq", rec.alias("rec"), "json")
    required = F.lit(True)
    for name in ("span_id", "component", "operation"):
        required = required & F.coalesce(F.map_contains_key("rec", name), F.lit(False))
    checked = F.when(~required, F.raise_error(F.concat(F.lit("span without a required field: "), F.col("json"))))
    if strict:
        extra = F.array_except(F.map_keys("rec"), F.array(*[F.lit(k) for k in sorted(known)]))
        checked = checked.when(
            F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown span field: "), F.array_join(extra, ",")))
        )
    # The check is part of a column that every reader needs, so that it cannot be pruned.
    rec_ok = F.coalesce(checked.cast("map<string,string>"), F.col("rec"))
    base = base.select("seq", rec_ok.alias("rec"))
    columns = []
    for name in SPAN_COLUMNS:
        if name == "seq":
            columns.append(F.col("seq"))
            continue
        value = _span_column(F.col("rec"), name, house_prefix)
        if name == "attempt":
            value = value.try_cast("int")
        elif name in ("is_async", "is_one_way"):
            value = F.coalesce(value.try_cast("boolean"), F.lit(False))
        columns.append(value.alias(name))
    return with_times(base.select(*columns))


def read_spans(spark: SparkSession, path: str, house_prefix: str | None = None, strict: bool = False) -> DataFrame:
    """Canonical span file (JSON lines)."""
    lines = read_lines(spark, path)
    return spans_from_records(lines.select("seq", F.col("line").alias("json")), house_prefix, strict)


def read_varied_spans(spark: SparkSession, path: str, house_prefix: str | None = None) -> DataFrame:
    """JSON lines with any of the known field names; other lines are skipped."""
    lines = read_lines(spark, path).filter(is_json(F.col("line")) & json_map(F.col("line")).isNotNull())
    return normalise_records(lines.select("seq", F.col("line").alias("json")), house_prefix)


def varied_counters(lines: DataFrame, house_prefix: str | None = None) -> DataFrame:
    """One row for a file of varied lines: total, json_errors, unexpected (errors that
    are no runtime lines), skipped, spans."""
    good = F.coalesce(is_json(F.col("line")) & json_map(F.col("line")).isNotNull(), F.lit(False))
    head = lines.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~good).alias("json_errors"),
        F.count_if(~good & ~F.col("line").rlike(RUNTIME_LINE_IN_FILE)).alias("unexpected"),
    ).withColumn("_one", F.lit(1))
    spans = (
        normalise_records(lines.filter(good).select("seq", F.col("line").alias("json")), house_prefix)
        .agg(F.count(F.lit(1)).alias("spans"))
        .withColumn("_one", F.lit(1))
    )
    return head.join(spans, "_one").select(
        "total", "json_errors", "unexpected",
        (F.col("total") - F.col("json_errors") - F.col("spans")).alias("skipped"), "spans",
    )


def read_agent_trace(spark: SparkSession, path: str) -> DataFrame:
    """(seq, session_id, trace_id, event, time_text, at, trace) of agent trace lines."""
    lines = read_lines(spark, path)
    return scan_agent_trace(lines)


def scan_agent_trace(lines: DataFrame) -> DataFrame:
    e = F.from_json("line", TRACE_EVENT_SCHEMA)
    stamp = F.coalesce(first_truthy(F.col("e.eventTime")), F.col("e.timestamp"), F.lit(""))
    return lines.select("seq", e.alias("e")).select(
        "seq",
        F.coalesce("e.sessionId", F.lit("")).alias("session_id"),
        F.coalesce("e.traceId", F.lit("")).alias("trace_id"),
        F.coalesce("e.event", F.lit("unknown")).alias("event"),
        stamp.alias("time_text"),
        parse_time(stamp).alias("at"),
        F.col("e.trace").alias("trace"),
    )


# --- windows and id filters over a table of events or spans ---

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def parse_since(text: str) -> timedelta:
    """`30m`, `24h`, `7d`, `15s`."""
    found = re.fullmatch(r"(\d+)([hdms])", text.lower())
    if not found:
        raise ValueError(f"not a duration like 30m, 24h or 7d: {text}")
    return timedelta(**{_UNITS[found.group(2)]: int(found.group(1))})


def relative_window(now: datetime, since: str, until: str | None = None) -> tuple[datetime, datetime]:
    """[now - since, now - until]."""
    return now - parse_since(since), now - (parse_since(until) if until else timedelta())


def padded(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """The window around one run: five seconds before, ten after."""
    return start - timedelta(seconds=5), end + timedelta(seconds=10)


def window_scan(
    tables: list[DataFrame],
    start: datetime,
    end: datetime,
    at: str = "logged_at",
    tie: str = "seq",
    limit: int | None = None,
) -> DataFrame:
    """Union of tables between two times, oldest first, optionally the first `limit`.

    The bounds are literals on the time column, so they reach the Parquet scan (and
    prune partitions where the table is partitioned by it).
    """
    picked = None
    for t in tables:
        part = t.filter(F.col(at).between(F.lit(start), F.lit(end)))
        picked = part if picked is None else picked.unionByName(part)
    ordered = picked.orderBy(at, tie)
    return ordered.limit(limit) if limit else ordered


def spans_by_id(
    spans: DataFrame,
    trace_ids: list[str] | DataFrame | None = None,
    request_ids: list[str] | DataFrame | None = None,
    session_ids: list[str] | DataFrame | None = None,
    also: Column | None = None,
) -> DataFrame:
    """Spans carrying any of the ids (session ids are agent session ids), by time.

    Ids become a table with one row each, whose join marks the rows themselves; how
    it is joined is left to Spark.
    """
    wanted = {"trace_id": trace_ids, "request_id": request_ids, "agent_session_id": session_ids}
    columns = spans.columns
    marks = []
    for c, ids in wanted.items():
        if ids is None:
            continue
        if not isinstance(ids, DataFrame):
            ids = spans.sparkSession.createDataFrame([(i,) for i in ids], f"{c} string")
        marks.append(f"_with_{c}")
        ids = ids.select(F.col(ids.columns[0]).alias(c)).distinct().withColumn(marks[-1], F.lit(True))
        spans = spans.join(ids, c, "left")
    if marks:
        spans = spans.filter(F.coalesce(*marks, F.lit(False))).select(*columns)
    if also is not None:
        spans = spans.filter(also)
    return spans.orderBy(F.col("start_at").asc_nulls_last(), "seq")


def search_spans(spans: DataFrame, text: str, fuzzy: int | None = None) -> DataFrame:
    """Spans whose operation, component or id contains a text, ignoring case; with
    `fuzzy`, names within that edit distance count too."""
    return spans.filter(_found(["operation", "component", "span_id"], text, fuzzy))


def search_rows(rows: DataFrame, text: str, columns: list[str], fuzzy: int | None = None, sort: str | None = None, ascending: bool = True) -> DataFrame:
    """Rows of any table (cases, iterations, executions) found by a text in `columns`,
    sorted by a column if one is given; nulls come last, ties by `columns`."""
    found = rows.filter(_found(columns, text, fuzzy))
    if sort is None:
        return found
    first = F.col(sort).asc_nulls_last() if ascending else F.col(sort).desc_nulls_last()
    return found.orderBy(first, *columns)


def _found(columns: list[str], text: str, fuzzy: int | None) -> Column:
    low = text.lower()
    match = F.lit(False)
    for c in columns:
        name = F.lower(F.col(c).cast("string"))
        match = match | F.contains(name, F.lit(low))
        if fuzzy is not None:
            match = match | _within(name, low, fuzzy)
    return match


def _within(name: Column, text: str, most: int) -> Column:
    """Edit distance of at most `most`, computed only for names that can be so near: each
    edit changes the length by one at most and spoils two pairs of letters at most."""
    pairs = sorted({text[i : i + 2] for i in range(len(text) - 1)})
    near = F.abs(F.length(name) - len(text)) <= most
    if len(pairs) > 2 * most:
        # Equal pairs of the text count once; an edit spoils each place of them apart.
        shared = sum((F.contains(name, F.lit(p)).cast("int") for p in pairs), F.lit(0))
        near = near & (shared >= len(pairs) - 2 * most)
    return near & (F.levenshtein(name, F.lit(text), most) >= 0)


def filter_spans(spans: DataFrame, kind: str) -> DataFrame:
    """`errors`, `retries`, or all."""
    if kind == "errors":
        return spans.filter(F.col("error").isNotNull())
    if kind == "retries":
        return spans.filter(F.col("attempt") > 1)
    return spans


