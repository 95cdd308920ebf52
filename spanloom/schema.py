"""Row shapes shared by all jobs."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()

ID_COLUMNS = [
    "trace_id",
    "request_id",
    "xray_id",
    "message_id",
    "agent_session_id",
    "thread_id",
    "session_id",
]

# One normalised boundary event. `request`, `response` and `error` hold JSON text,
# `seq` is the position of the line in its source.
SPAN_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("span_id", _S, False),
        T.StructField("parent_span_id", _S),
        T.StructField("component", _S, False),
        T.StructField("operation", _S, False),
        T.StructField("ts_start", _S),
        T.StructField("ts_end", _S),
        T.StructField("attempt", T.IntegerType()),
        *[T.StructField(name, _S) for name in ID_COLUMNS],
        T.StructField("request", _S),
        T.StructField("response", _S),
        T.StructField("error", _S),
        T.StructField("is_async", T.BooleanType()),
        T.StructField("is_one_way", T.BooleanType()),
    ]
)

SPAN_COLUMNS = [f.name for f in SPAN_SCHEMA.fields]

# Names a span file uses for the columns above, where they differ.
SPAN_FILE_NAMES = {
    "request_id": "lambda_request_id",
    "xray_id": "xray_trace_id",
    "message_id": "sqs_message_id",
    "agent_session_id": "bedrock_session_id",
}

JSON_MAP = T.MapType(_S, _S)

TRACE_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("sessionId", _S),
        T.StructField("traceId", _S),
        T.StructField("event", _S),
        T.StructField("eventTime", _S),
        T.StructField("timestamp", _S),
        T.StructField(
            "trace",
            T.StructType(
                [
                    T.StructField(
                        "orchestrationTrace",
                        T.StructType(
                            [
                                T.StructField("modelInvocationInput", _S),
                                T.StructField("modelInvocationOutput", _S),
                                T.StructField("invocationInput", _S),
                                T.StructField("observation", _S),
                                T.StructField("rationale", _S),
                            ]
                        ),
                    )
                ]
            ),
        ),
    ]
)
