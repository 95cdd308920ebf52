"""Agent trace events: pairing inputs with outputs, spans, and enriching log spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.values import truthy
from spanloom.operators.ordering import rank_within
from spanloom.session import checkpoint, stored

PAIRS = {"model": ("model_in", "model_out"), "action": ("action_in", "action_out")}


def classify_events(events: DataFrame) -> DataFrame:
    """Raw agent events (see `sources.logs.scan_agent_trace`) to (seq, session_id,
    trace_id, at, kind, action_group, payload). Each event counts as the first kind
    that fits."""
    orch = F.col("trace.orchestrationTrace")
    inv, obs = orch["invocationInput"], orch["observation"]

    def field(js: Column, path: str) -> Column:
        return F.get_json_object(js, "$." + path)

    is_action = field(inv, "invocationType") == "ACTION_GROUP"
    is_result = field(obs, "type") == "ACTION_GROUP"
    kind = (
        F.when(orch["modelInvocationInput"].isNotNull(), "model_in")
        .when(orch["modelInvocationOutput"].isNotNull(), "model_out")
        .when(inv.isNotNull(), F.when(is_action, "action_in"))
        .when(obs.isNotNull(), F.when(is_result, "action_out"))
        .when(orch["rationale"].isNotNull(), "rationale")
    )
    action_input = field(inv, "actionGroupInvocationInput")
    model = orch["modelInvocationInput"]
    payload = (
        F.when(kind == "model_in", F.to_json(F.struct(
            field(model, "text").alias("text"),
            field(model, "inferenceConfiguration").alias("inferenceConfiguration"),
            field(model, "type").alias("type"))))
        .when(kind == "model_out", F.to_json(F.struct(
            field(orch["modelInvocationOutput"], "parsedResponse").alias("parsedResponse"))))
        .when(kind == "action_in", F.to_json(F.struct(
            F.coalesce(field(action_input, "actionGroupName"), F.lit("unknown")).alias("actionGroupName"),
            field(action_input, "apiPath").alias("apiPath"),
            field(action_input, "verb").alias("verb"),
            field(action_input, "requestBody").alias("requestBody"))))
        .when(kind == "action_out", F.to_json(F.struct(
            field(field(obs, "actionGroupInvocationOutput"), "text").alias("text"))))
        .when(kind == "rationale", F.to_json(F.struct(field(orch["rationale"], "text").alias("reasoning"))))
    )
    return events.select(
        "seq", "session_id", "trace_id", "at",
        kind.alias("kind"),
        F.when(kind == "action_in", F.coalesce(field(action_input, "actionGroupName"), F.lit("unknown"))).alias("action_group"),
        payload.alias("payload"),
    )


def event_pairs(events: DataFrame) -> DataFrame:
    """(session, call, opened and closed event): an output belongs to the input of
    its kind right before it, among inputs and outputs of that kind."""
    call = F.when(F.col("kind").isin(*PAIRS["model"]), "model").when(
        F.col("kind").isin(*PAIRS["action"]), "action"
    )
    ends = events.withColumn("call", call).filter("call is not null")
    ranked = rank_within(
        ends,
        ["session_id", "call"],
        # Events without a readable time come first.
        [F.col("at"), F.col("seq")],
        previous=["kind", "seq", "at", "action_group", "payload"],
    )
    return ranked.filter(F.endswith("kind", F.lit("_out")) & F.endswith(F.col("prev.kind"), F.lit("_in"))).select(
        "session_id",
        "call",
        F.col("prev.seq").alias("in_seq"),
        F.col("seq").alias("out_seq"),
        F.col("prev.at").alias("opened_at"),
        F.col("at").alias("closed_at"),
        F.col("prev.action_group").alias("action_group"),
        F.col("prev.payload").alias("request"),
        F.col("payload").alias("response"),
    )


def agent_spans(events: DataFrame) -> DataFrame:
    """Spans of each session: the orchestrator, its calls and its rationales.

    Children are numbered by one counter across kinds, in order of their last event.
    """
    pairs = event_pairs(events).select(
        F.col("out_seq").alias("seq"),
        "session_id",
        F.col("call").alias("kind"),
        F.when(F.col("call") == "model", "agent:bedrock-model")
        .otherwise(F.concat(F.lit("lambda:"), "action_group")).alias("component"),
        F.when(F.col("call") == "model", "InvokeModel").otherwise("InvokeActionGroup").alias("operation"),
        F.col("opened_at").alias("start_at"),
        F.col("closed_at").alias("end_at"),
        "request",
        "response",
        F.col("closed_at").alias("_at"),
    )
    rationales = events.filter(F.col("kind") == "rationale").select(
        "seq", "session_id", "kind",
        F.lit("agent:bedrock-rationale").alias("component"),
        F.lit("Rationale").alias("operation"),
        F.col("at").alias("start_at"),
        F.lit(None).cast("timestamp").alias("end_at"),
        F.col("payload").alias("request"),
        F.lit(None).cast("string").alias("response"),
        F.col("at").alias("_at"),
    )
    children = rank_within(
        pairs.unionByName(rationales),
        ["session_id"],
        [F.col("_at"), F.col("seq")],
    ).select(
        "seq", "session_id",
        F.concat(F.lit("bedrock-"), "kind", F.lit("-"), F.lpad(F.col("pos").cast("string"), 3, "0")).alias("span_id"),
        F.lit("bedrock-orchestrator-000").alias("parent_span_id"),
        "component", "operation", "start_at", "end_at", "request", "response",
    )
    roots = events.groupBy("session_id").agg(
        F.min("seq").alias("seq"),
        F.min("at").alias("start_at"),
        F.max("at").alias("end_at"),
        F.min_by("trace_id", F.struct("at", "seq")).alias("_trace"),
    ).select(
        "seq", "session_id",
        F.lit("bedrock-orchestrator-000").alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.lit("agent:bedrock-orchestrator").alias("component"),
        F.lit("InvokeAgent").alias("operation"),
        "start_at", "end_at",
        F.to_json(F.struct("session_id")).alias("request"),
        F.to_json(F.struct(F.col("_trace").alias("trace_id"))).alias("response"),
    )
    return roots.unionByName(children).withColumn("agent_session_id", F.col("session_id"))


def _operation_class() -> Column:
    # Two operations go together if they are equal or both speak of a model.
    return F.when(F.contains("operation", F.lit("Model")), "Model").otherwise(F.col("operation"))


#: Spans in need, of one session and operation with differing offers, for one task.
BLOCK = 100_000
#: What an offer has: a request, a response, or both. Each kind is a queue.
KINDS = ((True, False), (False, True), (True, True))
_HEADS = ["h0", "h1", "h2"]


def _identity(df: DataFrame) -> Column:
    """Names a row: its place and all that it holds. Inputs that were put together may
    repeat a place."""
    return F.struct("seq", F.xxhash64(*[F.col(c) for c in df.columns]).alias("row"))


def _first_fit(wants: pd.DataFrame, offers: pd.DataFrame, heads: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """First fit over some spans in need in a row: each takes the earliest offer that has
    something it lacks. ``heads`` is how many offers of each kind are gone before.
    Returns how many are gone after, and the (place in need, place of offer) pairs."""
    queues, pairs, taken = [], [], [0, 0, 0]
    for kind, head in enumerate(heads):
        own = offers[(offers.kind == kind) & (offers.nth > head)].sort_values("nth")
        queues.append([*own.pos.tolist(), float("inf")])
    ahead = [q[0] for q in queues]
    wants = wants.sort_values("pos")
    for pos, r, s in zip(wants.pos.tolist(), wants.r.tolist(), wants.s.tolist(), strict=True):
        place, kind = min((ahead[k], k) for k, (has_r, has_s) in enumerate(KINDS) if (r and has_r) or (s and has_s))
        if place < float("inf"):
            pairs.append((pos, place))
            taken[kind] += 1
            ahead[kind] = queues[kind][taken[kind]]
    return [h + t for h, t in zip(heads, taken, strict=True)], pairs


def _at_blocks(wants: DataFrame, offers: DataFrame, blocks: DataFrame, key: list[str], size: int) -> DataFrame:
    """The rows that the given blocks need: their spans in need, and of each kind of offer
    the two chunks from the head on, which hold as many offers as a block can take."""
    heads = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(h).alias("head")) for k, h in enumerate(_HEADS)])
    chunks = blocks.withColumn("_head", F.explode(heads)).select(
        *key, "block", *_HEADS, "_head.kind",
        F.explode(F.array(F.expr(f"_head.head div {size}"), F.expr(f"_head.head div {size} + 1"))).alias("chunk"),
    )
    lit, no = F.lit, F.lit(False)
    return wants.join(blocks, [*key, "block"]).select(
        *key, "block", *_HEADS, lit(-1).alias("kind"), "pos", lit(0).cast("long").alias("nth"), "r", "s"
    ).unionByName(
        offers.join(chunks, [*key, "kind", "chunk"]).select(
            *key, "block", *_HEADS, "kind", "pos", "nth", no.alias("r"), no.alias("s")
        )
    )


def _heads_after(group: pd.DataFrame) -> pd.DataFrame:
    first = group.iloc[[0]][["session", "class", "block", *_HEADS]]
    after, _ = _first_fit(group[group.kind < 0], group[group.kind >= 0], first[_HEADS].iloc[0].tolist())
    return first.assign(**{f"after{k}": [x] for k, x in enumerate(after)})


def _pairs(group: pd.DataFrame) -> pd.DataFrame:
    heads = group[_HEADS].iloc[0].tolist()
    _, pairs = _first_fit(group[group.kind < 0], group[group.kind >= 0], heads)
    at = {c: group[c].iloc[0] for c in ("session", "class")}
    return pd.DataFrame(pairs, columns=["pos", "offer"]).astype("int64").assign(**at)


def _carried(group: pd.DataFrame) -> pd.DataFrame:
    """One row for each block of a (session, operation): new heads of the blocks from what
    each of them took. A block seen with the heads it now gets leads to what it led to;
    one seen with others takes as much as then, or ends where it ended if it did so from
    two different heads before. Only the first is certain, so all heads are right when
    they no longer change, and at least one more block is right after each round."""
    group = group.sort_values("block")
    ends = group[["n0", "n1", "n2"]].iloc[0].tolist()
    heads, out = [0, 0, 0], []
    for row in group.itertuples(index=False):
        out.append(tuple(heads))
        seen, after = (row.h0, row.h1, row.h2), (row.after0, row.after1, row.after2)
        met = (row.was0, row.was1, row.was2) == after and (row.from0, row.from1, row.from2) != seen
        if met or tuple(heads) == seen:
            heads = list(after)
        else:
            heads = [max(h, min(h + a - x, n)) for h, a, x, n in zip(heads, after, seen, ends, strict=True)]
    new = pd.DataFrame(out, columns=["to0", "to1", "to2"], index=group.index)
    return pd.concat([group[[*_STATE]], new], axis=1)


_STATE = [
    "session", "class", "block", "h0", "h1", "h2", "after0", "after1", "after2",
    "from0", "from1", "from2", "was0", "was1", "was2", "n0", "n1", "n2",
]


def _typed(names: list[str]) -> str:
    return ", ".join(f"`{c}` {'string' if c in ('session', 'class') else 'long'}" for c in names)


def _settled_heads(wants: DataFrame, offers: DataFrame, blocks: DataFrame, key: list[str], size: int) -> DataFrame:
    """(key, block, heads): how many offers of each kind are gone before each block.

    The first guess is that offers go in order whatever they have. Each round runs the
    blocks whose heads have changed, side by side, and carries what they took along the
    blocks of their group, a few numbers each.
    """
    by_kind = [F.count_if(F.col("kind") == k) for k in range(3)]
    cut = Window.partitionBy(*key).orderBy("block")
    gone = offers.groupBy(*key, F.expr(f"(pos - 1) div {size} + 1").alias("block")).agg(*[c.alias(h) for c, h in zip(by_kind, _HEADS, strict=True)])
    totals = offers.groupBy(*key).agg(*[c.alias(f"n{k}") for k, c in enumerate(by_kind)])
    # Where offers are used up there are blocks of need alone, where they are left over, of offers alone.
    guess = (
        blocks.join(gone, [*key, "block"], "full")
        .select(*key, "block", *[F.coalesce(F.sum(h).over(cut), F.lit(0)).alias(h) for h in _HEADS])
        .join(blocks, [*key, "block"], "left_semi")
        .join(totals, key)
    )
    empty = [F.lit(-1).cast("long").alias(c) for c in _STATE if c[:3] in ("aft", "fro", "was")]
    state = checkpoint(guess.select("*", *empty).select(*_STATE))
    due = state.select(*key, "block", *_HEADS)
    while not due.isEmpty():
        ran = _at_blocks(wants, offers, due, key, size).groupBy(*key, "block").applyInPandas(
            _heads_after, _typed([*key, "block", *_HEADS, "after0", "after1", "after2"])
        )
        ran = ran.select(*key, "block", *[F.col(f"after{k}").alias(f"end{k}") for k in range(3)])
        anew = F.col("end0").isNotNull()
        state = state.join(ran, [*key, "block"], "left").select(
            *key, "block", *_HEADS, *[F.coalesce(f"end{k}", f"after{k}").alias(f"after{k}") for k in range(3)],
            *[c for c in _STATE if c[:3] in ("fro", "was")], "n0", "n1", "n2",
        )
        carried = checkpoint(state.select(*_STATE).groupBy(*key).applyInPandas(_carried, _typed([*_STATE, "to0", "to1", "to2"])))
        changed = F.struct("to0", "to1", "to2") != F.struct(*_HEADS)

        def turned(new: str, old: str, changed: Column = changed) -> list[Column]:
            return [F.when(changed, F.col(f"{new}{k}")).otherwise(F.col(f"{old}{k}")).alias(f"{old}{k}") for k in range(3)]

        # What a changed block was seen with last becomes what it was seen with before.
        state = carried.select(
            *key, "block", *turned("to", "h"), "after0", "after1", "after2", *turned("h", "from"), *turned("after", "was"), "n0", "n1", "n2"
        )
        due = carried.filter(changed).select(*key, "block", *[F.col(f"to{k}").alias(f"h{k}") for k in range(3)])
    return state.select(*key, "block", *_HEADS)


def _mixed_matches(wants: DataFrame, offers: DataFrame, uneven: DataFrame, key: list[str], size: int) -> DataFrame:
    """(log_id, trace_id) where the offers of a (session, operation) differ: first fit in
    blocks of ``size`` spans in need, each in a task of its own, on places and flags only."""
    kind = F.when(~F.col("s"), 0).when(~F.col("r"), 1).otherwise(2)
    placed = rank_within(wants.filter(~F.col("even")).select(*key, "id", "r", "s"), key, [F.col("id")])
    wants = stored(placed.withColumn("block", F.expr(f"(pos - 1) div {size}")), "in-need")
    placed = rank_within(offers.join(uneven, key, "left_semi").select(*key, "id", kind.alias("kind")), key, [F.col("id")])
    placed = rank_within(placed, [*key, "kind"], [F.col("pos")], pos="nth")
    offers = stored(placed.withColumn("chunk", F.expr(f"(nth - 1) div {size}")), "offers")
    blocks = wants.select(*key, "block").distinct()
    large = blocks.filter("block > 0").select(*key).distinct()
    zero = [F.lit(0).cast("long").alias(h) for h in _HEADS]
    heads = blocks.join(large, key, "left_anti").select(*key, "block", *zero)
    if not large.isEmpty():
        several = [x.join(large, key, "left_semi") for x in (wants, offers, blocks)]
        heads = heads.unionByName(_settled_heads(*several, key, size))
    pairs = _at_blocks(wants, offers, heads, key, size).groupBy(*key, "block").applyInPandas(_pairs, "pos long, offer long, session string, class string")
    return (
        pairs.join(wants.select(*key, "pos", F.col("id").alias("log_id")), [*key, "pos"])
        .join(offers.select(*key, F.col("pos").alias("offer"), F.col("id").alias("trace_id")), [*key, "offer"])
        .select("log_id", "trace_id")
    )


def enrich(log_spans: DataFrame, trace_spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """Fill missing requests and responses of log spans from agent trace spans of
    the same session and operation, one-to-one and in order; add the unused ones.

    Within a (session, operation) group whose trace spans all offer the same fields
    the n-th span in need gets the n-th offer: two rankings and a join on unique
    keys. A row is known by its place and contents; rows alike in both are one. Groups
    with differing offers follow first-fit order in blocks of ``block`` spans in need,
    each from the offers left by those before. An enriched span keeps neither thread
    nor session id.
    """
    key = ["session", "class"]
    log_spans = log_spans.withColumn("_id", _identity(log_spans))
    log_spans = log_spans.withColumn("session", F.col("agent_session_id")).withColumn("class", _operation_class())
    offers_all = trace_spans.withColumn("_id", _identity(trace_spans))
    offers_all = offers_all.withColumn("session", F.col("agent_session_id")).withColumn("class", _operation_class())
    # Matching reads keys and flags several times; write those narrow rows once
    # instead of computing both inputs over and over.
    offers = checkpoint(
        offers_all.filter(truthy("session"))
        .select(*key, F.col("_id").alias("id"), truthy("request").alias("r"), truthy("response").alias("s"))
        .filter("r or s")
    )
    wants = checkpoint(
        log_spans.filter(truthy("session"))
        .select(*key, F.col("_id").alias("id"), (~truthy("request")).alias("r"), (~truthy("response")).alias("s"))
        .filter("r or s")
    )
    kinds = offers.groupBy(*key).agg(
        F.bool_and("r").alias("all_r"), F.bool_or("r").alias("any_r"),
        F.bool_and("s").alias("all_s"), F.bool_or("s").alias("any_s"),
    ).withColumn("even", (F.col("all_r") == F.col("any_r")) & (F.col("all_s") == F.col("any_s")))
    wants = wants.join(kinds, key)
    in_order = [F.col("id")]
    even_wants = rank_within(
        wants.filter(F.col("even") & ((F.col("r") & F.col("all_r")) | (F.col("s") & F.col("all_s")))).select(*key, "id"),
        key, in_order,
    )
    even_offers = rank_within(
        offers.join(kinds.filter("even").select(*key), key, "left_semi").select(*key, "id"),
        key, in_order,
    )
    even = even_wants.withColumnRenamed("id", "log_id").join(
        even_offers.withColumnRenamed("id", "trace_id"), [*key, "pos"]
    ).select(*key, "log_id", "trace_id")
    uneven = kinds.filter(~F.col("even")).select(*key)
    matches = even.select("log_id", "trace_id")
    if not uneven.isEmpty():
        matches = matches.unionByName(_mixed_matches(wants, offers, uneven, key, block))
    matches = checkpoint(matches)
    given = offers_all.select(
        F.col("_id").alias("trace_id"),
        F.struct("request", "response", "start_at", "end_at").alias("g"),
    )
    merged = log_spans.join(matches.join(given, "trace_id").select(F.col("log_id").alias("_id"), "g"), "_id", "left")
    hit = F.col("g").isNotNull()

    def filled(name: str) -> Column:
        return F.when(hit & ~truthy(name), F.col(f"g.{name}")).otherwise(F.col(name)).alias(name)

    out_columns = [c for c in log_spans.columns if c not in ("session", "class", "_id")]
    special = {
        "request": filled("request"),
        "response": filled("response"),
        "start_at": F.when(hit, F.coalesce("start_at", "g.start_at")).otherwise(F.col("start_at")).alias("start_at"),
        "end_at": F.when(hit, F.coalesce("end_at", "g.end_at")).otherwise(F.col("end_at")).alias("end_at"),
        "thread_id": F.when(~hit, F.col("thread_id")).alias("thread_id"),
        "session_id": F.when(~hit, F.col("session_id")).alias("session_id"),
    }
    enriched = merged.select(*[special.get(c, F.col(c)) for c in out_columns])
    unused = offers_all.filter(truthy("session")).join(
        matches.select(F.col("trace_id").alias("_id")), "_id", "left_anti"
    ).select(*[c for c in out_columns if c in trace_spans.columns])
    return enriched.unionByName(unused, allowMissingColumns=True)
