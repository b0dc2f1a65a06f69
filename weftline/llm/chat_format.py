"""Chat formatting from an event log.

Events of a conversation are partitioned by conversation, sorted by sequence and folded into final messages; the
messages are rendered with a template. DataFrame functions only.

Event kinds: ``message`` (the whole text), ``delta`` (appended), ``edit`` (replaces the text so far), ``regenerate``
(drops the text so far; later deltas fill it again) and ``retract`` (the message goes). An unknown kind counts as delta.
Only what follows the last event that starts anew counts; so a delta after ``retract`` leaves the message gone, an edit or a
regeneration brings it back. A null ``seq`` is the smallest; of events with one ``seq`` those that start anew come first, then
the text decides the order, and ``retract`` wins over the others.

Template: each turn is ``<s>`` + url-encoded role + newline + text + newline + ``</s>`` + newline. Control strings inside
a text get a backslash before them, and reading back takes one away, so every text survives. The loss mask covers the
texts of the role ``assistant``; a span says which turn it lies in, so that reading it does not scan the whole conversation.

Nulls and odd input: null roles and texts count as empty, a null conversation id is a conversation of its own; messages
with the same position stay separate, in the order of role and text; an empty log gives an empty result; further
columns of the input are not carried over.

Events are dealt and folded by (conversation, message), so that a long conversation is spread over tasks up to its finished
messages. Rendering then brings a conversation's messages together, since the rendered conversation is one row and its spans
count from its start: that step is one task for a conversation, and such a row can have at most 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

CONTROL = r"(</?s>|\[/?INST\])"
TURN_END = "\n</s>\n"
LOSS_ROLE = "assistant"
STARTS = ("message", "edit", "regenerate", "retract")
#: Characters of a streamed delta.
DELTA = 200


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """events (conv_id, message, seq, kind, role, text) -> messages (conv_id, message, role, text). message: anything that can be ordered."""
    key = W.partitionBy("conv_id", "message")
    starts = F.col("kind").isin(*STARTS)
    seq = F.coalesce(F.col("seq").cast("bigint"), F.lit(-(2**63)))
    marked = events.select("conv_id", "message", seq.alias("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    marked = marked.withColumn("last_start", F.max(F.when(starts, F.col("seq"))).over(key))
    live = marked.filter(F.col("last_start").isNull() | (F.col("seq") >= F.col("last_start")))
    folded = live.groupBy("conv_id", "message").agg(
        F.max_by("role", F.struct("seq", "role")).alias("role"),
        F.max(F.col("kind") == "retract").alias("gone"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", (~starts).alias("after"), "text"))), lambda e: e["text"]), "").alias("text"),
    )
    return folded.filter(~F.coalesce("gone", F.lit(False))).drop("gone")


def render(messages: DataFrame) -> DataFrame:
    """messages (conv_id, message, role, text) -> one row per conversation: formatted, loss_spans (start, length, turn).
    Messages stand in the order of message, role and text."""
    turn_head = F.concat(F.lit("<s>"), F.url_encode("role"), F.lit("\n"))
    body = escape(F.col("text"))
    turns = messages.select("conv_id", "message", "role", "text", turn_head.alias("head"), body.alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(TURN_END)))
    order = W.partitionBy("conv_id").orderBy("message", "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head"))
    turns = turns.withColumn("turn", F.row_number().over(order) - 1)
    span = F.when(F.col("role") == LOSS_ROLE, F.struct("start", F.char_length("body").cast("bigint").alias("length"), "turn"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return rows.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans")


def split_turns(formatted: Column) -> Column:
    """The turns of a rendered conversation as they stand in it, head and body, without their ends."""
    pieces = F.split(formatted, TURN_END, -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def read_turns(pieces: Column) -> Column:
    """From split turns: array of (role, text)."""
    head_end = lambda p: F.locate("\n", p)
    role = lambda p: F.url_decode(F.substr(p, F.lit(4), head_end(p) - F.lit(4)))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), unescape(F.substr(p, head_end(p) + F.lit(1))).alias("text")))


def read_masked(pieces: Column, loss_spans: Column) -> Column:
    """From split turns, the texts under the loss mask, unescaped: a span is the end of its turn."""
    piece = lambda span: F.get(pieces, span["turn"])
    return F.transform(loss_spans, lambda s: unescape(F.substr(piece(s), F.char_length(piece(s)) - s["length"].cast("int") + F.lit(1))))


def conversation_events(rows: DataFrame, delta: int = DELTA) -> DataFrame:
    """Logged turns (conv_id, turn, role, text) as the events that a chat service would have logged for them.

    A message is known by its turn and, where rows share one, by role, text and copy. By a hash of the text it was streamed in deltas
    of ``delta`` characters; or streamed once, then regenerated and streamed again; or sent whole as a draft and edited.
    Folding the events gives the turns back.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.select("conv_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"), "turn", "role", "text")
    identity = F.xxhash64("role", "text")
    rows = rows.select("conv_id", F.struct("turn", identity.alias("text"), "copy").alias("message"), F.pmod(identity, F.lit(3)).alias("way"), "role", "text", F.greatest(F.ceil(F.char_length("text") / delta), F.lit(1)).alias("n"))
    event = lambda seq, kind, said: F.struct(seq.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), said.alias("text"))
    stream = lambda first: F.transform(F.sequence(F.lit(1).cast("bigint"), "n"), lambda k: event(first + k, "delta", F.substr("text", ((k - 1) * delta + 1).cast("int"), F.lit(delta))))
    draft = F.array(event(F.lit(0), "message", F.left("text", F.lit(delta))))
    log = (
        F.when(F.col("way") == 0, stream(F.lit(0)))
        .when(F.col("way") == 1, F.concat(draft, F.array(event(F.lit(1), "regenerate", F.lit(""))), stream(F.lit(1))))
        .otherwise(F.concat(draft, F.array(event(F.lit(1), "delta", F.lit("...")), event(F.lit(2), "edit", F.col("text")))))
    )
    return rows.select("conv_id", "message", "role", F.explode(log).alias("e")).select("conv_id", "message", "e.seq", "e.kind", "role", "e.text")


def format_conversations(events: DataFrame) -> DataFrame:
    """The finished messages of a log, rendered. Of a message known by several values the turn tells its place."""
    messages = fold_events(events)
    if isinstance(messages.schema["message"].dataType, T.StructType):
        messages = messages.withColumn("message", F.col("message.turn"))
    return render(messages)


def digest(formatted: DataFrame) -> DataFrame:
    """Figures of the rendered conversations, all read back from the rendered text."""
    rows = formatted.select("conv_id", "formatted", "loss_spans", split_turns(F.col("formatted")).alias("pieces"))
    rows = rows.select("conv_id", "formatted", read_turns(F.col("pieces")).alias("turns"), read_masked(F.col("pieces"), F.col("loss_spans")).alias("masked"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), every.alias("every"), F.array_join("masked", "").alias("loss"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    return rows.select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode("every", "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
