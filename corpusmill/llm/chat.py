"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events in order of ``seq``: ``message`` starts a message, ``delta`` appends streamed text to
it, ``edit`` replaces its text, ``regenerate`` empties it so that later deltas write it anew. Events name their message
by (conv_id, turn, part), so folding needs the events of one message together, never a whole conversation.

Messages are rendered as ``<s>role\\ntext</s>\\n``. Control strings in roles and texts are broken up reversibly: a backslash
is doubled and one is put after the first character of every control string, so none occurs in a rendered text but
those of the template. Each rendered message is one row of output, in order of (conv_id, turn, part), with the range of
characters under the loss mask (the assistant's text); a conversation's text is its rows joined. Digests over whole
conversations are folded from sorted rows as a stream, so a conversation of any length takes constant memory.

Defined cases: a very long text is one row; a null text is empty, a null role is an empty role (never an assistant's),
null conversation ids form a conversation of their own, null turns come first, rows that share conversation and turn are
parts in order of role and text, each a turn of its own; an empty table gives only what is added to it; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialise

#: Strings that mark turns in this template or its relatives.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MESSAGE = ["conv_id", "turn", "part"]


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one after the first character of every control string."""
    text = F.regexp_replace(text, r"\\", r"\\\\")
    heads = "|".join(rf"{'\\' + c[0]}(?=\Q{c[1:]}\E)" for c in CONTROL)
    return F.regexp_replace(text, heads, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def message_events(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text), one row per finished message, as the log of a chat that streams: half
    of a text begins a message and a delta brings the rest; a quarter of the messages begin as a draft that an edit
    replaces, and a quarter are regenerated."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    part = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    left, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    events = lambda *es: F.array(*(F.struct(F.lit(i).cast("long").alias("seq"), F.lit(kind).alias("kind"), (F.col("role") if i == 0 else F.lit(None).cast("string")).alias("role"), text.alias("text")) for i, (kind, text) in enumerate(es)))
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    log = (
        F.when(kind == 0, events(("message", rest), ("edit", F.col("text"))))
        .when(kind == 1, events(("message", rest), ("regenerate", F.lit(None).cast("string")), ("delta", left), ("delta", rest)))
        .otherwise(events(("message", left), ("delta", rest)))
    )
    return rows.withColumn("part", part.cast("long")).select("conv_id", "turn", "part", F.inline(log)).select(*MESSAGE, "seq", "kind", "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """events(conv_id, turn, part, seq, kind, role, text) -> messages(conv_id, turn, part, role, text)."""
    item = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    log = events.groupBy(*MESSAGE).agg(F.array_sort(F.collect_list(item)).alias("log"))
    starts = F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(F.lit(0)))
    last = F.array_max(starts)
    tail = F.slice("log", last + 1, F.size("log"))
    text = F.array_join(F.transform(F.filter(tail, lambda e: e["kind"] != "regenerate"), lambda e: e["text"]), "")
    roles = F.filter("log", lambda e: e["role"].isNotNull())
    return log.select(*MESSAGE, F.get(roles, F.size(roles) - 1)["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, turn, part, formatted and the loss range [loss_start, loss_end) in it (equal where there is none)."""
    head = F.concat(F.lit("<s>"), F.url_encode(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    rows = messages.select(*MESSAGE, (F.col("role").eqNullSafe(F.lit("assistant"))).alias("loss"), head.alias("head"), body.alias("body"))
    start = F.length("head")
    return rows.select(*MESSAGE, F.concat("head", "body", F.lit("</s>\n")).alias("formatted"), start.alias("loss_start"), F.when(F.col("loss"), start + F.length("body")).otherwise(start).alias("loss_end"))


def parse(formatted: DataFrame) -> DataFrame:
    """Reads rendered rows back: role, text, and the text under the loss mask."""
    whole = F.col("formatted")
    inner = F.substring(whole, 4, F.length(whole) - 8)
    role = F.substring_index(inner, "\n", 1)
    body = F.substring(inner, F.length(role) + 2, F.length(inner))
    loss = F.substring(whole, F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return formatted.select(*MESSAGE, F.url_decode(role).alias("role"), unescape(body).alias("text"), (F.col("loss_end") > F.col("loss_start")).alias("masked"), unescape(loss).alias("loss"), F.length(whole).alias("chars"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds rows sorted by conversation; only the digests' states are kept."""

    def out(key, state) -> pa.RecordBatch:
        turns, loss, n, loss_chars, chars = state
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int64()), pa.array([n]), pa.array([turns.hexdigest()]), pa.array([loss_chars]), pa.array([loss.hexdigest()]), pa.array([chars])],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    key, state = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != key:
                if state is not None:
                    yield out(key, state)
                key, state = row["conv_id"], [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
            state[0].update(f"{row['role']}\n{row['text']}\n".encode())
            state[1].update(row["loss"].encode())
            state[2] += 1
            state[3] += len(row["loss"])
            state[4] += row["chars"]
    if state is not None:
        yield out(key, state)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The formatted rows of a table of finished messages."""
    return render(fold_events(message_events(conversations)))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted rows: conv_id, n_turns, turns_sha256 (role, newline, text, newline
    per turn), loss_chars, loss_sha256 and formatted_chars."""
    rows = parse(formatted).select(*MESSAGE, "role", "text", "loss", "chars")
    return rows.repartition("conv_id").sortWithinPartitions(*MESSAGE).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def written(formatted: DataFrame) -> DataFrame:
    """Writes the formatted rows to shared storage and reads them back."""
    return materialise(formatted, "chat")
