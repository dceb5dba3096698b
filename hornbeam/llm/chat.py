"""Chat formatting from event logs.

Streamed deltas, edits and regenerations of each message are folded into its
final text in the order of their sequence numbers; messages are rendered with
a template whose control strings cannot occur inside a text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is "### role\\ntext\\n</turn>\\n"; roles and texts are escaped, so that they hold no # and no <.
OPEN, CLOSE = "### ", "\n</turn>\n"
LOSS_ROLE = "assistant"


def events_of_turns(turns: DataFrame) -> DataFrame:
    """An event log of finished turns (conv_id, turn, role, text): each starts, then streams its text in two deltas.

    Rows are one message each, also when a turn number repeats; a null text is empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    kinds = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("start").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("step"), F.lit("delta").alias("kind"), F.substring(text, F.lit(1), half).alias("text")),
        F.struct(F.lit(2).alias("step"), F.lit("delta").alias("kind"), F.substring(text, half + 1, F.length(text)).alias("text")),
    )
    # A row's number tells equal rows apart; its three events are made where the row is read, so they share it.
    message = F.struct(F.col("turn").alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("copy"))
    rows = turns.select("conv_id", message.alias("message"), text.alias("text")).select("conv_id", "message", F.explode(kinds).alias("e"))
    return rows.select("conv_id", "message", F.col("message.role").alias("role"), F.struct("message.at", "e.step").alias("seq"), "e.kind", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, first, message, role, text: each message's final text.

    ``events`` has conv_id, message, role, seq, kind and text. By sequence, a
    delta appends, an edit replaces all so far, a regenerate empties it, a
    delete withdraws the message; a later start has no effect. Ties of seq are
    ordered by kind and text. Messages, not conversations, are the groups, so
    that a conversation that holds much of the log is split. Messages are
    ordered by their first sequence number, then by message.
    """
    e = events.select("conv_id", "message", "role", F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    grouped = e.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list("e")).alias("log"), F.min_by("role", "e").alias("role"))
    resets = F.filter(F.transform("log", lambda x, i: F.when(x["kind"].isin("edit", "regenerate", "delete"), i)), lambda i: i.isNotNull())
    last = F.coalesce(F.array_max(resets), F.lit(-1))
    parts = F.filter(F.col("log"), lambda x, i: ((i > F.col("last")) & (x["kind"] == "delta")) | ((i == F.col("last")) & (x["kind"] == "edit")))
    folded = grouped.withColumn("last", last).withColumn("text", F.array_join(F.transform(parts, lambda x: x["text"]), ""))
    gone = (F.col("last") >= 0) & (F.get(F.col("log")["kind"], F.col("last")) == "delete")
    return folded.filter(~F.coalesce(gone, F.lit(False))).select("conv_id", F.col("log")[0]["seq"].alias("first"), "message", "role", "text")


def escaped(text: Column) -> Column:
    """The text without # or <: a backslash is doubled, # is backslash-h and < is backslash-l."""
    for plain, code in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def render(messages: DataFrame) -> DataFrame:
    """conv_id, first, message, segment, loss_start, loss_end: the rendered turns and the code points under the loss mask.

    A newline in a role becomes backslash-n. The formatted conversation is its
    segments in the order of (first, message), with nothing between.
    """
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    body = escaped(F.col("text"))
    loss = F.col("role") == LOSS_ROLE
    start = F.length(head)
    return messages.select(
        "conv_id", "first", "message", F.concat(head, body, F.lit(CLOSE)).alias("segment"), F.when(loss, start).otherwise(0).alias("loss_start"), F.when(loss, start + F.length(body)).otherwise(0).alias("loss_end")
    )


_ESCAPE = re.compile(r"\\(.)", re.S)
_CODES = {"n": "\n", "h": "#", "l": "<"}


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _CODES.get(m[1], m[1]), text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        head, _, body = part.partition("\n")
        turns.append((unescape(head[len(OPEN) :]), unescape(body)))
    return turns


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the rendered segments.

    Rows stream through in order, with one conversation's digests held at a
    time: memory doesn't grow with a conversation.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def work(batches):
        now, state = None, None

        def done():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            out = []
            for conv, segment, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or conv != now:
                    if state is not None:
                        out.append(done())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                masked = unescape(segment[lo:hi])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(segment)
            if out:
                yield batch_of(out)
        if state is not None:
            yield batch_of([done()])

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "first", "message")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(work, schema)


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rendered segments of finished turns.

    Rows with a null conversation form one of their own; null turns come first,
    null roles and texts are empty; rows of the same turn follow each other by
    role, then by a hash of the text. Other columns are ignored.
    """
    given = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text"))
    return render(fold(events_of_turns(given)))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(regexp_replace(role, '[\\#<\n]', 'xx', 'g')) + 1 + length(regexp_replace(text, '[\\#<]', 'xx', 'g')) + 9) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
