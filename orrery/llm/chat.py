"""Chat formatting by event-sourced reconstruction, in SQL functions only.

A log holds events of messages: ``delta`` appends text, ``edit`` replaces the
text so far, ``regenerate`` discards it and begins anew.  Logs are grouped by
conversation, sorted by sequence, and each message's events are folded into its
final text; the messages are then rendered in the order of their first event.

Template: ``<|turn|>role NEWLINE text<|end|>NEWLINE``.  Inside texts and roles
every ``<``, backslashes, ``|`` gets one backslash more, so that no control
string remains, and exactly that backslash is taken away on reading.  In roles
a backslash and a newline are first written as backslash and b or n.  The loss mask lists the
code point spans of the assistant's texts in the formatted string.

Nulls: null text and role count as empty, a null sequence sorts first, events of
a null conversation form one conversation.  Ties in sequence are ordered by
message, kind, role and text.  Unknown kinds count as ``delta``.  Repeated
events are applied each time.  An empty log gives no rows.  Texts of any length
are folded whole; a conversation must fit into a task's memory, as its formatted
string must.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

TURN, END = "<|turn|>", "<|end|>"


def escaped(x: str) -> str:
    return rf"regexp_replace({x}, '<(\\\\*)\\|', '<\\\\$1|')"


def unescaped(x: str) -> str:
    return rf"regexp_replace({x}, '<\\\\(\\\\*)\\|', '<$1|')"


def header(role: str) -> str:
    return escaped(rf"replace(replace({role}, '\\', '\\b'), '\n', '\\n')")


def role_of(line: str) -> str:
    return rf"replace(replace({unescaped(line)}, '\\n', '\n'), '\\b', '\\')"


def reconstructed(events: DataFrame) -> DataFrame:
    """``events``: conv_id, seq, message, kind, role, text.  One row per conversation with its final messages."""
    fold = """aggregate(e, '', (t, x) -> case x.kind when 'edit' then x.text when 'regenerate' then x.text else concat(t, x.text) end)"""
    messages = (
        events.select("conv_id", "seq", "message", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("e"))
        .select("conv_id", F.struct(F.expr("e[0].seq").alias("seq"), "message", F.expr("e[0].role").alias("role"), F.expr(fold).alias("text")).alias("m"))
    )
    return messages.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages"))


def rendered(conversations: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` (start and end, in code points) to reconstructed conversations."""
    pieces = f"transform(messages, m -> named_struct('role', m.role, 'head', concat('{TURN}', {header('m.role')}, '\\n'), 'body', {escaped('m.text')}))"
    mask = """aggregate(pieces, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>)),
        (a, p) -> named_struct('at', a.at + length(p.head) + length(p.body) + {end},
            'spans', if(p.role = 'assistant', concat(a.spans, array(named_struct('start', a.at + length(p.head), 'end', a.at + length(p.head) + length(p.body)))), a.spans))).spans"""
    return (
        conversations.withColumn("pieces", F.expr(pieces))
        .withColumn("formatted", F.expr(f"array_join(transform(pieces, p -> concat(p.head, p.body, '{END}\\n')), '')"))
        .withColumn("loss_mask", F.expr(mask.replace("{end}", str(len(END) + 1))))
        .drop("pieces")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests taken from ``formatted`` and ``loss_mask`` alone."""
    turns = rf"transform(slice(split(formatted, '<\\|turn\\|>'), 2, 1000000000), x -> substring(x, 1, length(x) - {len(END) + 1}))"
    texts = f"transform(loss_mask, s -> {unescaped('substring(formatted, s.start + 1, s.end - s.start)')})"
    split_turn = rf"transform(_turns, x -> named_struct('role', {role_of(r'substring_index(x, chr(10), 1)')}, 'text', {unescaped('substring(x, locate(chr(10), x) + 1)')}))"
    return (
        formatted.withColumn("_turns", F.expr(turns)).withColumn("turns", F.expr(split_turn)).withColumn("_loss", F.expr(f"array_join({texts}, '')"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.expr(r"sha2(array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), ''), 256)").alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log that a service would have kept of them.

    A user's text is streamed in two deltas, an assistant's is regenerated after
    a first draft, and any other one is mended by an edit.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    half = "cast(length(text) / 2 as int)"
    first, rest = f"substring(text, 1, {half})", f"substring(text, {half} + 1)"
    event = "named_struct('kind', '{}', 'text', {})".format
    events = f"""case role
        when 'user' then array({event("delta", first)}, {event("delta", rest)})
        when 'assistant' then array({event("delta", "reverse(text)")}, {event("regenerate", first)}, {event("delta", rest)})
        else array({event("delta", first)}, {event("edit", "text")}) end"""
    turns = conversations.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("message"))
    return turns.select("conv_id", "message", "role", F.posexplode(F.expr(events)).alias("step", "e")).select("conv_id", (F.col("message") * 4 + F.col("step")).alias("seq"), "message", "e.kind", "role", "e.text")
