"""Chat formatting from an event log.

A log has events of conversations: a whole ``message``, a streamed ``delta`` that is appended, an ``edit`` that replaces
the text, and a ``regenerate`` that empties it for the deltas that follow. Events are dealt by conversation and message,
sorted by sequence and folded into final messages; messages are rendered one by one, as segments of the conversation's
text, so that a conversation of any length is never one value. The formatted text is the segments in order.

Template: ``<s>`` opens and ``</s>`` ends a turn; ``[SYS]``, ``[INST]`` and ``[ROLE]`` mark system, user and other roles (a
role's name stands between ``[ROLE]`` and ``[/ROLE]``), an assistant's text has no mark. Inside texts a backslash follows
the first letter of a control string, and a backslash is doubled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template.
CONTROL = ["<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
_ESCAPE = re.compile("|".join(["\\\\", *(re.escape(c) for c in CONTROL)]))
_TURN = re.compile(r"<s>(?:\[SYS\] (?P<system>.*) \[/SYS\]|\[INST\] (?P<user>.*) \[/INST\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*)|(?P<assistant>.*))</s>", re.DOTALL)
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    # A doubled backslash and a broken control string both keep their first letter and lose the backslash that follows.
    return re.sub(r"\\\\|([<\[])\\", lambda m: m[1] or "\\", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and where its text under the loss mask begins and ends (code points, end exclusive).

    Only an assistant's text is under the mask; the other roles have an empty span.
    """
    body = escape(text)
    if role == "assistant":
        return f"<s>{body}</s>", 3, 3 + len(body)
    if role == "system":
        made = f"<s>[SYS] {body} [/SYS]</s>"
    elif role == "user":
        made = f"<s>[INST] {body} [/INST]</s>"
    else:
        made = f"<s>[ROLE]{escape(role)}[/ROLE]{body}</s>"
    return made, 0, 0


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    found = _TURN.fullmatch(segment)
    if found is None:
        raise ValueError("not a turn of this template")
    if found["role"] is not None:
        return unescape(found["role"]), unescape(found["other"])
    role = next(r for r in ("system", "user", "assistant") if found[r] is not None)
    return role, unescape(found[role])


def fold_events(events: DataFrame, conversation: str = "conv_id", message: str = "turn", sequence: str = "seq") -> DataFrame:
    """Final messages: conversation, message, ``role``, ``text``; one row for each message that has an event.

    ``events`` also has ``kind``, ``role`` and ``text``. Events of a message are applied by sequence, equal ones by kind in
    the order of KINDS and then by text; a repeated event is applied again. The role is the first one that is not null. Null
    texts are empty; unknown kinds and null kinds count as whole messages, null conversations and messages are kept as a
    group of their own. Two whole messages with one number are two turns: the number of earlier ones is the column ``copy``.
    """
    columns = [conversation, message, sequence, "kind", "role", "text"]
    step = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(1)).cast("int")
    dealt = events.select(*(F.col(f"`{c}`") for c in columns)).withColumn("kind", F.when(step == 0, 1).otherwise(step))
    dealt = dealt.repartition(conversation, message).sortWithinPartitions(conversation, message, sequence, "kind", "role", "text")
    types = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, copy, role, parts = None, 0, None, []
        schema = None

        def rows(done):
            arrays = [pa.array([d[i] for d in done], schema[i]) for i in range(5)]
            return pa.RecordBatch.from_arrays(arrays, names=[conversation, message, "copy", "role", "text"])

        for batch in batches:
            schema = schema or [batch.schema.field(0).type, batch.schema.field(1).type, pa.int32(), pa.string(), pa.string()]
            done = []
            for c, m, _, kind, who, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                new = open_key != (c, m)
                if open_key is not None and (new or kind == 1):
                    done.append((*open_key, copy, role, "".join(parts)))
                if new or kind == 1:
                    open_key, copy, role, parts = (c, m), 0 if new else copy + 1, None, []
                if kind != 2:
                    parts = []
                parts.append(text or "" if kind != 4 else "")
                role = role if role is not None else who
            yield rows(done)
        if open_key is not None:
            yield rows([(*open_key, copy, role, "".join(parts))])

    return dealt.mapInArrow(fold, f"`{conversation}` {types[conversation]}, `{message}` {types[message]}, copy int, role string, text string")


def log_of_turns(turns: DataFrame, conversation: str = "conv_id", message: str = "turn", pieces: int = 16, least: int = 24) -> DataFrame:
    """An event log that ``fold_events`` folds back into the given turns (conversation, message, ``role``, ``text``).

    As a log of real use would, it tells a turn in one of four ways, chosen by a hash of its place: as a whole message; as
    an empty message and streamed deltas of ``least`` code points or more, at most ``pieces``; as a draft that an edit
    replaces; or as a streamed draft that is regenerated and streamed again. Turns of one number are told one after the
    other, by role and text. Null roles stay null, null texts are empty; the log has no order but its sequence numbers.
    """
    role, text = F.col("role"), F.coalesce(F.col("text"), F.lit(""))
    place = Window.partitionBy(conversation, message).orderBy(F.coalesce(role, F.lit("")), text)
    told = turns.select(conversation, message, "role", text.alias("text"), F.row_number().over(place).cast("bigint").alias("__copy"))
    size = F.greatest(F.lit(least), F.ceil(F.length("text") / pieces)).cast("int")
    none = F.lit(None).cast("string")

    def event(kind: str, said, who=none):
        return F.struct(F.lit(kind).alias("kind"), who.alias("role"), said.alias("text"))

    def streamed(said):
        starts = F.sequence(F.lit(0), F.ceil(F.length(said) / size).cast("int") - 1)
        cut = F.transform(starts, lambda i: event("delta", F.substring(said, i * size + 1, size)))
        return F.when(F.length(said) > 0, cut).otherwise(F.array().cast("array<struct<kind:string,role:string,text:string>>"))

    whole = F.col("text")
    begun = F.array(event("message", F.lit(""), F.col("role")))
    draft = F.concat(F.lit("Draft: "), F.left(whole, F.lit(least)))
    ways = [
        F.array(event("message", whole, F.col("role"))),
        F.concat(begun, streamed(whole)),
        F.array(event("message", draft, F.col("role")), event("edit", whole)),
        F.concat(begun, F.array(event("delta", draft)), F.array(event("regenerate", none)), streamed(whole)),
    ]
    way = F.pmod(F.xxhash64(conversation, message, "__copy"), F.lit(len(ways))).cast("int")
    chosen = told.withColumn("__way", way)
    events = ways[-1]
    for i in range(len(ways) - 1):
        events = F.when(F.col("__way") == i, ways[i]).otherwise(events)
    rows = chosen.select(conversation, message, "__copy", F.posexplode(events).alias("__step", "e"))
    return rows.select(conversation, message, (F.col("__copy") * F.lit(1 << 32) + F.col("__step")).alias("seq"), "e.kind", "e.role", "e.text")


def render(messages: DataFrame) -> DataFrame:
    """``messages`` (``role``, ``text``) with ``segment``, ``loss_start`` and ``loss_end``; null roles and texts are empty."""

    def run(roles: pa.Array, texts: pa.Array) -> pa.Array:
        made = [render_turn(r or "", t or "") for r, t in zip(roles.to_pylist(), texts.to_pylist(), strict=True)]
        arrays = [pa.array([m[0] for m in made], pa.string()), *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2))]
        return pa.StructArray.from_arrays(arrays, names=["segment", "loss_start", "loss_end"])

    run.__annotations__ = {"roles": pa.Array, "texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, "struct<segment:string,loss_start:bigint,loss_end:bigint>")
    base = messages.drop(*(c for c in messages.columns if c.lower() in ("segment", "loss_start", "loss_end", "__made")))
    return base.withColumn("__made", udf("role", "text")).select(*base.columns, "__made.*")


def digests(rendered: DataFrame, conversation: str = "conv_id", order: tuple[str, ...] = ("turn", "copy")) -> DataFrame:
    """What reading the segments back gives, one row for each conversation.

    ``n_turns``, ``turns_sha256`` (role, line end, text, line end of every turn), ``loss_chars`` and ``loss_sha256`` (the
    text under the loss mask, unescaped) and ``formatted_chars``. Segments come sorted and are hashed as they pass, so that
    a task holds one of them at a time.
    """
    dealt = rendered.select(conversation, *order, "segment", "loss_start", "loss_end").repartition(conversation).sortWithinPartitions(conversation, *order)
    kind = dealt.schema[conversation].dataType.simpleString()
    width = len(order)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, started, key_type = None, False, None
        turns = loss = hashlib.sha256()
        n = loss_chars = chars = 0

        def row(done):
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            key_type, done = batch.schema.field(0).type, []
            columns = [batch.column(0), *batch.columns[1 + width :]]
            for c, segment, start, end in zip(*(col.to_pylist() for col in columns), strict=True):
                if not started or c != at:
                    if started:
                        done.append((at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    at, started, turns, loss, n, loss_chars, chars = c, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                role, text = read_turn(segment)
                turns.update(f"{role}\n{text}\n".encode())
                masked = unescape(segment[start:end])
                loss.update(masked.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + len(segment)
            yield row(done)
        if started:
            yield row([(at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)])

    return dealt.mapInArrow(read, f"`{conversation}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def formatted(rendered: DataFrame, conversation: str = "conv_id", order: tuple[str, ...] = ("turn", "copy")) -> DataFrame:
    """One text for each conversation, for conversations that are known to fit one value."""
    parts = F.sort_array(F.collect_list(F.struct(*order, "segment")))
    return rendered.groupBy(conversation).agg(F.array_join(F.transform(parts, lambda s: s["segment"]), "").alias("formatted"))
