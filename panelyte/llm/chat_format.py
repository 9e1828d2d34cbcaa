"""Chat formatting with a grammar round trip.

Grammar of formatted text, each turn one of

    [INST] text [/INST]                  user
    [SYS] text [/SYS]                    system
     text </s>                           assistant (opens with its space)
    [ROLE] role [TEXT] text [/ROLE]      any other role

A turn's first character tells which rule holds, and a text ends where the next control string without a backslash
before it stands, so the parser never looks back. Backslashes matter only right before a control string, where the
parser takes one away. Each turn is rendered as it is and parsed again; if what comes back is not the turn (its text
holds a control string, or backslashes before one), its conflicting places are escaped and it is parsed again, until
it is identical. Texts without conflicts, nearly all, stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

RULES = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", " </s>")}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
CONTROL = re.compile(r"\[/?(?:INST|SYS|ROLE)\]|\[TEXT\]|</s>")
ESCAPED = re.compile(rf"(\\+)(?={CONTROL.pattern})")


def escape(text: str) -> str:
    """One backslash more before each control string."""
    return CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    """One backslash less before each control string that has some."""
    return ESCAPED.sub(lambda m: m.group(1)[1:], text) if "\\" in text else text


class Malformed(ValueError):
    """Text that the grammar does not derive."""


def read_text(s: str, at: int, close: str) -> tuple[int, int]:
    """(end of the text that starts at `at`, end of its closing part)."""
    for m in CONTROL.finditer(s, at):
        if m.start() > at and s[m.start() - 1] == "\\":
            continue
        end = m.start() - (close.index(m.group()) if m.group() in close else 0)
        if end < at or not s.startswith(close, end):
            raise Malformed(f"{m.group()} at {m.start()}, not {close}")
        return end, end + len(close)
    raise Malformed(f"no {close} after {at}")


def parse(s: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of formatted text; start and end of its text as it stands there."""
    at = 0
    while at < len(s):
        if s.startswith(OTHER[0], at):
            at += len(OTHER[0])
            end, after = read_text(s, at, OTHER[1])
            role, close = unescape(s[at:end]), OTHER[2]
        else:
            role, (opening, close) = next(((r, rule) for r, rule in RULES.items() if s.startswith(rule[0], at)), ("", ("", "")))
            if not role:
                raise Malformed(f"no turn at {at}")
            after = at + len(opening)
        end, at = read_text(s, after, close)
        yield role, unescape(s[after:end]), after, end


def render(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start, end of its text there), escaped as far as its way back asks for."""
    for escaped_role, escaped_text in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        opening, close = RULES.get(role) or (OTHER[0] + escaped_role + OTHER[1], OTHER[2])
        turn = opening + escaped_text + close
        try:
            if list(parse(turn)) == [(role, text, len(opening), len(opening) + len(escaped_text))]:
                return turn, len(opening), len(opening) + len(escaped_text)
        except Malformed:
            pass
    raise Malformed("a turn that does not come back")


def ordered(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text) with a conversation's rows in one task, in order; null role and text as empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def format_conversations(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_chars: int = 1 << 18
) -> DataFrame:
    """(conv_id, chunk, formatted, loss): each conversation in chunks of whole turns, from chunk 0 on, in order.

    A conversation's formatted text is its chunks joined; loss holds the spans [start, end) of assistant texts in the
    chunk, in code points. Turns are ordered by turn (nulls first), then role and text, so ties and repeated rows have
    a fixed order and are all kept. Null and empty texts and roles are empty; rows with a null id form one
    conversation. Texts of any length: a chunk closes once it has chunk_chars, so a task holds one chunk, not a
    conversation, whatever its length. Empty table: no rows. Other columns, whatever their names, are not read.
    """
    rows = ordered(conversations, id_col, turn_col, role_col, text_col)
    kind = rows.schema["conv"].dataType
    schema = f"conv_id {kind.simpleString()}, chunk long, formatted string, loss array<struct<start:long,end:long>>"
    of_id = to_arrow_type(kind)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def chunks(batches):
        conv, chunk, turns, size, loss, source = None, -1, [], 0, [], []

        def close():
            text = "".join(turns)
            if [t[:2] for t in parse(text)] != source:
                raise Malformed(f"chunk {chunk} of conversation {conv} does not come back")
            return (conv, chunk, text, loss)

        def batch_of(out):
            ids, numbers, texts, spans = zip(*out, strict=True)
            arrays = [pa.array(ids, of_id), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(span))]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "chunk", "formatted", "loss"])

        for batch in batches:
            out, held = [], 0
            for this, role, text in zip(batch.column("conv").to_pylist(), batch.column("role"), batch.column("text"), strict=True):
                if chunk >= 0 and (this != conv or size >= chunk_chars):
                    out.append(close())
                    held += size
                    turns, size, loss, source = [], 0, [], []
                    if held >= chunk_chars:
                        yield batch_of(out)
                        out, held = [], 0
                    chunk = chunk if this == conv else -1
                if not turns:
                    conv, chunk = this, chunk + 1
                role, text = role.as_py(), text.as_py()
                turn, start, end = render(role, text)
                if role == "assistant":
                    loss.append({"start": size + start, "end": size + end})
                turns.append(turn)
                source.append((role, text))
                size += len(turn)
            if out:
                yield batch_of(out)
        if chunk >= 0:
            yield batch_of([close()])

    return rows.mapInArrow(chunks, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from what format_conversations()
    gives, chunks of a conversation following each other in a task as they come from there."""
    kind = formatted.schema["conv_id"].dataType
    of_id = to_arrow_type(kind)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [of_id, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(batches):
        told: list | None = None

        def batch_of(done):
            rows = [(c, n, h.hexdigest(), chars, loss.hexdigest(), size) for c, n, h, chars, loss, size in done]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            done = []
            for conv, chunk, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "formatted", "loss")), strict=True):
                if chunk == 0:
                    if told:
                        done.append(told)
                    told = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse(text):
                    told[1] += 1
                    told[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    learned = unescape(text[span["start"] : span["end"]])
                    told[3] += len(learned)
                    told[4].update(learned.encode())
                told[5] += len(text)
            if done:
                yield batch_of(done)
        if told:
            yield batch_of([told])

    return formatted.mapInArrow(digest, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
  select *, length(text) + len(regexp_extract_all(text, '\[/?(INST|SYS|ROLE)\]|\[TEXT\]|</s>')) + case role
    when 'user' then 15 when 'system' then 13 when 'assistant' then 6
    else 23 + length(role) + len(regexp_extract_all(role, '\[/?(INST|SYS|ROLE)\]|\[TEXT\]|</s>')) end as chars from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""
