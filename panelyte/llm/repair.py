"""Conversation structure repair by Knuth's lightest-derivation agenda.

Items of the deduction system say "the first i turns are edited and the roles so far end in state q" of the automaton
of well-formed role sequences. From such an item and turn i follow, each with its price and its letter in the audit:

    Keep     (i, q) -> (i + 1, q')   where the turn's role fits; 0, and 1 for a truncated text
    Rerole   (i, q) -> (i + 1, q')   as the role that fits; 2, and 1 for a truncated text
    Delete   (i, q) -> (i + 1, q)    3; the only way for a blank or duplicate turn
    Insert   (i, q) -> (i, q')       an empty turn of the role that fits; 2
    Goal     (n, q) -> goal          where q accepts

A deduction adds its price to the cost and its letter to the audit of its item. That is a superior function of (cost,
audit): it never falls below the item's own value, and it keeps the order of two values of an item, as the cost of an
audit over the same turns follows from its letters, so that of two equally cheap ones neither begins the other. So an
item is final when the agenda gives it out first, and the goal's value is the cheapest repair with the least audit. The
audit tells the repaired turns, as each state takes one role for an edited turn.

A long conversation is taken in blocks. Between blocks only the (at most four) items there are left, each with its
cost, the rank of its audit among them, which stands for the audit in the next block, and a running digest of the
repaired text.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BEGIN, SYSTEM, USER, ASSISTANT = range(4)
FITS = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
EDITED = {BEGIN: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
ACCEPTS = (BEGIN, ASSISTANT)
FOLLOWS = {"su", "ua", "au"}
RANKS = "\x00\x01\x02\x03"  # below every letter of an audit
SPACE = " \t\n\x0b\x0c\r"
REQUIRED = {"blank", "duplicate"}


def lightest(turns: list[tuple[str, str, str]], begin: list[tuple[int, str, int]], last: bool) -> list[tuple[int, str, int]]:
    """[(cost, audit, state)] of the items after the turns [(role, text, fault)], from those before them.

    Where more turns follow (not last) these are the items right after the last turn, in order of their audits; at the
    end of a conversation the goal alone.
    """
    n, agenda, final, ends = len(turns), [(c, a, 0, q) for c, a, q in begin], set(), []
    heapq.heapify(agenda)
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n and not last:
            ends.append((cost, audit, q))
            continue
        if i == n and q in ACCEPTS:
            return [(cost, audit, q)]
        follows = [(2, "I", i, FITS[q, EDITED[q][0]])]
        if i < n:
            role, _, fault = turns[i]
            follows.append((3, "D", i + 1, q))
            if fault not in REQUIRED:
                more = int(fault == "truncated")
                follows.append((2 + more, "R", i + 1, FITS[q, EDITED[q][0]]))
                if (q, role[:1]) in FITS:
                    follows.append((more, "K", i + 1, FITS[q, role[:1]]))
        for price, letter, j, to in follows:
            if (j, to) not in final:
                heapq.heappush(agenda, (cost + price, audit + letter, j, to))
    return sorted(ends, key=lambda e: e[1])


def replay(turns: list[tuple[str, str, str]], audit: str, q: int) -> list[tuple[str, str]]:
    """The repaired (role, text) of the turns by the letters of an audit, from state q on."""
    out, rows = [], iter(turns)
    for letter in audit:
        if letter == "I":
            turn = (EDITED[q], "")
        else:
            role, text, _ = next(rows)
            if letter == "D":
                continue
            turn = (role if letter == "K" else EDITED[q], text)
        q = FITS[q, turn[0][:1]]
        out.append(turn)
    return out


class Seen:
    """The (role, text) pairs of a conversation by 120 bits of their digests; 16 bytes each beyond `most` of them."""

    def __init__(self, most: int = 100_000):
        self.recent: set[bytes] = set()
        self.sorted: list[np.ndarray] = []
        self.most = most

    def add(self, role: str, text: str) -> bool:
        """Whether the pair was there before."""
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=15).digest() + b"\x01"
        if key in self.recent or any((at := int(np.searchsorted(part, key))) < len(part) and part[at] == key for part in self.sorted):
            return True
        self.recent.add(key)
        if len(self.recent) >= self.most:
            self.sorted.append(np.sort(np.array(list(self.recent), "S16")))
            self.recent = set()
            while len(self.sorted) > 1 and len(self.sorted[-2]) <= 2 * len(self.sorted[-1]):
                self.sorted.append(np.sort(np.concatenate([self.sorted.pop(), self.sorted.pop()])))
        return False


class Conversation:
    """One conversation's turns as they come, by turn; the repair of what has come so far in blocks."""

    def __init__(self, block_turns: int, block_chars: int, keep: bool):
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.seen, self.before, self.illegal = Seen(), None, 0
        self.low, self.high, self.distinct = None, None, 0
        self.turns, self.chars, self.limits = [], 0, (block_turns, block_chars)
        #: cost, audit by rank, state, audits of the blocks before (linked), digest, repaired turns
        self.items = [(0, "", BEGIN, None, hashlib.sha256(), 0, [] if keep else None)]

    def add(self, turn: int | None, role: str, text: str) -> None:
        if len(self.turns) >= self.limits[0] or self.chars >= self.limits[1]:
            self._block(False)
        rest, again = text.rstrip(SPACE), self.seen.add(role, text)
        fault = "blank" if not rest else "duplicate" if again else "truncated" if rest[-1] not in ".!?" else ""
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in FOLLOWS:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.turns.append((role, text, fault))
        self.chars += len(text)

    def _block(self, last: bool) -> None:
        ends, items = lightest(self.turns, [(c, RANKS[k], q) for k, (c, _, q, *_) in enumerate(self.items)], last), []
        for cost, audit, q in ends:
            _, _, begin, link, digest, n, kept = self.items[RANKS.index(audit[0])]
            digest, repaired = digest.copy(), replay(self.turns, audit[1:], begin)
            for k, (role, text) in enumerate(repaired):
                digest.update((("\n" if n + k else "") + role + ":" + text).encode())
            items.append((cost, "", q, (link, audit[1:]), digest, n + len(repaired), None if kept is None else kept + repaired))
        self.items, self.turns, self.chars = items, [], 0

    def end(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, turns)"""
        self._block(True)
        cost, _, _, link, digest, _, kept = self.items[0]
        parts = []
        while link:
            link, part = link
            parts.append(part)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, *self.counts.values(), self.illegal, cost, "".join(reversed(parts)), digest.hexdigest(), kept


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_conversations(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    gone: Column | None = None,
    keep_turns: bool = True,
    block_turns: int = 1024,
    block_chars: int = 1 << 22,
) -> DataFrame:
    """One row (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, turns) for each id.

    Turns are taken by turn (nulls first), then role and text, so tied and repeated rows have a fixed order. Null roles
    and texts count as one space, and such a text is blank. Rows where `gone` holds are no turns, but their
    conversation has a row; one without turns has zeros, an empty audit and the digest of nothing. Rows with a null id
    form one conversation. Empty table: no rows. Other columns, whatever their names, are not read.

    turns are the repaired (role, text), a whole conversation in one cell; keep_turns=False leaves them out, and a
    task then holds a block of a conversation, its audit and 16 bytes for each of its distinct turns.
    """
    gone = F.lit(False) if gone is None else gone
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    rows = rows.withColumns({c: F.when(~F.col("gone"), F.col(c)) for c in ("turn", "role", "text")})
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    kind = rows.schema["conv"].dataType
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    types = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string(), *([turn_type] if keep_turns else [])]
    schema = f"conv_id {kind.simpleString()}, {REPORT}" + (", turns array<struct<role:string,text:string>>" if keep_turns else "")
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]

    def walk(batches):
        conv, state = None, None

        def batch_of(done):
            told = [(c, *report[:8], *([[{"role": r, "text": t} for r, t in report[8]]] if keep_turns else [])) for c, report in done]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*told, strict=True), types, strict=True)], names)

        for batch in batches:
            done = []
            ids, turns, dropped = (batch.column(c).to_pylist() for c in ("conv", "turn", "gone"))
            for this, turn, role, text, drop in zip(ids, turns, batch.column("role"), batch.column("text"), dropped, strict=True):
                if state is None or this != conv:
                    if state is not None:
                        done.append((conv, state.end()))
                    conv, state = this, Conversation(block_turns, block_chars, keep_turns)
                if not drop:
                    state.add(turn, role.as_py(), text.as_py())
            if done:
                yield batch_of(done)
        if state is not None:
            yield batch_of([(conv, state.end())])

    return rows.mapInArrow(walk, schema)


def damaged(conversations: DataFrame, kinds: int = 20, of: Callable[[Column], Column] = F.crc32) -> DataFrame:
    """conversations with planted damage, chosen by a hash of id and turn: rows dropped (marked `gone`), emptied, without
    end marks, repeated, or given to the user. Nulls count as one space."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = of(F.concat(conv, F.lit(":"), turn).cast("binary")) % kinds
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    bad = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"gone": F.col("kind") == 0, "text": bad, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(times)).select("conv_id", "turn", "role", "text", "gone")
