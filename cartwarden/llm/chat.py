"""Chat formatting: a finite-state machine over roles checks the order of turns, a declarative template makes the text.

A turn becomes segments (text, loss): the role's opening mark, the escaped text, the closing mark; only the texts of
roles that the template trains on are under the loss mask. Control strings inside texts are broken by an escape
character, so that a mark in the output is always the template's own, and the output can be read back to the same turns.

The machine's state depends on all turns before. A long conversation is cut into blocks of turns; each block is reduced
to what it does to every state (a few numbers), these are composed along the conversation, and then all blocks are
formatted at once, each from its own first state. So no task holds a conversation, and a hot one is spread over many.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SEGMENTS = "array<struct<text:string,loss:boolean>>"
TURN = "conv_id long, block long, place long, role string, segments " + SEGMENTS + ", state string, sound boolean"


@dataclass(frozen=True)
class Mark:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """marks: what stands around a role's text; other: around a role without marks ({} is its escaped name).

    order: state -> role -> next state; a turn that has no edge is a fault, and its state is ``start`` again. A
    conversation may end in the states of ``ends``.
    """

    marks: dict[str, Mark]
    other: Mark
    order: dict[str, dict[str, str]]
    start: str
    ends: tuple[str, ...]
    escape: str = "␛"
    also: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if len(self.escape) != 1 or any(self.escape in c for c in self.controls):
            raise ValueError("the escape is one character that no mark holds")
        if any(len(c) < 2 for c in self.controls):
            raise ValueError("a control string has two characters at least")
        if "{}" not in self.other.opens or any(not m.closes.strip() or not m.opens.strip() for m in [*self.marks.values(), self.other]):
            raise ValueError("every role has marks, and the other one's name a place")
        head = self.other.opens.partition("{}")[0]
        for opens in [*(m.opens for m in self.marks.values()), head, self.other.opens.partition("{}")[2]]:
            if any(opens.endswith(c[:k]) for c in self.controls for k in range(1, len(c))):
                raise ValueError(f"a text after {opens!r} could complete a control string")
        unknown = {s for edges in self.order.values() for s in edges.values()} | {self.start, *self.ends}
        if unknown - set(self.order):
            raise ValueError("an edge leads to a state that has no entry")

    @cached_property
    def controls(self) -> tuple[str, ...]:
        """What a text must not hold: the marks without the white space around them, longest first."""
        head, _, tail = self.other.opens.partition("{}")
        found = {m.opens.strip() for m in self.marks.values()} | {m.closes.strip() for m in [*self.marks.values(), self.other]} | {head.strip(), tail.strip(), *self.also}
        return tuple(sorted(filter(None, found), key=lambda c: (-len(c), c)))

    @cached_property
    def _breaks(self) -> re.Pattern:
        """Places after which an escape goes: the first character of a control string, or of the start of one at the end."""
        whole = "|".join(map(re.escape, self.controls))
        starts = "|".join(re.escape(c[:k]) for c in self.controls for k in range(len(c) - 1, 0, -1))
        return re.compile(rf"{re.escape(self.escape)}|(?=(?:{whole})|(?:{starts})\Z).", re.S)

    def escaped(self, text: str) -> str:
        return self._breaks.sub(lambda m: m[0] + self.escape, text)

    def unescaped(self, text: str) -> str:
        e = re.escape(self.escape)
        return re.sub(rf"{e}({e}?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        mark = self.marks.get(role)
        if mark is None:
            mark = Mark(self.other.opens.replace("{}", self.escaped(role)), self.other.closes, self.other.loss)
        return [(mark.opens, False), (self.escaped(text), mark.loss), (mark.closes, False)]

    def read(self, output: str) -> Iterator[tuple[str, str]]:
        """The turns (role, text) that an output is of."""
        head, _, tail = self.other.opens.partition("{}")
        by_opening = sorted(((m.opens, role, m.closes) for role, m in self.marks.items()), key=lambda m: -len(m[0]))
        at = 0
        while at < len(output):
            for opens, role, closes in by_opening:
                if output.startswith(opens, at):
                    begin = at + len(opens)
                    break
            else:
                if not output.startswith(head, at):
                    raise ValueError(f"no mark at {at}")
                end = output.index(tail, at + len(head))
                role, begin, closes = self.unescaped(output[at + len(head) : end]), end + len(tail), self.other.closes
            end = output.index(closes, begin)
            yield role, self.unescaped(output[begin:end])
            at = end + len(closes)


#: A system turn may come first; user and assistant take turns; the assistant speaks last.
ALTERNATE = {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
INSTRUCT = Template(
    marks={"system": Mark("<s>[SYS] ", " [/SYS]"), "user": Mark("<s>[INST] ", " [/INST]"), "assistant": Mark("<s>[ANS] ", " </s>", loss=True)},
    other=Mark("<s>[ROLE {} ROLE/] ", " [/ROLE]"), order=ALTERNATE, start="start", ends=("answered",), also=("<s>", "[INST]", "[SYS]", "[ANS]"),
)


def _in_order(df: DataFrame, block_turns: int) -> DataFrame:
    """Rows by conversation and block, each block's rows sorted by turn, then role and text (nulls first)."""
    turn = F.col("turn").cast("long")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("block", F.floor(F.col("turn") / block_turns).cast("long"))


def _streamed(df: DataFrame, by: list[str], order: list[str], work: Callable, schema: str) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*[F.asc_nulls_first(c) for c in [*by, *order]]).mapInArrow(work, schema)


def _same(*names: str, other: DataFrame, df: DataFrame) -> Column:
    found = F.lit(True)
    for name in names:
        found &= df[name].eqNullSafe(other[name])
    return found


def format_conversations(df: DataFrame, template: Template = INSTRUCT, block_turns: int = 1024) -> DataFrame:
    """One row a turn: conv_id, block, place (within the block, from 0), role, segments, state, sound.

    Turns are ordered by turn, then role and text; repeated rows are turns of their own, null turns come first, null
    roles and texts are empty, and rows without a conv_id are one conversation. ``state`` is the machine's state after
    the turn, ``sound`` false for a turn that had no edge; such turns are formatted like any other. Other columns are
    dropped. Order within the output is (conv_id, block, place), nulls first.
    """
    states, order, start = list(template.order), template.order, template.start
    rows = written(_in_order(df, block_turns), "chat-turns")

    def effects(batches):
        """A block's effect: the last state for each first one."""
        known, now = None, {}
        for batch in batches:
            out = []
            for conv, block, role in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if known != (conv, block):
                    if known is not None:
                        out.append((*known, [now[s] for s in states]))
                    known, now = (conv, block), {s: s for s in states}
                now = {s: order[t].get(role, start) for s, t in now.items()}
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "block", "effect"), r, strict=True)) for r in out], schema=effect)
        if known is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": known[0], "block": known[1], "effect": [now[s] for s in states]}], schema=effect)

    effect = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("effect", pa.list_(pa.string()))])
    first = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("first", pa.string())])

    def firsts(batches):
        conversation, state, begun = None, start, False
        for batch in batches:
            out = []
            for conv, block, ends in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or conv != conversation:
                    conversation, state, begun = conv, start, True
                out.append({"conv_id": conv, "block": block, "first": state})
                state = ends[states.index(state)]
            yield pa.RecordBatch.from_pylist(out, schema=first)

    blocks = _streamed(rows.select("conv_id", "block", "role", "turn", "text"), ["conv_id", "block"], ["turn", "role", "text"], effects, "conv_id long, block long, effect array<string>")
    begins = _streamed(blocks, ["conv_id"], ["block"], firsts, "conv_id long, block long, first string")
    joined = rows.join(begins, _same("conv_id", "block", other=begins, df=rows)).select(rows["conv_id"], rows["block"], "turn", "role", "text", "first")

    formatted = pa.schema([
        ("conv_id", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), ("state", pa.string()), ("sound", pa.bool_()),
    ])

    def turns(batches):
        known, state, place = None, start, 0
        for batch in batches:
            out = []
            for conv, block, role, text, begin in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "role", "text", "first")), strict=True):
                if known != (conv, block):
                    known, state, place = (conv, block), begin, 0
                sound = role in order[state]
                state = order[state].get(role, start)
                out.append((conv, block, place, role, [{"text": t, "loss": x} for t, x in template.segments(role, text)], state, sound))
                place += 1
            yield pa.RecordBatch.from_pylist([dict(zip(formatted.names, r, strict=True)) for r in out], schema=formatted)

    return _streamed(joined, ["conv_id", "block"], ["turn", "role", "text"], turns, TURN)


def verdicts(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Of each conversation: conv_id, n_turns, faults (turns without an edge), complete (no fault, and it ends where it may)."""
    last = F.max_by("state", F.struct(F.coalesce("block", F.lit(-(2**63))), "place"))
    found = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(~F.col("sound")).alias("faults"), last.alias("last"))
    return found.select("conv_id", "n_turns", "faults", ((F.col("faults") == 0) & F.col("last").isin(*template.ends)).alias("complete"))


def digests(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the output says of each conversation, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Each turn's segments are joined to the output's text, which is parsed for roles and texts; the loss mask alone says
    which characters are trained on. A digest of a conversation is one sequence, so its turns pass one task, one after
    the other; nothing of them is kept but the state of the hashes. An empty table gives no rows.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def work(batches):
        known, begun, all_turns, trained = None, False, None, None
        n = chars = size = 0
        ready = lambda: {"conv_id": known, "n_turns": n, "turns_sha256": all_turns.hexdigest(), "loss_chars": chars, "loss_sha256": trained.hexdigest(), "formatted_chars": size}
        for batch in batches:
            out = []
            for conv, segments in zip(batch.column("conv_id").to_pylist(), batch.column("segments").to_pylist(), strict=True):
                if not begun or conv != known:
                    if begun:
                        out.append(ready())
                    known, begun, all_turns, trained, n, chars, size = conv, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                output = "".join(s["text"] for s in segments)
                size += len(output)
                for role, text in template.read(output):
                    n += 1
                    all_turns.update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        text = template.unescaped(s["text"])
                        chars += len(text)
                        trained.update(text.encode())
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if begun:
            yield pa.RecordBatch.from_pylist([ready()], schema=schema)

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _streamed(turns.select("conv_id", "block", "place", "segments"), ["conv_id"], ["block", "place"], work, kinds)

#: The digests of format_conversations under INSTRUCT, for a table without rows that are equal throughout.
ORACLE = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), controls AS (
  SELECT unnest(['<s>', '</s>', '[INST]', '[/INST]', '[SYS]', '[/SYS]', '[ANS]', '[/ROLE]', 'ROLE/]']) AS control
), starts AS (
  SELECT DISTINCT left(control, k::INT) AS start FROM controls, range(1, 7) AS r(k) WHERE k < length(control)
), broken AS (  -- the characters that escapes add to a text
  SELECT text,
    (SELECT sum((length(text) - length(replace(text, control, ''))) // length(control)) FROM controls) + (SELECT count(*) FROM starts WHERE ends_with(text, start)) + length(text) - length(replace(text, '␛', '')) AS added
  FROM (SELECT DISTINCT text FROM given)
), marked AS (
  SELECT g.*, length(g.text) + b.added + CASE role WHEN 'system' THEN 9 + 7 WHEN 'user' THEN 10 + 8 WHEN 'assistant' THEN 9 + 5 ELSE length('<s>[ROLE  ROLE/] ') + length(role) + 8 END AS size
  FROM given g JOIN broken b ON b.text = g.text
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
