"""Chat formatting by a finite-state machine over roles.

A template is data: for each role the marks before and after a turn's text and whether the text is trained on, and for each
state of the machine the roles that may follow.  Conversations are dealt by id and sorted by turn, and stream through the
machine one turn at a time, so a long conversation is never held at once.  Each turn gives up to three segments: mark, text,
mark; only the text segments of trained roles have the loss flag.  A turn out of order is formatted like any other, and its
segments have ``valid`` false.

Every control string inside a text, alone or as part of a mark, is broken by a backslash after its first character, and a backslash
is doubled, so no text holds a control string, and dropping each backslash before any character, but not the second of two,
gives the text back.

Cases: null text is empty; a null role is the empty role; a role that the template does not name is written with its name in a
mark of its own and is out of order; turns with equal numbers are ordered by role and text; null turns come first; rows with a
null conv_id are one conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles, the other roles' marks (with the role's name between the first two), the machine: role -> roles it may follow, the
    empty string being a conversation's beginning; and the control strings that all marks consist of, blanks aside."""

    roles: dict[str, Role]
    other: tuple[str, str, str]
    follows: dict[str, tuple[str, ...]]
    controls: tuple[str, ...]

    def __post_init__(self) -> None:
        whole = re.compile(f"(?:{'|'.join(map(re.escape, self.marks()))}|\\s)*")
        for mark in (*self.other, *(m for r in self.roles.values() for m in (r.before, r.after))):
            if not whole.fullmatch(mark):
                raise ValueError(f"the mark {mark!r} has more than control strings")

    def marks(self) -> list[str]:
        """The control strings, the longest first."""
        return sorted(set(self.controls), key=lambda m: (-len(m), m))

    def pattern(self) -> re.Pattern:
        return re.compile(r"\\|" + "|".join(map(re.escape, self.marks())))


TEMPLATE = Template(
    roles={"system": Role("<<SYS>>\n", "\n<</SYS>>\n"), "user": Role("<s>[INST] ", " [/INST]"), "assistant": Role("<|reply|> ", " </s>\n", True)},
    other=("<<ROLE ", "<<TEXT>>\n", "\n<</ROLE>>\n"),
    follows={"system": ("",), "user": ("", "system", "assistant"), "assistant": ("user",)},
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|reply|>", "<<ROLE", "<<TEXT>>", "<</ROLE>>"),
)
SEGMENT = "conv_id long, turn_no long, part int, text string, loss boolean, valid boolean"


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def segments_of(role: str, text: str, template: Template, pattern: re.Pattern) -> list[tuple[str, bool]]:
    known = template.roles.get(role)
    if known:
        return [(known.before, False), (escape(text, pattern), known.loss), (known.after, False)]
    return [(template.other[0] + escape(role, pattern) + template.other[1], False), (escape(text, pattern), False), (template.other[2], False)]


class Reader:
    """Reads a formatted conversation back from its text alone, which may come in pieces of any size: turns are found by the template's marks, which
    texts can't hold unescaped.  ``masked`` gives what lies between two places of the text, both counted from its start."""

    def __init__(self, template: Template):
        self.template, self.held, self.at = template, "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, int, int]]:
        """Role, text, and begin and end (in the whole text) of each turn that is complete now."""
        self.held += piece
        while (turn := self._turn()) is not None:
            role, body, end = turn
            yield role, body, self.at, self.at + end
            self.held, self.at = self.held[end:], self.at + end

    def _turn(self) -> tuple[str, str, int] | None:
        first, middle, last = self.template.other
        for name, role in self.template.roles.items():
            if self.held.startswith(role.before):
                end = self.held.find(role.after, len(role.before))
                return None if end < 0 else (name, unescape(self.held[len(role.before) : end]), end + len(role.after))
        if self.held.startswith(first):
            mid = self.held.find(middle, len(first))
            end = -1 if mid < 0 else self.held.find(last, mid + len(middle))
            return None if end < 0 else (unescape(self.held[len(first) : mid]), unescape(self.held[mid + len(middle) : end]), end + len(last))
        if len(self.held) > max(map(len, (first, *(r.before for r in self.template.roles.values())))):
            raise ValueError("not a turn of this template")
        return None

    def masked(self, begin: int, end: int) -> str:
        """The plain text between two places of a turn that has not been left yet."""
        return unescape(self.held[begin - self.at : end - self.at])


def read_turn(formatted: str, template: Template) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    turns = list(Reader(template).feed(formatted))
    if len(turns) != 1 or turns[0][3] != len(formatted):
        raise ValueError("not a turn of this template")
    return turns[0][0], turns[0][1]


def _segments(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, conv, state, number = template.pattern(), ..., "", 0
        for batch in batches:
            rows = []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if c != conv:
                    conv, state, number = c, "", 0
                valid = state in template.follows.get(role, ())
                rows += [(c, number, k, t, loss, valid) for k, (t, loss) in enumerate(segments_of(role, text, template, pattern))]
                state, number = role, number + 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=["conv_id", "turn_no", "part", "text", "loss", "valid"])

    return run


def format_chats(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Segments: conv_id, turn_no, part, text, loss, valid; each conversation's in order within one partition."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_segments(template), SEGMENT)


class _Digest:
    """What one conversation's text says, with the loss mask as spans of places in that text."""

    def __init__(self, template: Template):
        self.reader, self.turns, self.loss = Reader(template), hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.valid, self.spans = True, []

    def add(self, text: str, trained: bool, valid: bool) -> None:
        if trained:
            self.spans.append((self.chars, self.chars + len(text)))
        self.chars, self.valid = self.chars + len(text), self.valid and valid
        for role, plain, begin, end in self.reader.feed(text):
            self.turns.update(f"{role}\n{plain}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
            while self.spans and self.spans[0][1] <= end:
                low, high = self.spans.pop(0)
                under = self.reader.masked(max(low, begin), high)
                self.loss_chars += len(under)
                self.loss.update(under.encode("utf-8", "surrogatepass"))

    def row(self, conv) -> tuple:
        if self.reader.held:
            raise ValueError("a conversation ends inside a turn")
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def _digests(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, out = ..., None, []
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])
            out.clear()
            return made

        for batch in batches:
            for c, text, trained, ok in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "text", "loss", "valid")), strict=True):
                if c != conv:
                    if digest:
                        out.append(digest.row(conv))
                    conv, digest = c, _Digest(template)
                digest.add(text, trained, ok)
            yield batch_of()
        if digest:
            out.append(digest.row(conv))
        yield batch_of()

    return run


def digests(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What a conversation's segments, joined, say when that text is read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and
    whether all turns were in order.  Turns come from the text, and what is trained on from its places; where segments begin and end tells nothing else."""
    return segments.mapInArrow(_digests(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def sql(template: Template = TEMPLATE) -> str:
    """DuckDB SQL for the query, over the view conversations."""
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    marks = "|".join(re.sub(r"([\[\]|/])", r"\\\1", m) for m in template.marks())
    # every control string inside a text costs one character, and so does every backslash
    extra = f"len(regexp_extract_all(text, {quote(marks)})) + length(text) - length(replace(text, chr(92), ''))"
    known = " ".join(f"WHEN {quote(n)} THEN {len(r.before) + len(r.after)}" for n, r in template.roles.items())
    follows = " OR ".join(f"(role = {quote(n)} AND before IN ({', '.join(map(quote, f))}))" for n, f in template.follows.items())
    trained = ", ".join(quote(n) for n, r in template.roles.items() if r.loss)
    role_extra = extra.replace("text", "role")
    return f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t AS (SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows_)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role IN ({trained})), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role IN ({trained})), '')) AS loss_sha256,
  sum(length(text) + {extra} + CASE role {known} ELSE {sum(map(len, template.other))} + length(role) + {role_extra} END)::BIGINT AS formatted_chars,
  bool_and({follows}) AS valid
FROM t GROUP BY conv_id"""
