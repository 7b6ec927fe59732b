"""Chat formatting: a state machine over roles turns conversations into text segments with a loss flag each."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenantlens.llm.common import stage, table

PIECE_CHARS = 1 << 20  # of a formatted conversation in one row; only a longer segment exceeds it
EXTRA_ID = -7
EXTRA_TEXT = r"\### Assistant: </turn> ok"


@dataclass(frozen=True)
class Role:
    name: str  # in the header of its turns
    loss: bool = False
    after: tuple[str, ...] = ()  # roles it may follow; "" is the start


@dataclass(frozen=True)
class Template:
    """What marks a turn, who may follow whom, and whose text is trained on.

    A turn is ``opens``, the role's name, ``names``, the text, ``closes``. In a
    text, the first character of each control string becomes the escape and a
    letter, and the escape itself is doubled, so that no control string is left
    and unescaping restores the text. A role that the template lacks is written
    as ``other`` and its own, escaped name; it is never trained on.
    """

    roles: dict[str, Role] = field(default_factory=lambda: {
        "system": Role("System", after=("",)),
        "user": Role("User", after=("", "system", "assistant")),
        "assistant": Role("Assistant", loss=True, after=("user",))})
    opens: str = "### "
    names: str = ": "
    closes: str = "</turn>\n"
    other: str = "?"
    controls: tuple[str, ...] = ("###", "</turn>")
    escape: str = "\\"

    def __post_init__(self):
        assert self.opens.startswith(self.controls) and self.closes.startswith(self.controls) and not any(self.escape in c for c in self.controls)
        assert not any(r.name.startswith(self.other) or self.names in r.name for r in self.roles.values())
        codes = {c: chr(ord("a") + i) for i, c in enumerate(sorted({c[0] for c in self.controls} | {self.names[0]}))}
        begins = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        put = object.__setattr__
        put(self, "_codes", codes)
        put(self, "_letters", {v: k for k, v in codes.items()} | {self.escape: self.escape})
        put(self, "_unsafe", re.compile(f"{re.escape(self.escape)}|{begins}"))
        put(self, "_unsafe_name", re.compile(f"{re.escape(self.escape)}|{begins}|{re.escape(self.names[0])}"))
        put(self, "_escaped", re.compile(f"{re.escape(self.escape)}(.)", re.DOTALL))
        put(self, "_by_name", {r.name: key for key, r in self.roles.items()})

    def quote(self, text: str, *, name: bool = False) -> str:
        pattern = self._unsafe_name if name else self._unsafe
        return pattern.sub(lambda m: self.escape + self._codes.get(m[0], self.escape), text)

    def unquote(self, text: str) -> str:
        return self._escaped.sub(lambda m: self._letters[m[1]], text)

    def header(self, role: str) -> str:
        known = self.roles.get(role)
        return self.opens + (known.name if known else self.other + self.quote(role, name=True)) + self.names

    def role_of(self, name: str) -> str:
        return self.unquote(name[len(self.other):]) if name.startswith(self.other) else self._by_name[name]

    def follows(self, state: str | None, role: str) -> str | None:
        """Next state of the machine: the role, or None (for good) where its turn is out of order."""
        known = self.roles.get(role)
        return role if state is not None and known and state in known.after else None


def format_turns(turns: DataFrame, template: Template = Template(), *, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Formatted conversations: conv_id, piece (from 0), segments (array of text, loss), bad_turns.

    The text of a conversation is that of its segments, pieces in order. Turns
    ascend by ``turn`` (nulls first), then role and text. A null text or role is
    empty. Every turn is written, repeated rows too; ``bad_turns`` counts the
    turns of the piece from the first that the machine does not accept. Rows
    without conv_id are one conversation. An empty table gives an empty
    result. A conversation is read as a stream, so a task holds one piece of it.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started, conv, piece, size, segments, state, bad = False, None, 0, 0, [], "", 0
        ready, held = [], 0
        for batch in batches:
            for c, role, text in zip(batch["conv"], batch["role"], batch["text"]):
                new = not started or c != conv
                role, text = role or "", template.quote(text or "")
                if segments and (new or size + len(text) > piece_chars):
                    ready.append((conv, piece, segments, bad))
                    held += size
                    piece, size, segments, bad = piece + 1, 0, [], 0
                    if held > piece_chars:
                        yield pd.DataFrame(ready, columns=names)
                        ready, held = [], 0
                if new:
                    started, conv, piece, state = True, c, 0, ""
                state = template.follows(state, role)
                bad += state is None
                known = template.roles.get(role)
                head = template.header(role)
                segments += [(head, False), (text, bool(known and known.loss)), (template.closes, False)]
                size += len(head) + len(text) + len(template.closes)
        if segments:
            ready.append((conv, piece, segments, bad))
        yield pd.DataFrame(ready, columns=names)

    names = ["conv", "piece", "segments", "bad_turns"]
    kind = turns.schema["conv_id"].dataType
    # ids travel as text; "-" before an id tells it from no id
    rows = turns.select(F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("-"), F.col("conv_id").cast("string"))).alias("conv"), "turn", "role", "text")
    made = (rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
            .mapInPandas(run, "conv string, piece int, segments array<struct<text:string,loss:boolean>>, bad_turns int"))
    return made.select(F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id"), "piece", "segments", "bad_turns")


class Reader:
    """Reads one conversation back from its segments, using their joined text and the loss mask alone."""

    def __init__(self, template: Template):
        self.t, self.turns, self.chars, self.loss_chars = template, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def piece(self, segments) -> None:
        t, text = self.t, "".join(s["text"] for s in segments)
        at, trained = 0, []
        for s in segments:
            if s["loss"]:
                trained.append(s["text"])
            at += len(s["text"])
        self.chars += at
        kept = t.unquote("".join(trained))
        self.loss.update(kept.encode())
        self.loss_chars += len(kept)
        at = 0
        while at < len(text):
            assert text.startswith(t.opens, at)
            colon = text.index(t.names, at + len(t.opens))
            stop = text.index(t.closes, colon + len(t.names))
            role, body = t.role_of(text[at + len(t.opens):colon]), t.unquote(text[colon + len(t.names):stop])
            self.all.update(f"{role}\n{body}\n".encode())
            self.turns += 1
            at = stop + len(t.closes)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid of each formatted conversation.

    Turns are found in the text by the template's marks, trained text by the
    mask; both are unescaped. ``valid`` if the machine accepted every turn.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started, conv, reader, bad, done = False, None, None, 0, []

        def close():
            done.append((conv, reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars, bad == 0))
        for batch in batches:
            for c, segments, wrong in zip(batch["conv"], batch["segments"], batch["bad_turns"]):
                if not started or c != conv:
                    if started:
                        close()
                    started, conv, reader, bad = True, c, Reader(template), 0
                reader.piece(segments)
                bad += wrong
            yield pd.DataFrame(done, columns=names)
            done.clear()
        if started:
            close()
            yield pd.DataFrame(done, columns=names)

    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kind = formatted.schema["conv_id"].dataType
    rows = formatted.select(F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("-"), F.col("conv_id").cast("string"))).alias("conv"), "piece", "segments", "bad_turns")
    made = (rows.repartition("conv").sortWithinPartitions("conv", "piece")
            .mapInPandas(run, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"))
    return made.select(F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id"), *names[1:])


def op12_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, "assistant", EXTRA_TEXT)], turns.schema)
    return read_back(stage(format_turns(turns.unionByName(extra))))


QUERIES = {"op12_chat_template": op12_chat_template}

ORACLES = {"op12_chat_template": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(turn, role)),
w AS (SELECT *, length('### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' END || ': ' || '</turn>' || chr(10))
    + length(text) + length(replace(text, '\', '\\')) - length(text) + length(replace(text, '</turn>', '\c/turn>')) - length(text)
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS shown,
    lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars,
  bool_and((role = 'system' AND before = '') OR (role = 'user' AND before IN ('', 'system', 'assistant')) OR (role = 'assistant' AND before = 'user')) AS valid
FROM w GROUP BY conv_id"""}
