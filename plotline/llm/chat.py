"""Operator 8, chat formatting: a finite-state machine over roles, and a declarative template.

A turn becomes text segments, each with a loss flag: the template's control strings around the escaped text. Control strings
inside texts are escaped with a backslash, as backslashes are, so the turns can be read back from the formatted text alone.
Turns are sorted within their conversation and streamed; no conversation is gathered, whatever its length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around texts, which roles are trained on, and which role may follow which."""

    mark: str = "### "
    titles: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    after_role: str = ":\n"
    end: str = "</turn>"
    between: str = "\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: state -> roles that may come next, each of which is the next state
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepts: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, ("\\", self.mark.strip(), self.end))))

    def escape(self, text: str) -> str:
        return self.controls().sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(rf"\\({self.controls().pattern})", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of one turn. A role without a title is written as a JSON string."""
        title = self.titles.get(role) or json.dumps(role)
        return [(f"{self.mark}{title}{self.after_role}", False), (self.escape(text), role in self.loss_roles), (self.end + self.between, False)]

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """Next state, and whether ``role`` may come in ``state``; a wrong role goes on as if it had been right."""
        return role, role in self.follows.get(state, ())

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of every turn, from the formatted text alone."""
        names = {v: k for k, v in self.titles.items()}
        head = re.compile(rf'{re.escape(self.mark)}({"|".join(map(re.escape, names))}|"(?:[^"\\]|\\.)*"){re.escape(self.after_role)}')
        body = re.compile(rf"\\(?:{self.controls().pattern})|{re.escape(self.end + self.between)}")
        out, at = [], 0
        while at < len(formatted):
            m = head.match(formatted, at)
            if m is None:
                raise ValueError(f"no turn starts at {at}")
            role = names.get(m[1])
            stop = next(x for x in body.finditer(formatted, m.end()) if not x[0].startswith("\\"))
            out.append((json.loads(m[1]) if role is None else role, self.unescape(formatted[m.end() : stop.start()])))
            at = stop.end()
        return out


TURNS = "conv_id string, n int, role string, allowed boolean, last boolean, segments array<struct<text string, loss boolean>>"


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: turns of a conversation together and in order; ties by role and text, nulls first."""
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n (from 0), role, allowed (by the machine), last, segments (text, loss) for every turn, in order.

    Every conversation is formatted; one the machine rejects has a turn with allowed false, or its last turn in a state it does
    not accept. Null roles and texts are empty; turns of a null conv_id are one conversation. An empty table gives no row.
    """
    t = template or Template()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple = ()
        state, n = "", 0
        held: list | None = None  # the row before, until it is known whether it is the last of its conversation
        for pdf in batches:
            out = []
            for conv, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"], strict=True):
                if held is not None:
                    held[4] = (conv,) != now
                    out.append(held)
                if (conv,) != now:
                    now, state, n = (conv,), "", 0
                state, allowed = t.step(state, role)
                held = [conv, n, role, allowed, False, [{"text": a, "loss": b} for a, b in t.segments(role, text)]]
                n += 1
            if out:
                yield _frame(out)
        if held is not None:
            held[4] = True
            yield _frame([held])

    found = ordered(turns).withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(run, TURNS)
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "n", "role", "allowed", "last", "segments"])


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation of ``format_turns``, from conv_id and segments alone.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed for each turn), loss_chars, loss_sha256 (unescaped text under the loss
    mask), formatted_chars, valid (the machine accepts the roles that were read). ``formatted`` is read as it streams, in its order.
    """
    t = template or Template()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        now: tuple = ()
        x: list = []  # turns, digest, characters and digest under the mask, characters, whether every turn was allowed, state

        def row() -> tuple:
            return (*now, x[0], x[1].hexdigest(), x[2], x[3].hexdigest(), x[4], x[5] and x[6] in t.accepts)

        for pdf in batches:
            out = []
            for conv, segments in zip(pdf["conv_id"], pdf["segments"], strict=True):
                if (conv,) != now:
                    if now:
                        out.append(row())
                    now, x = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, ""]
                for role, text in t.parse("".join(s["text"] for s in segments)):
                    x[0] += 1
                    x[1].update(f"{role}\n{text}\n".encode())
                    x[6], allowed = t.step(x[6], role)
                    x[5] = x[5] and allowed
                for s in segments:
                    x[4] += len(s["text"])
                    if s["loss"]:
                        text = t.unescape(s["text"])
                        x[2] += len(text)
                        x[3].update(text.encode())
            if out:
                yield pd.DataFrame(out, columns=names)
        if now:
            yield pd.DataFrame([row()], columns=names)

    found = formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "segments").mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))
