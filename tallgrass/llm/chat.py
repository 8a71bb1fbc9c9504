"""Chat formatting from event logs: fold events into final messages, render a template, read it back.

An event log has the columns conv_id, message (any orderable value; messages of a conversation follow its order), seq
(order of the events of one message), kind, role and text. Kinds: `open` gives the message its role, `delta` appends
streamed text, `edit` replaces all text so far, `regenerate` throws all text so far away, `delete` takes the message
out. Events are partitioned by conversation and message, so that one huge conversation spreads over many tasks, then
sorted by sequence and folded with array functions.

The template is `<|im_start|>role LF text <|im_end|> LF` per message. Within texts and roles a backslash becomes two and
`<|` becomes `<\\|`, so that no control string can occur inside a text and the escape can be undone; a line feed
within a role becomes backslash n. The loss mask covers the texts of the role `assistant`.

The rendered table has one row per message; a conversation's output is its rows in order, put end to end. `read_back`
knows nothing of rows: it scans that output for unescaped control strings and takes turns and the mask's text from what
it finds. It streams sorted partitions and holds one turn and the hash states of one conversation, whatever the
conversation's length. Output that is not a sequence of turns raises a ValueError.

Defined cases: null texts and roles count as empty; a null kind is ignored; a null conv_id is a conversation of its
own; events of one message with equal seq are ordered by kind, role and text; repeated events apply again; a message
without `open` has the empty role; an empty log gives empty tables; extra columns of the log are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LEARNED = "<|im_start|>", "<|im_end|>", "assistant"


def events_of_turns(turns: DataFrame) -> DataFrame:
    """An event log of plain turns (conv_id, turn, role, text), as a chat service would have streamed them.

    Every row opens a message; a draft is streamed and then thrown away (by `regenerate` for the learned role, by
    `edit` for others), and the text follows in two deltas. Equal rows stay separate messages.
    """
    t = F.coalesce("text", F.lit(""))
    half = (F.length(t) / 2).cast("int")
    rows = (
        turns.groupBy("conv_id", "turn", "role", "text").count()
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    )
    event = lambda k, kind, text: F.struct(F.lit(k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    redo = F.when(F.col("role") == LEARNED, event(2, "regenerate", F.lit(""))).otherwise(event(2, "edit", F.lit("")))
    log = F.array(
        event(0, "open", F.lit("")),
        event(1, "delta", F.reverse(F.substring(t, 1, 16))),
        redo,
        event(3, "delta", F.substring(t, F.lit(1), half)),
        event(4, "delta", F.substring(t, half + 1, F.length(t))),
    )
    part = F.sha2(F.concat_ws("\n", F.coalesce("role", F.lit("")), t), 256)
    return rows.select(
        "conv_id", F.struct("turn", part.alias("part"), "copy").alias("message"), "role", F.explode(log).alias("e")
    ).select("conv_id", "message", "e.seq", "e.kind", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of an event log."""
    e = events.select("conv_id", "message", F.struct("seq", "kind", "role", "text").alias("e"))
    e = e.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list("e")).alias("log"))
    numbered = F.transform("log", lambda x, i: F.struct(i.alias("i"), x.kind.alias("kind"), x.role.alias("role"), x.text.alias("text")))
    e = e.withColumn("log", numbered)
    e = e.withColumn("reset", F.coalesce(F.array_max(F.filter("log", lambda x: x.kind.isin("edit", "regenerate")).i), F.lit(-1)))
    kept = F.filter("log", lambda x: ((x.kind == "delta") & (x.i > F.col("reset"))) | ((x.kind == "edit") & (x.i == F.col("reset"))))
    return e.where(~F.coalesce(F.exists("log", lambda x: x.kind == "delete"), F.lit(False))).select(
        "conv_id",
        "message",
        F.coalesce(F.try_element_at(F.filter("log", lambda x: x.kind == "open"), F.lit(1)).role, F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda x: F.coalesce(x.text, F.lit(""))), "").alias("text"),
    )


def escaped(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def render(messages: DataFrame) -> DataFrame:
    """Adds `formatted`, the message's part of its conversation's output, and the span of it that the loss covers.

    loss_from and loss_to are code point offsets within `formatted` (end exclusive), null outside the learned role.
    """
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    learned = F.col("role") == LEARNED
    return messages.select(
        "conv_id",
        "message",
        F.concat(head, body, F.lit(END + "\n")).alias("formatted"),
        F.when(learned, F.length(head)).alias("loss_from"),
        F.when(learned, F.length(head) + F.length(body)).alias("loss_to"),
    )


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


READ_BACK = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


class Scanner:
    """Reads a conversation's output piece by piece: turns, and the text under the loss mask."""

    def __init__(self, conv):
        self.conv, self.rest, self.at, self.due = conv, "", 0, []
        self.turns, self.chars, self.said, self.learned = 0, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, a: int | None, z: int | None) -> None:
        """More output, and the span of it under the mask."""
        if a is not None:
            self.due.append((self.at + len(self.rest) + a, self.at + len(self.rest) + z))
        self.rest += text
        done = 0
        while (end := self.turn(done)) is not None:
            self.mask(end)
            done = end
        self.at, self.rest = self.at + done, self.rest[done:]

    def turn(self, start: int) -> int | None:
        """Reads the turn at a place; where it ends, or None if its end is not there yet."""
        if not self.rest.startswith(START, start):
            if len(self.rest) - start < len(START) and START.startswith(self.rest[start:]):
                return None
            raise ValueError(f"no turn at character {self.at + start} of conversation {self.conv}")
        head = self.rest.find("\n", start)
        mark = self.rest.find("<|", head) if head >= 0 else -1
        stop = mark + len(END) + 1
        if mark < 0 or len(self.rest) < stop:
            return None
        if not self.rest.startswith(END + "\n", mark):
            raise ValueError(f"a control string at character {self.at + mark} of conversation {self.conv}")
        self.turns += 1
        role, body = self.rest[start + len(START) : head], self.rest[head + 1 : mark]
        self.said.update(f"{unescaped(role)}\n{unescaped(body)}\n".encode())
        return stop

    def mask(self, end: int) -> None:
        """Takes the masked text of a turn that has been read."""
        while self.due and self.due[0][0] < self.at + end:
            a, z = self.due.pop(0)
            learned = unescaped(self.rest[a - self.at : z - self.at])
            self.chars += len(learned)
            self.learned.update(learned.encode())

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.conv} ends within a turn")
        return self.conv, self.turns, self.said.hexdigest(), self.chars, self.learned.hexdigest(), self.at


def read_back(rendered: DataFrame) -> DataFrame:
    """Scans the rendered output and returns one row of digests per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            out = []
            for conv, text, a, z in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = Scanner(conv)
                now.add(text, a, z)
            yield table(out)
        if now is not None:
            yield table([now.row()])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in READ_BACK.split(", ")])

    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "message")
    return ordered.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(run, READ_BACK)
