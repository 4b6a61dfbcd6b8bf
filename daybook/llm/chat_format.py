"""Chat formatting from an event log: fold the events of each message, then render each conversation.

Events of a message: ``start`` opens it with a role, ``delta`` appends text, ``edit`` replaces the text, ``regenerate``
takes it back to empty before new deltas. They carry a sequence number; an event delivered twice counts once.
Messages are folded first, by (conversation, message), so a conversation with very many events is folded by many tasks;
then its finished messages, and only those, meet in sequence to be rendered into its one text.

The template marks turns by control strings. Inside roles and texts the first character of any control string, of this
template or another common one, is written as a code, and so is the escape character, so nothing in a text can open or
close a turn, and all of it can be read back.

Defined cases: a NULL text is empty, a NULL role an empty role; a message without ``start`` has an empty role; a message
whose events add up to nothing is an empty turn; NULL conversation ids are one conversation; rows that repeat are turns of
their own; turns of the same number are ordered by role and text; an empty table gives an empty result; other columns are
ignored. A conversation's text is one value and must fit a row (2 GB).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common templates; none is a prefix of another
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
DELTA_CHARS = 512
ESCAPED = re.compile("|".join([r"\\", *[f"{re.escape(a)}(?={'|'.join(re.escape(c[1:]) for c in CONTROL if c[0] == a)})" for a in "<["]]))
CODED = re.compile(r"\\(\\|[0-9a-f]{2})")
TURN = re.compile(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.DOTALL)


def escape(s: str) -> str:
    return ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"\\{ord(m[0]):02x}", s)


def unescape(s: str) -> str:
    return CODED.sub(lambda m: "\\" if m[1] == "\\" else chr(int(m[1], 16)), s)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The text and its loss mask: start and end, in turn, of each assistant text."""
    out, mask, at = [], [], 0
    for role, text in messages:
        head = f"{START}{escape(role).replace('\n', '\\0a')}\n"
        inner = escape(text)
        if role == "assistant":
            mask += [at + len(head), at + len(head) + len(inner)]
        out.append(f"{head}{inner}{END}\n")
        at += len(out[-1])
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events sorted by conversation, message and sequence into one row per message."""
    names = ["_conv", "_turn", "_order"]
    key, seen, role, parts = None, None, "", []
    for b in batches:
        out = []
        for c, t, o, seq, kind, text in zip(*(b[x] for x in [*names, "_seq", "_kind", "_text"]), strict=True):
            if (c, t, o) != key:
                if key is not None:
                    out.append((*key, role, "".join(parts)))
                key, seen, role, parts = (c, t, o), None, "", []
            if seq == seen:
                continue
            seen = seq
            if kind == "start":
                role = text or ""
            elif kind == "delta":
                parts.append(text or "")
            elif kind == "edit":
                parts = [text or ""]
            elif kind == "regenerate":
                parts = []
        yield pd.DataFrame(out, columns=[*names, "role", "text"])
    if key is not None:
        yield pd.DataFrame([(*key, role, "".join(parts))], columns=[*names, "role", "text"])


def rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Messages sorted by conversation and place into one row per conversation."""

    def done(key, messages):
        text, mask = render(messages)
        return pd.DataFrame({"_conv": [key], "n_turns": [len(messages)], "formatted": [text], "mask": [mask]})

    key, messages = None, []
    for b in batches:
        for c, role, text in zip(b["_conv"], b["role"], b["text"], strict=True):
            if c != key:
                if messages:
                    yield done(key, messages)
                key, messages = c, []
            messages.append((role, text))
    if messages:
        yield done(key, messages)


def conv_key(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def format_events(events: DataFrame) -> DataFrame:
    """``events``: conv_id, turn (long), message (tells apart messages of one turn), seq, kind, text. Gives conv_id, n_turns,
    formatted and mask, one row per conversation."""
    kind = events.schema["conv_id"].dataType
    turn = F.when(F.col("turn").isNull(), F.lit(-(2**63))).otherwise(F.col("turn"))
    e = events.select(conv_key(F.col("conv_id")).alias("_conv"), turn.alias("_turn"), F.col("message").cast("long").alias("_order"), F.col("seq").alias("_seq"), F.col("kind").alias("_kind"), F.col("text").alias("_text"))
    by = ["_conv", "_turn", "_order"]
    messages = e.repartition(*by).sortWithinPartitions(*by, "_seq").mapInPandas(fold, "_conv string, _turn long, _order long, role string, text string")
    whole = messages.repartition("_conv").sortWithinPartitions(*by).mapInPandas(rendered, "_conv string, n_turns long, formatted string, mask array<long>")
    conv = F.when(F.col("_conv") != "n", F.substring("_conv", 2, 2**31 - 1)).cast(kind)
    return whole.select(conv.alias("conv_id"), "n_turns", "formatted", "mask")


def events_of(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", delta_chars: int = DELTA_CHARS) -> DataFrame:
    """An event log whose fold gives back ``turns``: texts arrive in deltas; answers are begun, taken back and generated
    again; other turns are sent with a slip and edited."""
    t = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("_role"), F.coalesce(text, F.lit("")).alias("_text")
    )
    t = t.withColumn("message", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("_role", "_text")))
    deltas = F.transform(
        F.sequence(F.lit(0), F.floor(F.length("_text") / delta_chars).cast("int")),
        lambda i: F.struct(F.lit("delta").alias("kind"), F.substring("_text", i * delta_chars + 1, F.lit(delta_chars)).alias("text")),
    )

    def event(kind: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), value.alias("text")))

    start, none = event("start", F.col("_role")), F.lit(None).cast("string")
    answer = F.concat(start, event("delta", F.substring("_text", 1, 80)), event("regenerate", none), deltas)
    other = F.concat(start, event("delta", F.concat(F.substring("_text", 1, 40), F.lit("..."))), event("edit", F.col("_text")))
    log = F.when(F.col("_role") == "assistant", answer).otherwise(other)
    return t.select("conv_id", "turn", "message", F.posexplode(log).alias("seq", "_e")).select("conv_id", "turn", "message", "seq", "_e.kind", "_e.text")


def digests(formatted: DataFrame) -> DataFrame:
    """Read the rendered texts back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        for b in batches:
            out = []
            for c, text, mask in zip(b["_conv"], b["formatted"], b["mask"], strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[x:y]) for x, y in zip(mask[::2], mask[1::2], strict=True))
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((c, len(turns), sha256(told.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType
    src = formatted.select(F.col("conv_id").cast("string").alias("_conv"), "formatted", "mask")
    got = src.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return got.withColumn("conv_id", F.col("conv_id").cast(kind))
