"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that turn's text
trainable. A turn is written `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts a backslash is
doubled and `<|` becomes `<\\|`, so no control string can arise from a text, and reading undoes it exactly.

A conversation's rows are brought together, sorted by turn, and streamed: one conversation's prefix is held at
a time, and examples leave in batches of bounded size. A conversation that does not end with an assistant turn
has a last example without a target, so that no row is lost. The examples of a conversation hold about half
the square of its turns; that is the expansion itself.

Edge cases: null texts and roles are empty; null turns come first; rows of one turn are ordered by role, then
text; the role `assistant` is matched as it is; an empty table gives no rows; further columns are not looked
at; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
#: Characters of examples in a batch that leaves a task, about.
CHARS = 1 << 21
EXAMPLE = "conv_id long, example int, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\\||\\\\", lambda m: "<|" if m[0] == "<\\|" else "\\", text)


def escape_role(role: str) -> str:
    """A role stands on one line: its line feeds are written as `\\n`, after the escapes of texts."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"<\\\||\\\\|\\n", lambda m: {"<\\|": "<|", "\\\\": "\\", "\\n": "\n"}[m[0]], role)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example; ValueError if it is not one."""
    found, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("a turn does not start")
        head = text.index("\n", at)
        end = text.index("<|", head)
        if not text.startswith(END, end):
            raise ValueError("a turn does not end")
        found.append((unescape_role(text[at + len(START) : head]), unescape(text[head + 1 : end])))
        at = end + len(END)
    return found


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    held, now, prefix, number, target = 0, None, "", 0, True

    def finish() -> None:
        if now is not None and not target:
            rows.append((now[0], number, prefix, len(prefix), len(prefix)))

    for batch in batches:
        for conv, missing, role, text in zip(batch["conv_id"], batch["_none"], batch["role"], batch["text"], strict=True):
            key = (None if missing else int(conv),)
            if key != now:
                finish()
                now, prefix, number, target = key, "", 0, True
            turn, start, end = turn_text(role, text)
            at = len(prefix)
            prefix += turn
            target = role == ASSISTANT
            if target:
                rows.append((now[0], number, prefix, at + start, at + end))
                number += 1
                held += len(prefix)
            if held > CHARS:
                yield _frame(rows)
                rows, held = [], 0
    finish()
    if rows:
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "example", "text", "loss_start", "loss_end"])
    return out.assign(conv_id=out["conv_id"].astype("Int64"))


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end (code points of the trainable text).

    The rows of a conversation leave one task, in order.
    """
    arrow_limits(conversations.sparkSession)
    rows = conversations.select("conv_id", F.col("conv_id").isNull().alias("_none"), F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("conv_id", F.coalesce("conv_id", F.lit(0))).repartition("conv_id", "_none").sortWithinPartitions("_none", "conv_id", "turn", "role", "text")
    return rows.mapInPandas(_examples, EXAMPLE)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a conversation, all of it read back from its examples."""
    out: list[tuple] = []
    now, last, loss, loss_chars, chars = None, "", None, 0, 0

    def finish() -> None:
        turns = hashlib.sha256()
        n = 0
        for role, text in read_turns(last):
            turns.update(f"{role}\n{text}\n".encode())
            n += 1
        out.append((now[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for batch in batches:
        for conv, text, start, end in zip(batch["conv_id"], batch["text"], batch["loss_start"], batch["loss_end"], strict=True):
            key = (None if pd.isna(conv) else int(conv),)
            if key != now:
                if now is not None:
                    finish()
                now, loss, loss_chars, chars = key, hashlib.sha256(), 0, 0
            own = unescape(text[start:end])
            loss.update(own.encode())
            loss_chars += len(own)
            chars += len(text)
            last = text
        if len(out) >= 1000:
            yield _digests(out)
            out = []
    if now is not None:
        finish()
    if out:
        yield _digests(out)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return out.assign(conv_id=out["conv_id"].astype("Int64"))


def digests(examples: DataFrame) -> DataFrame:
    """What the examples of `expand` hold, one row a conversation; they must come as `expand` gives them."""
    return examples.mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
