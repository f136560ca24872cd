"""Chat formatting with typed content parts.

A turn's content is a list of parts: ``type`` (text, image, audio or document), ``text``, ``ref`` (where the attachment lies) and ``size``
(pixels, seconds or pages). A visitor flattens the parts in order: text as it is, with control strings escaped; every attachment as the
placeholder of its type, its reference and the number of tokens that it will expand to recorded beside it. Turns become

    <|im_start|>role LF content <|im_end|> LF

and content of assistants lies under the loss mask, one stretch per turn, given as offsets in the turn's own text.

Escaping: a backslash is put between ``<`` and ``|``, and one more where backslashes stand there already, so unescaping takes one away
again; backslashes and line feeds in a role are written ``\\\\`` and ``\\n``. Turns stay rows, so no conversation is ever gathered; digests
stream over rows sorted by conversation and turn.

Null texts and roles are empty, parts of an unknown type are left out, a turn without parts has empty content. Ties in ``turn`` follow
role, then text. Rows without a conversation id are one conversation. Repeated rows are repeated turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens of an attachment: units of its size per token.
PIXELS_PER_TOKEN, SECONDS_PER_TOKEN, TOKENS_PER_PAGE = 784, 0.04, 256
PARTS = "array<struct<type:string,text:string,ref:string,size:double>>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    return escaped(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def expanded_tokens(part: Column) -> Column:
    size = F.greatest(F.coalesce(part["size"], F.lit(0.0)), F.lit(0.0))
    return (
        F.when(part["type"] == "image", F.ceil(size / PIXELS_PER_TOKEN))
        .when(part["type"] == "audio", F.ceil(size / SECONDS_PER_TOKEN))
        .when(part["type"] == "document", F.ceil(size) * TOKENS_PER_PAGE)
    )


def format_turns(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, parts)`` as ``conv_id, turn, role, formatted, loss_start, loss_end, attachments``.

    ``loss_start`` and ``loss_end`` are code points in ``formatted`` (null: not learned from). ``attachments`` has type, ref, the number of
    placeholders before it and its expanded tokens. Texts of parts are escaped, so their strings are never placeholders or marks.
    """
    shown = visitor(lambda p: escaped(F.coalesce(p["text"], F.lit(""))))
    known = F.filter("parts", lambda p: p["type"].isin("text", *PLACEHOLDERS))
    attached = F.filter(known, lambda p: p["type"] != "text")
    content = F.coalesce(F.array_join(F.transform(known, shown), ""), F.lit(""))
    head = F.concat(F.lit(START), escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), content.alias("content"), attached.alias("attached"))
    loss = F.col("role") == "assistant"
    return rows.select(
        "conv_id",
        "turn",
        "role",
        F.concat("head", "content", F.lit(END + "\n")).alias("formatted"),
        F.when(loss, F.length("head")).alias("loss_start"),
        F.when(loss, F.length("head") + F.length("content")).alias("loss_end"),
        F.transform("attached", lambda p, i: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), i.alias("placeholder"), expanded_tokens(p).alias("tokens"))).alias("attachments"),
    )


def visitor(text: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A part to what stands for it in the content; ``text`` says it for text parts."""

    def visit(part: Column) -> Column:
        shown = F.when(part["type"] == "text", text(part))
        for kind, placeholder in PLACEHOLDERS.items():
            shown = shown.when(part["type"] == kind, F.lit(placeholder))
        return shown

    return visit


def _conversation_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn: everything is read back from the formatted text; one conversation's digests are open."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    done: list[tuple] = []
    state = None

    def close() -> None:
        if state:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    def given() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)
        done.clear()
        return batch

    for batch in batches:
        for key, text, low, high in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            if state is None or state[0] != key:
                close()
                state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, content = TURN.fullmatch(text).groups()
            state[1] += 1
            state[2].update(f"{unescape_role(role)}\n{unescape(content)}\n".encode())
            if low is not None:
                learned = unescape(text[low:high])
                state[3] += len(learned)
                state[4].update(learned.encode())
            state[5] += len(text)
        if done:
            yield given()
    close()
    if done:
        yield given()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what can be read back from its formatted turns, in order of turn, role and text (as it was before escaping)."""
    first, last = F.instr("formatted", "\n") + 1, F.length("formatted") - len(END + "\n")
    content = F.substr("formatted", first, last - first + 1)
    text = F.regexp_replace(content, r"<\\(\\*)\|", "<$1|")
    rows = formatted.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end", text.alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("text")
    return ordered.mapInArrow(_conversation_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
