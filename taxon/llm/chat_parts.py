"""Chat formatting of typed content parts.

A turn holds an array of parts: text, image, audio or document. A visitor, one column function for each
kind, turns a part into its place in the text, an attachment reference and the number of tokens that it
will expand to. Turns are rendered one by one, and a conversation is put together from its rendered
turns, with the spans of assistant text under the loss mask. ``read_back`` undoes the template.

Template: ``<|turn|>role\\n`` content ``<|end|>`` for each turn. A string inside a text that reads like a
control string gets a word joiner after its first character, one more if it already has some, so that
removing one restores it. A newline in a role is written %0A, a percent sign %25.

Defined results: a null text or role is empty; a null or empty array of parts is an empty turn; a part of
an unknown kind is text if it has text, else an attachment that expands to nothing. Turns go by number,
null last, then by role and content; repeated rows are turns of their own. A null conversation id is a
conversation of its own. Columns other than the named ones are ignored. A conversation is one sequence,
so one row holds its text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<turn:bigint,part:int,kind:string,uri:string,tokens:bigint>>"
TURN, END, JOINER = "<|turn|>", "<|end|>", "⁠"
#: What follows the first character, < or [, of a control string.
CONTROL = r"\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]"


@dataclass(frozen=True)
class Expansion:
    """Documented parameters: how many tokens attachments expand to."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 256
    bytes_per_token: float = 4.0


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])({JOINER}*)(?={CONTROL})", f"$1$2{JOINER}")


def unescape(text: str) -> str:
    return re.sub(f"([<\\[]){JOINER}({JOINER}*)(?={CONTROL})", r"\1\2", text)


def _visit(part: Column, rendered: Column, attached: Column | None, tokens: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        rendered.alias("rendered"), (none if attached is None else attached).alias("kind"),
        (none if attached is None else part["uri"]).alias("uri"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"),
    )


def visit_text(part: Column, e: Expansion) -> Column:
    text = F.coalesce(part["text"], F.lit(""))
    return _visit(part, escape(text), None, F.ceil(F.octet_length(text) / e.bytes_per_token))


def visit_image(part: Column, e: Expansion) -> Column:
    return _visit(part, F.lit("<|image|>"), F.lit("image"), F.ceil(part["width"] / e.patch) * F.ceil(part["height"] / e.patch))


def visit_audio(part: Column, e: Expansion) -> Column:
    return _visit(part, F.lit("<|audio|>"), F.lit("audio"), F.ceil(part["seconds"] * e.per_second))


def visit_document(part: Column, e: Expansion) -> Column:
    return _visit(part, F.lit("<|document|>"), F.lit("document"), part["pages"] * e.per_page)


def visit_unknown(part: Column, e: Expansion) -> Column:
    return F.when(part["text"].isNotNull(), visit_text(part, e)).otherwise(
        _visit(part, F.lit("<|attachment|>"), F.coalesce(part["kind"], F.lit("unknown")), F.lit(0))
    )


VISITORS = {"text": visit_text, "image": visit_image, "audio": visit_audio, "document": visit_document}


def accept(part: Column, e: Expansion) -> Column:
    """The part as its visitor renders it."""
    out = visit_unknown(part, e)
    for kind, visitor in VISITORS.items():
        out = F.when(part["kind"] == kind, visitor(part, e)).otherwise(out)
    return out


def text_parts(text: Column) -> Column:
    """One text part, for tables whose turns hold plain text."""
    none = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    rest = [F.lit(None).cast(kind).alias(name) for name, kind in none.items()]
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *rest))


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    learned: str = "assistant", expansion: Expansion = Expansion(),
) -> DataFrame:
    """``conv_id, n_turns, formatted, loss_spans, attachments, n_tokens`` of each conversation.

    Spans are code points of ``formatted``, end excluded. ``n_tokens`` estimates the expanded length.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(parts), F.array().cast(PARTS)).alias("parts"),
    ).withColumn("seen", F.transform("parts", lambda p: accept(p, expansion)))
    name = F.replace(F.replace(escape(F.col("role")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    rendered = rows.select(
        "conv_id", "turn", "role",
        F.concat(F.lit(TURN), name, F.lit("\n")).alias("head"),
        F.array_join(F.transform("seen", lambda s: s["rendered"]), "").alias("body"),
        F.aggregate("seen", F.lit(0).cast("long"), lambda n, s: n + s["tokens"]).alias("tokens"),
        F.filter(
            F.transform("seen", lambda s, i: F.struct(F.col("turn").alias("turn"), i.cast("int").alias("part"), s["kind"].alias("kind"), s["uri"].alias("uri"), s["tokens"].alias("tokens"))),
            lambda a: a["kind"].isNotNull(),
        ).alias("attached"),
    )
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("body")]
    window = Window.partitionBy("conv_id").orderBy(*order)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.length("head") + F.length("body") + len(END)
    placed = rendered.withColumns({"nr": F.row_number().over(window), "at": F.coalesce(F.sum(whole).over(before), F.lit(0))})
    start = F.col("at") + F.length("head")
    span = F.when(F.col("role") == learned, F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    one = F.struct("nr", F.concat("head", "body", F.lit(END)).alias("text"), span.alias("span"), "attached")
    gathered = placed.withColumn("one", one).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("all"), F.sum("tokens").alias("n_tokens"))
    return gathered.select(
        "conv_id",
        F.size("all").cast("long").alias("n_turns"),
        F.array_join(F.col("all.text"), "").alias("formatted"),
        F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("all.attached")).alias("attachments"),
        "n_tokens",
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    turns = []
    for piece in formatted.split(TURN)[1:]:
        role, _, body = piece.removesuffix(END).partition("\n")
        turns.append((unescape(role.replace("%0A", "\n").replace("%25", "%")), unescape(body)))
    return turns


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, taken from the formatted conversations."""

    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, starts, ends in zip(*batch, strict=True):
                turns = parse(text)
                digest = hashlib.sha256()
                for role, body in turns:
                    digest.update(f"{role}\n{body}\n".encode())
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                rows.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    udf = F.pandas_udf(read, kind)
    found = udf(F.col("formatted"), F.col("loss_spans.start"), F.col("loss_spans.end"))
    return chats.select("conv_id", found.alias("f"), "n_tokens").select("conv_id", "f.*", "n_tokens")
