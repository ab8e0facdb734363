"""Chat formatting: typed content parts flattened into one marked string per conversation.

A conversation becomes ``<|turn|>role\\nbody<|end|>\\n`` per turn. A visitor renders every part of a turn: text with its
control strings escaped, and attachments as numbered placeholders such as ``<|image:0|>``. Everything is a column
expression.

Defined cases: a null role, text, part list or part type is empty; a part of an unknown type renders as its text; a null
turn sorts first; rows that agree in turn are ordered by role and body, and repeated rows all stay; a null conversation id
is one conversation; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
KINDS = ("image", "audio", "document")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
# A backslash goes before each backslash and into each control string behind its first character.
ESCAPE_AT = r"\\|(?<=[<\[])(?=\||/?s>|/?INST\]|/?SYS>>|</?SYS>>)"
PLACEHOLDER = r"<\|(image|audio|document):\d+\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE_AT, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A part list that holds one text."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    nulls = [F.lit(None).cast(kind).alias(name) for name, kind in none.items()]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *nulls))


def expanded_tokens(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens a placeholder stands for: image patches, audio frames or document pages; a missing size counts as one."""
    side = lambda n: F.ceil(F.greatest(F.coalesce(part[n], F.lit(1)), F.lit(1)) / F.lit(patch))
    return (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * audio_rate))
        .otherwise(F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * page_tokens)
        .cast("long")
    )


def visit(parts: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """``struct<body, attachments>`` of one turn; placeholders are numbered within the turn."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    # Compared null-safely: a part of null type is text.
    is_attachment = lambda p: F.coalesce(p["type"].isin(*KINDS), F.lit(False))
    attachments = F.transform(
        F.filter(parts, is_attachment),
        lambda p, i: F.struct(
            i.alias("ordinal"), p["type"].alias("kind"), p["ref"].alias("ref"),
            expanded_tokens(p, patch, audio_rate, page_tokens).alias("tokens"),
        ),
    )
    number = lambda i: F.size(F.filter(F.slice(parts, 1, i), is_attachment)).cast("string")
    rendered = F.transform(
        parts,
        lambda p, i: F.when(is_attachment(p), F.concat(F.lit("<|"), p["type"], F.lit(":"), number(i), F.lit("|>")))
        .otherwise(escape(F.coalesce(p["text"], F.lit("")))),
    )
    return F.struct(F.array_join(rendered, "").alias("body"), attachments.alias("attachments"))


def format_conversations(
    turns: DataFrame, parts: str = "parts", patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 1024,
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation from rows ``conv_id, turn, role, <parts>``.

    ``formatted``; ``loss``: per turn under the mask its number, its start in ``formatted`` and in the turn's piece, and
    its length, in code points; ``attachments`` with turn, ordinal, kind, reference and expanded tokens;
    ``attachment_tokens``. Offsets are running sums over the turns, so a long conversation costs no more per turn.
    """
    seen = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        visit(F.col(parts), patch, audio_rate, page_tokens).alias("_v"),
    ).select("conv_id", "turn", "role", "_v.*")
    # A role holds no line end or mark once it is percent-encoded.
    head = F.concat(F.lit(TURN), F.url_encode("role"), F.lit("\n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    pieces = seen.withColumns({"piece": F.concat(head, "body", F.lit(END)), "head_chars": F.length(head)}).withColumns({
        "number": F.row_number().over(order),
        "start": F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    under_mask = F.when(
        (F.col("role") == loss_role) & (F.length("body") > 0),
        F.struct("number", (F.col("start") + F.col("head_chars")).alias("start"),
                 F.col("head_chars").alias("offset"), F.length("body").alias("length")),
    )
    references = F.transform("attachments", lambda a: F.struct(
        F.col("number").alias("turn"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"),
        a["tokens"].alias("tokens")))
    grouped = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "piece"))).alias("_pieces"),
        F.array_sort(F.collect_list(under_mask)).alias("loss"),
        F.flatten(F.collect_list(references)).alias("attachments"),
    )
    return grouped.select(
        "conv_id", F.array_join(F.transform("_pieces", lambda p: p["piece"]), "").alias("formatted"), "loss",
        F.array_sort("attachments").alias("attachments"),
        F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, body, text>>`` of a formatted conversation; ``text`` is unescaped and without placeholders."""
    pieces = F.split(formatted, r"<\|turn\|>")
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        code = F.substring_index(piece, "\n", 1)
        body = piece.substr(F.length(code) + 2, F.length(piece) - F.length(code) - 1 - len(END))
        return F.struct(F.url_decode(code).alias("role"), body.alias("body"),
                        unescape(F.regexp_replace(body, PLACEHOLDER, "")).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped and joined; cut by offsets, piece by piece."""
    pieces = F.split(formatted, r"<\|turn\|>")
    cut = lambda s: F.element_at(pieces, s["number"] + 1).substr(s["offset"] - len(TURN) + 1, s["length"])
    return F.array_join(F.transform(loss, lambda s: unescape(F.regexp_replace(cut(s), PLACEHOLDER, ""))), "")
