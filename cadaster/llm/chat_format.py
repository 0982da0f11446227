"""Operator 1: chat formatting, in Spark expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of one role become one
message, and messages are concatenated:

    <s>[role]text<|turn|>text of the same role</s>[role]text</s>

`<s>[`, `]`, `<|turn|>` and `</s>` mark turns. Inside texts and roles a backslash is doubled and each
control string gets a backslash after its first character, so no control string is left in them and
one pass over the backslashes undoes it.

Edge cases: a null text is empty; a null role is an empty role; turns are ordered by (turn, role,
text), nulls first, so ties have one order; a null conv_id is a conversation of its own; columns
other than the four named ones are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the template writes, and markers that chat models commonly reserve.
OPEN, ROLE_END, JOIN, CLOSE = "<s>[", "]", "<|turn|>", "</s>"
CONTROL = ("<s>", "</s>", "<|turn|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"
#: Pieces, and code points of a text, that are looked through at once.
BLOCK, TEXT_BLOCK = 32, 1024


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def escape_role(role: Column) -> Column:
    """As escape(), with `]` and a line feed kept out of the header too."""
    return F.replace(escape(role), F.lit("]"), F.lit("\\e"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\e", "$1]"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, messages, formatted, loss_spans.

    messages: array of (role, texts), texts being the turns merged into the message.
    loss_spans: (start, length) in code points of `formatted` of each assistant text, escaped as it
    stands there; a training loss covers those spans alone.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    # the first turn of each message: its role differs from the turn before
    starts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    rows = rows.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns") + 1))
    rows = rows.withColumn("bounds", F.arrays_zip(F.col("starts").alias("a"), ends.alias("b")))
    messages = F.transform(
        "bounds",
        lambda x: F.struct(
            F.element_at("turns", x["a"])["role"].alias("role"),
            F.transform(F.slice("turns", x["a"], x["b"] - x["a"]), lambda t: t["text"]).alias("texts"),
        ),
    )
    rows = rows.withColumn("messages", messages)
    # what is written, piece by piece; a piece is trained on or not
    piece = lambda s, loss: F.struct(s.alias("s"), F.lit(loss).alias("loss") if isinstance(loss, bool) else loss.alias("loss"))
    pieces = F.flatten(
        F.transform(
            "messages",
            lambda m: F.concat(
                F.array(piece(F.concat(F.lit(OPEN), escape_role(m["role"]), F.lit(ROLE_END)), False)),
                F.flatten(
                    F.transform(
                        m["texts"],
                        lambda t, i: F.array(
                            piece(F.when(i > 0, F.lit(JOIN)).otherwise(F.lit("")), False),
                            piece(escape(t), m["role"] == TRAINED_ROLE),
                        ),
                    )
                ),
                F.array(piece(F.lit(CLOSE), False)),
            ),
        )
    )
    rows = rows.withColumn("pieces", F.explode(F.array(pieces)))  # computed once: nothing moves below a generator
    placed = _let(F.transform("pieces", lambda p: F.length(p["s"])), lambda sizes: _let(_starts(sizes), lambda starts: F.arrays_zip(F.transform("pieces", lambda p: p["loss"]).alias("loss"), starts.alias("start"), sizes.alias("length"))))
    spans = F.transform(F.filter(placed, lambda p: p["loss"]), lambda p: F.struct(p["start"], p["length"]))
    return rows.select("conv_id", "messages", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def _let(value: Column, body) -> Column:
    """body(value), the value being computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(sizes: Column) -> Column:
    """The sum of the sizes before each, from sums of blocks of BLOCK sizes, so that no array is copied once an element."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda t, x: t + x)
    block = lambda i: F.floor(i / BLOCK).cast("int")
    blocks = F.sequence(F.lit(0), block(F.size(sizes)))
    sums = F.transform(blocks, lambda b: total(F.slice(sizes, b * BLOCK + 1, BLOCK)))
    before = _let(sums, lambda s: F.transform(blocks, lambda b: total(F.slice(s, 1, b))))
    return _let(before, lambda own: F.transform(sizes, lambda _, i: F.get(own, block(i)) + total(F.slice(sizes, block(i) * BLOCK + 1, i % BLOCK))))


def at_spans(text: Column, spans: Column) -> Column:
    """The part of a text at each (start, length): looked up in blocks of the text, so a span costs its own length."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), 0)

    def of(found):
        first = lambda s: F.floor(s["start"] / TEXT_BLOCK).cast("int")
        held = lambda s: F.array_join(F.slice(found, first(s) + 1, F.floor((s["start"] % TEXT_BLOCK + s["length"]) / TEXT_BLOCK).cast("int") + 1), "")
        return F.transform(spans, lambda s: F.substring(held(s), s["start"] % TEXT_BLOCK + 1, s["length"]))

    return _let(blocks, of)


def parse_formatted(rows: DataFrame) -> DataFrame:
    """Adds what is read back from `formatted` alone: read_turns array of (role, text), one per turn."""
    body = F.filter(F.split("formatted", "</s>"), lambda m: m != "")
    message = lambda m: F.struct(
        unescape_role(F.substring(m, F.lit(len(OPEN) + 1), F.instr(m, F.lit(ROLE_END)) - len(OPEN) - 1)).alias("role"),
        F.split(F.substring(m, F.instr(m, F.lit(ROLE_END)) + 1, F.length(m)), r"<\|turn\|>", -1).alias("texts"),
    )
    turns = F.flatten(F.transform(F.transform(body, message), lambda m: F.transform(m["texts"], lambda t: F.struct(m["role"].alias("role"), unescape(t).alias("text")))))
    return rows.withColumn("read_turns", turns)


def digest(rows: DataFrame) -> DataFrame:
    """What the formatted output holds, read back from it: turns, and the text under the loss mask."""
    read = parse_formatted(rows).withColumn(
        "loss_text",
        F.array_join(F.transform(at_spans(F.col("formatted"), F.col("loss_spans")), unescape), ""),
    )
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
