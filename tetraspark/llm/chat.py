"""Chat formatting into budgeted windows, with DataFrame functions only.

Each conversation's turns become one or more training windows. Prefix sums of the turns' tokens
choose spans that begin and end at turns and stay within a budget; every window starts with the
conversation's system turns, then repeats a limited history of earlier turns, then brings new turns.
Only new assistant turns are targets: what a window repeats is masked out of its loss.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a role or text are
escaped with U+E000, so a mark in the output is always a mark, and reading back restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: The escape character, and the strings in texts that some template gives a meaning (fixed values).
ESCAPE = "\ue000"
CONTROL = r"<(?=\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?<?/?SYS>>)|\[(?=/?INST\])"
#: Tokens in a window, and tokens of earlier turns that it may repeat.
BUDGET, HISTORY = 512, 128


def escape(c: Column) -> Column:
    """Reversible: the escape character becomes E0, a control string's first character E1 or E2."""
    c = F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    c = F.regexp_replace(c, CONTROL, ESCAPE + "$0")
    return F.replace(F.replace(c, F.lit(ESCAPE + "<"), F.lit(ESCAPE + "1")), F.lit(ESCAPE + "["), F.lit(ESCAPE + "2"))


def unescape(c: Column) -> Column:
    for code, char in (("3", "\n"), ("2", "["), ("1", "<"), ("0", ESCAPE)):
        c = F.replace(c, F.lit(ESCAPE + code), F.lit(char))
    return c


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(ESCAPE + "3"))


def tokens(text: Column) -> Column:
    """A turn's tokens: one for every four characters begun, and three for its marks."""
    return F.ceil(F.char_length(text) / 4).cast("long") + 3


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, repeated, loss) : one row for each window of each conversation.

    ``repeated``: how many of the window's turns were in an earlier window. ``loss``: the spans
    (start, end) in characters of ``formatted`` that are trained on, escaped as they stand there.

    Turns are ordered by turn, ties by role and text, so repeated rows stay and have a defined place.
    A null text is empty, a null role is the empty role, turns with a null number come first, rows
    with a null conv_id form one conversation. A turn longer than the budget has a window of its own
    and is never cut. System turns at a conversation's start head every window; later ones are
    ordinary turns. Empty texts are turns as well; an empty table gives no window. Other columns are
    ignored.
    """
    t = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # leading system turns
    first = F.array_position(F.transform("t", lambda x: x["role"] != "system"), True)
    heads = F.when(first == 0, F.size("t")).otherwise(first.cast("int") - 1)
    # texts are escaped once; every further step handles numbers until a window's pieces are joined
    piece = F.transform("t", lambda x: F.struct(
        F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("mark"),
        escape(x["text"]).alias("body"),
        (x["role"] == "assistant").alias("target"),
    ))
    g = grouped.select("conv_id", heads.alias("h"), piece.alias("p"), F.transform("t", lambda x: tokens(x["text"])).alias("n"))
    zero = F.lit(0).cast("long")
    sums = F.aggregate("n", F.array(zero), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))
    g = g.withColumn("s", sums)  # s[i]: tokens before turn i
    g = g.withColumn("room", F.greatest(F.lit(budget) - F.get("s", F.col("h")), F.lit(1).cast("long")))
    # cut points: a new window starts where the span with its history would pass the room
    state = F.struct(F.array(F.struct(F.col("h").alias("a"), F.col("h").alias("b"))).alias("cuts"), F.col("h").alias("a"), F.col("h").alias("b"))

    def step(acc: Column, i: Column) -> Column:
        fits = (F.get("s", i + 1) - F.get("s", acc["a"]) <= F.col("room")) | (i == acc["b"])
        # the earliest turn from which the history's tokens, with turn i, still fit
        back = F.aggregate(
            F.sequence(F.lit(1), F.lit(history)), i,
            lambda j, _: F.when(
                (j > F.col("h")) & (F.get("s", i) - F.get("s", j - 1) <= history) & (F.get("s", i + 1) - F.get("s", j - 1) <= F.col("room")), j - 1
            ).otherwise(j),
        )
        return F.when(fits, acc).otherwise(F.struct(
            F.array_append(acc["cuts"], F.struct(back.alias("a"), i.alias("b"))).alias("cuts"), back.alias("a"), i.alias("b")))

    last = F.size("n") - 1
    body = F.when(last >= F.col("h"), F.sequence(F.col("h"), last)).otherwise(F.array().cast("array<int>"))
    g = g.withColumn("cuts", F.aggregate(body, state, step)["cuts"])
    # a window: system turns, then a (history begins) <= b (new turns begin) < e (next window's b)
    w = g.select("conv_id", "h", "p", F.posexplode(F.transform("cuts", lambda c, i: F.struct(
        c["a"].alias("a"), c["b"].alias("b"), F.coalesce(F.get("cuts", i + 1)["b"], F.size("n")).alias("e")))).alias("window", "c"))
    head = F.slice("p", F.lit(1), F.col("h"))
    tail = F.slice("p", F.col("c.a") + 1, F.col("c.e") - F.col("c.a"))
    fresh = F.when(F.col("window") == 0, F.lit(0)).otherwise(F.col("h") + F.col("c.b") - F.col("c.a"))
    w = w.select("conv_id", "window", fresh.cast("int").alias("repeated"), F.concat(head, tail).alias("p"))
    w = w.withColumn("formatted", F.array_join(F.transform("p", lambda x: F.concat(x["mark"], x["body"], F.lit(END + "\n"))), ""))
    close = len(END) + 1
    size = F.transform("p", lambda x: (F.char_length(x["mark"]) + F.char_length(x["body"]) + close).cast("long"))
    ends = F.aggregate(size, F.array(zero), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))
    w = w.withColumn("o", ends)
    spans = F.transform("p", lambda x, i: F.struct(
        (F.get("o", i) + F.char_length(x["mark"])).cast("long").alias("start"), (F.get("o", i + 1) - close).cast("long").alias("end"),
        (x["target"] & (i >= F.col("repeated"))).alias("target")))
    loss = F.transform(F.filter(spans, lambda x: x["target"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return w.select("conv_id", F.col("window").cast("int").alias("window"), "formatted", "repeated", loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the windows alone."""
    marks = F.slice(F.split("formatted", F.lit(r"<\|im_start\|>"), F.lit(-1)), F.lit(2), F.lit(1 << 30))
    fresh = F.slice(marks, F.col("repeated") + 1, F.lit(1 << 30))
    cut = len(END) + 1

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        at = F.char_length(role) + 1
        return F.concat(unescape(role), F.lit("\n"), unescape(F.substring(x, at + 1, F.char_length(x) - at - cut)), F.lit("\n"))

    read = windows.select(
        "conv_id", "window", F.char_length("formatted").cast("long").alias("chars"),
        F.size(fresh).cast("long").alias("n"),
        F.array_join(F.transform(fresh, turn), "").alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "").alias("loss"),
    )
    got = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"),
    )
    both = {c: F.array_join(F.col("w")[c], "") for c in ("turns", "loss")}
    return got.select(
        "conv_id", "n_turns", F.sha2(F.encode(both["turns"], "UTF-8"), 256).alias("turns_sha256"),
        F.char_length(both["loss"]).cast("long").alias("loss_chars"), F.sha2(F.encode(both["loss"], "UTF-8"), 256).alias("loss_sha256"), "formatted_chars",
    )
