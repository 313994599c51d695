"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into spans that end with a turn.  A window is
the opening system turn, a limited history of turns before the span, and the span; only
assistant texts of the span are under the loss mask, so each is learned once.  Sums run per
chunk of turn numbers first and over chunks after that, so a conversation of any length stays
spread.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts and roles a backslash goes between
``<`` and ``|`` (one more where there are some already), so marks never occur inside; roles have
``%`` and line feeds percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posequery.session import cut

START, END = "<|im_start|>", "<|im_end|>\n"
#: Words and signs count as tokens; the marks of a turn count as four.
_TOKEN, _MARKS = r"\w+|[^\w\s]", 4
_CHUNK = 1024
_ROLE_CHARS = (("%", "%25"), ("\n", "%0A"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    for char, code in _ROLE_CHARS:
        role = F.replace(role, F.lit(char), F.lit(code))
    return escape(role)


def unescape_role(role: Column) -> Column:
    role = unescape(role)
    for char, code in reversed(_ROLE_CHARS):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def _summed(turns: DataFrame) -> DataFrame:
    """``place``, ``before`` and ``upto``: number and tokens of the turns before each, and with it."""
    chunk = [*_KEY, "chunk"]
    turns = turns.withColumn("chunk", F.floor(F.coalesce("turn", F.lit(0)) / _CHUNK))
    # Turns of one number go by role and text; equal turns are interchangeable.
    order = Window.partitionBy(*chunk).orderBy("turn", "role", "text")
    rows = turns.withColumn("row", F.row_number().over(order)).withColumn("sum", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    totals = turns.groupBy(*chunk).agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    earlier = Window.partitionBy(*_KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*chunk, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_0"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("sum_0"))
    return rows.join(totals, chunk).select(
        *_KEY, "conv_id", "turn", "role", "text", "tokens",
        (F.col("row") + F.col("rows_0") - 1).alias("place"), (F.col("sum") + F.col("sum_0")).alias("upto"),
    ).withColumn("before", F.col("upto") - F.col("tokens"))


_KEY = ["_conv", "_none"]


def chat_windows(
    turns: DataFrame,
    budget: int = 1024,
    history_turns: int = 4,
    learned_role: str = "assistant",
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, window, n_turns, n_context, n_tokens, over_budget, formatted, loss`` per window.

    A conversation opens with a system turn if its first turn has that role.  The rest is cut
    where the sum of tokens passes a multiple of half the budget left by it; so a window holds
    ``budget`` tokens unless one turn has more than half of them, which is kept whole and
    marked ``over_budget``.  Up to ``history_turns`` turns that still fit are repeated before a
    later span.  ``n_context`` counts the leading turns that are repeated, ``loss`` lists the
    code points (``start`` from 0, ``length``) of the texts to learn.  Null texts and roles count
    as empty, a null turn number comes first, rows without a conversation id form one
    conversation, repeated rows are turns of their own, an empty table gives no rows.  Runs a job
    when called.
    """
    named = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("_conv"),
        F.col(conv_col).isNull().alias("_none"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    count = F.regexp_count("text", F.lit(_TOKEN)) + _MARKS
    # Spans, history and texts are all taken from the placed turns: made once.
    placed = cut(_summed(named.withColumn("tokens", count.cast("long"))), "turns")
    system = placed.where("place = 0 AND role = 'system'").select(*_KEY, F.col("text").alias("system"), F.col("tokens").alias("system_tokens"))
    rest = placed.join(system.drop("system"), _KEY, "left").withColumn("opening", F.coalesce("system_tokens", F.lit(0)))
    left = F.greatest(F.lit(budget) - F.col("opening"), F.lit(2))
    span = F.floor((F.greatest(F.col("upto") - F.col("opening"), F.lit(1)) - 1) / F.floor(left / 2))
    rest = rest.withColumn("left", left).withColumn("span", span)
    spans = rest.groupBy(*_KEY, "span").agg(
        F.min("place").alias("first"), F.min("before").alias("from"), F.sum("tokens").alias("own"), F.max("left").alias("left"), F.max("opening").alias("opening")
    )
    # Candidates for history by their place, then as far as the budget reaches back.
    wanted = spans.where("first > 0").withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(history_turns)))).withColumn("place", F.col("first") - F.col("place"))
    told = wanted.select(*_KEY, F.col("span").alias("window"), "place", "from", (F.col("left") - F.col("own")).alias("room"))
    history = rest.join(told, [*_KEY, "place"]).where("from - before <= room AND NOT (place = 0 AND opening > 0)")
    again = spans.where("first > 0 AND opening > 0").join(system, _KEY)
    columns = [*_KEY, "window", "place", "role", "text", "tokens", "repeated"]
    rows = (
        rest.select(*_KEY, F.col("span").alias("window"), "place", "role", "text", "tokens", F.lit(False).alias("repeated"))
        .unionByName(history.withColumn("repeated", F.lit(True)).select(columns))
        .unionByName(
            again.select(
                *_KEY, F.col("span").alias("window"), F.lit(-1).cast("long").alias("place"), F.lit("system").alias("role"), F.col("system").alias("text"),
                F.col("system_tokens").alias("tokens"), F.lit(True).alias("repeated"),
            )
        )
    )
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select(*columns, head.alias("head"), escape(F.col("text")).alias("body")).withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy(*_KEY, "window").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.length("piece")).over(order))
    mask = F.struct(
        (F.col("end") - F.length("piece") + F.length("head")).cast("int").alias("start"), F.length("body").alias("length")
    )
    learned = (F.col("role") == learned_role) & ~F.col("repeated")
    grouped = rows.groupBy(*_KEY, "window").agg(
        F.count("*").alias("n_turns"),
        F.sum(F.col("repeated").cast("long")).alias("n_context"),
        F.sum("tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(learned, mask))).alias("loss"),
    )
    ids = placed.groupBy(*_KEY).agg(F.max("conv_id").alias("conv_id"))
    return grouped.join(ids, _KEY).select(
        "conv_id", "window", "n_turns", "n_context", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"),
        F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), "loss",
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """``conv_id, window, place, role, text`` of every turn that is not repeated, read from ``formatted``."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.col("n_context") + 2, F.size(F.split("formatted", r"<\|im_start\|>", -1)))
    rows = windows.select("conv_id", "window", F.posexplode(pieces).alias("place", "piece"))
    at = F.instr("piece", "\n")
    return rows.select(
        "conv_id", "window", "place",
        unescape_role(F.substring("piece", F.lit(1), at - 1)).alias("role"),
        unescape(F.substring("piece", at + 1, F.length("piece") - at - len(END))).alias("text"),
    )


def learned_texts(windows: DataFrame) -> Column:
    """Texts under the loss mask, in order, unescaped."""
    return F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"])))
