"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns become windows of whole turns. Prefix sums of the turns' tokens choose the windows; every
window starts with the conversation's leading system turn and a limited number of turns from before it, and only
the assistant turns that are new in it are under the loss mask, so each is a target exactly once.

Template of a turn: ``### role: text</turn>\\n``. Inside role and text ``\\`` is written ``\\b``, ``#`` ``\\h``, ``</turn>``
``\\e``, and in roles ``:`` ``\\c``; a backslash in the output is always the start of such a mark, so this can be undone.

Tokens are words between white space. With C the budget less the system turn's and the history's tokens
(at least a quarter of the budget), and h = C / 2: a turn belongs to the stretch of h tokens in which it
ends, and a turn of more than h tokens stands alone. So the new turns of a window have at most C tokens, unless
one turn alone has more; turns are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

BUDGET = 512
#: Turns repeated before a window, and the most tokens they may have, as a share of the budget.
HISTORY_TURNS, HISTORY_SHARE = 2, 4
#: Turn numbers that share one window of the prefix sum's first step.
STRETCH = 512
END = "</turn>\n"
NONE = "(none)"


def escaped(x: Column, role: bool = False) -> Column:
    for mark, code in (("\\", "\\b"), ("#", "\\h"), ("</turn>", "\\e"), *([(":", "\\c")] if role else [])):
        x = F.replace(x, F.lit(mark), F.lit(code))
    return x


def plain(x: Column) -> Column:
    """Undoes ``escaped``."""
    for mark, code in ((":", "\\c"), ("</turn>", "\\e"), ("#", "\\h"), ("\\", "\\b")):
        x = F.replace(x, F.lit(code), F.lit(mark))
    return x


def positions(turns: DataFrame) -> DataFrame:
    """Turns with ``pos`` (1, 2, …), ``end`` (tokens up to and with the turn) and ``system`` (tokens of a leading system turn).

    Sums go over stretches of turn numbers and then over the stretches, so no window holds a whole conversation.
    """
    order = Window.partitionBy("conv", "stretch").orderBy("turn", "role", "piece")
    part = turns.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-1 << 40)))
    part = part.withColumns({"place": F.row_number().over(order), "sum": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    sums = part.groupBy("conv", "stretch").agg(
        F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max(F.when((F.col("place") == 1) & (F.col("role") == "system"), F.col("tokens"))).alias("lead")
    )
    over = Window.partitionBy("conv").orderBy("stretch")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "conv", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
        F.coalesce(F.first("lead").over(over), F.lit(0)).alias("system"),
    )
    return part.join(sums, ["conv", "stretch"]).select(
        "conv", "role", "piece", "head", "tokens", (F.col("n0") + F.col("place")).alias("pos"), (F.col("t0") + F.col("sum")).alias("end"), "system"
    )


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY_TURNS) -> DataFrame:
    """conv_id, window, text, n_repeated, n_new, loss: a row per window.

    ``conversations`` has conv_id, turn, role and text, a row per turn; other columns are not read. Turns go by
    turn, then role, then escaped text; a null turn comes first. Null role or text: empty. Rows with a null conv_id
    are one conversation. Repeated rows are turns of their own. ``loss`` lists (start, length), 0-based code
    points of ``text``; the first ``n_repeated`` turns of a window are repeated. An empty table has no windows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("### "), escaped(role, True), F.lit(": "))
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(NONE)).alias("conv"), "turn", role.alias("role"),
        F.length(head).alias("head"), F.concat(head, escaped(text), F.lit(END)).alias("piece"),
    )
    turns = turns.withColumn("tokens", F.regexp_count("piece", F.lit(WORD)).cast("long"))
    half = F.expr(f"greatest({budget} - system - {budget // HISTORY_SHARE}, {budget // 4}) div 2")
    rows = positions(turns).withColumn("h", half).select(
        "conv", "pos", "role", "head", "piece", "tokens", F.expr("2 * ((end - 1) div h) + if(tokens > h, 0, 1)").alias("window"),
        ((F.col("pos") == 1) & (F.col("role") == "system")).alias("lead"),
    )
    rows = stored(rows, "turns")  # read several times; the prefix sums are worked out once
    starts = rows.groupBy("conv", "window").agg(F.min("pos").alias("first"))
    kept = ["conv", "window", "pos", "role", "head", "piece", "new"]
    new = rows.withColumn("new", F.lit(True)).select(*kept)
    # Repeated turns: by position before the window's first, as far as the history's tokens go.
    wanted = starts.select("conv", "window", "first", F.explode(F.sequence(F.lit(1), F.lit(max(1, history)))).alias("back")).where(F.col("back") <= history)
    wanted = wanted.withColumn("pos", F.col("first") - F.col("back")).where("pos >= 1")
    back = Window.partitionBy("conv", "window").orderBy("back").rowsBetween(Window.unboundedPreceding, 0)
    old = (
        wanted.select("conv", F.col("window").alias("to"), "back", "pos").join(rows.where("not lead").drop("window"), ["conv", "pos"])
        .withColumnRenamed("to", "window").withColumn("sum", F.sum("tokens").over(back)).where(F.col("sum") <= budget // HISTORY_SHARE)
        .withColumn("new", F.lit(False)).select(*kept)
    )
    lead = rows.where("lead").drop("window").join(starts.where("first > 1"), "conv").withColumn("new", F.lit(False)).select(*kept)
    at = Window.partitionBy("conv", "window").orderBy("pos")
    every = new.union(old).union(lead).withColumn("start", F.coalesce(F.sum(F.length("piece")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    target = F.when(F.col("new") & (F.col("role") == "assistant"), F.struct((F.col("start") + F.col("head")).alias("start"), (F.length("piece") - F.col("head") - len(END)).alias("length")))
    made = every.groupBy("conv", "window").agg(
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"), F.array_sort(F.collect_list(target)).alias("loss"),
        F.sum((~F.col("new")).cast("long")).alias("n_repeated"), F.sum(F.col("new").cast("long")).alias("n_new"),
    )
    return made.select(
        F.when(F.col("conv") != NONE, F.col("conv").cast("long")).alias("conv_id"), "window",
        F.array_join("pieces.piece", "").alias("text"), "n_repeated", "n_new", "loss",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns, targets: the new turns (role, text) of each window and the texts under its mask, unescaped."""
    pieces = F.expr(f"slice(split(text, '{END[:-1]}\\n', -1), cast(n_repeated + 1 as int), cast(n_new as int))")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, ": ", 1)
        return F.struct(
            plain(role.substr(F.lit(5), F.length(role))).alias("role"),
            plain(piece.substr(F.length(role) + 3, F.length(piece))).alias("text"),
        )

    return windows.select(
        "conv_id", "window", F.transform(pieces, turn).alias("turns"),
        F.transform("loss", lambda s: plain(F.col("text").substr((s["start"] + 1).cast("int"), s["length"].cast("int")))).alias("targets"),
        F.length("text").alias("chars"),
    )
