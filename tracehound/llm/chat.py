"""Chat formatting into budgeted windows by column expressions.

A turn is written as

    ### role:<newline>text</turn><newline>

with backslash, '#', '<' and (in roles) ':' escaped inside, so that no text can hold a marker and
every text comes back. Prefix sums of turn tokens deal the turns into windows: a window's own turns
are those that begin in one stretch of `stride` tokens; before them stand the conversation's system
turn and the last turns that begin within `history` tokens. Own assistant turns are targets, and
only they are in the loss mask: repeated turns never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Character, and what follows the backslash in its place; the backslash comes first.
ESCAPES = [("\\", "s"), ("#", "h"), ("<", "l")]
ROLE_ESCAPES = [*ESCAPES, (":", "c")]
OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"
SYSTEM, TARGET = "system", "assistant"
BUDGET, HISTORY = 2048, 256
#: Turns of a conversation that are summed together before its prefix sums are put together.
BLOCK = 256


def escape(c: Column, table=ESCAPES) -> Column:
    for a, b in table:
        c = F.replace(c, F.lit(a), F.lit("\\" + b))
    return c


def unescape(c: Column, table=ESCAPES) -> Column:
    for a, b in reversed(table):
        c = F.replace(c, F.lit("\\" + b), F.lit(a))
    return c


def turn_tokens(role: Column, text: Column) -> Column:
    """Estimate of a turn's tokens: one for every three bytes, and the markers'. Budgets count these, not a tokenizer's."""
    return (F.ceil((F.octet_length(text) + F.octet_length(role)) / 3) + 6).cast("long")


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with place (order in the conversation), before (tokens of earlier turns) and total.

    Sums go by blocks of turns first, so no task holds all turns of a conversation.
    """
    rows = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    own = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"t0": F.coalesce(F.sum("tokens").over(own), F.lit(0)), "p0": F.count("*").over(own)})
    sums = turns.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.sum("tokens").alias("t"), F.count("*").alias("p"))
    past = W.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("conv_id")
    sums = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("t").over(past), F.lit(0)).alias("t1"), F.coalesce(F.sum("p").over(past), F.lit(0)).alias("p1"), F.sum("t").over(every).alias("total"))
    both = rows.join(sums, rows.conv_id.eqNullSafe(sums.c) & rows.block.eqNullSafe(sums.b))
    return both.select("conv_id", "role", "text", "tokens", (F.col("t0") + F.col("t1")).alias("before"), (F.col("p0") + F.col("p1")).alias("place"), "total")


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, context (turns repeated before the window's own), mask (start, length).

    conversations: conv_id, turn, role, text, by turn (equal turns by role, then text; null turns
    first; null text or role: empty). Windows keep to the budget (of estimated tokens) unless a single
    turn, or the system turn, is more than half of what is left for turns of its own. mask counts
    characters of formatted. Equal rows are turns of their own, an empty table gives no window.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("tokens", turn_tokens(F.col("role"), F.col("text")))
    rows = written(_numbered(turns), "turns")
    first = rows.where((F.col("place") == 0) & (F.col("role") == SYSTEM)).select(F.col("conv_id").alias("sc"), F.col("text").alias("system"), F.col("tokens").alias("sys_tokens"))
    rows = rows.join(first, rows.conv_id.eqNullSafe(first.sc), "left").drop("sc")
    stride = F.greatest(F.floor((F.lit(budget - history) - F.coalesce("sys_tokens", F.lit(0))) / 2), F.lit(1)).cast("long")
    rows = rows.withColumn("w", F.floor(F.col("before") / stride))
    # The next window's own turns begin where this window's end.
    ends = rows.groupBy("conv_id", "w").agg(F.max(F.col("before") + F.col("tokens")).alias("end"), F.max("total").alias("all"), F.max(stride).alias("stride"))
    ends = ends.select(F.col("conv_id").alias("ec"), F.col("w").alias("ew"), "end", F.when(F.col("end") < F.col("all"), F.floor(F.col("end") / F.col("stride"))).alias("next"))
    rows = rows.join(ends, rows.conv_id.eqNullSafe(ends.ec) & (rows.w == ends.ew))
    system = (F.col("place") == 0) & F.col("system").isNotNull()
    again = F.col("next").isNotNull() & (F.col("end") - F.col("before") <= history) & ~system
    copies = F.array(F.struct(F.col("w").alias("window"), F.lit(True).alias("own")), F.struct(F.when(again, F.col("next")).alias("window"), F.lit(False).alias("own")))
    laid = rows.select("conv_id", "place", "role", "text", "system", F.explode(F.filter(copies, lambda c: c["window"].isNotNull())).alias("c"))
    turn = F.struct("place", F.col("c.own").alias("own"), "role", "text")
    packed = laid.groupBy("conv_id", F.col("c.window").alias("window")).agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max("system").alias("system"))
    lead = F.when(F.col("system").isNotNull() & (F.get("turns", F.lit(0))["place"] > 0), F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(False).alias("own"), F.lit(SYSTEM).alias("role"), F.col("system").alias("text"))))
    packed = packed.withColumn("turns", F.concat(F.coalesce(lead, F.slice("turns", 1, 0)), "turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(MIDDLE))
    parts = packed.select("conv_id", "window", F.size(F.filter("turns", lambda t: ~t["own"])).alias("context"), F.transform("turns", lambda t: F.struct((t["own"] & (t["role"] == TARGET)).alias("target"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("parts"))
    length = lambda t: (F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).cast("long")
    begin = lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0).cast("long"), lambda s, t: s + length(t))
    spans = F.transform("parts", lambda t, i: F.when(t["target"], F.struct((begin(i) + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length"))))
    whole = F.array_join(F.transform("parts", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return parts.select("conv_id", "window", whole.alias("formatted"), "context", F.filter(spans, lambda m: m.isNotNull()).alias("mask"))


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window."""
    pieces = F.split(formatted, CLOSE)
    bodies = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        cut = F.locate(MIDDLE, p)
        return F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), cut - 1 - len(OPEN)), ROLE_ESCAPES).alias("role"), unescape(F.substring(p, cut + len(MIDDLE), F.length(p))).alias("text"))

    return F.transform(bodies, turn)


def masked_texts(formatted: Column, mask: Column) -> Column:
    return F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int"))))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: its turns and the texts under the loss mask, in order."""
    turns = parse_turns(F.col("formatted"))
    own = F.slice(turns, F.col("context") + 1, F.size(turns))
    rows = windows.select("conv_id", F.struct("window", own.alias("turns"), masked_texts(F.col("formatted"), F.col("mask")).alias("loss")).alias("w"), F.length("formatted").cast("long").alias("chars"))
    both = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    return both.select("conv_id", F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"), F.flatten(F.transform("w", lambda w: w["loss"])).alias("loss"), "formatted_chars")


def chat_digest(windows: DataFrame) -> DataFrame:
    back = read_back(windows)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def with_control_case(conversations: DataFrame) -> DataFrame:
    """conversations and conversation -7, whose texts hold the template's own strings."""
    spark: SparkSession = conversations.sparkSession
    said = "\\### Assistant: </turn> ok"
    case = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(case)


def chat_report(conversations: DataFrame) -> DataFrame:
    return chat_digest(written(format_windows(with_control_case(conversations)), "windows"))


