"""Chat formatting in budgeted windows, in DataFrame functions only.

Method: prefix sums of the turns' tokens choose turn-aligned spans of a conversation, each as long as the budget allows
beside what it repeats: the leading system turn and, up to a limit, the turns before its own. The loss mask covers the
assistant turns that are a window's own, so that a repeated target is never trained on twice.

Turns are put in order by ranges, which split a long conversation; spans are chosen within blocks of `BLOCK` turns, so
that no task or row holds a conversation's turns. A window is the most that stands in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BUDGET = 8192
HISTORY = 1024
BLOCK = 1024  # turns; a window ends with its block
CONTROL = r"(?:<\||\|>|</?s>|\[/?INST\])"
HEAD, END = "<|{}|>\n", "\n<|end|>\n"


def escape(text: Column) -> Column:
    """One backslash more before every control string; unescape() takes it away, whatever backslashes stood there."""
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def opening(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.url_encode(role), F.lit("|>\n"))


def tokens(role: Column, text: Column) -> Column:
    """The UTF-8 bytes of a turn as it is formatted: no byte-level vocabulary gives it more tokens."""
    return (F.octet_length(opening(role)) + F.octet_length(escape(text)) + len(END)).cast("long")


def spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """ck, mid, at, since, tokens, window of `turns` (ck, mid, at, since, tokens; lead, the tokens of a leading system turn).

    A window takes turns as long as the budget holds them beside the system turn and the history, and one at least.
    """
    kept = F.struct("mid", "at", "since", "tokens")
    blocks = turns.groupBy("ck", F.floor((F.col("at") - 1) / BLOCK).alias("block"), "lead").agg(F.sort_array(F.collect_list(kept)).alias("turns"))
    out = "array<struct<mid:bigint,at:bigint,since:bigint,tokens:bigint,n:bigint>>"
    zero = F.lit(0).cast("bigint")
    state = F.struct(zero.alias("n"), zero.alias("used"), F.array().cast(out).alias("out"))

    def step(s: Column, t: Column) -> Column:
        stays = (F.size(s["out"]) > 0) & (s["used"] + t["tokens"] <= budget)
        ahead = F.least(F.lit(history).cast("bigint"), t["since"] - F.col("lead"))
        fixed = F.when(t["at"] == 1, zero).otherwise(F.col("lead") + ahead)
        n = F.when(stays | (F.size(s["out"]) == 0), s["n"]).otherwise(s["n"] + 1)
        used = F.when(stays, s["used"] + t["tokens"]).otherwise(fixed + t["tokens"])
        return F.struct(n.alias("n"), used.alias("used"), F.array_append(s["out"], F.struct(t["mid"], t["at"], t["since"], t["tokens"], n.alias("n"))).alias("out"))

    chosen = blocks.select("ck", "block", "lead", F.explode(F.aggregate("turns", state, step, lambda s: s["out"])).alias("t"))
    return chosen.select("ck", "lead", "t.mid", "t.at", "t.since", "t.tokens", (F.col("block") * BLOCK + F.col("t.n")).alias("window"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: str | None = None) -> DataFrame:
    """conv_id, window, text, loss (array<struct<start, length>> in code points), repeated (its first turns, not its own).

    Input: conv_id, turn, role, text; other columns are ignored but for `count`, if it is named: the tokens of a turn as
    formatted. Without it a turn counts its bytes, which bounds its tokens in any byte-level vocabulary. Turns stand by
    turn, then role and text, nulls first; null role or text is empty; a null conv_id is a conversation of its own.
    Repeated rows are turns of their own. A window holds at most `budget` tokens, the system turn and at most `history`
    tokens of earlier turns included, unless the system turn and one own turn alone have more. Windows are numbered in
    order, with gaps. An empty table gives none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    size = F.greatest(F.col(count).cast("long"), F.lit(1)) if count else tokens(role, text)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    clean = conversations.select(key.alias("ck"), "conv_id", "turn", role.alias("role"), text.alias("text"), size.alias("tokens"))
    order = [F.col(c).asc_nulls_first() for c in ("ck", "turn", "role", "text")]
    # rows that lie in order through all partitions; their numbers are drawn once
    lying = cut(clean.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    light = lying.select("ck", "part", "mid", "tokens", (F.col("role") == "system").alias("system"))
    inside = Window.partitionBy("ck", "part").orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    parts = light.groupBy("ck", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("sum"))
    before = Window.partitionBy("ck").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("ck", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum"))
    counted = light.withColumn("at", F.count(F.lit(1)).over(inside)).withColumn("since", F.sum("tokens").over(inside) - F.col("tokens"))
    placed = counted.join(parts, ["ck", "part"]).select("ck", "mid", "tokens", "system", (F.col("at") + F.col("rows")).alias("at"), (F.col("since") + F.col("sum")).alias("since"))
    lead = placed.filter("at = 1 and system").select("ck", F.col("tokens").alias("lead"))
    placed = placed.drop("system").join(lead, "ck", "left").withColumn("lead", F.coalesce("lead", F.lit(0)))
    own = cut(spans(placed, budget, history))
    # what a window may repeat of the turns before it: those that begin no further ahead than there is room
    begins = own.groupBy("ck", "window", "lead").agg(F.min("since").alias("begin"), F.min("at").alias("first"), F.sum("tokens").alias("own")).filter("first > 1")
    room = F.least(F.lit(history).cast("bigint"), F.lit(budget) - F.col("lead") - F.col("own"))
    cell = max(1, history)
    asked = begins.withColumn("room", room).filter("room > 0").withColumn("from", F.greatest(F.col("begin") - F.col("room"), F.col("lead")))
    asked = asked.select("ck", "window", "begin", "from", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor(F.col("begin") / cell))).alias("cell"))
    held = own.select("ck", "mid", "since", F.floor(F.col("since") / cell).alias("cell"))
    past = asked.join(held, ["ck", "cell"]).filter("since >= from and since < begin").select("ck", "window", "mid")
    first = own.filter("at = 1 and lead > 0").select("ck", "mid")
    kept = begins.filter("lead > 0").select("ck", "window").join(first, "ck").select("ck", "window", "mid")
    placed = own.select("window", "mid", F.lit(1).alias("own")).unionByName(past.unionByName(kept).select("window", "mid", F.lit(0).alias("own")))
    turns = placed.join(lying.select("mid", "ck", "conv_id", "role", "text"), "mid")
    ready = turns.select("ck", "conv_id", "window", "own", F.struct("mid", "role", opening(F.col("role")).alias("head"), escape(F.col("text")).alias("body"), "own").alias("t"))
    grouped = ready.groupBy("ck", "window").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list("t")).alias("turns"), F.sum(1 - F.col("own")).cast("int").alias("repeated"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def add(s: Column, t: Column) -> Column:
        start, size = s["at"] + F.length(t["head"]), F.length(t["body"])
        loss = F.when((t["own"] == 1) & (t["role"] == "assistant"), F.array_append(s["loss"], F.struct(start.alias("start"), size.alias("length")))).otherwise(s["loss"])
        return F.struct((start + size + len(END)).alias("at"), loss.alias("loss"))

    return grouped.select("conv_id", "window", text.alias("text"), F.aggregate("turns", state, add, lambda s: s["loss"]).alias("loss"), "repeated")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns, spoken, learned, formatted_chars: a conversation as its windows tell it, each turn once.

    `spoken` is role, line feed, text, line feed of each turn; `learned` is the text under the loss mask; both unescaped.
    """
    marks = F.filter(F.split("text", r"(?<=\n)<\|end\|>\n", -1), lambda x: x != "")
    turns = F.slice(marks, F.col("repeated") + 1, F.greatest(F.size(marks) - F.col("repeated"), F.lit(0)))

    def said(t: Column) -> Column:
        role = F.url_decode(F.regexp_extract(t, r"^<\|([^|]*)\|>\n", 1))
        body = F.regexp_replace(t, r"^<\|[^|]*\|>\n", "")
        return F.concat(role, F.lit("\n"), unescape(F.substring(body, 1, F.length(body) - 1)), F.lit("\n"))

    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    each = formatted.select("conv_id", "window", turns.alias("own"), F.array_join(learned, "").alias("learned"), F.length("text").alias("chars"))
    each = each.select("conv_id", F.size("own").alias("n"), "chars", F.struct("window", F.array_join(F.transform("own", said), "").alias("spoken"), "learned").alias("part"))
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", F.array_join("parts.spoken", "").alias("spoken"), F.array_join("parts.learned", "").alias("learned"), "formatted_chars")
