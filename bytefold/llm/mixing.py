"""Mixing sources to target weights: subset-sum budget fitting.

Method: documents are counted by exact length; each source's budget is split into whole copies of all its documents
and a rest, and the rest is filled by count of length from a bounded-knapsack table, from below and, where that misses,
by what is left out from above; the nearer of both counts. Up to `TABLE` words the table holds the whole rest, so the sum
is the nearest there is. Beyond, a proportional share of every length and the longest that fit are taken first, and the
table settles the last `TABLE` words, in which every length takes part. Of each length the documents with the smallest seeded hash are taken. Only length counts
enter the fitting; documents are ranked by buckets of their hash, so that no group of equal lengths is ever sorted as
a whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, cut

WEIGHTS = (5, 2, 1)
MOST = 3
TABLE = 1 << 23  # words, a byte and an int32 each
BUCKETS = 1024


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> the same with target. The weights repeat over the sources by code point, null last.

    All sizes are shared out by weight; a target stops at `most` times its source's size and the excess is shared by
    weight over the others, until none is above. The driver sees only sums.
    """
    first = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("at", F.spark_partition_id()))
    inside = first.withColumn("n", F.row_number().over(Window.partitionBy("at").orderBy(F.col("source").asc_nulls_last())))
    ends = first.groupBy("at").agg(F.count(F.lit(1)).alias("rows"))
    before = ends.alias("a").join(ends.alias("b"), F.col("b.at") < F.col("a.at"), "left").groupBy("a.at").agg(F.coalesce(F.sum("b.rows"), F.lit(0)).alias("before"))
    turn = F.pmod(F.col("n") + F.col("before") - 1, F.lit(len(weights)))
    ranked = cut(inside.join(before, "at").select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    above, rate = None, 0.0
    while True:  # the rate only grows, and with it the set of sources at their limit
        free = F.lit(True) if above is None else F.col("source_size") * most >= F.col("weight") * above
        kept, weight, n = ranked.agg(F.sum(F.when(free, 0).otherwise(F.col("source_size") * most)), F.sum(F.when(free, F.col("weight")).otherwise(0.0)), F.sum(F.when(free, 1).otherwise(0))).first()
        rate = (total - kept) / weight if weight else 0.0
        if not n or above is not None and rate <= above * (1 + 1e-15):
            break
        above = rate
    rate = max(rate, above or 0.0)
    return ranked.select("source", "source_size", F.least(F.col("weight") * rate, (F.col("source_size") * most).cast("double")).alias("target"))


def fill(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many of each length have the largest sum up to `goal`: a bounded knapsack by binary parts of each count.

    A step adds a part of one length to all sums reached before it, and a new sum remembers its step, which leads back.
    """
    take = np.zeros(len(lengths), np.int64)
    reached, step, parts, top = np.zeros(goal + 1, bool), np.zeros(goal + 1, np.int32), [], 0
    reached[0] = True
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        free, part = min(int(counts[i]), goal // size) if size else 0, 1
        while free > 0 and not reached[goal]:
            n = min(part, free)
            far = n * size
            top = min(goal, top + far)
            fresh = reached[: top - far + 1] & ~reached[far : top + 1]
            step[far : top + 1][fresh] = len(parts)
            reached[far : top + 1] |= fresh
            parts.append((i, n, far))
            free, part = free - n, part * 2
    at = goal - int(np.argmax(reached[::-1]))
    while at:
        i, n, far = parts[step[at]]
        take[i] += n
        at -= far
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes as near below `budget` as this finds, never more of a length
    than there are; exact up to a budget of `TABLE`."""
    counts = counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts
    if budget <= TABLE:
        return fill(lengths, counts, max(budget, 0))
    take = np.floor(counts * (budget / total)).astype(np.int64)
    rest = budget - int((take * lengths).sum())
    while rest < 0:  # rounding of the share
        i = int(np.argmax(take * lengths))
        take[i] -= 1
        rest += int(lengths[i])
    for i in np.argsort(-lengths, kind="stable").tolist():
        if rest > TABLE and lengths[i]:
            more = min(int(counts[i] - take[i]), rest // int(lengths[i]))
            take[i] += more
            rest -= more * int(lengths[i])
    # give some of each length back, as much as the table holds, so that what is taken can also be exchanged
    room, left = TABLE - rest, len(lengths)
    for i in np.argsort(lengths, kind="stable").tolist():
        if lengths[i] and room > 0:
            back = min(int(take[i]), room // (int(lengths[i]) * left))
            take[i] -= back
            rest += back * int(lengths[i])
            room -= back * int(lengths[i])
        left -= 1
    return take + fill(lengths, counts - take, min(rest, TABLE))


def nearest(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many of each length to take so that their sum comes as near to `budget` as fit() finds, from below or above."""
    total = int((lengths * counts).sum())
    below = fit(lengths, counts, int(budget))
    short = budget - int((below * lengths).sum())
    if short <= 0.5:  # no whole number above is nearer
        return below
    # what is left out of a sum just above the budget is a sum just below the rest
    above = counts.astype(np.int64) - fit(lengths, counts, max(total - int(np.ceil(budget)), 0))
    above = np.where(lengths == 0, below, above)
    over = int((above * lengths).sum()) - budget
    return above if 0 <= over < short else below


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def rank_of(seed: int = 7) -> Column:
    """The seeded rank of a row; equal for rows with equal ids and texts."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of each row of `docs` (doc_id, source, text).

    Size is the number of words of the text, 0 for null. A null source is a source of its own and comes last. A row
    is taken `copies` times, `most` at most. Equal rows are interchangeable; runs agree. An empty table gives none.
    """
    sized = docs.select("doc_id", "source", size_of("text").alias("size"), rank_of(seed).alias("h"))
    return choose(cut(sized), weights, most)


def choose(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """mix() of rows that are counted already: doc_id, source, size, h. They are read more than once."""
    counted = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = cut(targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    lengths = counted.alias("a").join(goals.alias("b"), same).select("a.source", "a.size", "a.n", "b.source_size", "b.target")

    def fitted(frame):
        whole, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        base = min(most, int(round(target)) // whole) if whole else 0
        frame["base"] = base
        frame["take"] = nearest(frame["size"].to_numpy(), frame["n"].to_numpy(), max(target - base * whole, 0.0)) if base < most and whole else 0
        return frame[["source", "size", "n", "source_size", "target", "base", "take"]]

    plan = cut(lengths.groupBy("source").applyInPandas(fitted, "source string, size long, n long, source_size long, target double, base long, take long"))
    bucket = F.shiftrightunsigned("h", 64 - BUCKETS.bit_length() + 1).alias("bucket")
    key = ["source", "size"]
    both = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))
    split = plan.filter((F.col("take") > 0) & (F.col("take") < F.col("n")))
    some = sized.withColumn("bucket", bucket).alias("a").join(split.alias("b"), both).select("a.doc_id", "a.source", "a.size", "a.h", "a.bucket", "b.take")
    filled = some.groupBy(*key, "bucket", "take").agg(F.count(F.lit(1)).alias("here"))
    filled = filled.withColumn("before", F.sum("here").over(Window.partitionBy(*key).orderBy("bucket")) - F.col("here"))
    edge = cut(filled.filter((F.col("before") < F.col("take"))).select(*key, "bucket", (F.col("take") - F.col("before")).alias("room"), "here"))
    rows = sized.withColumn("bucket", bucket).alias("a").join(plan.alias("b"), both).select("a.*", "b.source_size", "b.target", "b.base", "b.n", "b.take")
    where = both & (F.col("a.bucket") == F.col("b.bucket"))
    rows = rows.alias("a").join(edge.alias("b"), where, "left").select("a.*", "b.room", "b.here")
    sure = rows.filter((F.col("take") == 0) | (F.col("take") == F.col("n")) | F.col("room").isNull() | (F.col("room") >= F.col("here")))
    sure = sure.withColumn("extra", F.when(F.col("take") == 0, 0).when((F.col("take") == F.col("n")) | F.col("room").isNotNull(), 1).otherwise(0))
    close = rows.filter((F.col("take") > 0) & (F.col("take") < F.col("n")) & (F.col("room") < F.col("here")))
    close = close.withColumn("extra", F.when(F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("h", "doc_id")) <= F.col("room"), 1).otherwise(0))
    copies = (F.col("base") + F.col("extra")).alias("copies")
    return sure.unionByName(close).select("doc_id", "source", "size", "h", "source_size", "target", copies, (F.col("size") * copies).alias("taken"))
