"""Exact top-k inner products by a bit-sliced index.

Method: components are quantised to integers, and each attribute of a block of rows is kept as bitmaps, one per binary
digit. A query's scores are added up in bitmap arithmetic (carry-save adders over the products of its digits with the
slices), from a lowest slice on that is a parameter. The top rows are then selected from the most significant slice
downward; rows that the slices left out could still move across the boundary are resolved by exact integer products.

Queries and rows meet in cells of a block of rows and a block of queries, both of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
BLOCK = 4096
QUERIES = 1024
AT_ONCE = 128
LOWEST = 5
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
LONG = 1 << 63


def quantise(vectors: list, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole numbers: int64, or Python's where a product could leave 64 bits."""
    x = np.floor(scale * np.stack(vectors).astype(float))
    if x.size and np.abs(x).max() >= 1 << 26:
        return np.array([[int(v) for v in row] for row in x.tolist()], object)
    return x.astype(np.int64)


def slices(x: np.ndarray) -> list[list[np.ndarray]]:
    """Bitmaps (64-bit words over the rows) of the digits of each column of `x`, which has no negative entries."""
    rows = -(-len(x) // 64) * 64
    padded = np.zeros((x.shape[1], rows), np.int64)
    padded[:, : len(x)] = x.T
    digits = [max(1, int(c.max()).bit_length()) if len(x) else 1 for c in x.T]
    return [[np.packbits((c >> d & 1).astype(np.uint8), bitorder="little").view(np.uint64) for d in range(n)] for c, n in zip(padded, digits)]


class Adder:
    """Sums of shifted bitmaps for many queries at once: carry-save, with two rows of digits kept until the end."""

    def __init__(self, shape: tuple[int, int]):
        self.shape, self.at = shape, {}

    def add(self, weight: int, bits: np.ndarray) -> None:
        while True:
            have = self.at.setdefault(weight, [])
            if len(have) < 2:
                have.append(bits)
                return
            a, b = have
            half = a ^ b
            carry = (a & b) | (half & bits)
            self.at[weight] = [half ^ bits]
            weight, bits = weight + 1, carry

    def digits(self) -> list[np.ndarray]:
        out, weight = [], 0
        while self.at and weight <= max(self.at):
            have = self.at.pop(weight, [])
            if len(have) == 2:
                a, b = have
                self.add(weight + 1, a & b)
                have = [a ^ b]
            out.append(have[0] if have else np.zeros(self.shape, np.uint64))
            weight += 1
        return out


def kth_value(digits: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value per query, read from the most significant slice downward; there are k valid rows at least."""
    n = len(digits[0])
    tied, need, value = np.broadcast_to(valid, digits[0].shape).copy(), np.full(n, k), np.zeros(n, np.int64)
    for d in reversed(range(len(digits))):
        ones = tied & digits[d]
        count = np.bitwise_count(ones).sum(axis=1).astype(np.int64)
        up = count >= need
        value |= up.astype(np.int64) << d
        need = np.where(up, need, need - count)
        tied = np.where(up[:, None], ones, tied & ~digits[d])
    return value


def at_least(digits: list[np.ndarray], valid: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Bitmaps of the valid rows whose value is no less than each query's `floor`."""
    over, tied = np.zeros_like(digits[0]), np.broadcast_to(valid, digits[0].shape).copy()
    floor = np.maximum(floor, 0)
    for d in reversed(range(len(digits))):
        want = np.where(floor >> d & 1, ONES, np.uint64(0))[:, None]
        over |= tied & digits[d] & ~want
        tied &= ~(digits[d] ^ want)
    return over | tied


def best_of_block(ids: np.ndarray, marks: np.ndarray, x: np.ndarray, query_marks: np.ndarray, q: np.ndarray, k: int, lowest: int = LOWEST) -> list[tuple[int, int, int]]:
    """(query position, row position, score) of the k best rows of a block per query, ties to smaller ids; a query's own row never."""
    out: list[tuple[int, int, int]] = []

    def settle(i: int, rows: np.ndarray) -> None:
        score = x[rows] @ q[i]
        keep = marks[rows] != query_marks[i]
        rows, score = rows[keep], score[keep]
        order = sorted(range(len(rows)), key=lambda r: (-score[r], ids[rows[r]]))[:k] if x.dtype == object else np.lexsort((ids[rows], -score))[:k]
        out.extend((i, int(rows[r]), int(score[r])) for r in order)

    if x.dtype == object or q.dtype == object or len(x) <= k + 1:
        for i in range(len(q)):
            settle(i, np.arange(len(x)))
        return out
    low, high = x.min(axis=0), x.max(axis=0)
    up, down = slices(x - low), slices(high - x)  # a negative factor takes the distance from the top
    words = len(up[0][0])
    valid = np.packbits(np.arange(words * 64) < len(x), bitorder="little").view(np.uint64)[None, :]
    for s in range(0, len(q), AT_ONCE):
        part = q[s : s + AT_ONCE]
        size, sum_of, slack = np.abs(part), Adder((len(part), words)), np.zeros(len(part), np.int64)
        for j in range(part.shape[1]):
            for side, planes in ((part[:, j] > 0, up[j]), (part[:, j] < 0, down[j])):
                if not side.any():
                    continue
                for c in range(int(size[side, j].max()).bit_length()):
                    has = side & (size[:, j] >> c & 1).astype(bool)
                    if not has.any():
                        continue
                    mask = np.where(has, ONES, np.uint64(0))[:, None]
                    for d, plane in enumerate(planes):
                        if c + d < lowest:
                            slack += has.astype(np.int64) << (c + d)
                        else:
                            sum_of.add(c + d - lowest, mask & plane)
        digits = sum_of.digits() or [np.zeros((len(part), words), np.uint64)]
        # what lies below the lowest slice adds up to `slack` at most
        floor = kth_value(digits, valid, k + 1) - (slack >> lowest) - 1
        chosen = at_least(digits, valid, floor)
        for i in range(len(part)):
            settle(s + i, np.flatnonzero(np.unpackbits(chosen[i].view(np.uint8), bitorder="little")))
    return out


def top(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = SCALE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k best other rows.

    `vectors` has vec_id and embedding; other columns are ignored. Vectors that are null or hold a null or non-finite
    component, rows with a null vec_id, and rows of another length than the query's take no part. A repeated row is a
    row of its own, as query and as candidate. Scores beyond 64 bits are ranked exactly inside a block and returned as
    the nearest long. An empty table gives none.
    """
    fine = F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = cut(vectors.select("vec_id", "embedding").filter(fine).filter(F.size("embedding") > 0).withColumn("mark", F.monotonically_increasing_id()).withColumn("n", F.size("embedding")))
    asked = rows.filter(F.col("vec_id") % every == 0)
    sizes = rows.groupBy("n").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.sum((F.col("vec_id") % every == 0).cast("int")) / queries)).cast("int").alias("parts"))
    h = F.xxhash64("mark")
    left = rows.join(F.broadcast(sizes), "n").withColumn("b", F.pmod(h, F.col("blocks")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = asked.join(F.broadcast(sizes), "n").withColumn("p", F.pmod(h, F.col("parts")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["n", "b", "p"]

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            x, q = quantise(a["embedding"].tolist(), scale), quantise(b["q_embedding"].tolist(), scale)
            if x.dtype != q.dtype:
                x, q = x.astype(object), q.astype(object)
            found = best_of_block(a["vec_id"].to_numpy(), a["mark"].to_numpy(), x, b["q_mark"].to_numpy(), q, k)
        i, j, score = ([f[c] for f in found] for c in range(3))
        return pd.DataFrame({"mark": b["q_mark"].to_numpy()[i], "query_id": b["q_vec_id"].to_numpy()[i], "vec_id": a["vec_id"].to_numpy()[j], "score": [max(-LONG, min(LONG - 1, s)) for s in score]}).astype("int64")

    columns = [*cell, "vec_id", "mark", "embedding"]
    left, right = left.select(*columns), right.select(*[F.col(c).alias(f"q_{c}") for c in columns])
    cells = left.groupBy(*cell).cogroup(right.groupBy(*[f"q_{c}" for c in cell]))
    found = cells.applyInPandas(work, "mark long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("mark").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("mark", "query_id", "vec_id", "score", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
