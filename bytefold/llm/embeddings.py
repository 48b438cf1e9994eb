"""Near-duplicate embeddings by collision-counting projections.

Method: vectors are scaled to length one and projected on many seeded random directions; per projection they are
sorted, and each query vector counts how often another vector falls into the window around its own projection. Pairs
whose count reaches a threshold, calibrated so that a pair just at the similarity limit is missed with a chance below
`MISS`, are verified by their cosine in double precision.

Work is dealt in tiles. Copies of a vector are one row with a weight. The rows of a label are cut into slabs along one
direction of length one; linked vectors differ there by no more than their distance, so only slabs that near each
other meet. A tile returns its links as sums per vector and as a spanning forest, never as a list of all pairs.
"""

from __future__ import annotations

from functools import cache
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

SIMILAR = 0.98
PROJECTIONS = 40
WIDTH = 1.0  # half a window, in standard deviations of the difference of a pair at the limit
MISS = 1e-6
SLAB = 2048
SEED = 11


@cache
def directions(dim: int, n: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((dim, n))


@cache
def threshold(n: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """The largest count that a pair at the limit reaches but for a chance of `miss`: binomial, a Gaussian share per window."""
    p, tail = erf(width / sqrt(2)), 0.0
    for k in range(n + 1):
        tail += comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail > miss:
            return k
    return n


class Forest:
    """Union-find over positions, the smallest position on top."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of the pairs of unit rows with a cosine of `similar` or more; of a tile with itself, each once."""
    away = directions(a.shape[1])
    half = WIDTH * sqrt(max(0.0, 2 - 2 * similar))
    pa, pb = a @ away, b @ away
    count = np.zeros(len(a) * len(b), np.uint8)
    for i in range(away.shape[1]):
        order = np.argsort(pb[:, i], kind="stable")
        line = pb[order, i]
        low, high = np.searchsorted(line, pa[:, i] - half), np.searchsorted(line, pa[:, i] + half, side="right")
        size = high - low
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        count[np.repeat(np.arange(len(a)) * len(b), size) + order[at]] += 1
    x, y = np.divmod(np.flatnonzero(count >= threshold()), len(b))
    if same:
        x, y = x[x < y], y[x < y]
    keep = np.zeros(len(x), bool)
    for s in range(0, len(x), 1 << 16):
        keep[s : s + (1 << 16)] = np.einsum("ij,ij->i", a[x[s : s + (1 << 16)]], b[y[s : s + (1 << 16)]]) >= similar
    return x[keep], y[keep]


def _unit(frame: pd.DataFrame) -> np.ndarray:
    v = np.stack(frame["embedding"].to_numpy()).astype(float)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def near(vectors: DataFrame, similar: float = SIMILAR, slab: int = SLAB) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding, label; other columns are ignored).

    Rows link when their labels are equal and not null, their vectors of one length, and the cosine is `similar` or
    more. A null or zero vector, one with a null or non-finite component and one with a null vec_id or label links
    with nothing. Rows that repeat a vec_id count as vectors of their own but share its component. An empty table
    gives none.
    """
    good = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding")
    plus = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))  # -0.0 and 0.0 are one
    valid = rows.filter(good).filter(fine).withColumn("embedding", plus)
    key = F.struct("label", F.size("embedding").alias("n"), F.xxhash64("embedding").alias("h"), F.hash("embedding").alias("g"))
    # one row per distinct vector; its smallest id stands for the copies
    some = valid.withColumn("key", key)
    reps = cut(some.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding")))
    reach = sqrt(max(0.0, 2 - 2 * similar)) * (1 + 1e-9)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    weights = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: F.when(i % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)))
    along = F.aggregate(F.zip_with("embedding", weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x) / length / F.sqrt(F.size("embedding"))
    placed = reps.withColumn("along", along)
    spread = placed.groupBy("key.label", "key.n").agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("along", F.array(*[F.lit(i / 1024) for i in range(1, 1024)]), 10000).alias("cuts"))
    many = F.ceil(F.col("rows") / slab).cast("int")
    picked = F.transform(F.sequence(F.lit(1), F.greatest(F.least(many, F.lit(1024)) - 1, F.lit(1))), lambda i: F.element_at("cuts", F.floor(i * 1023 / F.greatest(F.least(many, F.lit(1024)), F.lit(1))).cast("int") + 1))
    # quantiles are approximate, so they are drawn once
    cuts = cut(spread.select("label", "n", F.when(many > 1, F.array_distinct(picked)).otherwise(F.array().cast("array<double>")).alias("cuts")))
    slabs = placed.join(cuts, (F.col("key.label") == F.col("label")) & (F.col("key.n") == F.col("n"))).select("label", "n", "rep", "weight", "embedding", "along", "cuts")

    def slab_of(x):
        return F.size(F.filter("cuts", lambda c: c < x))

    cells = slabs.withColumn("slab", slab_of(F.col("along"))).withColumn("to", slab_of(F.col("along") + reach))
    # a slab with more rows than a tile takes, as with more than 1024 slabs, is dealt over blocks by hash
    full = cells.groupBy("label", "n", "slab").agg(F.max("to").alias("to"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / (2 * slab))).cast("int").alias("blocks"))
    cells = cells.drop("to").join(full, ["label", "n", "slab"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = cells.select("label", "n", "slab", "block", "rep", "weight", "embedding")
    # a block meets itself, the later blocks of its slab and all blocks of the higher slabs that a row of its slab may reach
    blocks = cut(full.select("label", "n", "slab", "to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    a, b = blocks.alias("a"), blocks.alias("b")
    later = (F.col("b.slab") > F.col("a.slab")) | (F.col("b.block") >= F.col("a.block"))
    near_by = F.col("b.slab").between(F.col("a.slab"), F.col("a.to")) & later
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.n") == F.col("b.n")) & near_by)
    pairs = cut(pairs.select("a.label", "a.n", "a.slab", "a.block", F.col("b.slab").alias("slab2"), F.col("b.block").alias("block2")))
    tile = ["label", "n", "slab", "block", "slab2", "block2"]
    left = cells.join(pairs, ["label", "n", "slab", "block"]).select(*tile, "rep", "weight", "embedding", F.lit(0).alias("side"))
    other = cells.withColumnsRenamed({"slab": "slab2", "block": "block2"})
    right = other.join(pairs.filter("slab <> slab2 or block <> block2"), ["label", "n", "slab2", "block2"]).select(*tile, "rep", "weight", "embedding", F.lit(1).alias("side"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep", kind="stable")
        same = (frame["slab"].iloc[0], frame["block"].iloc[0]) == (frame["slab2"].iloc[0], frame["block2"].iloc[0])
        a, b = frame[frame["side"] == 0], frame[frame["side"] == (0 if same else 1)]
        x, y = tile_links(_unit(a), _unit(b), bool(same), similar) if len(a) and len(b) else (np.zeros(0, np.int64),) * 2
        ids, weights = np.concatenate([a["rep"], b["rep"]]), np.concatenate([a["weight"], b["weight"]])
        y = y + len(a)
        links = np.bincount(np.concatenate([x, y]), weights=weights[np.concatenate([y, x])], minlength=len(ids)).astype(np.int64)
        forest = Forest(len(ids))
        edges = [(ids[i], ids[j]) for i, j in zip(x.tolist(), y.tolist()) if forest.join(i % len(a) if same else i, j % len(a) if same else j)]
        some = np.flatnonzero(links)
        out = {"rep": np.concatenate([ids[some], [i for i, _ in edges]]), "links": np.concatenate([links[some], [0] * len(edges)]), "other": np.concatenate([[0] * len(some), [j for _, j in edges]])}
        return pd.DataFrame({k: np.asarray(v, np.int64) for k, v in out.items()} | {"edge": np.arange(len(some) + len(edges)) >= len(some)})

    found = cut(left.unionByName(right).groupBy(*tile).applyInPandas(work, "rep long, links long, other long, edge boolean"))
    links = found.filter("not edge").groupBy("rep").agg(F.sum("links").alias("links"))
    copies = some.select("key", F.col("vec_id").alias("copy")).join(reps.select("key", "rep", "weight"), "key")
    same_id = copies.filter("copy <> rep").select(F.col("copy").alias("src"), F.col("rep").alias("dst"))
    classes = components(found.filter("edge").select(F.col("rep").alias("src"), F.col("other").alias("dst")).unionByName(same_id))
    counts = reps.join(links, "rep", "left").select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    whole = rows.withColumn("ok", good & F.coalesce(fine, F.lit(False))).withColumn("key", F.when(F.col("ok"), F.struct("label", F.size("embedding").alias("n"), F.xxhash64(plus).alias("h"), F.hash(plus).alias("g"))))
    out = whole.alias("a").join(counts.alias("c"), F.col("a.key") == F.col("c.key"), "left").select("a.vec_id", F.coalesce("c.n_links", F.lit(0)).cast("long").alias("n_links"))
    out = out.join(classes.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id").alias("component_id")
    return out.select("vec_id", "n_links", component, F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"))
