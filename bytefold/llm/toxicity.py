"""Toxicity scores by weak supervision.

Method: many voters, each a lexicon entry (a word or the first bytes of words) or a pattern (a share of capitals, of
exclamation marks, of other symbols), vote on a text. A generative label model estimates by expectation-maximisation
how often each voter, the annotators among them, votes on toxic and on clean texts, and how voters correlate given the
class; correlated voters share their weight. Its posterior labels train a linear classifier on the voters,
which then scores every whole text.

Lexicons are found, not given: entries more frequent among toxic texts than among clean ones, by a likelihood-ratio
test of at least `LEAST_GAIN` and twice the logarithm of the number of entries tested, and in `LEAST_ODDS` times as many;
all that pass vote. All learning uses at most `MOST_ROWS` labelled rows outside the held-out fifth; scores use
the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textcore as tc
from .common import cut

MOST_ROWS = 20_000
LEAST_GAIN = 18.0
LEAST_TEXTS = 4
LEAST_ODDS = 4
SAME = 0.6  # correlation from which voters say the same thing
PREFIXES = (4, 5, 6, 8)
U64 = np.uint64


def entries(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, lexicon entry) of every word of a chunk: its hash as a whole and those of its first bytes, where it is as long."""
    low = tc.LOWER[buf]
    start, end, doc = tc.word_spans(low, off, tc.NOT_ALNUM)
    sums = tc.prefix_sums(low)
    rows, found = [doc], [tc.span_hashes(sums, start, end)]
    for n in PREFIXES:
        some = end - start >= n
        rows.append(doc[some])
        found.append(tc.span_hashes(sums, start[some], start[some] + n) ^ U64(0xA5A5 + n))
    return np.concatenate(rows), np.concatenate(found)


def patterns(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Shares of bytes per text: capitals, exclamation marks, other ASCII symbols, digits."""
    kind = np.zeros(256, np.int64)
    kind[0x41:0x5B], kind[0x21], kind[0x30:0x3A] = 1, 2, 4
    kind[[*range(0x23, 0x27), 0x2A, 0x2B, 0x3C, 0x3D, 0x3E, 0x40, 0x5E, 0x5F, 0x60, 0x7C, 0x7E]] = 3
    seen = kind[buf]
    size = np.maximum(np.diff(off), 1)
    out = np.empty((len(off) - 1, 4))
    for k in range(4):
        total = np.concatenate([[0], np.cumsum(seen == k + 1)])
        out[:, k] = (total[off[1:]] - total[off[:-1]]) / size
    return out


@dataclass
class Model:
    """A linear classifier over the presence of lexicon entries and patterns."""

    lexicon: np.ndarray  # sorted
    cuts: np.ndarray  # of patterns, above which they vote
    weights: np.ndarray
    bias: float

    def counts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, voters): how often each entry stands in each text, then 1 for each pattern above its cut and 1 if any entry stands there."""
        n = len(off) - 1
        out = np.zeros((n, len(self.lexicon) + len(self.cuts) + 1), np.float32)
        if len(self.lexicon):
            rows, found = entries(buf, off)
            table = np.zeros(1 << 16, bool)
            table[self.lexicon >> U64(48)] = True
            some = np.flatnonzero(table[found >> U64(48)])
            rows, found = rows[some], found[some]
            at = np.minimum(np.searchsorted(self.lexicon, found), len(self.lexicon) - 1)
            good = self.lexicon[at] == found
            np.add.at(out, (rows[good], at[good]), 1)
        out[:, len(self.lexicon) : -1] = patterns(buf, off) > self.cuts
        out[:, -1] = out[:, : len(self.lexicon)].any(axis=1)
        return out

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((counts > 0).astype(np.float32) @ self.weights + self.bias, -30, 30)))


def _chunks(n: int, size: int = 1024) -> list[slice]:
    """Slices of rows, so that the driver never holds the sample's votes as floats."""
    return [slice(at, at + size) for at in range(0, n, size)]


def label_model(votes: np.ndarray, silent: np.ndarray, labels: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior chances of toxicity given the votes (0/1, texts by voters) and the texts that no entry votes on.

    Expectation-maximisation of a two-class model that begins at whether any entry votes. Correlations given the class are
    estimated from the residuals of the votes in the first rounds; a voter's evidence is divided by the sum of those
    beyond `SAME`, so that voters which say the same thing count as one. A voter that does not vote abstains; that no
    entry votes is a vote of its own. The labels (0/1) say at the end which of both classes is the toxic one; nothing else
    takes them into account.
    """
    all_votes = np.column_stack([votes, silent]).astype(np.uint8)
    size = all_votes.shape[1]
    chance, share = np.where(silent, 0.02, 0.9), np.ones(size)
    for turn in range(rounds):
        prior = np.clip(chance.mean(), 1e-4, 1 - 1e-4)
        toxic, clean = np.zeros(size), np.zeros(size)
        for rows in _chunks(len(chance)):
            toxic += chance[rows] @ all_votes[rows]
            clean += (1 - chance[rows]) @ all_votes[rows]
        toxic, clean = (toxic + 0.1) / (chance.sum() + 1), (clean + 0.1) / ((1 - chance).sum() + 1)
        if turn < 2:
            spread = np.zeros((size, size), np.float32)
            for rows in _chunks(len(chance)):
                left = (all_votes[rows] - np.outer(chance[rows], toxic) - np.outer(1 - chance[rows], clean)).astype(np.float32)
                spread += left.T @ left
            scale = np.sqrt(np.diag(spread) / len(chance) + 1e-9)
            together = spread / len(chance) / np.outer(scale, scale)
            share = 1 / np.maximum(np.where(together >= SAME, np.minimum(together, 1), 0).sum(axis=1), 1)
            share[-1] = 1.0
        yes = np.log(np.clip(toxic, 1e-4, 1 - 1e-4) / np.clip(clean, 1e-4, 1 - 1e-4)) * share
        odds = np.concatenate([all_votes[rows] @ yes for rows in _chunks(len(chance))])
        was, chance = chance, 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + odds, -30, 30)))
        if np.abs(chance - was).max() < 1e-3:
            break
    ones, zeros = chance.sum(), (1 - chance).sum()
    if min(ones, zeros) > 1:
        share, apart = labels.mean(), chance @ labels / ones - (1 - chance) @ labels / zeros
        if apart < -3 * np.sqrt(share * (1 - share) * (1 / ones + 1 / zeros)):  # clearly the other class
            chance = 1 - chance
    return chance


def linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.05, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method with a ridge on all weights but the bias."""
    w = np.zeros(x.shape[1] + 1)
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    w[-1] = np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4))

    def padded(rows: slice) -> np.ndarray:
        return np.column_stack([x[rows], np.ones(len(x[rows]))]).astype(float)

    def loss(w: np.ndarray) -> float:
        total = 0.5 * float(keep @ (w * w))
        for rows in _chunks(len(x)):
            z = padded(rows) @ w
            total += float((np.logaddexp(0, z) - target[rows] * z).sum())
        return total

    now = loss(w)
    for _ in range(rounds):
        slope, curve = -keep * w, np.diag(keep)
        for rows in _chunks(len(x)):
            part = padded(rows)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope = slope + part.T @ (target[rows] - p)
            half = (part * np.sqrt(p * (1 - p) + 1e-6)[:, None]).astype(np.float32)  # steps need no more, and each is tested
            curve = curve + half.T @ half
        step, was = np.linalg.solve(curve, slope), now
        for _ in range(12):  # halved until it helps
            if (now := loss(w + step)) <= was:
                break
            step = step / 2
        else:
            break
        w = w + step
        if was - now < 1e-6 * max(1.0, was):
            break
    return w[:-1], float(w[-1])


def _gain(toxic: int, clean: int) -> F.Column:
    """Twice the log likelihood ratio of an entry's frequencies against one common frequency; 0 where clean texts have it more."""
    share = (F.col("toxic") + F.col("clean")) / (toxic + clean)

    def part(n: F.Column, expected: F.Column) -> F.Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    total = F.lit(0.0)
    for name, size in (("toxic", toxic), ("clean", clean)):
        total = total + part(F.col(name), share * size) + part(size - F.col(name), (1 - share) * size)
    return F.when(F.col("toxic") / toxic > F.col("clean") / clean, 2 * total).otherwise(0.0)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Learn from documents (doc_id, text) with labels (doc_id, toxic), never from held-out ones.

    A document labelled more than once counts as toxic if one label says so; null labels say nothing. Beyond
    `most_rows` labelled documents those with the smallest hash of their id are taken; of rows that repeat an id, the
    least text. Without a toxic or a clean example, or an entry that passes the test, every score is the share of toxic
    labels, or 0.
    """
    given = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    taken = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")
    sample = cut(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    nothing = Model(np.zeros(0, U64), np.full(4, np.inf), np.zeros(5), float(np.log((toxic + 1e-9) / (clean + 1e-9))) if toxic + clean else -30.0)
    if not toxic or not clean:
        return nothing

    def texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, buf, off in tc.chunks(batch.column(0)):
                rows, found = entries(buf, off)
                order = np.lexsort((rows, found))
                rows, found = rows[order], found[order]
                fresh = np.ones(len(found), bool)
                fresh[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
                rows, found = rows[fresh], found[fresh]
                first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
                bad = label[a:b][rows]
                sums = np.add.reduceat(bad, first) if len(first) else np.zeros(0, np.int64)
                size = np.diff(np.append(first, len(found)))
                yield pa.RecordBatch.from_arrays([pa.array(found[first].view(np.int64)), pa.array(sums.astype(np.int64)), pa.array((size - sums).astype(np.int64))], ["entry", "toxic", "clean"])

    seen = sample.mapInArrow(texts_with, "entry long, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = cut(seen.filter(F.col("toxic") >= LEAST_TEXTS))
    least = max(LEAST_GAIN, 2 * float(np.log(max(seen.count(), 1))))
    best = seen.filter(F.col("toxic") >= LEAST_ODDS * F.col("clean")).filter(_gain(toxic, clean) >= least).select("entry")
    lexicon = np.sort(np.array([r["entry"] for r in best.collect()], np.int64).view(U64))
    if not len(lexicon):
        return nothing
    model = Model(lexicon, np.full(4, np.inf), np.zeros(0), 0.0)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in tc.chunks(batch.column(0)):
                counts = np.minimum(model.counts(buf, off)[:, : len(lexicon)], 255).astype(np.uint8)
                packed = [row.tobytes() for row in counts]
                shares = [row.tobytes() for row in patterns(buf, off)]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(shares, pa.binary()), batch.column(1).slice(a, b - a)], ["counts", "shares", "toxic"])

    rows = sample.mapInArrow(voted, "counts binary, shares binary, toxic int").toArrow()
    label = rows["toxic"].to_numpy().astype(float)
    shares = np.frombuffer(b"".join(rows["shares"].to_pylist()), float).reshape(-1, 4)
    votes = (np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint8).reshape(len(label), len(lexicon)) > 0).astype(np.uint8)
    cuts = np.quantile(shares, 0.95, axis=0)
    votes = np.column_stack([votes, (shares > cuts).astype(np.uint8), votes.any(axis=1).astype(np.uint8)])  # entries, patterns, any entry
    del rows, shares
    order = np.lexsort((label, *votes.T[:8], votes.sum(axis=1)))  # rows come in any order; sums should not depend on it
    votes, label = votes[order], label[order]
    weights, bias = linear(votes, label_model(votes[:, :-1] > 0, votes[:, -1] == 0, label))
    return Model(lexicon, cuts, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` (any with a `text`), and `score`, 0 to 1, of every whole text, in place of a column of that
    name; null reads as empty."""
    docs = docs.drop("score")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for a, b, buf, off in tc.chunks(batch.column(at)):
                out[a:b] = model.scores(model.counts(buf, off))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "score"])

    return docs.mapInArrow(scored, schema)
