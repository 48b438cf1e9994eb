"""N-gram Jaccard join by set-relation skipping.

A document's set holds the 64-bit hashes of its distinct word n-grams. Equal sets are one node. Links are found by an
exact prefix index: in the order of their hashes, two sets that link share one token at least of a prefix, and several
of a longer one, so sets whose prefix tokens stand in no other set drop out at once; of the rest only the tokens that
stand in the fewest sets are indexed.

The index lists are used with two kinds of skipping. A list stands in blocks of like sizes: sets that link lie in one
block or in two neighbouring ones, so a set stands in its own block and the one below and all other blocks of the list
are never read for it. Inside a block, entries carry the token's position in their set, which bounds the overlap that a
pair can still reach, so entries of far positions are skipped. And answers are derived from
those of a similar set: each block is first compared with one of its sets, its hub; two sets that link with it need no
comparison for the classes, and by the triangle inequality of the Jaccard distance a pair can only link when its
distances to the hub differ by no more than the limit. What remains unanswered is compared pair by pair. No cap is set
anywhere, and no list is ever held by one task: a slice of texts in which many sets share a token sends it once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import components, cut, release

U64 = np.uint64
PRUNINGS = 2
HOT = 16  # sets of a slice that share a token; one that more share counts as more frequent than all others
MARK = 1 << 30


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its word k-grams), row by row; a text of fewer words has its whole sequence as one."""
    for at, _, buf, off in tc.chunks(texts):
        low = tc.LOWER[buf]
        start, end, doc = tc.word_spans(low, off, tc.SPACE)
        h = tc.span_hashes(tc.prefix_sums(low), start, end)
        grams = tc.gram_hashes(h, k)
        first = np.searchsorted(doc, np.arange(len(off)))
        for r in range(len(off) - 1):
            a, b = first[r], first[r + 1]
            if b - a >= k:
                yield at + r, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield at + r, tc.mix(tc.gram_hashes(h[a:b], int(b - a)) + U64(b - a))
            else:
                yield at + r, np.zeros(0, U64)


def set_hash(s: np.ndarray) -> int:
    """A hash of the set as a whole, as a signed long; an empty set has 0."""
    return int(tc.mix(tc.mix(s ^ U64(0x5851F42D4C957F2D)).sum(keepdims=True) + U64(len(s)))[0].astype(np.int64)) if len(s) else 0


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """(tokens to index, tokens that a linking pair shares among them at least) for a set of n."""
    spare = n - -(-percent * n // 100)
    shared = 1 + n // 10
    return min(n, spare + shared), shared


def _nodes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig = [], []
            for _, s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                sig.append(set_hash(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64())], ["doc_id", "n_shingles", "sig"])

    return run


def _index(percent: int, k: int):
    """Rows key, other, pos of the indexed tokens: token, sig and place. Of a token that more than HOT sets of a slice share
    one row goes there, with MARK added to its place; its sets need no answer, and stand as sig, token and -1 - place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.parts(batches, 0):
            seen: set[int] = set()
            tokens, sigs, sizes = [np.zeros(0, U64)], [], []
            for _, s in shingle_sets(batch.column(0), k):
                sig = set_hash(s)
                if len(s) and sig not in seen:
                    seen.add(sig)
                    sizes.append(prefix_sizes(len(s), percent)[0])
                    tokens.append(s[: sizes[-1]])
                    sigs.append(sig)
            token, sig = np.concatenate(tokens).view(np.int64), np.repeat(np.array(sigs, np.int64), sizes)
            pos = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in sizes)])
            order = np.argsort(token, kind="stable")
            fresh = np.ones(len(token), bool)
            fresh[1:] = token[order][1:] != token[order][:-1]
            group = np.cumsum(fresh) - 1
            hot, first = np.zeros(len(token), bool), np.zeros(len(token), bool)
            hot[order] = np.bincount(group, minlength=1)[group] > HOT
            first[order] = fresh
            key, other, place = np.where(hot, sig, token), np.where(hot, token, sig), np.where(hot, -1 - pos, pos)
            marks = np.flatnonzero(hot & first)
            columns = (np.concatenate([key, token[marks]]), np.concatenate([other, sig[marks]]), np.concatenate([place, pos[marks] + MARK]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "other", "pos"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, sets = [], []
            for _, s in shingle_sets(batch.column(0), k):
                sig.append(set_hash(s))
                sets.append(s.tobytes())
                if len(sig) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(sets, pa.binary())], ["sig", "tokens"])
                    sig, sets = [], []
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(sets, pa.binary())], ["sig", "tokens"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in sets]))], ["token", "sig"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [len(np.intersect1d(np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64), assume_unique=True)) for a, b in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64())], ["a", "b", "shared"])


def join(docs: DataFrame, percent: int = 85, k: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text; other columns are ignored).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets; component_id is the smallest
    doc_id that links reach. Null and empty texts have no shingles and link with nothing. Rows that repeat a doc_id
    share its component; a row without doc_id links with nothing and has a null component. An empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    release(docs.sparkSession)
    rows = cut(docs.mapInArrow(_nodes(k), "doc_id long, n_shingles long, sig long"))
    docs = docs.filter("doc_id is not null")
    # cut, so that joins with it are of plain exchanges, where Spark can split the rows of a set that has many copies
    nodes = cut(rows.filter("n_shingles > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")))
    sent = docs.select("text").mapInArrow(_index(percent, k), "key long, other long, pos int").withColumn("known", F.col("pos") < 0)
    line = Window.partitionBy("key", "known")
    seen = sent.select("*", F.min("other").over(line).alias("lo"), F.max("other").over(line).alias("hi"), F.count(F.lit(1)).over(line).alias("df"), (F.max("pos").over(line) >= MARK).alias("hot"))
    listed = seen.filter("known or (lo <> hi or hot) and pos < " + str(MARK))
    of = [F.when(F.col("known"), F.col(a)).otherwise(F.col(b)) for a, b in (("key", "other"), ("other", "key"))]
    rank = F.when(F.col("known") | F.col("hot"), MARK).otherwise(F.col("df"))
    shared = listed.select(of[0].alias("sig"), of[1].alias("token"), rank.alias("df"), F.when(F.col("known"), -1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"))
    shared = shared.groupBy("sig", "token").agg(F.max("df").alias("df"), F.max("pos").alias("pos"))
    held = shared.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("df", "token", "pos"))).alias("held"))
    # of a set's indexed tokens, those that no other set has are the rarest; a pair must share one of the `need` rarest
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100)
    size = F.least(F.col("n"), spare + 1 + F.floor(F.col("n") / 10))
    low = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 10)
    need = size - low + 1 - (size - F.size("held"))
    chosen = held.join(nodes, "sig").withColumn("need", need.cast("int")).filter("need > 0")
    chosen = cut(chosen.select("sig", "doc_id", "n", F.slice("held", 1, F.least(F.col("need"), F.size("held"))).alias("held")))
    release(docs.sparkSession)

    texts = docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(k), "sig long, tokens binary").dropDuplicates(["sig"])
    sets = cut(sets.join(chosen.select("sig"), "sig", "left_semi"))
    release(docs.sparkSession)
    # the same test on whole sets: a set with more tokens of its own than a link can spare links with none
    for _ in range(PRUNINGS):
        alone = sets.mapInArrow(_tokens, "token long, sig long").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("sig").alias("sig")).filter("n = 1")
        own = alone.groupBy("sig").agg(F.count(F.lit(1)).alias("own"))
        left = chosen.drop("own").join(own, "sig", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        chosen = cut(left.filter(F.col("own") <= F.col("n") - F.ceil(F.col("n") * percent / 100)))
        sets = cut(sets.join(chosen.select("sig"), "sig", "left_semi"))
        release(docs.sparkSession)
    lists = chosen.select("sig", "doc_id", "n", "own", F.explode("held").alias("t")).select("sig", "doc_id", "n", "own", F.col("t.token").alias("token"), F.col("t.pos").alias("pos"))
    # sizes of linking sets differ by a factor of 100 / percent at most, so by one block at most
    block = F.floor(F.log("n") / (log(100 / percent) * (1 + 1e-9)))
    lists = lists.withColumn("block", F.explode(F.array(block, block - 1)))

    def possible(a: str, b: str):
        """Sizes, tokens of their own, and positions (from 0, in hash order) leave room for enough overlap."""
        (na, oa, i), (nb, ob, j) = ([F.col(x + c) for c in ("n", "own", "pos")] for x in (a, b))
        most = F.least(na - oa, nb - ob, F.least(i, j) + 1 + F.least(na - 1 - i, nb - 1 - j))
        return (100 + percent) * most >= percent * (na + nb)

    def measured(pairs: DataFrame) -> DataFrame:
        """a, b, shared of distinct pairs of sigs. They are cut from what made them distinct, so that Spark may split a hub's."""
        one = cut(pairs).join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x")), "a")
        both = one.join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
        found = cut(both.mapInArrow(_verify, "a long, b long, shared long"))
        release(docs.sparkSession)
        return found

    sizes = chosen.select("sig", "doc_id", "n")

    def links(found: DataFrame) -> DataFrame:
        a, b = (sizes.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("doc_id").alias(f"d{x}")) for x in "ab")
        full = found.join(a, "a").join(b, "b").withColumn("near", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
        return full.withColumn("linked", 100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared")))

    # the set with the fewest tokens of its own stands nearest to the others
    hubs = lists.groupBy("token", "block").agg(F.min_by(F.struct("sig", "n", "own", "pos"), F.struct(F.col("own") / F.col("n"), "sig")).alias("hub"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    met = lists.join(hubs, ["token", "block"]).filter(F.col("sig") != F.col("hub.sig"))
    star = met.filter(possible("", "hub.")).select(F.col("hub.sig").alias("a"), F.col("sig").alias("b")).distinct()
    first = cut(links(measured(star)))
    classes = cut(components(_edges(first)))
    # a hub whose lists hold sets of its class alone is answered; of the others, each set that is not of the hub's class
    # meets the sets of the same hub, once per hub and not once per token
    under = lists.join(hubs.select("token", "block", F.col("hub.sig").alias("h")), ["token", "block"]).select("h", "sig", "doc_id", "n", "own").distinct()
    classed = under.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("class", F.coalesce("component", "doc_id")).drop("component", "doc_id")
    done = classed.filter("sig = h").select("h", F.col("class").alias("done"))
    near = first.select(F.col("a").alias("h"), F.col("b").alias("sig"), (1 - F.col("near")).alias("far"), F.col("shared").alias("met"))
    still = cut(classed.filter("sig <> h").join(done, "h").join(near, ["h", "sig"], "left"))
    apart = F.abs(F.col("a.far") - F.col("b.far")) <= 1 - percent / 100 + 1e-9
    # two sets share what both share with the hub, and beyond it only tokens that neither has alone
    beyond = F.least(*[F.col(f"{x}.n") - F.col(f"{x}.met") - F.col(f"{x}.own") for x in "ab"])
    total = percent * (F.col("a.n") + F.col("b.n"))
    enough = (100 + percent) * (F.least("a.met", "b.met") + beyond) >= total
    fits = (100 + percent) * F.least(F.col("a.n") - F.col("a.own"), F.col("b.n") - F.col("b.own")) >= total
    unlike = (F.col("a.sig") != F.col("b.sig")) & (F.col("a.class") != F.col("b.class"))
    pairs = still.filter("class <> done").alias("a").join(still.alias("b"), (F.col("a.h") == F.col("b.h")) & unlike & fits & F.coalesce(apart & enough, F.lit(True)))
    second = links(measured(pairs.select(F.least("a.sig", "b.sig").alias("a"), F.greatest("a.sig", "b.sig").alias("b")).distinct()))
    edges = _edges(first).unionByName(_edges(second))
    repeated = rows.filter("n_shingles > 0 and doc_id is not null").join(nodes.select("sig", F.col("doc_id").alias("top")), "sig").filter("doc_id <> top").select(F.col("doc_id").alias("src"), F.col("top").alias("dst"))
    final = components(edges.unionByName(repeated))
    tops = nodes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("sig", F.coalesce("component", "doc_id").alias("top"))
    out = rows.join(tops, "sig", "left")
    return out.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("top")).otherwise(F.col("doc_id")).alias("component_id"))


def _edges(found: DataFrame) -> DataFrame:
    return found.filter("linked").select(F.col("da").alias("src"), F.col("db").alias("dst"))
