"""Substring dedup by recompression.

Method: texts are rewritten level by level. A level first names every run of one symbol, then every adjacent pair whose
left symbol falls into the left half of the alphabet and whose right symbol into the right half. A name is a function of
what it stands for, so it is global: one name means one string of words in every text, and equal substrings get equal
symbols but near their ends. Each symbol knows the words that its formation depends on.

Spark rounds go down the levels. The first brings the high symbols of all texts together, each verified by a second hash
of its own words: one that a smaller document has too shows a long repeat, and settles all windows inside it at once.
For the windows that are left, the next round does so with low symbols: a window is anchored at the symbol with the
longest text among those that begin in its first half and depend on words of the window alone; the half a window of words
that begins there is the anchor. So equal windows have equal anchors, and anchors that only one text has rule their
windows out. Windows with a shared anchor are verified by 128 bits of their own words in
the last round; the smallest document that has a window keeps it. A window without such a symbol (long runs) is its own
anchor. Copies of a whole text are settled by its first document.

Hot strings never gather: a batch of texts settles among its own what it can and sends one row per symbol or window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import textcore as tc
from .common import cut, fresh, settle

U64 = np.uint64
AGAIN = U64(0x2545F4914F6CDD1D)  # makes second hashes of words
FAR = np.int64(1 << 60)
HIGH = (12,)  # levels whose symbols show long repeats, of about 30 words: a level has 3/4 of the symbols of the one below
LOW = 2  # levels whose symbols anchor single windows


def recompress(symbol, row, start, end, left, right, turn: int):
    """One round: (symbols, rows, first word, word behind the last, first and last word of what each depends on)."""
    n = len(symbol)
    fresh = np.ones(n, bool)
    fresh[1:] = (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(fresh)
    b = np.append(a[1:], n) - 1
    count = b - a + 1
    run = symbol[a].copy()
    many = count > 1
    run[many] = tc.mix(run[many] * U64(0x9FB21C651E98DF25) + count[many].astype(U64) + U64(turn))
    row, start, end = row[a], start[a], end[b]
    # a run ends where its neighbours differ, so it depends on them
    left = np.where(a > 0, left[np.maximum(a - 1, 0)], -1)
    right = np.where(b < n - 1, right[np.minimum(b + 1, n - 1)], FAR)
    second_half = (tc.mix(run ^ U64(turn * 7919)) >> U64(63)).astype(bool)
    opens = np.zeros(len(run), bool)
    opens[:-1] = ~second_half[:-1] & second_half[1:] & (row[1:] == row[:-1])
    closes = np.zeros(len(run), bool)
    closes[1:] = opens[:-1]
    i = np.flatnonzero(~closes)
    pair = opens[i]
    j = np.where(pair, i + 1, i)
    name = np.where(pair, tc.mix(run[i] * U64(0xD6E8FEB86659FD93) + tc.mix(run[j]) + U64(turn)), run[i])
    # a symbol that stays alone depends on the neighbour it could have paired with
    before, after = np.maximum(i - 1, 0), np.minimum(i + 1, len(run) - 1)
    low = np.where(~pair & second_half[i], left[before], left[i])
    high = np.where(pair, right[j], np.where(~second_half[i], right[after], right[i]))
    return name, row[i], start[i], end[j], low, high


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, first byte, last byte, row) of every word of a chunk of texts."""
    at, to, row = tc.word_spans(buf, off, tc.SPACE)
    return tc.span_hashes(tc.prefix_sums(buf), at, to), at, to, row


def _start(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    place = np.arange(len(words), dtype=np.int64)
    return words, row, place, place + 1, place, place + 1


def long_symbols(buf: np.ndarray, off: np.ndarray, window: int, high: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """(row, first word in it, words, name, second hash) of the symbols of `high` levels that hold a window at least."""
    words, _, _, row = _words(buf, off)
    power, inverse = tc.powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(tc.mix(words ^ AGAIN) * power[: len(words)], dtype=U64)])
    state, found = _start(words, row), []
    for turn in range(1, max(high) + 1):
        if len(state[0]):
            state = recompress(*state, turn)
        name, at, start, end = state[:4]
        if turn in high:
            k = np.flatnonzero(end - start >= window)
            more = tc.mix((sums[end[k]] - sums[start[k]]) * inverse[start[k]] + (end[k] - start[k]).astype(U64))
            found.append((at[k], start[k] - np.searchsorted(row, at[k]), end[k] - start[k], name[k], more))
    return tuple(np.concatenate(c) for c in zip(*found))


def anchored(buf: np.ndarray, off: np.ndarray, window: int, low: int) -> tuple[np.ndarray, ...]:
    """(row, first word in it, hash, second hash, anchor) of every window of a chunk of texts."""
    words, at, to, row = _words(buf, off)
    whole = tc.gram_hashes(words, window)
    n = len(whole)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), whole, whole, whole
    again = tc.gram_hashes(tc.mix(words ^ AGAIN), window)
    inside = np.flatnonzero(row[:n] == row[window - 1 :])
    half = window // 2 + 1
    halves, place, state = tc.gram_hashes(words, half), np.arange(len(words), dtype=np.int64), _start(words, row)
    letters = np.concatenate([[0], np.cumsum(to - at)])  # what stands between words may differ
    found, best, anchor = np.zeros(n, bool), np.zeros(n, U64), whole.copy()
    for turn in range(1, low + 1):
        state = recompress(*state, turn)
        name, _, start, end, left, right = state
        size = np.minimum(letters[end] - letters[start], 255).astype(U64)
        rank = (size << U64(56)) | (tc.mix(name) >> U64(8))
        first, last = np.searchsorted(left, place[:n]), np.searchsorted(right, place[:n] + window, side="right")
        last = np.minimum(last, np.searchsorted(start, place[:n] + window - half, side="right"))
        for step in range(int((last - first).max(initial=0))):
            k = first + step
            ok = np.flatnonzero(k < last)
            k = k[ok]
            up = (rank[k] > best[ok]) | ~found[ok]
            ok, k = ok[up], k[up]
            found[ok], best[ok], anchor[ok] = True, rank[k], halves[start[k]]
    return row[inside], inside - np.searchsorted(row, row[inside]), whole[inside], again[inside], anchor[inside]


def _gather(texts: pa.Array, what, *given) -> tuple[np.ndarray, ...]:
    """What long_symbols() or anchored() finds in a whole batch, its texts numbered through."""
    parts = [(a, what(buf, off, *given)) for a, _, buf, off in tc.chunks(texts)]
    if not parts:
        return what(np.zeros(0, np.uint8), np.zeros(1, np.int64), *given)
    return (np.concatenate([a + p[0] for a, p in parts]), *(np.concatenate(c) for c in list(zip(*(p for _, p in parts)))[1:]))


def _listed(row: np.ndarray, anchor: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which of the (row, anchor) stand in the list of their row."""
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    known = lists.flatten().to_numpy().view(U64)
    if not len(known):
        return np.zeros(len(row), bool)
    mixed = np.sort(tc.mix(known + tc.mix(np.repeat(np.arange(len(size)), size).astype(U64))))
    asked = tc.mix(anchor + tc.mix(row.astype(U64)))
    return mixed[np.minimum(np.searchsorted(mixed, asked), len(mixed) - 1)] == asked


def _settled(row: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which of all windows, by row, lie in the list of progressions of their row."""
    out = np.zeros(len(row), bool)
    packed = lists.flatten().to_numpy()
    if len(packed):
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        out[np.searchsorted(row, np.repeat(owner, (packed & ~SETTLED) >> COUNT)) + starts_of(packed)] = True
    return out


def _unique(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by the first column, then the next; repeated rows once."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return tuple(c[fresh] for c in columns)


def _first_rows(batch: pa.RecordBatch, at: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose document (column `at`) is the first with its text (the next column), once each, and their documents."""
    doc, first = batch.column(at), batch.column(at + 1)
    keep = np.flatnonzero(pc.fill_null(pc.equal(doc, first), False).to_numpy(zero_copy_only=False))
    ids = doc.take(pa.array(keep)).to_numpy()
    once = np.sort(np.unique(ids, return_index=True)[1])
    return batch.take(pa.array(keep[once])), ids[once]


def _send_symbols(window: int, high: tuple[int, ...], text: int, own: int):
    """Rows key, more, doc, at of the high symbols, at their names; `at` is the windows inside. A document that is not the
    first of its slice with a symbol is settled already: its rows are doc, 0, doc, at with the sign bit of `at` set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.parts(batches, text):
            part, doc = _first_rows(batch, own)
            row, start, size, key, more = _gather(part.column(text), long_symbols, window, high)
            key, more, owner, start, size = _unique(key, more, doc[row], start, size)
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
            mine = owner == owner[fresh][np.cumsum(fresh) - 1]
            which, at = stretches(start, size - window + 1)
            key, more, owner, mine = key[which].view(np.int64), more[which].view(np.int64), owner[which], mine[which]
            key, more, at = np.where(mine, key, owner), np.where(mine, more, 0), np.where(mine, at, at | SETTLED)
            order = np.argsort(owner, kind="stable")  # a document's rows together pack better
            yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (key, more, owner, at)], ["key", "more", "doc", "at"])

    return run


def _send_anchors(window: int, low: int, text: int, own: int):
    """Rows key, symbol, doc of the anchors of windows that are not settled (the column behind the first document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.parts(batches, text):
            batch, ids = _first_rows(batch, own)
            row, _, _, _, anchor = _gather(batch.column(text), anchored, window, low)
            live = ~_settled(row, batch.column(own + 2))
            anchor, doc = _unique(anchor[live], ids[row[live]])
            fresh = np.ones(len(anchor), bool)
            fresh[1:] = anchor[1:] != anchor[:-1]
            group = np.cumsum(fresh) - 1
            shared = np.bincount(group, minlength=1)[group] > 1 if len(group) else fresh
            # one row per anchor goes to its key; documents that share it in this slice need no answer
            key, owner = np.concatenate([anchor[fresh].view(np.int64), doc[shared]]), np.concatenate([doc[fresh], doc[shared]])
            symbol, plain = np.concatenate([anchor[fresh], anchor[shared]]).view(np.int64), np.arange(len(key)) < fresh.sum()
            order = np.argsort(owner, kind="stable")  # a document's rows together pack better
            yield pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(symbol[order], mask=plain[order]), pa.array(owner[order])], ["key", "symbol", "doc"])

    return run


# `at` packs an arithmetic progression of starts: the first in 31 bits, the stride in 12, the count in 20, a flag on top
STRIDE, COUNT, SETTLED = 31, 43, np.int64(-(1 << 63))
LONGEST, MOST = (1 << 12) - 1, 1 << 19


def progressions(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, doc, at) of rows sorted by all three: the starts of a key in a document as progressions, by document.

    A document that repeats one word or pair has a window thousands of times; it is sent once.
    """
    n = len(key)
    if not n:
        return key.view(np.int64), doc, start
    same, step = np.zeros(n, bool), np.zeros(n, np.int64)
    same[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    step[1:] = start[1:] - start[:-1]
    head = ~same | (step > LONGEST) | (np.arange(n) % MOST == 0)
    head[1:] |= same[:-1] & (step[1:] != step[:-1])
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, n))
    stride = np.where(count > 1, step[np.minimum(first + 1, n - 1)], 0)
    at = start[first] | stride << STRIDE | count << COUNT
    order = np.lexsort((start[first], doc[first]))  # a document's rows together pack better
    first = first[order]
    return key[first].view(np.int64), doc[first], at[order]


def stretches(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, at): `count` starts one after another from each `start`, as progressions of at most MOST."""
    pieces = -(-count // MOST)
    which = np.repeat(np.arange(len(start)), pieces)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return which, start[which] + turn * MOST | np.int64(1 << STRIDE) | np.minimum(MOST, count[which] - turn * MOST) << COUNT


def starts_of(packed: np.ndarray) -> np.ndarray:
    first, stride, count = packed & (1 << STRIDE) - 1, packed >> STRIDE & LONGEST, (packed & ~SETTLED) >> COUNT
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + np.repeat(stride, count) * inside


def _send_windows(window: int, low: int, text: int, own: int):
    """Rows key, more, doc, at of windows that are not settled and have a shared anchor, at their own hashes; or doc, 0, doc, at of windows that this
    slice has settled already, with the sign bit of `at` set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.parts(batches, text):
            part, doc = _first_rows(batch, own)
            row, start, whole, again, anchor = _gather(part.column(text), anchored, window, low)
            some = np.flatnonzero(_listed(row, anchor, part.column(own + 3)) & ~_settled(row, part.column(own + 2)))
            key, more, owner, start = whole[some], again[some], doc[row[some]], start[some].astype(np.int64)
            order = np.lexsort((start, owner, more, key))
            key, more, owner, start = key[order], more[order], owner[order], start[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
            group = np.cumsum(fresh) - 1
            mine = owner == owner[fresh][group]  # all others of this slice have a smaller document here already
            at, who, where = progressions(group[mine].astype(U64), owner[mine], start[mine])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[fresh][at].view(np.int64), more[fresh][at].view(np.int64), who, where)], ["key", "more", "doc", "at"])
            owner, start = owner[~mine], start[~mine]
            order = np.lexsort((start, owner))
            _, owner, at = progressions(owner[order].view(U64), owner[order], start[order])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.zeros(len(owner), np.int64)), pa.array(owner), pa.array(at | SETTLED)], ["key", "more", "doc", "at"])

    return run


def _strip(window: int, at: int, own: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.parts(batches, at):
            n, gone, kept = [], [], []
            for text, doc, first, *lists in zip(*(batch.column(c) for c in (at, own, own + 1, own + 2, own + 3))):
                words = (text.as_py() or "").encode().split()
                doc, first = doc.as_py(), first.as_py()
                n.append(len(words))
                if doc is not None and first is not None and doc > first and len(words) >= window:
                    gone.append(len(words))
                    kept.append("")
                    continue
                spans = [x.values.to_numpy() for x in lists if x.is_valid and doc == first and len(x.values)]
                if spans:
                    change = np.zeros(len(words) + 1, np.int64)
                    begin = starts_of(np.concatenate(spans))
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + window, -1)
                    stay = np.cumsum(change[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            columns = [batch.column(c) for c in range(own)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names)

    return run


def _later(rows: DataFrame) -> DataFrame:
    """Of rows key, more, doc, at those that a smaller document has too, or that are settled."""
    line = Window.partitionBy("key", "more", "settled")
    return rows.withColumn("settled", F.col("at") < 0).withColumn("least", F.min("doc").over(line)).filter("settled or doc > least")


def dedup(docs: DataFrame, window: int = 13, high: tuple[int, ...] = HIGH, low: int = LOW) -> DataFrame:
    """All columns of `docs` (doc_id, text and any others), with n_words, n_removed and `kept`, the words left, joined by
    spaces; these take the place of columns of their names.

    A word goes if it lies in a window of `window` words of its document that a document with a smaller doc_id also
    has; the input's windows count. Null and empty texts have no words. Equal rows have equal
    results. Of rows that give a doc_id several texts, the one with the smallest text hash is the document; the others
    remove nothing elsewhere, and lose words only as copies of a smaller document. A row without doc_id keeps all words
    and removes none elsewhere. An empty table gives none.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    names = [F.col(f"`{c}`") for c in docs.columns]
    at, own = docs.columns.index("text"), len(names)
    doc, text_id, first, settled, symbols, spans = fresh(docs, "__doc", "__text_id", "__first", "__settled", "__symbols", "__spans")
    # every step below joins the same rows by text, whole, so that Spark deals out the texts once
    whole = F.coalesce("text", F.lit(""))
    rows = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(text_id, F.struct(F.xxhash64(whole), F.xxhash64(F.lit(1), whole)))
    own_text = rows.filter(F.col(doc).isNotNull()).groupBy(doc).agg(F.min(text_id).alias(text_id))
    # cut, so that the texts' joins with it are of plain exchanges, where Spark can split the copies of one text
    firsts = cut(own_text.groupBy(text_id).agg(F.min(doc).alias(first)))
    repeated = rows.join(firsts, text_id).select(*names, doc, first).mapInArrow(_send_symbols(window, high, at, own), "key long, more long, doc long, at long")
    long = _later(repeated).groupBy(F.col("doc").alias(first)).agg(F.collect_list("at").alias(settled))
    firsts = settle(firsts.join(long, first, "left").withColumn(settled, F.coalesce(settled, F.array().cast("array<bigint>"))))
    sent = rows.join(firsts, text_id).select(*names, doc, first, settled).mapInArrow(_send_anchors(window, low, at, own), "key long, symbol long, doc long")
    line = Window.partitionBy("key", "known")
    seen = sent.withColumn("known", F.col("symbol").isNotNull()).select("*", F.min("doc").over(line).alias("lo"), F.max("doc").over(line).alias("hi"))
    shared = seen.filter("known or lo <> hi").select("doc", F.coalesce("symbol", "key").alias("symbol"))
    lists = shared.groupBy(F.col("doc").alias(first)).agg(F.collect_set("symbol").alias(symbols))
    asked = rows.join(firsts.join(lists, first), text_id).select(*names, doc, first, settled, symbols)
    gone = _later(asked.mapInArrow(_send_windows(window, low, at, own), "key long, more long, doc long, at long"))
    spanned = gone.groupBy(F.col("doc").alias(first)).agg(F.collect_list("at").alias(spans))
    joined = rows.join(firsts.join(spanned, first, "left"), text_id, "left").select(*names, doc, first, settled, spans)
    schema = StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    return joined.mapInArrow(_strip(window, at, own, schema.names), schema)
