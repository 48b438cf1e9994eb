"""Best-fit packing of token sequences with certified bin counts.

Method: bound-certified repacking. Pieces are dealt over partitions; each partition runs best-fit decreasing and
compares its number of bins with a lower bound from dual-feasible functions. A bin count that meets its bound is
certified. Partitions with a gap put their open bins into a common pool, certified ones only their emptiest bin; the
pool is dealt anew over fewer partitions and packed again, until one partition holds the rest or the pool no longer shrinks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 2048
PER_PARTITION = 40_000
END_ID = 0
TURNS = 1 << 8  # rounds that sequence ids have room for; the pool stops shrinking long before
_encoders: dict[str, object] = {}


def reader(json_path: str):
    """The vocabulary's .json with its own settings: strings of its added tokens inside a text are those tokens."""
    if json_path not in _encoders:
        from tokenizers import Tokenizer

        _encoders[json_path] = Tokenizer.from_file(json_path)
    return _encoders[json_path]


def encoder(ranks_path: str, json_path: str, pattern: str):
    """The same vocabulary as ranks, with the added tokens that the .json names; tokenisers are only read, never trained."""
    if ranks_path not in _encoders:
        import base64
        import json

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, encoding="utf-8") as f:
            added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        _encoders[ranks_path] = tiktoken.Encoding(ranks_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return _encoders[ranks_path]


def public_ids(text: str | None) -> np.ndarray:
    """Ids as the .json reader of byte_bpe_50k gives them (add_special_tokens=False), then the end id.

    They come from the vocabulary's ranks file, whose reader is faster; tests hold both equal. A string of an added token
    in a text is that token's one id in both. The ranks reader's expression overflows on very long runs of white space;
    such a text goes to the .json reader.
    """
    import public_tokenizers

    ranks, whole = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    try:
        ids = encoder(ranks, whole, public_tokenizers.PATTERN).encode_to_numpy(text or "", allowed_special="all")
    except ValueError:
        ids = np.array(reader(whole).encode(text, add_special_tokens=False).ids, "<u4")
    return np.append(ids.astype("<u4"), np.uint32(END_ID)).astype("<u4")


def cut_points(n: int, capacity: int = CAPACITY) -> list[int]:
    """Bounds of the pieces of n tokens: one piece if they fit, else full pieces behind a first one with what is left over."""
    return [0, *range((n - 1) % capacity + 1, n + 1, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, ids=public_ids) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces. A null text is empty and has the end id alone."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                all_ids = ids(text.as_py())
                at = cut_points(len(all_ids), capacity)
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    for column, value in zip(rows, (doc, k, a, b - a, zlib.crc32(all_ids[a:b].tobytes()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins any packing needs, by dual-feasible functions: the volume, and for every threshold t the function
    that rounds items above capacity - t up to a whole bin, leaves the middle and drops items below t; and the
    staircase functions floor((k + 1) x / capacity) / k, exact multiples kept."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    big = np.cumsum(count[::-1])[::-1]  # items of a length or more
    volume = np.cumsum(count * size)
    for t in range(1, capacity // 2 + 1):
        whole = int(big[capacity - t + 1]) if t else 0
        middle = int(volume[capacity - t] - volume[t - 1])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * size
        steps = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)  # k * capacity times the function
        best = max(best, -(-int((count * steps).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset in it, fill of each bin); an item goes to the fullest bin it fits in."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []
    for i in order.tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += need
        if room > need:
            by_room[room - need].append(b)
            rooms |= 1 << (room - need)
    return where, offset, np.array(fill, np.int64)


_PACKED = "salt long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def _packer(capacity: int, per_partition: int, turn: int, last: bool):
    def packed_part(key, frame):
        lengths = frame["length"].to_numpy()
        where, offset, fill = best_fit_decreasing(lengths, capacity)
        give = np.zeros(len(fill), bool)
        if not last:
            give[fill < capacity] = len(fill) > lower_bound(lengths, capacity)
            give[int(fill.argmin())] = True
        frame = frame[["salt", "doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        frame["sequence_id"] = (int(key[0]) * per_partition * 8 + where) * TURNS + turn
        frame["offset"], frame["open"] = offset, give[where]
        return frame

    return packed_part


def pack(parts: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Give each row of `parts` (a length of 1 to `capacity`, any other columns of pieces()) a sequence_id and an offset.

    Rows may repeat: each is placed. No input rows give no output rows. A partition holds about `per_partition` rows
    whatever the number of rows; equal rows are dealt apart by a number of their own.
    """
    parts = cut(parts.withColumn("salt", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())))
    full = parts.filter(F.col("length") == capacity).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("open"))
    done, pool = [full.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence_id") * TURNS).alias("sequence_id"), "offset")], parts.filter(F.col("length") < capacity)
    count, bins, turn = pool.count(), None, 0
    while count:
        turn += 1
        many = -(-count // per_partition)
        last = many == 1 or turn == TURNS - 1
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("salt", F.lit(turn)), F.lit(many)))
        packed = cut(dealt.groupBy("part").applyInPandas(_packer(capacity, per_partition, turn, last), _PACKED))
        if last:
            done.append(packed.select(*done[0].columns))
            break
        count, used = packed.filter("open").agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if bins is not None and used >= bins:  # the pool no longer shrinks: what this round packed stands
            done.append(packed.select(*done[0].columns))
            break
        done.append(packed.filter("not open").select(*done[0].columns))
        pool, bins = packed.filter("open").select(*parts.columns), used
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, ids=public_ids) -> DataFrame:
    """Tokenise, cut and pack documents (doc_id, text; other columns are ignored)."""
    return pack(pieces(docs, capacity, ids), capacity)
