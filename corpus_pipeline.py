"""The corpus pipeline: five operators in a row over documents, each on all that the one before it kept.

Columns of documents: doc_id, text, lang, source, n_chars. All stages but the last return them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefold.llm import jaccard, mixing, packing, secrets, toxicity
from bytefold.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below 0.5 stay; the model learns from `labels` as in op3."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("score < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (sets of five-word shingles, Jaccard 0.8 or more) one row stays: of the smallest
    doc_id, and of its rows in the class the one whose text hashes lowest. Rows that share a doc_id are near-duplicates only
    by their texts; of rows with one doc_id and one text, one stays. Rows without doc_id or without words have no class and stay."""
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("key")
    keyed = docs.select(*COLUMNS, key)
    classes = jaccard.join(keyed.select(F.col("key").alias("doc_id"), "text"), percent=80, k=5).filter("doc_id is not null and n_shingles > 0")
    ids = keyed.filter("key is not null").select("key", "doc_id").distinct()
    placed = cut(classes.select(F.col("doc_id").alias("key"), "component_id").distinct().join(ids, "key"))
    first = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first")).select(F.col("first.key").alias("key"))
    left = keyed.join(placed.select("key").join(first, "key", "left_anti"), "key", "left_anti")
    worded = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = left.filter(worded).groupBy("key", "doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return one.select(*COLUMNS).unionByName(left.filter(~worded).select(*COLUMNS))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; found secrets are masked in its text and n_chars follows."""
    masked = secrets.redact(secrets.scan(docs.select(*COLUMNS)))
    return masked.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stands as often as the mix takes it, none to three times; rows without words cost nothing and stay once."""
    keyed = docs.select(*COLUMNS, mixing.size_of("text").alias("size"), mixing.rank_of().alias("h"))
    chosen = mixing.choose(cut(keyed.select("doc_id", "source", "size", "h")))
    copies = chosen.groupBy("doc_id", "source", "size", "h").agg(F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).alias("times"), F.count(F.lit(1)).alias("rows"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "source", "size", "h")]
    placed = keyed.alias("a").join(copies.alias("b"), same[0] & same[1] & same[2] & same[3])
    # rows that repeat each other share out their copies: each the whole part, the first ones one more
    whole = F.floor(F.col("b.times") / F.col("b.rows"))
    alone = placed.filter("b.rows = 1").select("a.*", F.col("b.times").alias("times"))
    several = placed.filter("b.rows > 1").select("a.*", whole.alias("whole"), (F.col("b.times") - whole * F.col("b.rows")).alias("more"))
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("doc_id", "source", "size", "h").orderBy("lang", "n_chars"))
    several = several.withColumn("times", F.col("whole") + F.when(turn <= F.col("more"), 1).otherwise(0)).drop("whole", "more")
    both = alone.unionByName(several.select(*alone.columns)).filter("times > 0")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    return packing.pack_documents(docs.select("doc_id", "text")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_redaction),
    ("mixing", source_mix),
    ("packing", packed_sequences),
]

# Learned scores, seeded choices and packed offsets are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
