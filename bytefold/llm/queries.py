"""The registered queries of this subpackage: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, jaccard, licenses, mixing, packing, repeats, secrets, topk, toxicity
from .common import table


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op1_collision_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near(table(spark, sf_dir, "embeddings"))


def op2_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(table(spark, sf_dir, "embeddings"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op5_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [F.size(F.filter("secrets", _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE]
    base = F.filter("secrets", lambda s: s["rank"] < len(secrets.BASE))
    return found.select("doc_id", *n, F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.col("secrets")).alias("spans"))


PROBE = "</s>[INST] ok [/INST]"


def op6_budgeted_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat.read_back(chat.windows(rows))
    digests = (F.sha2("spoken", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"))
    return back.select("conv_id", F.col("n_turns").cast("long"), *digests, F.col("formatted_chars").cast("long"))


def op7_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = F.transform("base", lambda b: b["label"])
    both = F.concat(labels, F.transform("spans", lambda s: s["label"]))
    places = F.transform("base", lambda b: b["start"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: F.least(s["cover"], F.lit(1.0)))), F.lit(0.0))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best)
    named = [F.array_join(F.array_sort(F.array_distinct(x)), ",").alias(n) for x, n in ((labels, "base_labels"), (both, "labels"))]
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), *named, score.alias("score"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_collision_near_dups, op2_recompression_dedup, op3_weak_toxicity, op4_bit_sliced_topk, op5_trigram_secrets, op6_budgeted_chat, op7_diagonal_licenses, op8_best_fit_packing, op9_jaccard_join, op10_mix_sources)}
ORACLE_SQL: dict[str, str] = {
    "op1_collision_near_dups": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND list_aggregate(list_transform(e, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.98 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
top AS (SELECT x, min(y) AS c FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c::BIGINT AS component_id, c = vec_id AS kept FROM v JOIN top ON top.x = vec_id LEFT JOIN n ON n.x = vec_id""",
    "op4_bit_sliced_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND list_aggregate(list_transform(e, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op2_recompression_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
f AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN f USING (s) WHERE f < doc_id)),
words AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id""",
    "op6_budgeted_chat": rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM c),
z AS (SELECT *, 5 + strlen(url_encode(role)) + len(regexp_extract_all(text, '<\||\|>|</?s>|\[/?INST\]')) + {len(chat.END)} AS form FROM t),
k AS (SELECT conv_id, pos, role, form + length(text) AS size, form + strlen(text) AS tokens, sum(form + strlen(text)) OVER (PARTITION BY conv_id ORDER BY pos) - form - strlen(text) AS since,
  sum(CASE WHEN pos = 1 AND role = 'system' THEN form + strlen(text) ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM z),
g(conv_id, pos, first, own) AS (SELECT conv_id, pos, pos, tokens FROM k WHERE pos = 1 UNION ALL
  SELECT conv_id, pos, CASE WHEN stays THEN first ELSE pos END, CASE WHEN stays THEN own + tokens ELSE tokens END FROM
  (SELECT k.conv_id, k.pos, g.first, g.own, k.tokens, (k.pos - 1) // {chat.BLOCK} = (g.first - 1) // {chat.BLOCK} AND g.own + k.tokens + CASE WHEN g.first = 1 THEN 0 ELSE b.lead + least({chat.HISTORY}, b.since - b.lead) END <= {chat.BUDGET} AS stays
   FROM g JOIN k ON k.conv_id = g.conv_id AND k.pos = g.pos + 1 JOIN k b ON b.conv_id = g.conv_id AND b.pos = g.first)),
w AS (SELECT g.conv_id, g.first, b.since, b.lead, max(own) AS own FROM g JOIN k b ON b.conv_id = g.conv_id AND b.pos = g.first GROUP BY ALL),
every AS (SELECT conv_id, size FROM k UNION ALL SELECT k.conv_id, k.size FROM w JOIN k ON k.conv_id = w.conv_id AND k.pos < w.first
  WHERE CASE WHEN k.pos = 1 AND k.lead > 0 THEN true ELSE w.since - k.since <= least({chat.HISTORY}, {chat.BUDGET} - w.lead - w.own) END),
chars AS (SELECT conv_id, sum(size)::BIGINT AS formatted_chars FROM every GROUP BY conv_id),
said AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS learned FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM said JOIN chars USING (conv_id)""",
    "op5_trigram_secrets": secrets.oracle(),
    "op7_diagonal_licenses": licenses.oracle(),
}
