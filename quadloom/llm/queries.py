"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .balltree import top_inner_products
from .bpe import round_trip_digest
from .centroids import cluster_vectors
from .crosstokens import align_corpus
from .embeddings import similar_vectors
from .importance import resample
from .media import stream_digest
from .packing import pack_documents
from .sharding import shard_by_bytes
from .simhash import near_duplicates
from .substring import remove_repeats
from .suffixes import repeated_string_digest
from .tokenfiles import token_file_digest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).withColumn("n_removed", F.size("removed"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(_table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_by_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"), 16, keep=["doc_id"])
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_digest(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, end_id=1, with_ids=False).drop("ids")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_string_digest(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scores


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_corpus(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, scale=256, dim=64, seed=2).drop("centroid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_simhash, op3_embedding_dedup, op4_sharding, op5_transport_stream, op6_best_fit_packing, op7_suffix_array_dedup, op8_token_files, op9_bpe_replay, op10_importance_resampling, op11_exact_top_k, op12_cross_tokens, op13_centroid_clustering)
}

_WHOLE = "list_transform(embedding, lambda x: floor({scale} * x::DOUBLE))"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)"

_TOP_K = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, {_WHOLE.format(scale=1024)} AS v FROM embeddings WHERE {_FINITE}),
scored AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM kept q JOIN kept c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10"""


def _rounds(rounds: int) -> str:
    """The clustering in SQL: a pair of tables a round, ``a`` of assignments and ``c`` of centroids."""
    assign = """a{i} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(k.v) AS v,
  min({{'d': list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}}) AS best FROM kept k, c{i} c GROUP BY row)"""
    move = """s{i} AS MATERIALIZED (SELECT c, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v)::BIGINT AS x, unnest(range(64)) AS pos FROM a{i}) GROUP BY c, pos),
c{j} AS MATERIALIZED (SELECT c, list(((s - ((s % n + n) % n)) // n)::DOUBLE ORDER BY pos) AS v FROM s{i} GROUP BY c UNION ALL SELECT c, v FROM c{i} WHERE c NOT IN (SELECT c FROM s{i}))"""
    return ",\n".join([assign.format(i=i) + ",\n" + move.format(i=i, j=i + 1) for i in range(rounds)] + [assign.format(i=rounds)])


_CLUSTERS = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, {_WHOLE.format(scale=256)} AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM (SELECT * FROM kept ORDER BY sha256('2:' || vec_id), v LIMIT 40)),
{_rounds(5)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(f.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM a5 JOIN c5 f ON f.c = a5.best.c"""

#: The others are beyond DuckDB's SQL as a whole: they rest on XXH64, CRC-32, tokenizers, codecs or seeded noise.
ORACLE_SQL: dict[str, str] = {"op11_exact_top_k": _TOP_K, "op13_centroid_clustering": _CLUSTERS}
