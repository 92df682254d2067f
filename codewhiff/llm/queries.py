"""The queries of the corpus operators, and SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import debruijn, decontaminate, hnsw, langid, licenses, ngram_join, packing, repeats, sharding, suffix_dedup, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_array_dedup(_table(spark, sf_dir, "documents"), length=50)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train_on(docs))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=4096)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return hnsw.nearest_neighbours(rows, rows.where("vec_id % 100 = 0"), k=10)


def op8_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.write_wavelet_shards(_table(spark, sf_dir, "documents")).select("doc_id", "shard", "start", "n_tokens")


def op9_compacted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_de_bruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.de_bruijn_repeats(_table(spark, sf_dir, "documents"), length=50, k=25)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_language_id": op4_language_id,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_license_scan": op6_license_scan,
        "op7_nearest_neighbours": op7_nearest_neighbours,
        "op8_wavelet_shards": op8_wavelet_shards,
        "op9_compacted_shards": op9_compacted_shards,
        "op10_de_bruijn_repeats": op10_de_bruijn_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": ngram_join.sql(),
        "op2_suffix_array_dedup": repeats.sql(50),
        "op6_license_scan": licenses.sql(),
        "op10_de_bruijn_repeats": repeats.sql(50),
    }
