"""Thin queries over the given tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.llm import attention_lm, decontaminate, license_scan, line_crf, minhash, ns_kmeans, page_text, periodic_runs, quality, secret_scan, toxicity
from newsweave.llm.minhash import near_duplicates
from newsweave.llm.packing import packed
from newsweave.llm.token_files import fresh_folder, read_token_files, write_token_files


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer file lies; the package is found at run time and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op3_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(_table(spark, sf_dir, "documents"))


def op4_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), folder, tokenizer_file(), end_id=0)
    return read_token_files(spark, folder)


def op5_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(_table(spark, sf_dir, "documents"))


def op6_attention_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.scored(_table(spark, sf_dir, "documents"), tokenizer_file())


def op7_page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extracted(_table(spark, sf_dir, "pages"))


def op8_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), tokenizer_file(), end_id=1, max_len=2048)


def op9_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_ns_bounds_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns_kmeans.clustered(_table(spark, sf_dir, "embeddings"), k=8, rounds=10)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), periodic_runs.repeat_tail))


def op13_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_crf.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_lines", F.size("bad_lines").cast("long").alias("n_bad_lines"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_host_quality": op2_host_quality,
    "op3_license_sentences": op3_license_sentences,
    "op4_rans_token_files": op4_rans_token_files,
    "op5_trigram_secret_scan": op5_trigram_secret_scan,
    "op6_attention_lm_score": op6_attention_lm_score,
    "op7_page_main_text": op7_page_main_text,
    "op8_tiered_packing": op8_tiered_packing,
    "op9_cnn_toxicity": op9_cnn_toxicity,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_ns_bounds_clustering": op11_ns_bounds_clustering,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_crf_quality": op13_crf_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": minhash.ORACLE_SQL,
    "op2_host_quality": quality.ORACLE_SQL,
    "op5_trigram_secret_scan": secret_scan.ORACLE_SQL,
    "op3_license_sentences": license_scan.ORACLE_SQL,
    "op10_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op11_ns_bounds_clustering": ns_kmeans.ORACLE_SQL,
}
