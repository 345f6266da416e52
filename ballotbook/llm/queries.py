"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_cut")


#: The query's own key; a deployment passes a secret one.
SURROGATE_KEY = b"ballotbook surrogates"


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import replace_personal_data

    found = replace_personal_data(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return found.select("doc_id", "text", "n_entities")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import top_inner_products

    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def tokenizer_path() -> str:
    """The vocabulary file of the contract, where the machine has it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_passages": op1_passages,
        "op2_minhash": op2_minhash,
        "op3_decontamination": op3_decontamination,
        "op4_lines": op4_lines,
        "op5_surrogates": op5_surrogates,
        "op6_sharding": op6_sharding,
        "op7_quality": op7_quality,
        "op8_warc": op8_warc,
        "op9_topk": op9_topk,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    """Passages, lines, surrogates, sharding, quality and packing have no SQL; tests hold them against brute force."""
    from . import oracle

    return {
        "op2_minhash": oracle.NEAR_DUPLICATES,
        "op3_decontamination": oracle.CONTAMINATION,
        "op8_warc": oracle.ARCHIVES,
        "op9_topk": oracle.TOP_K,
    }
