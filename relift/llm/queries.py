"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import digests, encode

    return digests(encode(_docs(spark, sf_dir)))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language

    return language(_docs(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op6_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import read, write

    return read(*write(_docs(spark, sf_dir)))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_docs(spark, sf_dir))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import removals

    return removals(_docs(spark, sf_dir)).drop("spans")


def op10_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cdc import removed

    return removed(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_quality": op2_quality,
        "op3_media": op3_media,
        "op4_language": op4_language,
        "op5_toxicity": op5_toxicity,
        "op6_tokenfile": op6_tokenfile,
        "op7_packing": op7_packing,
        "op8_neardup": op8_neardup,
        "op9_suffix": op9_suffix,
        "op10_chunks": op10_chunks,
    }


def oracle_sql() -> dict[str, str]:
    from .sql import NEARDUP, SUFFIX

    return {"op8_neardup": NEARDUP, "op9_suffix": SUFFIX}
