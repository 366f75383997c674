"""The queries opN_<name> of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizers are; the files are never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: <|startoftext|> of word_bpe_49k.json
START_OF_TEXT = 49406


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs.where(~langid.held_out())))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.classes(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secretscan

    return secretscan.scan(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: each vector of embeddings is drawn as one, and its copies are found."""
    from . import media

    return media.copies(media.rendered(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", "image")


def op8_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality; background: all documents."""
    from . import lmscore

    return lmscore.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"), tokenizer_path(), START_OF_TEXT)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.score(table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_langid": op2_langid,
    "op3_bpe": op3_bpe,
    "op4_licenses": op4_licenses,
    "op5_neardup": op5_neardup,
    "op6_secrets": op6_secrets,
    "op7_media": op7_media,
    "op8_lmscore": op8_lmscore,
    "op9_quality": op9_quality,
    "op10_substring": op10_substring,
}

ORACLE_SQL: dict[str, str] = {"op4_licenses": licenses.oracle()}
