"""The registered queries of this subpackage: each applies an operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.url_filters import judged_pages

    return judged_pages(spark, table(spark, sf_dir, "pages"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.fingerprints import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.language_id import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs, public_tokenizers.path("piece_bpe_32k.model")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import fit, held_out, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontamination import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.token_output import read_tokens, write_tokens

    files = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, files, with_ids=False)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n_words=3, percent=85)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.pii import labelled_table, scan, train

    return scan(table(spark, sf_dir, "documents"), train(labelled_table(spark)))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.importance import ranked

    out = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_n=1, n_buckets=10_000, percent=10, min_words=20, seed=2024)
    c = F.col
    return out.select("doc_id", c("importance_features").alias("n_features"), c("importance_weight").alias("weight"), c("importance_score").alias("score"), c("importance_rank").alias("rank"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.common import staged
    from millrace.llm.sharding import assign, measured

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = assign(staged(measured(docs).drop("text"), "measured"), shards=24, bits=4, law="rows")
    size, crc = F.col("shard_size").alias("size"), F.col("shard_crc32").alias("text_crc32")
    return out.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.common import staged
    from millrace.llm.vector_codes import encode, fit, with_label_error

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = fit(vectors, parts=16, n_entries=64, rounds=2, scale=256)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = staged(encode(vectors, books).drop("embedding"), "codes")
    out = with_label_error(coded)
    code = F.lower(F.hex("vector_code")).alias("code")
    return out.select("vec_id", code, F.col("vector_error").alias("error"), "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
