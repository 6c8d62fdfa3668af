"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import storage
from barloom.llm import (
    bpe_codec,
    common,
    content_sort,
    decontaminate,
    hard_negatives,
    lang_id,
    line_dedup,
    ngram_join,
    packing,
    quality,
    token_files,
    url_filter,
    whiten,
    wrapper,
)

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
FILE_END, PACK_END = 2, 1
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[run.__name__] = run
    return run


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    model = lang_id.fit(docs, ~lang_id.held_out())
    rows = docs.select("doc_id", "text", lang_id.held_out().alias("held_out"))
    return lang_id.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    stored = token_files.write(docs, storage.scratch_path(spark, "tokens"), tokenizer(BYTE_BPE), FILE_END)
    return token_files.read(spark, stored, with_ids=False)


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judged(docs).select("doc_id", *counts, "base_failed", "kept", "distance2")


@query
def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(common.table(spark, folder, "pages"), URL_RULES)


@query
def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(common.table(spark, folder, "documents"), n=3, percent=90)


@query
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return content_sort.groups(common.table(spark, folder, "documents"), keep="largest")


@query
def op7_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe_codec.round_trip(common.table(spark, folder, "documents"), tokenizer(WORD_BPE))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "decoded", "plain")]
    return coded.select("doc_id", "n_tokens", *digests)


@query
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(common.table(spark, folder, "documents"), tokenizer(BYTE_BPE), PACK_END)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    cleaned = line_dedup.dedup(docs)
    text = F.coalesce("text", F.lit(""))
    return cleaned.select("doc_id", "n_lines", "n_deleted", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


@query
def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper.extract(common.table(spark, folder, "pages"))


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = common.table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query
def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = (common.table(spark, folder, name) for name in ("documents", "benchmark"))
    found = decontaminate.report(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten.whitened(common.table(spark, folder, "embeddings"))
