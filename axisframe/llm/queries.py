"""The operators' queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.llm import alignment as _alignment
from axisframe.llm import collocations as _collocations
from axisframe.llm import decontaminate as _decontaminate
from axisframe.llm import langid as _langid
from axisframe.llm import mixing as _mixing
from axisframe.llm import resample as _resample
from axisframe.llm import sharding as _sharding
from axisframe.llm import simhash as _simhash
from axisframe.llm import sql
from axisframe.llm import suffixes as _suffixes
from axisframe.llm import tokens as _tokens
from axisframe.llm import topk as _topk
from axisframe.llm import urlfilter as _urlfilter
from axisframe.llm import warc as _warc
from axisframe.llm.common import fresh_path
from axisframe.tables import table


def op1_quality_resample(spark: SparkSession, folder: str) -> DataFrame:
    return _resample.resample(table(spark, folder, "documents"), table(spark, folder, "labels"), keys_only=True)


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return _simhash.digest(_simhash.near_duplicates(table(spark, folder, "documents")))


def op3_shuffle_shards(spark: SparkSession, folder: str) -> DataFrame:
    return _sharding.digest(_sharding.shuffle_into_shards(table(spark, folder, "documents"), 40))


def op4_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    return _suffixes.digest(_suffixes.repeated_spans(table(spark, folder, "documents"), length=50))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return _decontaminate.digest(_decontaminate.find_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = _langid.fit(docs.where(~_langid.held_out(F.col("doc_id"))))
    return _langid.identify(docs, model).select("doc_id", _langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    _warc.write_captures(_warc.with_revisits(table(spark, folder, "pages")), path)
    return _warc.digest(_warc.assemble(spark, path))


def tokenizer_path() -> str:
    """The tokenizer file of the token output; every executor has the library."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    _tokens.write_tokens(table(spark, folder, "documents"), path, tokenizer_path())
    return _tokens.digest(_tokens.read_tokens(spark, path))


def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = _topk.scaled(table(spark, folder, "embeddings"), "embedding", 256)
    return _topk.top_k(rows.where(F.col("vec_id") % 50 == 0), rows, 5, id_column="vec_id", vector="embedding")


#: Softens the hot source's share: weights are row counts to this power.
MIX_TEMPERATURE = 0.7


def op10_pfair_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = _mixing.mix(table(spark, folder, "documents"), temperature=MIX_TEMPERATURE)
    return mixed.select("doc_id", "source", *[c for c in mixed.columns if c.startswith("mix_")])


def aligned_tokenizers() -> tuple[str, str]:
    """The tokenizer files that are aligned."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_align_tokenizers(spark: SparkSession, folder: str) -> DataFrame:
    both = aligned_tokenizers()
    return _alignment.digest(_alignment.align(table(spark, folder, "documents"), both), both)


#: The rules (host, path, verdict), and the names of listed sites.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The list of hosts: every site of the table that has a listed name, whatever the rest of its host."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    host, _ = _urlfilter.split_url(F.col("url"))
    site = F.regexp_extract(host, rf"(?:^|\.)((?:{'|'.join(LISTED_SITES)})\..*)$", 1)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return _urlfilter.judge(pages, rules, pages.select(site.alias("host")))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return _collocations.ranked(_collocations.collocations(table(spark, folder, "documents")))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_resample": op1_quality_resample,
        "op2_simhash": op2_simhash,
        "op3_shuffle_shards": op3_shuffle_shards,
        "op4_repeated_spans": op4_repeated_spans,
        "op5_decontaminate": op5_decontaminate,
        "op6_language_id": op6_language_id,
        "op7_warc": op7_warc,
        "op8_token_ids": op8_token_ids,
        "op9_top_k": op9_top_k,
        "op10_pfair_mix": op10_pfair_mix,
        "op11_align_tokenizers": op11_align_tokenizers,
        "op12_url_filter": op12_url_filter,
        "op13_collocations": op13_collocations,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
