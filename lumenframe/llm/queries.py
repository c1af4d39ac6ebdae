"""Registered queries over the dealt operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import alignment, decontaminate, exact_dedup, html_text, licenses, merkle, mixing, ngram_join, pii, quality, sharding, token_blocks, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, *tables: str, sql: str | None = None):
    """Register a function of the named tables."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in tables))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@_query("op3_toxicity", "documents", "labels")
def _op3(documents, labels):
    return toxicity.toxicity(documents, labels)


@_query("op7_ngram_join", "documents")
def _op7(documents):
    return ngram_join.ngram_join(documents)


@_query("op1_decontaminate", "documents", "benchmark")
def _op1(documents, benchmark):
    return decontaminate.decontaminate(documents, benchmark)


@_query("op9_mixing", "documents", sql=mixing.MIX_SQL)
def _op9(documents):
    return mixing.mix(documents)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query("op5_token_blocks", "documents")
def _op5(documents):
    return token_blocks.token_blocks(documents, vocabulary())


@_query("op10_exact_dedup", "documents", sql=exact_dedup.DEDUP_SQL)
def _op10(documents):
    return exact_dedup.exact_dedup(documents)


@_query("op2_quality", "documents", "labels")
def _op2(documents, labels):
    return quality.quality(documents, labels)


@_query("op8_html_text", "pages")
def _op8(pages):
    return html_text.html_text(pages)


@_query("op4_pii", "documents")
def _op4(documents):
    return pii.pii(documents)


@_query("op6_licenses", "documents")
def _op6(documents):
    return licenses.license_scan(documents, licenses.template_table(documents.sparkSession))


@_query("op13_tokenizer_alignment", "documents")
def _op13(documents):
    import public_tokenizers

    return alignment.align_documents(documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op12_histogram_shards", "documents", sql=sharding.SHARD_SQL)
def _op12(documents):
    return sharding.shard_query(documents)


@_query("op11_merkle_manifest", "documents", sql=merkle.MANIFEST_SQL)
def _op11(documents):
    return merkle.manifest_query(documents)
