"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaloom.llm import conversation_trie, decontamination, language_id, line_dedup, media, near_duplicates, packing, secret_scan, spelling_variants, substring_dedup, token_output, toxicity, warc
from taxaloom.llm.common import shared_dir, stored

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    token_output.write_tokens(documents(spark, sf_dir), folder, tokenizer(), end_id=2)
    return token_output.read_tokens(spark, folder)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "media")
    media.write_media(documents(spark, sf_dir), folder)
    return media.media_features(media.read_media(spark, folder))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer(), separator_id=0, capacity=2048)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.predict(docs, language_model(docs))


def language_model(docs: DataFrame) -> language_id.Model:
    """Fitted to the rows that aren't held out."""
    return language_id.fit_ngrams(language_id.sample(docs, language_id.crc_of_id("doc_id") % 4 != 2))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir), MAX_RATIO, host_col="source")


def line_dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over raw pages, whose lines end at tags that break lines."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.regexp_extract("url", HOST, 1)
    lines = F.regexp_replace("html", BREAKS, "\n")
    return line_dedup.line_report(pages.select("page_id", host.alias("host"), lines.alias("html")), MAX_RATIO, host_col="host", id_col="page_id", text_col="html")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir), words=5, percent=75)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_repeats(documents(spark, sf_dir), window=13).digests()


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(spelling_variants.words(documents(spark, sf_dir)), shared_dir(spark, "variants"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"), shared_dir(spark, "trie"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    warc.write_captures(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = stored(warc.read_records(spark, folder, payload=False), folder, "records")
    return warc.digests(warc.resolved(warc.captures(records)))


#: Lines on more than a tenth of a host's pages are boilerplate.
MAX_RATIO = 0.1
#: Host of a web address, and tags after which a page's next line begins.
HOST = r"^[a-zA-Z]+://([^/:?#]+)"
BREAKS = r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/title|/ul|/nav|/article|/head|/script|/style)[^>]*>"

_ALL = (op1_token_output, op2_secret_scan, op3_media_columns, op4_language_id, op5_best_fit_packing, op6_line_dedup, line_dedup_pages, op7_toxicity, op8_benchmark_decontamination, op9_minhash_near_dedup, op10_substring_dedup, op11_spelling_variants, op12_conversation_trie, op13_warc)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    limits = {"min_pages": 1, "max_ratio": MAX_RATIO}
    pages = f"""(select page_id, regexp_extract(url, '{HOST}', 1) as host, regexp_replace(html, '{BREAKS}', chr(10), 'g') as html from pages)"""
    return {
        "op6_line_dedup": line_dedup.REPORT_SQL.format(table="documents", id="doc_id", host="source", text="text", **limits),
        "op11_spelling_variants": spelling_variants.SQL,
        "op12_conversation_trie": conversation_trie.SQL,
        "op13_warc": warc.SQL,
        "line_dedup_pages": line_dedup.REPORT_SQL.format(table=pages, id="page_id", host="host", text="html", **limits),
    }
