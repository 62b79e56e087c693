"""One query per operator over its whole table; SQL where SQL can tell the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import clusters, html, lexical, media, mixing, packing, quality, rules, simhash, substrings, toxicity, urls, warc
from .common import folder, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of every document's tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and likelihood-ratio verdict of every document."""
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in the mix."""
    return mixing.mixing(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = folder(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    return warc.read_back(spark, path)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or model verdict on every page's url."""
    return urls.url_filter(table(spark, sf_dir, "pages"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as WAV, and its fingerprint as read back; the WAV column itself is not returned."""
    return media.media(table(spark, sf_dir, "documents"), keep_media=False)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that aren't repeated from a smaller one."""
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector."""
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_quality, op4_simhash, op5_rules, op6_mixing, op7_warc, op8_urls, op9_html, op10_media, op11_ranked, op12_substrings, op13_clusters)}
ORACLES = {"op6_mixing": mixing.SQL, "op7_warc": warc.SQL, "op11_ranked": lexical.SQL, "op12_substrings": substrings.SQL, "op13_clusters": clusters.SQL}
