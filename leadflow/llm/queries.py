"""Registered queries of the training-data operators: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .alignment import align
from .common import table
from .hard_negatives import mine
from .html_text import extract_text
from .licenses import scan
from .line_dedup import line_dedup_digest
from .mixing import mix
from .packing import pack
from .quality_model import score, train_all
from .quality_rules import quality_report
from .simhash import simhash_digest
from .token_files import read_checksums, write_tokens
from .topk import top_k
from .url_filter import judge_urls
from .oracles import ORACLES


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shared by documents stay in the first document only."""
    return line_dedup_digest(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes: 3-word shingles, fingerprints linked at 2 bits or fewer."""
    return simhash_digest(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of all documents when sources are mixed by size to the power 0.7, the
    expected size of the whole unchanged, in global random order."""
    return mix(table(spark, sf_dir, "documents"), alpha=0.7, seed=42)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors by integer inner product for every 50th vector id."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document; kept if as likely good and clean as
    all but a hundredth of the held-out good ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, **train_all(docs, labels))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return scan(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule, verdict and path template of every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict under cutoffs certified on the labelled holdout."""
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the token-id files."""
    path = scratch_path(spark, "llm", "tokens", unique=True)
    write_tokens(table(spark, sf_dir, "documents"), path, end_id=1)
    return read_checksums(spark, path)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 best rows of other labels scoring 50 to 95 % of each positive, for every 50th id's 5 positives;
    every 7th id has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens of every document, weighed by the corpus's counts."""
    return align(table(spark, sf_dir, "documents")).drop("linked")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_simhash_dedup, op3_source_mixing, op4_exact_topk,
                                   op5_quality_classifier, op6_html_text, op7_license_scan, op8_url_filter, op9_packing,
                                   op10_quality_rules, op11_token_files, op12_hard_negatives, op13_token_alignment)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
