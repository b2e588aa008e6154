"""The training-corpus pipeline: five stages applied one after another to the documents table.

Every stage is one operator of loomtext.llm over all rows that its predecessor kept. A stage's decision takes effect:
rejected documents are gone and changed texts replace the old ones. All stages but the last return the columns of
documents; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from loomtext.llm import byte_bpe, decontam, lang_id, line_dedup, minhash
from loomtext.session import materialize, small_side, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts of MIN_CHARS or more whose best cosine is under MIN_SCORE are like no learned language; shorter ones say too little.
MIN_SCORE, MIN_CHARS = 0.2, 200


def identify(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and longer ones that are like no language of the corpus."""
    found = lang_id.predict(docs, lang_id.train(docs), keep=[F.col(c) for c in COLUMNS[1:]])
    unlike = (F.col("score") < MIN_SCORE) & (F.length("text") >= MIN_CHARS)
    return found.where((F.col("lang_pred") != lang_id.UNKNOWN) & ~unlike).select(*COLUMNS)


def dedup_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document that loses its last non-blank line goes."""
    found = line_dedup.dedup_lines(docs)
    found = found.where((F.col("n_removed") == 0) | (F.length(F.trim(F.col("text"))) > 0))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five-word shingles, similarity of 0.8 or more)."""
    found = minhash.near_components(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone")).distinct()
    gone = materialize(found, "gone")
    return docs.join(small_side(gone), docs["doc_id"] == gone["gone"], "left_anti").select(*COLUMNS)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a passage with a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of the bytes that they decode to."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = byte_bpe.encode_column(docs.select(*COLUMNS), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256")


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("minhash_dedup", dedup_near), ("decontamination", decontaminate), ("byte_bpe", encode)]
#: Language profiles, MinHash and BPE have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
