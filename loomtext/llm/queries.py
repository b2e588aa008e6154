"""Registered queries over the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from loomtext.llm import byte_bpe, collocations, decontam, embed_dedup, fill_middle, lang_id, license_scan, line_dedup, minhash, secret_scan, sharding, token_counts, toxicity
from loomtext.session import table


def op1_decontam(spark, sf_dir):
    """Documents that share a passage with a benchmark item."""
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max("n_hits").alias("n_hits"), F.max("best").alias("best"))


def op2_embed_dedup(spark, sf_dir):
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_secrets(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir):
    """Counts under the entries of a public piece vocabulary taken as a unigram vocabulary."""
    vocab = token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocab)


def op5_lang_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).alias("held_out")
    prototypes = lang_id.train(docs.where(~held))
    return lang_id.predict(docs, prototypes, keep=[F.coalesce(held, F.lit(False)).alias("held_out")])


def op6_sharding(spark, sf_dir):
    found = sharding.shard_records(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op7_minhash(spark, sf_dir):
    return minhash.near_components(table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op8_byte_bpe(spark, sf_dir):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.token_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    index = toxicity.fit(docs.where(~held), labels)
    return toxicity.score(docs, index).withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted", "evidence")


def op11_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark, sf_dir):
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_licenses(spark, sf_dir):
    return license_scan.summary(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontam": op1_decontam, "op2_embed_dedup": op2_embed_dedup, "op3_secrets": op3_secrets, "op4_token_counts": op4_token_counts,
    "op5_lang_id": op5_lang_id, "op6_sharding": op6_sharding, "op7_minhash": op7_minhash, "op8_byte_bpe": op8_byte_bpe,
    "op9_line_dedup": op9_line_dedup, "op10_toxicity": op10_toxicity, "op11_collocations": op11_collocations, "op12_fill_middle": op12_fill_middle, "op13_licenses": op13_licenses,
}
ORACLE_SQL = {"op1_decontam": decontam.SQL, "op9_line_dedup": line_dedup.SQL, "op11_collocations": collocations.SQL, "op12_fill_middle": fill_middle.SQL}
