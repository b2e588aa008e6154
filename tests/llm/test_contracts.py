"""Every registered opN_ query on the smallest tables: its columns, types, held-out rows and one row a record."""

import zlib

import pandas as pd
import pytest

from loomtext.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_embed_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op3_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op4_token_counts": "doc_id bigint, n_tokens bigint",
    "op5_lang_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_line_dedup": "doc_id bigint, text string, n_lines bigint, n_removed bigint",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}
TABLE = {"op2_embed_dedup": ("embeddings", "vec_id")}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    table, key = TABLE.get(name, ("documents", "doc_id"))
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    got = queries.QUERIES[name](spark, SF)
    types = dict(got.dtypes)
    assert all(types.get(c) == t for c, t in (f.split() for f in COLUMNS[name].split(", "))), types
    got = got.toPandas()
    assert sorted(got[key]) == ids
    crc = got[key].map(lambda i: zlib.crc32(str(i).encode()))
    if name == "op5_lang_id":
        assert (got["held_out"] == (crc % 4 == 2)).all() and got["score"].between(0, 1).all()
        assert set(got["lang_pred"]) <= {"en", "de", "fr", "es", "und"}
    if name == "op10_toxicity":
        assert (got["held_out"] == (crc % 5 == 0)).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
        taught = set(spark.read.parquet(f"{SF}/labels.parquet").toPandas()["doc_id"])
        seen = {e["id"] for ev in got["evidence"] for e in ev}
        assert seen <= {i for i in taught if zlib.crc32(str(i).encode()) % 5}
    if name == "op6_sharding":
        assert set(got["law"]) == {"bytes"} and set(got["shard"]) <= set(range(8)) and got["grown_shard"].isna().all()
    if "kept" in got:
        assert (got["kept"] == (got[key] == got["component_id"])).all()


def test_contaminated_rows(spark):
    got = queries.QUERIES["op1_decontam"](spark, SF).toPandas()
    assert list(got.columns) == ["doc_id", "item_id", "n_hits", "best"] and not got.duplicated(["doc_id", "item_id"]).any() and pd.api.types.is_integer_dtype(got["n_hits"])
