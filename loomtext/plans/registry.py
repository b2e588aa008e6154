"""All queries of the library by name, with their SQL counterparts."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from loomtext.plans import agreement_queries, catalog_queries, evidence_queries, graph_queries, join_queries, library_queries, overlap_queries, stream_queries, structure_queries


def _wide(query):
    """The query with whole numbers as long, as SQL engines count them."""

    @wraps(query)
    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t == "int"})

    return run


_ALL = {**overlap_queries.QUERIES, **agreement_queries.QUERIES, **structure_queries.QUERIES, **evidence_queries.QUERIES, **graph_queries.QUERIES, **join_queries.QUERIES, **catalog_queries.QUERIES, **library_queries.QUERIES, **stream_queries.QUERIES}
QUERIES = {name: _wide(query) for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
