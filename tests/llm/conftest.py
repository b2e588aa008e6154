import pytest

WORDS = "amber basin cedar delta ember fjord grove heath inlet jetty knoll lagoon marsh north ocean plain quarry ridge shoal tundra upland valley wharf zephyr".split()


@pytest.fixture
def docs(spark):
    """A function from rows (id, text) to a documents table with columns whose names the operators use inside."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        if extra:
            df = df.selectExpr("*", "'x' AS id", "1 AS n", "2 AS th", "3 AS component_id", "'y' AS spans", "4 AS shard", "'z' AS lang_pred", "5 AS score", "6 AS ids", "7 AS n_lines")
        return df

    return make


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
