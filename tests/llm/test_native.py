"""Quality rules and mixing: SQL, and edge cases."""

import pytest

from loomset.llm import catalog, mixture, oracle, quality_rules
from tests.llm.helpers import duck, equal_to_sql

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (2, "", "en", "a", 0),
    (None, " \n\t ", None, "b", 4),
    (4, "w " * 5000, "en", "é", 10000),
    (5, "one two three\none two three\n\n|<#", "en", "a", 3),
    (6, "a b c d e f g h x a b c d e f g h", "en", None, 3),
    (7, "ünï 😀😀", "en", "\U0001f600", 3),
]


@pytest.mark.parametrize("name", ["op1_mixture", "op5_quality_rules"])
def test_equals_sql(spark, name):
    assert equal_to_sql(catalog.QUERIES[name](spark, SF), oracle.SQL[name], duck(SF)) == 1000


@pytest.fixture(params=["rows", "none"])
def edge(request, spark, tmp_path):
    df = spark.createDataFrame(EDGE if request.param == "rows" else [], DOCS)
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), len(EDGE) if request.param == "rows" else 0


@pytest.mark.parametrize("name", ["op1_mixture", "op5_quality_rules"])
def test_edges_equal_sql(spark, edge, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{edge[0]}/documents.parquet/*.parquet'")
    assert equal_to_sql(catalog.QUERIES[name](spark, edge[0]), oracle.SQL[name], con) == edge[1]


def test_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a b c " * 10, "s", 5, True, 9)], "doc_id int, text string, source string, n_words int, kept boolean, copies int"
    )
    assert quality_rules.judge(docs).first()["n_words"] == 30
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert mixture.mix(docs).columns == docs.columns


def test_mix_emits_whole_copies(spark):
    docs = spark.createDataFrame(
        [(i, "w " * 20, s) for s, n in (("a", 40), ("b", 400), ("c", 400)) for i in range(n)],
        "doc_id int, text string, source string",
    )
    counts = {r["source"]: r["count"] for r in mixture.mix(docs).groupBy("source").count().collect()}
    # a may take 80 of its 40 rows; b and c share what is left of 1260 by 2 to 1, b stopping at 800
    assert counts["a"] == 80 and counts["b"] == pytest.approx(1180 * 2 / 3, rel=0.1)
    assert sum(counts.values()) == pytest.approx(1260, rel=0.1)
    assert mixture.mix(docs).count() == sum(counts.values())


def test_targets_are_native(spark):
    for name in ("op1_mixture", "op5_quality_rules"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
