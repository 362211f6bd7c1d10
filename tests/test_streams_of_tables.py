"""Streams of tables that are one file, or a folder of files."""

import pytest

from loomset.catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_examples", "stream_dedup"])
def test_table_in_a_folder_streams_like_a_file(spark, tmp_path, name):
    for table in ("documents", "events"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    want = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    assert want
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == want
