import pytest

from loomset import storage


class FakeSession:
    def __init__(self, **conf):
        self.values = {k.replace("_", "."): v for k, v in conf.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_the_configured_folder_is_used():
    assert storage.shared_dir(FakeSession(spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError):
        storage.shared_dir(FakeSession(spark_master="yarn"))


def test_a_local_session_gets_its_own():
    session = FakeSession(spark_master="local[2]", spark_app_id="app-1")
    assert storage.shared_dir(session) == storage.shared_dir(session)


def test_materialised_tables_are_read_back(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) s")
    back = storage.materialise(df, "t")
    assert sorted(back.collect()) == sorted(df.collect())
    assert storage.shared_dir(spark) in back.inputFiles()[0]
