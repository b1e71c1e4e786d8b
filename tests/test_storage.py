import pytest

from gradewise import storage


class Session:
    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_a_cluster_needs_a_shared_folder():
    assert storage.shared_folder(Session(spark_master="spark://host:7077", **{"spark_checkpoint_dir": "hdfs:///kept/"})) == "hdfs:///kept"
    assert storage.shared_folder(Session(spark_master="local[4]")).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_folder(Session(spark_master=master))


def test_kept_tables_are_read_back(spark):
    table = storage.kept(spark.range(5).selectExpr("id", "id * 2 AS twice"), "numbers")
    assert sorted((r.id, r.twice) for r in table.collect()) == [(i, 2 * i) for i in range(5)]
    assert "FileScan parquet" in table._jdf.queryExecution().executedPlan().toString()
