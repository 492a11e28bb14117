import os

import pytest
from pyspark.sql import functions as F

from kedrion import session as ks


class Conf:
    def __init__(self, **values):
        self.conf, self.values = self, {k.replace("_", "."): v for k, v in values.items()}

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_staging_folder_comes_from_the_session():
    assert ks.shared_dir(Conf(spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    local = ks.shared_dir(Conf(spark_master="local[2]"))
    assert local.startswith("file:///") and local == ks.shared_dir(Conf(spark_master="local[2]"))
    with pytest.raises(ValueError):
        ks.shared_dir(Conf(spark_master="yarn"))


def test_staged_keeps_rows_and_schema_and_is_released(spark):
    rows = spark.createDataFrame([(1, [1, None], None), (2, None, "x")], "a int, b array<int>, c string")
    table, seen = ks.staged_with(rows, "t", rows=F.count("*"), known=F.count("c"))
    assert table.schema == rows.schema and sorted(table.collect()) == sorted(rows.collect()) and seen == {"rows": 2, "known": 1}
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    empty, seen = ks.staged_with(rows.limit(0), "t", rows=F.count("*"))
    assert empty.count() == 0 and seen == {"rows": 0}


def test_every_query_is_registered_once():
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and {"p1_found", "p2_found", "full_pipeline"} <= set(names)
