from millrace.sources import scratch


class Session:
    """Only the settings that choose the folder."""

    def __init__(self, **settings):
        self.conf = settings


def test_the_session_names_the_folder():
    named = Session(**{"spark.checkpoint.dir": "hdfs://shared/folder/"})
    assert scratch.scratch_root(named) == "hdfs://shared/folder"


def test_without_it_the_shared_warehouse_holds_the_tables():
    plain = Session(**{"spark.sql.warehouse.dir": "hdfs://shared/warehouse/"})
    assert scratch.scratch_root(plain) == "hdfs://shared/warehouse/_scratch"


def test_lineage_is_cut_by_a_written_table(spark):
    df = spark.range(100).withColumnRenamed("id", "x")
    cut = scratch.cut_lineage(df)
    assert cut.dtypes == df.dtypes and cut.count() == 100
    assert "Range" not in cut._jdf.queryExecution().executedPlan().toString()


def test_a_written_table_can_be_freed(spark):
    cut = scratch.cut_lineage(spark.range(10))
    folder = cut.inputFiles()[0].rpartition("/")[0]
    scratch.free_table(cut)
    fs, target = scratch.hadoop_path(spark, folder)
    assert not fs.exists(target)


def test_the_setting_that_frees_shuffles_is_put_back(spark):
    before = spark.conf.get(scratch.SHUFFLE_CLEANUP)
    scratch.cut_lineage(spark.range(10).groupBy("id").count())
    assert spark.conf.get(scratch.SHUFFLE_CLEANUP) == before
