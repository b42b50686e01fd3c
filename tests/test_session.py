"""Partition sizing and session defaults."""

from gleaner.session import DEFAULTS, ensure_checkpoint_dir, sized_settings

MB = 1 << 20


def test_sizing_for_a_small_local_input():
    s = sized_settings(15 * MB, 8)
    assert int(s["spark.sql.files.maxPartitionBytes"]) == 1 * MB
    assert s["spark.sql.shuffle.partitions"] == "8"
    assert int(s["spark.sql.adaptive.advisoryPartitionSizeInBytes"]) == 16 * MB


def test_sizing_for_100_tb():
    s = sized_settings(100 * 10**12, 8000)
    assert int(s["spark.sql.files.maxPartitionBytes"]) == 256 * MB
    assert 80_000 < int(s["spark.sql.shuffle.partitions"]) < 100_000
    assert s["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == s["spark.sql.shuffle.partitions"]
    assert int(s["spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"]) == 1024 * MB


def test_defaults_keep_aqe_and_skew_join_on(spark):
    assert DEFAULTS["spark.sql.adaptive.enabled"] == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_checkpoint_dir_is_taken_from_the_session(spark):
    path = ensure_checkpoint_dir(spark)
    assert path and spark.sparkContext.getCheckpointDir()
    assert ensure_checkpoint_dir(spark) == path


def test_each_session_has_its_own_role_views(spark):
    from gleaner.sources.roles import role_tables

    other = spark.newSession()
    sf = "/root/testdata/sf0.001"
    assert role_tables(spark, sf) is role_tables(spark, sf)
    assert role_tables(other, sf).claims.sparkSession is other


def test_folder_size_is_measured_from_the_file_index(spark, tmp_path):
    from gleaner.session import folder_bytes

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("12345")
    (tmp_path / "y.csv").write_text("123")
    assert folder_bytes(spark, str(tmp_path)) == 8
