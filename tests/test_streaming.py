"""Change files applied by a streaming query, one snapshot per micro-batch."""

from gleaner.schema import PROVIDERS, change_schema
from gleaner.streaming import changes as stream
from tests.fixtures import PROVIDER_ROWS


def test_change_stream_produces_snapshots(spark, tmp_path):
    root, inbox = str(tmp_path / "providers"), str(tmp_path / "inbox")
    stream.write_initial(spark.createDataFrame(PROVIDER_ROWS, PROVIDERS), root)
    batch1 = spark.createDataFrame([
        ("insert", 1, 6, "Eka", "NGO", None, "Goa", None, None),
        ("update", 2, 1, None, None, None, None, None, ["Contact"]),
    ], change_schema("providers"))
    batch1.coalesce(1).write.mode("append").parquet(inbox)
    q = stream.start(spark, "providers", inbox, root, str(tmp_path / "ckpt"))
    try:
        q.processAllAvailable()
        spark.createDataFrame([("delete", 3, 2, None, None, None, None, None, None)],
                              change_schema("providers")).coalesce(1).write.mode("append").parquet(inbox)
        q.processAllAvailable()
    finally:
        q.stop()
    v1 = {r["Provider_ID"]: r for r in stream.read_snapshot(spark, root, "providers", 1).collect()}
    v2 = {r["Provider_ID"]: r for r in stream.read_snapshot(spark, root, "providers", 2).collect()}
    assert sorted(v1) == [1, 2, 3, 4, 5, 6] and v1[1]["Contact"] is None
    assert sorted(v2) == [1, 3, 4, 5, 6]


def test_failed_batch_is_replayed_once(spark, tmp_path, monkeypatch):
    """A micro-batch that dies is re-run after restart and writes the same snapshot."""
    root, inbox, ckpt = str(tmp_path / "p"), str(tmp_path / "inbox"), str(tmp_path / "ckpt")
    stream.write_initial(spark.createDataFrame(PROVIDER_ROWS, PROVIDERS), root)
    spark.createDataFrame([
        ("insert", 1, None, "Keyless", "NGO", None, "Goa", None, None),
        ("update", 2, 3, None, None, None, "Pune", None, ["City"]),
    ], change_schema("providers")).coalesce(1).write.mode("append").parquet(inbox)

    real = stream.apply_changes
    failures = []

    def flaky(current, batch, key):
        out = real(current, batch, key)
        if not failures:
            failures.append(1)
            out.write.mode("overwrite").parquet(stream.snapshot_path(root, 1))  # partial work
            raise RuntimeError("executor lost")
        return out

    monkeypatch.setattr(stream, "apply_changes", flaky)
    q = stream.start(spark, "providers", inbox, root, ckpt)
    try:
        q.processAllAvailable()
    except Exception:  # noqa: BLE001 - the first attempt fails by design
        pass
    finally:
        q.stop()
    q = stream.start(spark, "providers", inbox, root, ckpt)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    v1 = {r["Provider_ID"]: r for r in stream.read_snapshot(spark, root, "providers", 1).collect()}
    assert sorted(v1) == [1, 2, 3, 4, 5, 6]
    assert v1[6]["Name"] == "Keyless" and v1[3]["City"] == "Pune"


def test_backlog_is_folded_in_bounded_batches(spark, tmp_path):
    root, inbox = str(tmp_path / "p"), str(tmp_path / "inbox")
    stream.write_initial(spark.createDataFrame(PROVIDER_ROWS, PROVIDERS), root)
    for i in range(3):
        spark.createDataFrame([("insert", i, 10 + i, f"N{i}", "NGO", None, "Goa", None, None)],
                              change_schema("providers")).coalesce(1).write.mode("append").parquet(inbox)
    q = stream.start(spark, "providers", inbox, root, str(tmp_path / "ckpt"), max_files_per_trigger=1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    sizes = [stream.read_snapshot(spark, root, "providers", v).count() for v in range(4)]
    assert sizes == [5, 6, 7, 8]


def test_change_stream_commits_versions_and_replays_once(spark, tmp_path, monkeypatch):
    """A micro-batch is one version; one that dies after its commit is found to be there when it is run again."""
    from gleaner.sources.versions import VersionedTable

    inbox, ckpt = str(tmp_path / "inbox"), str(tmp_path / "ckpt")
    table = VersionedTable.create(spark.createDataFrame(PROVIDER_ROWS, PROVIDERS), str(tmp_path / "p"), "Provider_ID", 4)
    spark.createDataFrame([("insert", 1, None, "Keyless", "NGO", None, "Goa", None, None)],
                          change_schema("providers")).coalesce(1).write.mode("append").parquet(inbox)
    real, failures = VersionedTable.apply, []

    def dies(self, *args, **kwargs):
        out = real(self, *args, **kwargs)
        if not failures:
            failures.append(1)
            raise RuntimeError("driver lost")
        return out

    monkeypatch.setattr(VersionedTable, "apply", dies)
    for _ in range(2):
        q = stream.start_versioned(spark, "providers", inbox, table, ckpt)
        try:
            q.processAllAvailable()
        except Exception:  # noqa: BLE001 - the first attempt fails by design
            pass
        finally:
            q.stop()
    assert table.numbers() == [0, 1]
    table.apply(spark.createDataFrame([("delete", 1, 2, None, None, None, None, None, None)], change_schema("providers")))
    spark.createDataFrame([("insert", 2, None, "Later", "NGO", None, "Goa", None, None)],
                          change_schema("providers")).coalesce(1).write.mode("append").parquet(inbox)
    q = stream.start_versioned(spark, "providers", inbox, table, ckpt, keep=2)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["Provider_ID"]: r["Name"] for r in table.read().collect()}
    assert sorted(got) == [1, 3, 4, 5, 6, 7] and got[6] == "Keyless" and got[7] == "Later"
    assert table.numbers() == [2, 3]
