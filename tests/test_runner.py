"""Batch run of the catalogue: one directory per query, run log with errors and empties."""

from gleaner.plans import runner
from gleaner.plans.catalog import CATALOGUE, Metric
from tests.fixtures import PARAMS


def test_run_writes_results_and_log(spark, edge, tmp_path, monkeypatch):
    t, _ = edge
    monkeypatch.setitem(CATALOGUE, "broken", Metric(lambda tables: tables.claims.select("nope")))
    keys = ["claims_by_status", "providers_in_city", "broken", "orphan_references"]
    params = dict(PARAMS, city="Atlantis")
    log = {r["query"]: r for r in runner.run_catalogue(
        spark, t, str(tmp_path), params, keys, parallel=2).collect()}
    assert log["claims_by_status"]["status"] == "ok" and log["claims_by_status"]["row_count"] == 4
    assert log["providers_in_city"]["status"] == "empty"
    assert log["providers_in_city"]["params"] == '{"city": "Atlantis", "format": "parquet"}'
    assert log["claims_by_status"]["params"] == '{"format": "parquet"}'
    assert log["broken"]["status"] == "error" and "nope" in log["broken"]["error"]
    assert "Project" in log["broken"]["error"]  # the whole message
    assert log["orphan_references"]["row_count"] == 1
    back = spark.read.parquet(str(tmp_path / "claims_by_status"))
    assert sorted(r["Status"] for r in back.collect()) == ["Cancelled", "Completed", "Done", "Pending"]


def test_csv_sink_has_header(spark, edge, tmp_path):
    t, _ = edge
    runner.run_catalogue(spark, t, str(tmp_path), PARAMS, ["total_quantity"], fmt="csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "total_quantity"))
    assert back.columns == ["total_quantity"] and back.collect()[0][0] == "29"


def test_resume_runs_again_with_other_parameters_or_format(spark, edge, tmp_path):
    t, _ = edge
    run = lambda city, fmt="parquet": {r["query"]: r["row_count"] for r in runner.run_catalogue(
        spark, t, str(tmp_path), dict(PARAMS, city=city), ["providers_in_city"], fmt=fmt, resume=True).collect()}
    assert run("Atlantis") == {"providers_in_city": 0}
    here = t.providers.where("City IS NOT NULL").first()["City"]
    n = t.providers.where(t.providers["City"] == here).count()
    assert n and run(here) == {"providers_in_city": n}
    assert run(here, "json") == {"providers_in_city": n}
    assert spark.read.json(str(tmp_path / "providers_in_city")).count() == n


def test_unordered_results_have_no_final_sort_but_keep_their_limits(spark, edge):
    from gleaner.functions.agg import unordered

    t, _ = edge
    plan = lambda k: CATALOGUE[k](t, **PARAMS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan("claims_per_food_id")
    with unordered():
        assert "Sort" not in plan("claims_per_food_id")
        assert "Sort" in plan("top_food_names") and "Limit" in plan("top_food_names")


def test_resume_skips_finished_queries(spark, edge, tmp_path, monkeypatch):
    t, _ = edge
    runner.run_catalogue(spark, t, str(tmp_path), PARAMS, ["claims_by_status", "total_quantity"])
    calls = []
    original = runner._run_one

    def spy(spark_, key, *args):
        calls.append(key)
        return original(spark_, key, *args)

    monkeypatch.setattr(runner, "_run_one", spy)
    log = runner.run_catalogue(spark, t, str(tmp_path), PARAMS,
                               ["claims_by_status", "total_quantity", "top_meal_type"], resume=True)
    assert calls == ["top_meal_type"]
    assert sorted(r["query"] for r in log.collect()) == ["claims_by_status", "top_meal_type",
                                                         "total_quantity"]
