"""CSV ingest: header spaces, typed parse, unparsable -> NULL, missing files."""

import datetime as D

import pytest
from pyspark.sql import functions as F

from gleaner.sources import csv as ingest
from gleaner.sources.store import load_tables, save_tables


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_header_spaces_and_unparsable_dates(spark, tmp_path):
    write(tmp_path / "food_listings_data.csv",
          " Food_ID , Food_Name,Quantity ,Expiry_Date,Provider_ID,Provider_Type,Location,Food_Type,Meal_Type\n"
          "1,Rice,5,2025-03-17,1,Restaurant,Delhi,Veg,Lunch\n"
          "2,Bread,x7,soon,1,Restaurant,Delhi,Veg,Dinner\n"
          "3,Soup,4,3/20/2025,2,Household,Pune,Non-Veg,Snack\n"
          "4,Dal,3,2025-03-18 00:00:00,2,Household,Pune,Non-Veg,Lunch\n")
    df = ingest.read_csv_table(spark, str(tmp_path / "food_listings_data.csv"), "food_listings")
    got = {r["Food_ID"]: r for r in df.collect()}
    assert df.schema["Expiry_Date"].dataType.typeName() == "date"
    assert got[1]["Expiry_Date"] == D.date(2025, 3, 17)
    assert got[2]["Expiry_Date"] is None and got[2]["Quantity"] is None
    assert got[3]["Expiry_Date"] == D.date(2025, 3, 20)
    assert got[4]["Expiry_Date"] == D.date(2025, 3, 18)
    report = {r["column"]: r["unparsed"] for r in
              ingest.parse_report(ingest.read_raw(spark, str(tmp_path / "food_listings_data.csv")),
                                  df.schema, "food_listings").collect()}
    assert report["Expiry_Date"] == 1 and report["Quantity"] == 1 and report["Food_ID"] == 0


def test_timestamps_parse_to_ntz(spark, tmp_path):
    write(tmp_path / "claims_data.csv",
          "Claim_ID,Food_ID,Receiver_ID,Status,Timestamp\n"
          "1,1,1,Pending,2025-03-17 10:30:00\n"
          "2,1,2,Completed,not a time\n"
          "3,1,2,Completed,2025-03-18T07:15:00.250\n"
          "4,1,2,Completed,3/19/2025 8:05\n")
    df = ingest.read_csv_table(spark, str(tmp_path / "claims_data.csv"), "claims")
    got = {r["Claim_ID"]: r["Timestamp"] for r in df.collect()}
    assert df.schema["Timestamp"].dataType.typeName() == "timestamp_ntz"
    assert got == {1: D.datetime(2025, 3, 17, 10, 30), 2: None,
                   3: D.datetime(2025, 3, 18, 7, 15, 0, 250000), 4: D.datetime(2025, 3, 19, 8, 5)}


def test_missing_files_give_empty_tables(spark, tmp_path):
    write(tmp_path / "providers_data.csv",
          "Provider_ID,Name,Type,Address,City,Contact\n1,Asha,Restaurant,Road,Delhi,a@b.c\n")
    t = ingest.read_csv_tables(spark, str(tmp_path))
    assert t.providers.count() == 1
    assert t.claims.count() == 0 and t.claims.columns == ["Claim_ID", "Food_ID", "Receiver_ID",
                                                          "Status", "Timestamp"]
    report = ingest.ingest_report(spark, str(tmp_path))
    assert report.where("unparsed > 0").count() == 0


def test_store_round_trip_keeps_types_and_rows(spark, edge, tmp_path):
    t, _ = edge
    save_tables(t, str(tmp_path / "store"), files=2)
    back = load_tables(spark, str(tmp_path / "store"))
    for name, df in t.by_name().items():
        other = back.by_name()[name]
        assert other.schema == df.schema
        assert sorted(map(tuple, other.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_short_and_long_lines_are_kept(spark, tmp_path):
    write(tmp_path / "receivers_data.csv",
          "Receiver_ID,Name,Type,City,Contact\n"
          "1,Ravi,NGO,Delhi,r@x.org\n"
          "2,Sita,Individual,Pune,123,EXTRA\n"
          "3,Tara\n")
    df = ingest.read_csv_table(spark, str(tmp_path / "receivers_data.csv"), "receivers")
    got = {r["Receiver_ID"]: r for r in df.collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[2]["Contact"] == "123" and got[3]["Name"] == "Tara" and got[3]["City"] is None
    report = {(r["table_name"], r["column"]): r["unparsed"]
              for r in ingest.ingest_report(spark, str(tmp_path)).collect()}
    assert report[("receivers", "_malformed_lines")] == 2


def test_quoted_commas_and_empty_fields_are_not_malformed(spark, tmp_path):
    write(tmp_path / "receivers_data.csv",
          'Receiver_ID,Name,Type,City,Contact\n'
          '1,"Ravi, ""the"" NGO",NGO,Delhi,\n'
          '2,,,,\n'
          '\n')
    got = ingest.malformed_lines(spark, str(tmp_path / "receivers_data.csv"), "receivers").first()
    assert got["unparsed"] == 0
    df = ingest.read_csv_table(spark, str(tmp_path / "receivers_data.csv"), "receivers")
    assert [r["Name"] for r in df.orderBy("Receiver_ID").collect()] == ['Ravi, "the" NGO', None]


def test_report_on_a_folder_without_files(spark, tmp_path):
    assert ingest.ingest_report(spark, str(tmp_path)).count() == 0


def test_integral_decimals_are_ids(spark, tmp_path):
    write(tmp_path / "claims_data.csv",
          "Claim_ID,Food_ID,Receiver_ID,Status,Timestamp\n"
          "1.0,7,3.0,Pending,2025-03-17 10:30:00\n"
          "2,7.5,x,Pending,2025-03-17 10:30:00\n")
    got = {r["Claim_ID"]: r for r in
           ingest.read_csv_table(spark, str(tmp_path / "claims_data.csv"), "claims").collect()}
    assert got[1]["Receiver_ID"] == 3 and got[2]["Food_ID"] is None and got[2]["Receiver_ID"] is None


def test_a_hot_expiry_date_is_spread_over_files(spark, tmp_path):
    import datetime as dt
    from gleaner.schema import FOOD_LISTINGS
    from gleaner.sources.store import save_table
    hot = [(i, "Rice", 1, dt.date(2025, 3, 17), 1, "R", "Goa", "Veg", "Lunch") for i in range(3000)]
    rest = [(3000 + i, "Dal", 1, dt.date(2025, 1, 1) + dt.timedelta(days=i % 300), 1, "R", "Goa", "Veg",
             "Lunch") for i in range(6000)]
    df = spark.createDataFrame(hot + rest, FOOD_LISTINGS).repartition(4)
    save_table(df, str(tmp_path / "l"), "food_listings", files=8)
    import pyarrow.parquet as pq
    counts = [pq.ParquetFile(p).metadata.num_rows for p in (tmp_path / "l").glob("*.parquet")]
    assert sum(counts) == 9000 and max(counts) < 3000


def test_quoted_line_breaks_blank_markers_and_bad_lines(spark, tmp_path):
    (tmp_path / "providers_data.csv").write_text(
        'Provider_ID, Name ,Type,Address,City,Contact\n'
        '1,Asha,Restaurant,"12 ""Old"" Road\nMH 411001",Pune,a@b.c\n'
        '2,NA,nan,N/A,NULL,None\n'
        '3, pad ,Other,#N/A,null,\n'
        '4,long,Other,x,Goa,c,too many\n'
        '5,short,Other\n')
    rows = {r["Provider_ID"]: r for r in
            ingest.read_csv_table(spark, str(tmp_path / "providers_data.csv"), "providers").collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[1]["Address"] == '12 "Old" Road\nMH 411001' and rows[1]["City"] == "Pune"
    assert [rows[2][c] for c in ("Name", "Type", "Address", "City", "Contact")] == [None] * 5
    assert rows[3]["Name"] == " pad " and rows[3]["City"] is None
    bad = {r["Provider_ID"]: r["_corrupt_record"] for r in
           ingest.bad_records(spark, str(tmp_path / "providers_data.csv")).collect()}
    assert bad == {"4": "4,long,Other,x,Goa,c,too many", "5": "5,short,Other"}


DATE_CELLS = [
    "17-03-2025", "2025-03-17T10:30:00Z", "2025-03-17T10:30:00+05:30", "March 17, 2025", "3/17/2025 2:30 PM",
    "2025-3-7", "2025-03-17 10:30:00.123456789", "2025-03-17", "2025-03-17 10:30", "03/17/2025", "17 March 2025",
    "Mar 5 2025", "5-Mar-2025", "2025/3/7 9:05:06", "20250317", "12/11/2025", "13/14/2025", "2025-02-30", "garbage",
    "Mon, March 17, 2025 11:05 am", "2025-03-17 12:00 AM", "2025-03-17T10:30:00.5-0800", " 2025-03-17 ",
]


@pytest.mark.filterwarnings("ignore")
def test_date_cells_equal_pandas(spark):
    import pandas as pd
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    df = spark.createDataFrame(list(enumerate(DATE_CELLS)), "k int, cell string")
    got = {r["k"]: r for r in df.select("k", ingest._parse(F.col("cell"), T.TimestampNTZType()).alias("at"),
                                        ingest._parse(F.col("cell"), T.DateType()).alias("day")).collect()}
    for k, cell in enumerate(DATE_CELLS):
        want = pd.to_datetime(cell.strip(), errors="coerce")
        if pd.isna(want):
            assert got[k]["at"] is None and got[k]["day"] is None, cell
            continue
        want = (want.tz_convert("UTC").tz_localize(None) if want.tzinfo else want).floor("us")
        assert pd.Timestamp(got[k]["at"]) == want and got[k]["day"] == want.date(), cell


def test_written_csv_comes_back_unchanged(spark, tmp_path):
    from gleaner.sinks.writer import write_result

    texts = [" Asha ", " ", 'say "x"', "a\\b", "two\nlines", "comma, here", "\ttab", None]
    df = spark.createDataFrame([(k, t, None, None, None, None) for k, t in enumerate(texts)],
                               "Provider_ID long, Name string, Type string, Address string, City string, Contact string")
    write_result(df, str(tmp_path / "p.csv"), "csv")
    back = ingest.read_csv_table(spark, str(tmp_path / "p.csv"), "providers").collect()
    assert {r["Provider_ID"]: r["Name"] for r in back} == dict(enumerate(texts))


def test_an_unreadable_table_fails_the_report(spark, tmp_path, monkeypatch):
    from pyspark.errors import AnalysisException

    def broken(*args, **kwargs):
        raise AnalysisException("[SOMETHING_ELSE] not a missing path")

    monkeypatch.setattr(ingest, "read_raw", broken)
    with pytest.raises(AnalysisException):
        ingest.ingest_report(spark, str(tmp_path))


def test_two_frames_of_one_round_trip_live_side_by_side(spark, edge):
    from gleaner.plans import roundtrip

    t, _ = edge
    a, b = roundtrip.listings_via_csv(t), roundtrip.listings_via_csv(t)
    assert a.exceptAll(t.listings).count() == 0 and t.listings.exceptAll(b).count() == 0


HEAD = "Receiver_ID,Name,Type,City,Contact\n"


def test_plain_files_are_read_in_splits_and_broken_ones_whole(spark, tmp_path):
    folder = tmp_path / "receivers with space"
    folder.mkdir()
    plain = [(k, f"name {k}", "NGO", "Goa", "") for k in range(30_000)]
    write(folder / "a plain.csv", HEAD + "".join(",".join(map(str, r)) + "\n" for r in plain))
    write(folder / "b broken.csv", HEAD + "".join(f'{k},"two\nlines ""{k}""",NGO,Goa,\n' for k in range(30_000, 30_100)))
    write(folder / "c even.csv", HEAD + '40000,"say ""x"", so",NGO,Goa,\n')
    whole, others = ingest.files_with_breaks(spark, str(folder))
    assert [f.rsplit("/", 1)[1] for f in whole] == ["b broken.csv"]
    assert [f.rsplit("/", 1)[1] for f in others] == ["a plain.csv", "c even.csv"]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = ingest.read_csv_table(spark, str(folder), "receivers")
        tasks = df.select(F.spark_partition_id()).distinct().count()
        rows = {r["Receiver_ID"]: r["Name"] for r in df.collect()}
        one = ingest.read_csv_table(spark, str(folder), "receivers", multi_line=True)
        assert one.select(F.spark_partition_id()).distinct().count() <= 3  # a file a task
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert tasks >= 10
    assert len(rows) == 30_101 and rows[17] == "name 17" and rows[40_000] == 'say "x", so'
    assert rows[30_005] == 'two\nlines "30005"'


def test_files_whose_names_are_patterns_are_read_whole(spark, tmp_path):
    (tmp_path / "r").mkdir()
    write(tmp_path / "r" / "a[1].csv", HEAD + "1,x,NGO,Goa,\n")
    write(tmp_path / "r" / "b.csv", HEAD + '2,"y\nz",NGO,Goa,\n')
    got = {r["Receiver_ID"]: r["Name"] for r in ingest.read_csv_table(spark, str(tmp_path / "r"), "receivers").collect()}
    assert got == {1: "x", 2: "y\nz"}
