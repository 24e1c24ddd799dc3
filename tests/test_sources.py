import datetime
import json

import pytest
from pyspark.sql import functions as F

from wayscore import schemas, session
from wayscore.sources import files, tables

HEADER = "user_id,timestamp,latitude,longitude,city\n"


def test_csv_has_types_blank_lines_and_bad_fields(spark, tmp_path):
    path = tmp_path / "gps.csv"
    path.write_text(HEADER + "a,1,25.033,121.5654,Taipei\n\nb,oops,,1.0,台北\n", encoding="utf-8")
    rows = [tuple(r) for r in files.read_csv(spark, str(path)).collect()]
    assert rows == [("a", 1, 25.033, 121.5654, "Taipei"), ("b", None, None, 1.0, "台北")]


def test_csv_with_other_header_is_an_error(spark, tmp_path):
    path = tmp_path / "gps.csv"
    path.write_text("timestamp,user_id,latitude,longitude,city\n1,a,2.0,3.0,T\n")
    with pytest.raises(Exception, match="CSV header|column name"):
        files.read_csv(spark, str(path)).collect()


MATRIX = [("新竹", "u1", 1.5, 3, 1, 130.0), ("Taipei", "u2", 0.0, 1, 1, -20.0)]


def test_json_lines_and_arrays(spark, tmp_path):
    df = spark.createDataFrame(MATRIX, schemas.DECISION_MATRIX)
    lines = str(tmp_path / "lines")
    files.write_json(df, lines)
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "lines").glob("*.json"))
    assert "新竹" in text
    back = files.read_json(spark, lines, schemas.DECISION_MATRIX)
    assert sorted(map(tuple, back.collect())) == sorted(MATRIX)

    array = tmp_path / "array.json"
    array.write_text(
        json.dumps([dict(zip(df.columns, r)) for r in MATRIX], ensure_ascii=False, indent=4),
        encoding="utf-8",
    )
    back = files.read_json(spark, str(array), schemas.DECISION_MATRIX, records=True)
    assert sorted(map(tuple, back.collect())) == sorted(MATRIX)


@pytest.mark.parametrize("n", [0, 1, 250])
def test_json_array_report_in_order(spark, tmp_path, n):
    rows = [(f"城{i % 7}", f"u{i:03d}", 0.5, i, None, float(i % 60)) for i in range(n)]
    df = spark.createDataFrame(rows, schemas.DECISION_MATRIX).repartition(5)
    files.write_json_array(df, str(tmp_path / "report"), F.desc("final_score"), F.asc("user_id"))
    parts = sorted(
        (tmp_path / "report").rglob("part-*"), key=lambda p: int(p.parent.name.partition("=")[2] or 0),
    )
    found = [row for p in parts for row in json.loads(p.read_text("utf-8"))]
    back = files.read_json(spark, str(tmp_path / "report"), schemas.DECISION_MATRIX, records=True)
    assert back.count() == n
    rows.sort(key=lambda r: (-r[5], r[1]))
    assert [tuple(r[c] for c in df.columns) for r in found] == rows


def test_first_available_source(spark, tmp_path):
    df = spark.createDataFrame(MATRIX, schemas.DECISION_MATRIX)
    parquet, lines = str(tmp_path / "m.parquet"), str(tmp_path / "m.json")
    files.write_json(df.limit(1), lines)
    choices = [("parquet", parquet), ("json", lines)]

    def size():
        return files.read_first_available(spark, choices, schemas.DECISION_MATRIX).count()

    assert size() == 1
    files.write_parquet(df, parquet)
    assert size() == 2
    damaged = tmp_path / "bad.parquet"
    damaged.write_text("this is not parquet")
    choices[0] = ("parquet", str(damaged))
    assert size() == 1
    array = tmp_path / "a.json"
    array.write_text(json.dumps([dict(zip(df.columns, r)) for r in MATRIX], indent=2))
    choices[1] = ("json array", str(array))
    assert size() == 2
    with pytest.raises(FileNotFoundError, match="parquet"):
        files.read_first_available(
            spark, [("parquet", str(tmp_path / "none"))], schemas.DECISION_MATRIX
        )


def test_parquet_overwrite_is_snappy(spark, tmp_path):
    df = spark.createDataFrame(MATRIX, schemas.DECISION_MATRIX)
    path = str(tmp_path / "m")
    for _ in range(2):
        files.write_parquet(df, path)
    assert files.read_parquet(spark, path).count() == 2
    assert list((tmp_path / "m").glob("*.snappy.parquet"))


def test_report_status(spark, tmp_path):
    missing = files.report_status(spark, str(tmp_path / "none")).first()
    assert missing["data_ready"] is False and missing["last_update"] is None
    path = str(tmp_path / "m")
    files.write_parquet(spark.createDataFrame(MATRIX, schemas.DECISION_MATRIX), path)
    found = files.report_status(spark, path).first()
    assert found["data_ready"] is True and found["source"] == path
    assert isinstance(found["last_update"], datetime.datetime)


def test_epoch_seconds_do_not_depend_on_the_session_zone(spark, given):
    zone = spark.conf.get("spark.sql.session.timeZone")

    def total():
        return sorted(
            r[0]
            for r in tables.events(spark, given).select(tables.epoch_seconds()).collect()
        )

    utc = total()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert total() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert utc[0] // 86400 == 19723  # 2024-01-01


def test_stored_tables_go_to_the_named_folder(spark, tmp_path, monkeypatch):
    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, name, default=None):
            return self.folder

    class Context:
        applicationId = "app-1"
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        def __init__(self, folder):
            self.conf = Conf(folder)

    assert session.shared_folder(Session("hdfs:/shared/")) == "hdfs:/shared/wayscore/app-1"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session(None))
    Context.master = "local[2]"
    first = session.shared_folder(Session(None))
    assert first == session.shared_folder(Session(None))
