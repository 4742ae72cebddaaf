"""CSV files whose columns differ, with broken lines."""

from wattloom.operators.cleaning import alert_rollup
from wattloom.sources.files import file_alerts, read_by_header


def test_layouts_broken_lines_and_missing_headers(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("a one.csv", 'UCP,FECHA,TOTAL\nx,2020-01-01,1\nx,2020-01-02\n\nx,2020-01-03,3,4\n"x,y",2020-01-04,\nUCP,FECHA,TOTAL\n')
    put("b.csv", ' FECHA , "UCP",extra,TOTAL\n2020-02-01,z,e,5\n')
    put("c.csv", "x,2020-01-01,1\nx,2020-01-02,2\n")
    put("d.csv", "")
    put("e.csv", "UCP,FECHA,TOTAL\n")
    rows, broken = read_by_header(spark, str(tmp_path), ["UCP", "FECHA"])
    got = sorted((r["source_file"][-5:], r["UCP"], r["FECHA"], r["TOTAL"], r["extra"]) for r in rows.collect())
    assert got == sorted([("e.csv", "x", "2020-01-01", "1", None), ("e.csv", "x,y", "2020-01-04", None, None), ("e.csv", "UCP", "FECHA", "TOTAL", None), ("b.csv", "z", "2020-02-01", "5", "e")], key=str)
    bad = sorted((r["source_file"][-5:], r["line"], r["reason"]) for r in broken.collect())
    assert bad == [("c.csv", "x,2020-01-01,1", "header"), ("c.csv", "x,2020-01-02,2", "header"), ("e.csv", "x,2020-01-02", "fields"), ("e.csv", "x,2020-01-03,3,4", "fields")]
    alerts = file_alerts(rows, broken, ["UCP", "extra", "never"])
    want = {("e.csv", "broken_fields", "ALERT", 2), ("c.csv", "broken_header", "ALERT", 2), ("e.csv", "column_extra", "WARNING", 3), ("e.csv", "column_never", "WARNING", 3), ("b.csv", "column_never", "WARNING", 1)}
    assert {(r["source_file"][-5:], r["check"], r["level"], r["n"]) for r in alerts.collect()} == want
    assert alert_rollup(alerts).where("level is null and check is null").first()["alerts"] == 5


def test_no_files(spark, tmp_path):
    rows, broken = read_by_header(spark, str(tmp_path), ["UCP", "FECHA"])
    assert rows.columns == ["UCP", "FECHA", "source_file"] and rows.count() == 0 and broken.count() == 0
