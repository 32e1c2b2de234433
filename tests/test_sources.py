import json
import re

import pytest
from pyspark.sql import functions as F

from trendlab import sources as src
from trendlab.functions.embedding import model_embedder
from trendlab.plans import build_trend_matrix, run_pipeline, verify_stored
from trendlab.sources.files import list_files

HEADER = "normalized_term,报告日期,搜索频率排名"
COLS = src.LogColumns()


@pytest.fixture
def folder(tmp_path):
    reports = tmp_path / "reports 报告"
    reports.mkdir()

    def write(name, text, encoding="utf-8"):
        (reports / name).write_bytes(text.encode(encoding))

    write("bom.csv", f'{HEADER}\n"red, shoe",2024-01-01,"1,234"\nnull,2024-01-01,7\nNA,2024-01-01,\n', "utf-8-sig")
    write("gbk.csv", f"{HEADER}\n运动鞋,2024-01-08,5\n", "gbk")
    write("padded.csv", " 搜索频率排名 ,extra, normalized_term,报告日期\n3,x,red shoes,2024-01-01\n")
    write("missing.csv", "normalized_term,报告日期\nlost,2024-01-01\n")
    write("ragged.csv", f"{HEADER}\nodd,2024-01-01,1\nodd,2024-01-01,1,2,3\n")
    write("short.csv", f"{HEADER}\nfine,2024-01-15,4\nfine\n")
    write("invalid.csv", f"{HEADER}\nx,soon,1\ny,2024-01-01,none\n")
    write("empty.csv", "")
    (reports / "binary.csv").write_bytes(b"normalized_term,a,b\n\xff\xff\x01,1,2\n")
    write("notes.txt", "not a report")
    return str(reports)


def name(file):
    from urllib.parse import unquote

    return unquote(file).rsplit("/", 1)[-1]


def test_files_and_encodings(spark, folder):
    assert {name(r.file) for r in list_files(spark, folder).collect()} == {
        "bom.csv", "gbk.csv", "padded.csv", "missing.csv", "ragged.csv", "short.csv", "invalid.csv", "empty.csv", "binary.csv",
    }
    got = {name(r.file): r.encoding for r in src.detect_encoding(spark, folder).collect()}
    assert got.pop("gbk.csv") == "GBK" and got.pop("binary.csv") is None and got.pop("empty.csv") is None
    assert set(got.values()) == {"UTF-8"}
    missing = {name(r.file): r.missing for r in src.missing_columns(spark, folder, COLS.required()).collect()}
    assert missing == {"missing.csv": ["搜索频率排名"]}


def test_read_and_report(spark, folder):
    log = src.read_term_log(spark, folder)
    rows = {(name(r.file), r.term, str(r.report_date), r.rank_raw) for r in log.collect()}
    assert ("bom.csv", "red, shoe", "2024-01-01", "1,234") in rows
    assert ("bom.csv", "null", "2024-01-01", "7") in rows and ("bom.csv", "NA", "2024-01-01", None) in rows
    assert ("gbk.csv", "运动鞋", "2024-01-08", "5") in rows
    assert ("padded.csv", "red shoes", "2024-01-01", "3") in rows
    assert "extra" in log.columns and log.where("extra = 'x'").count() == 1
    assert ("missing.csv", "lost", "2024-01-01", None) in rows

    files = src.inspect_files(spark, folder, COLS.required())
    report = src.file_quality_report(log, files, COLS.required())
    reasons = {name(r.file): r.reason for r in report.collect() if r.reason}
    assert reasons == {
        "missing.csv": "missing columns: 搜索频率排名",
        "ragged.csv": "malformed rows: 1",
        "invalid.csv": "no valid data",
        "empty.csv": "empty file",
        "binary.csv": "no encoding fits",
    }
    assert src.run_summary(report, files).first().asDict() == {"ok": 4, "total": 9}
    counts = {name(r.file): (r.undated, r.unranked) for r in report.collect()}
    assert counts["short.csv"] == (1, 1) and counts["invalid.csv"] == (1, 1) and counts["bom.csv"] == (0, 1)
    whole = {"bom.csv", "gbk.csv", "padded.csv", "short.csv", "invalid.csv"}
    for stage, more in (("matrix", set()), ("mapped_log", {"missing.csv"}), ("vocabulary", {"missing.csv"})):
        kept = src.accepted(log, report, stage)
        assert {name(r.file) for r in kept.collect()} == whole | more
        assert kept.columns == log.columns


def test_na_values(spark, folder):
    log = src.read_term_log(spark, folder, na_values=src.PANDAS_NA)
    terms = {r.term for r in log.collect()}
    assert "null" not in terms and "NA" not in terms and "red, shoe" in terms


def test_term_column_is_read_alone(spark, folder):
    plan = src.read_term_log(spark, folder).select("term")._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read and all(fields.count(":") == 1 for fields in read)


def test_no_usable_report(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="no report"):
        src.read_term_log(spark, str(tmp_path))


@pytest.mark.parametrize("rule", ["shortest", "fewest_words"])
def test_pipeline(spark, folder, tmp_path, rule):
    out = str(tmp_path / "out")
    res = run_pipeline(spark, folder, out, rule=rule)
    assert {r.check: r.passed for r in res.checks.collect()}["all"] is True
    mapping = {r.term: r.canonical for r in res.mapping.collect()}
    assert {"lost", "x", "y", "NA", "运动鞋"} <= set(mapping) and "odd" not in mapping
    terms = {r.term for r in res.matrix.terms.collect()}
    assert terms == {mapping[t] for t in ("red, shoe", "null", "red shoes", "运动鞋", "fine")}
    assert res.matrix.long.count() == len(terms) * 3
    features = src.load_features(spark, f"{out}/matrix", f"{out}/vectors")
    assert features.where(F.size("vector") == 64).count() == len(terms)
    assert res.features.columns == ["term", "vector", "curve"] and res.features.count() == len(terms)
    bare = src.load_features(spark, f"{out}/matrix")
    assert bare.where("vector is null").count() == len(terms)
    stats = json.loads(spark.read.text(f"{out}/matrix/matrix_stats").first().value)
    assert stats["n_terms"] == len(terms) and stats["n_dates"] == 3
    assert json.loads(spark.read.text(f"{out}/run_summary").first().value) == {"ok": 4, "total": 9}
    mapped = spark.read.parquet(f"{out}/mapped_log")
    assert {"mapped_term", "term", "rank_raw", "extra", "report_date"} <= set(mapped.columns)
    assert mapped.count() == 10
    again = build_trend_matrix(mapped, str(tmp_path / "again"), term_col="mapped_term")
    curves = lambda stored: sorted(map(tuple, stored.curves.collect()))
    assert curves(again) == curves(res.matrix)


def test_csv_sinks(spark, tmp_path):
    mapped = spark.createDataFrame([("a", "2024-01-01", "b")], "term string, report_date string, mapped_term string")
    src.write_mapped(mapped, str(tmp_path / "m"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 1


def test_verify_without_parts(spark, tmp_path):
    got = {r.check: r.passed for r in verify_stored(spark, str(tmp_path)).collect()}
    assert not got["has_matrix"] and not got["has_terms"] and not got["has_dates"] and not got["all"]


def test_undecodable_header_is_reported(spark, tmp_path):
    # A valid pair of GBK bytes without an assigned character, in a header.
    (tmp_path / "odd.csv").write_bytes(b"\xa2\xa1,\xf8\xa1\xfe\xfe\n1,2\n")
    (tmp_path / "good.csv").write_text(f"{HEADER}\na,2024-01-01,1\n")
    files = src.inspect_files(spark, str(tmp_path), COLS.required())
    log = src.read_term_log(spark, str(tmp_path), files=files)
    reasons = {name(r.file): r.reason for r in src.file_quality_report(log, files, COLS.required()).collect()}
    assert reasons == {"odd.csv": "no encoding fits"}


def write_reports(tmp_path, **texts):
    folder = tmp_path / "in"
    folder.mkdir()
    for stem, text in texts.items():
        (folder / f"{stem}.csv").write_text(text)
    return str(folder), str(tmp_path / "out")


def test_dates_with_bad_ranks_only_are_kept_on_request(spark, tmp_path):
    folder, out = write_reports(
        tmp_path, a=f"{HEADER}\nred shoe,2024-01-01,5\n", b=f"{HEADER}\nred shoe,2024-01-08,n/a\nlamp,2024-01-08,none\n"
    )
    dates = lambda keep, to: {str(r.report_date) for r in run_pipeline(spark, folder, to, keep_empty_dates=keep).matrix.dates.collect()}
    assert dates(False, f"{out}1") == {"2024-01-01"} and dates(True, f"{out}2") == {"2024-01-01", "2024-01-08"}
    assert {r.term for r in spark.read.parquet(f"{out}1/vocabulary").collect()} == {"red shoe", "lamp"}


def test_clashing_and_repeated_names(spark, tmp_path):
    folder, out = write_reports(
        tmp_path,
        a=f"term,{HEADER},file,x,x,,Malformed\nown,red shoe,2024-01-01,5,f,1,2,3,m\n",
        b=f"{HEADER}\nlamp,2024-01-01,7\n",
    )
    log = src.read_term_log(spark, folder)
    row = log.where("term = 'red shoe'").first().asDict()
    assert {k: row[k] for k in ("term_2", "file_2", "x", "x_2", "column_8", "Malformed_2")} == {
        "term_2": "own", "file_2": "f", "x": "1", "x_2": "2", "column_8": "3", "Malformed_2": "m",
    }
    assert run_pipeline(spark, folder, out).matrix.terms.count() == 2


def test_date_layouts(spark, tmp_path):
    days = ["2024.01.22", "22.01.2024", "Jan 22, 2024", "January 22, 2024", "1/22/2024", "2024/1/22 08:00", "2024-01-22T20:00:00", "2024年1月22日"]
    lines = "".join(f'term {i},"{d}",5\n' for i, d in enumerate(days))
    folder, _ = write_reports(tmp_path, a=f"{HEADER}\n{lines}own,22|1|24,5\n")
    log = src.read_term_log(spark, folder, date_formats=["d|M|yy"])
    assert {str(r.report_date) for r in log.collect()} == {"2024-01-22"}


def test_each_term_is_embedded_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        def encode(self, terms):
            seen.add(len(terms))
            return [[float(len(t)), float(t.count("e")), 1.0] for t in terms]

    folder, out = write_reports(tmp_path, a=HEADER + "\n" + "".join(f"term {i},2024-01-01,{i + 1}\n" for i in range(30)))
    result = run_pipeline(spark, folder, out, embedder=model_embedder(Counting))
    assert seen.value == 30 and result.features.where("vector is not null").count() == result.features.count()


def test_reports_are_parsed_twice_at_most(spark, folder, tmp_path, monkeypatch):
    scans = []
    plain = src.read_term_log
    monkeypatch.setattr("trendlab.plans.jobs.read_term_log", lambda *a, **k: scans.append(1) or plain(*a, **k))
    out = str(tmp_path / "out")
    result = run_pipeline(spark, folder, out)
    assert len(scans) == 1
    assert not [f for df in (result.mapping, result.features) for f in df.inputFiles() if f.endswith(".csv")]


def test_reports_of_one_day_stay_apart(spark, tmp_path):
    folder, out = write_reports(
        tmp_path,
        a=f"{HEADER}\nred shoe,2024/1/8 08:00,5\nlamp,2024/1/8 08:00,9\n",
        b=f"{HEADER}\nred shoe,2024/1/8 20:00,3\nred shoe,2024-01-15,4\n",
    )
    done = run_pipeline(spark, folder, out)
    assert sorted(str(r.report_date) for r in done.matrix.dates.collect()) == ["2024-01-08 08:00:00", "2024-01-08 20:00:00", "2024-01-15 00:00:00"]
    cells = {(r.term, str(r.report_date)): round(10**r.log_rank - 1) for r in done.matrix.long.collect()}
    assert [cells["red shoe", t] for t in ("2024-01-08 08:00:00", "2024-01-08 20:00:00", "2024-01-15 00:00:00")] == [5, 3, 4]
    assert cells["lamp", "2024-01-08 20:00:00"] == 2_000_000 and len(cells) == 6
    assert all(r.passed for r in done.checks.collect())
    assert spark.read.parquet(f"{out}/mapped_log").select("report_date").distinct().count() == 3
    assert src.read_term_log(spark, folder).schema["report_date"].dataType.simpleString() == "date"


def test_axis_without_times_is_of_dates(spark, tmp_path):
    folder, out = write_reports(tmp_path, a=f"{HEADER}\nred shoe,2024-01-08,5\nred shoe,2024/1/15,6\n")
    assert run_pipeline(spark, folder, out).matrix.dates.schema["report_date"].dataType.simpleString() == "date"


def test_times_are_kept_as_written(spark):
    from trendlab.functions import parse_time

    texts = {
        "2024-01-08T08:00+08:00": "2024-01-08 08:00:00", "2024-01-08 8:00 PM": "2024-01-08 20:00:00",
        "2024.1.8 08:00": "2024-01-08 08:00:00", "8.1.2024 08:00": "2024-01-08 08:00:00",
        "20240108 08:00": "2024-01-08 08:00:00", "2024年1月8日 08:00": "2024-01-08 08:00:00",
        "Jan 8, 2024 08:00": "2024-01-08 08:00:00", "1/8/2024 8:00 PM": "2024-01-08 20:00:00",
        "2024/3/10 02:30": "2024-03-10 02:30:00", "2024-01-08 12:00 AM": "2024-01-08 00:00:00",
        "2024-01-08 13:00 PM": "None", "2024-02-30": "None", "13/01/2024": "None",
    }
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # a zone with summer time
    try:
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = {r.t: str(r.ts) for r in df.select("t", parse_time(F.col("t")).alias("ts")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == texts


def test_day_first_file_by_vote(spark, tmp_path):
    day_first = "".join(f"t{i},{d}/01/2024 08:00,5\n" for i, d in enumerate([3, 13, 25]))
    ambiguous = "".join(f"u{i},{d}/02/2024,5\n" for i, d in enumerate([3, 4]))
    month_first = "v,01/13/2024,5\nw,3/4/2024,5\n"
    folder, _ = write_reports(tmp_path, a=f"{HEADER}\n{day_first}", b=f"{HEADER}\n{ambiguous}", c=f"{HEADER}\n{month_first}")
    log = src.read_term_log(spark, folder, time_axis=True)
    got = {r.term: str(r.report_date) for r in log.collect()}
    assert got == {"t0": "2024-01-03 08:00:00", "t1": "2024-01-13 08:00:00", "t2": "2024-01-25 08:00:00",
                   "u0": "2024-03-02 00:00:00", "u1": "2024-04-02 00:00:00",
                   "v": "2024-01-13 00:00:00", "w": "2024-03-04 00:00:00"}
    votes = {r.file.rsplit("/", 1)[-1]: (r.day_first, r.ambiguous) for r in src.date_layouts(spark, folder).collect()}
    assert votes == {"a.csv": (True, False), "b.csv": (False, True), "c.csv": (False, False)}
