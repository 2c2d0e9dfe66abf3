"""Sources, publishing and streaming on real files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loadlens.operators import profile, publish
from loadlens.plans import ingest
from loadlens.session import work_dir
from loadlens.sources import files, readings as src, weather as ws
from loadlens.streaming import jobs

HEAD = "계약번호\t검침년월일\t검침시분\t유효전력량계\t계약종별\t지상무효전력량계\t진상무효전력량계\t지사\n"
BODY = ("C1\t2024-01-01\t0:15\t1.5\t일반용[을]\t0.5\t0.25\t서울지사\n"
        "C1\t2024-01-01\t24:00\t2.5\t일반용[을]\t\t0.25\t서울지사\n"
        "C2\t2024-01-02\tabc\tx\t주택\t1\t1\t부산\n")


@pytest.mark.parametrize("encoding,bom", [("utf-8", False), ("utf-8", True), ("cp949", False)])
def test_meter_export(spark, tmp_path, encoding, bom):
    data = (HEAD + BODY).encode(encoding)
    (tmp_path / "a.csv").write_bytes((b"\xef\xbb\xbf" if bom else b"") + data)
    # a second file with commas and fewer columns
    (tmp_path / "b.csv").write_text("계약번호,검침년월일,검침시분,유효전력량계\nC3,20240105,930,7\n")
    (tmp_path / "_skip.csv").write_text("x\n1\n")
    seen = files.surveys(spark, [str(tmp_path / "a.csv")])[str(tmp_path / "a.csv")]
    assert seen.charset == encoding and seen.lines == 4 and seen.lines_damaged == 0
    assert files.layout_of(seen.first, encoding).sep == "\t"
    cfg = src.SourceConfig("meter", str(tmp_path), src.METER_COLUMNS)
    got = {(r.customer_id, str(r.ts)): r for r in src.load(spark, cfg).collect()}
    assert len(got) == 4
    a = got[("C1", "2024-01-01 00:15:00")]
    assert (a.contract_type, a.p_active_kwh, a.p_reactive_kwh, a.region_code) == (
        "일반용(을)", 1.5, 0.75, "서울지사")
    assert got[("C1", "2024-01-02 00:00:00")].p_reactive_kwh == 0.25
    bad = got[("C2", "None")]
    assert bad.p_active_kwh is None and bad.contract_type == "주택용"
    assert got[("C3", "2024-01-05 09:30:00")].p_active_kwh == 7.0


def test_grid_source(spark, tmp_path):
    head = ",".join(src.GRID_COLUMNS)
    (tmp_path / "g.csv").write_bytes((
        f"{head}\n1,2,37.5,127,2024,1,5,1,100,4,80,3.5,40,1\n1,2,37.5,127,2024,1,5,24,100,0,80,3.5,40,1\n"
        "1,2,37.5,127,2024,1,5,24,100,8,80,3.5,40,1\n").encode("cp949"))
    got = sorted((str(r.ts), r.p_active_kwh, r.customer_id) for r in src.load(
        spark, src.SourceConfig("grid", str(tmp_path))).collect())
    assert got == [("2024-01-05 00:00:00", 20.0, "grid_1_2"), ("2024-01-05 23:00:00", 10.0, "grid_1_2")]


def test_epw_layouts(spark, tmp_path):
    short = ["2020", "1", "1", "1", "60", "f"] + [str(i) for i in range(6, 29)]
    long = ["2020", "12", "31", "24", "60", "f"] + [str(i) for i in range(6, 35)]
    long[6] = "99.9"
    for sid, line in (("108", short), ("101", long)):
        (tmp_path / f"{sid}.epw").write_text("\n".join([
            f"LOCATION,X{sid},KOR,SRC,{sid},37.5,127.0,9.0,86.0", *["HEADER,1,2"] * 7,
            ",".join(line), "2020,1,1,2,short"]) + "\n")
    meta, series = ws.read_epw(spark, str(tmp_path))
    assert {r.station_id: r.elevation_m for r in meta.collect()} == {"108": 86.0, "101": 86.0}
    got = {r.station_id: r for r in series.collect()}
    assert (got["108"].temp_c, got["108"].wind_dir_deg, got["108"].precip_mm) == (6.0, 18.0, None)
    assert (got["101"].temp_c, got["101"].wind_dir_deg, got["101"].precip_mm) == (None, 20.0, 33.0)
    assert str(got["101"].ts) == "2020-12-31 23:00:00"
    assert ws.read_epw(spark, str(tmp_path), {"108"})[1].count() == 1


def test_observed_weather_and_others(spark, tmp_path):
    rows = [["108", "서울", "2024-01-01 01:00", "-3.5", "", "1.2"] + [""] * 14,
            ["108", "서울", "2024-01-03 00:00", "bad", "2", "1.2"] + [""] * 14]
    p = tmp_path / "w"
    p.mkdir()
    head = ",".join(f"열{i}" for i in range(20))
    (p / "w.csv").write_bytes("\n".join([head, *[",".join(r) for r in rows]]).encode("euc-kr") + b"\n")
    d = ws.read_observed(spark, str(p))
    assert [(r.station_id, r.temp_c, r.precip_mm) for r in d.orderBy("ts").collect()] == [
        (108, -3.5, None), (108, None, 2.0)]
    assert ws.read_observed(spark, str(p), "2024-01-01", "2024-01-02").count() == 1
    h = tmp_path / "h.csv"
    h.write_text("date,name,category\n2024-01-01,x,election\nbad,y,\n")
    assert [str(r.date) for r in ws.read_holidays(spark, str(h)).collect()] == ["2024-01-01"]
    s = tmp_path / "solar.csv"
    s.write_text("datetime,total_solar_mw,market_solar_mw\n2024-01-01 01:00,5,2\n2024-01-01 24:00,7,3\n")
    got = ws.read_solar(spark, str(s)).orderBy("ts").collect()
    assert [r.total_solar_mw for r in got] == [5.0, 7.0]


def test_conversion_and_repair(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,x,\n2,3,\n3,y,5\n")
    d = src.csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"))
    assert dict(d.dtypes) == {"a": "double", "b": "string", "c": "string"}
    (tmp_path / "bad.txt").write_bytes(b"ok\nbro\xffken\n")
    assert src.broken_lines(spark, str(tmp_path / "bad.txt")).count() == 1
    src.repair(spark, str(tmp_path / "bad.txt"), str(tmp_path / "good"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "good")).collect()) == ["broken", "ok"]


def test_text_ingest_loses_nothing(spark, tmp_path):
    """Charset from all lines, bad lines counted, and one set of rows for every query."""
    late = "a,b\n" + "x,1\n" * 40_000 + "가나,2\n"  # the first Korean bytes lie far from the head
    deep = tmp_path / "month=1"
    deep.mkdir()
    (deep / "late.csv").write_bytes(late.encode("cp949"))
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3\n4,5,6\n7,8\n")
    d = src.read_delimited(spark, str(tmp_path))
    assert d.count() == len(d.collect()) == len(d.select("b").collect()) == 40_003
    assert d.where("a = '가나'").count() == 1
    got = {r.file.rsplit("/", 1)[1]: (r.lines_read, r.lines_bad, r.lines_kept, r.charset)
           for r in src.bad_line_report(spark, str(tmp_path)).collect()}
    assert got == {"late.csv": (40_001, 0, 40_001, "cp949"), "bad.csv": (4, 2, 2, "utf-8")}
    wide = ",".join(f"column{i}" for i in range(12_000))  # a header longer than the first look
    (tmp_path / "wide.csv").write_text(f"{wide}\n1\n")
    seen = files.surveys(spark, [str(tmp_path / "wide.csv")])[str(tmp_path / "wide.csv")]
    assert len(files.layout_of(seen.first, "utf-8").header) == 12_000


def test_broken_bytes_do_not_decide_about_a_file(spark, tmp_path):
    body = [f"이름{i},{i}".encode("cp949") for i in range(50)]
    (tmp_path / "old.csv").write_bytes(b"\r\n".join(
        ["이름,값".encode("cp949"), b"", *body, b"x\xff\xffy,7"]) + b"\r\n")
    (tmp_path / "new.csv").write_bytes("이름,값\n가,1\n".encode() + b"\xb0\xa1,2\n" + "나,1003\n".encode())
    (tmp_path / "plain.csv").write_bytes(b"a,b\nx\xfe,1\n")
    (tmp_path / "empty.csv").write_bytes(b"\n \n")
    seen = {p.rsplit("/", 1)[1]: s for p, s in src.survey(spark, str(tmp_path)).items()}
    assert {n: (s.charset, s.lines_damaged, s.bytes_replaced) for n, s in seen.items()} == {
        "old.csv": ("cp949", 1, 2), "new.csv": ("utf-8", 1, 2), "plain.csv": ("utf-8", 1, 1)}
    (tmp_path / "plain.csv").unlink()
    d = src.read_delimited(spark, str(tmp_path))
    assert set(d.columns) == {"이름", "값"}
    got = {r["값"]: r["이름"] for r in d.collect()}
    assert got["49"] == "이름49" and got["7"].startswith("x\ufffd") and got["1003"] == "나"
    report = {r.file.rsplit("/", 1)[1]: (r.lines_read, r.lines_bad, r.lines_damaged)
              for r in src.bad_line_report(spark, str(tmp_path)).collect()}
    assert report == {"old.csv": (51, 0, 1), "new.csv": (3, 0, 1)}


def readings(spark, n=3):
    rows = [(f"c{c}", dt.datetime(2024, 1, 1 + d, h), "주택용", float(h), 0.1, 0.2, "서울본부")
            for c in range(n) for d in range(3) for h in (1, 12)]
    return spark.createDataFrame(rows, "customer_id string, ts timestamp_ntz, contract_type string, "
                                 "p_active_kwh double, p_reactive_lag double, p_reactive_lead double, "
                                 "region_code string")


def test_publish_and_smart_load(spark, tmp_path):
    out = str(tmp_path / "pub")
    meta = publish.publish(spark, ingest.ingest_tables(readings(spark)), out)
    assert meta["status"] == "OK" and meta["tables"]["daily"]["rows"] == 9
    d = src.load_smart(spark, src.SourceConfig("table", "/nowhere"), out)
    assert d.count() == 9 and "region_code" in d.columns
    grades = {r.column_name: r.grade for r in publish.self_test(d).collect()}
    assert grades["day_kwh"] == "OK"
    with pytest.raises(publish.PublishError):
        publish.publish(spark, ingest.ingest_tables(readings(spark).limit(0)), out)
    # a failed publication leaves the tables alone and is not trusted
    raw = str(tmp_path / "raw")
    readings(spark).write.parquet(raw)
    back = src.load_smart(spark, src.SourceConfig("table", raw), out)
    assert back.count() == 18 and spark.read.parquet(f"{out}/daily").count() == 9


def test_profile_isolates_failures_and_skips_missing_columns(spark, monkeypatch):
    def broken(_):
        raise ValueError("broken statistic")

    keep = ("customer_counts", "weather_regression", "hourly_profile")
    stats = {k: profile.STATISTICS[k] for k in keep} | {"broken": broken}
    monkeypatch.setattr(profile, "STATISTICS", stats)
    seen = []
    d = profile.run_profile(readings(spark), lambda n, df: seen.append((n, df.count())),
                            frozenset({"hourly_profile"}))
    got = {r.name: r.status for r in d.collect()}
    assert got == {"customer_counts": "ok", "weather_regression": "skipped",
                   "hourly_profile": "skipped", "broken": "failed"}
    assert [n for n, _ in seen] == ["customer_counts"]


def test_ingest_job_with_weather(spark, tmp_path):
    raw = str(tmp_path / "raw")
    readings(spark).write.parquet(raw)
    hourly = spark.createDataFrame([(108, dt.datetime(2024, 1, 1, 1), 3.0)],
                                   "station_id int, ts timestamp_ntz, temp_c double")
    meta = ingest.run(spark, src.SourceConfig("table", raw), str(tmp_path / "out"), hourly)
    assert meta["status"] == "OK"
    d = spark.read.parquet(str(tmp_path / "out" / "daily"))
    assert {str(r.date): r.temp_c for r in d.where("customer_id = 'c0'").collect()} == {
        "2024-01-01": 3.0, "2024-01-02": None, "2024-01-03": None}


def test_stage_resume_and_results(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert publish.stage(spark, str(tmp_path / "s"), build).count() == 3
    assert len(calls) == 1
    publish.save_result(spark.range(4), str(tmp_path), "r", sort_by="id")
    assert '"rows": 4' in (tmp_path / "r_meta.json").read_text()


def test_upsert_is_idempotent(spark, tmp_path):
    target = str(tmp_path / "t")
    write = jobs.upsert_days(target)
    schema = "customer_id string, contract_type string, date date, day_kwh double, n_intervals bigint"

    def batch(rows):
        return spark.createDataFrame([(c, "A", dt.date.fromisoformat(d), v, 1) for c, d, v in rows],
                                     schema)

    first = batch([("a", "2024-01-01", 1.0), ("a", "2024-02-01", 2.0)])
    write(first, 0)
    write(batch([("a", "2024-02-01", 5.0), ("b", "2024-02-02", 7.0)]), 1)
    write(batch([("a", "2024-02-01", 5.0), ("b", "2024-02-02", 7.0)]), 1)
    got = sorted((r.customer_id, str(r.date), r.day_kwh) for r in jobs.read_upserted(spark, target).collect())
    assert got == [("a", "2024-01-01", 1.0), ("a", "2024-02-01", 5.0), ("b", "2024-02-02", 7.0)]
    alarms = jobs.month_to_date_alarms(
        jobs.read_upserted(spark, target), F.lit("2024-02-10").cast("date"),
        spark.createDataFrame([("a", "A", dt.date(2024, 1, 1), 10.0)],
                              "customer_id string, contract_type string, year_month date, "
                              "monthly_kwh double"))
    r = {x.customer_id: x for x in alarms.collect()}
    assert r["a"].pred_monthly_kwh == 5.0 * 29 and r["a"].pred_prev and not r["b"].pred_any


def test_readers_never_see_half_a_batch(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    write = jobs.upsert_days(target)

    def batch(v, days=("2024-01-01", "2024-02-01", "2024-03-01")):
        return spark.createDataFrame([("a", "A", dt.date.fromisoformat(d), v, 1) for d in days],
                                     "customer_id string, contract_type string, date date, "
                                     "day_kwh double, n_intervals bigint")

    def seen(version=None):
        return sorted(r.day_kwh for r in jobs.read_upserted(spark, target, version).collect())

    with pytest.raises(FileNotFoundError):
        jobs.read_upserted(spark, target)
    write(batch(1.0), 0)
    first = jobs.versions(spark, target)[-1]
    before = jobs.read_upserted(spark, target)
    # The commit fails after every month was written: the table is as it was, whole.
    move, looks = files.rename, []

    def broken(spark, src, dst):
        looks.append(seen())
        raise OSError("lost")

    monkeypatch.setattr(files, "rename", broken)
    with pytest.raises(OSError):
        write(batch(2.0), 1)
    assert looks == [[1.0] * 3] and seen() == [1.0] * 3
    monkeypatch.setattr(files, "rename", move)
    write(batch(2.0), 1)
    assert seen() == [2.0] * 3 and seen(first) == [1.0] * 3
    assert sorted(r.day_kwh for r in before.collect()) == [1.0] * 3  # a reader that began before
    # Months that a batch does not touch keep their folder; old versions go in the end.
    write(batch(3.0, ["2024-02-01"]), 2)
    assert seen() == [2.0, 2.0, 3.0]
    for i in range(3, 6):
        write(batch(float(i), ["2024-02-01"]), i)
    assert len(jobs.versions(spark, target)) == jobs.KEEP_VERSIONS and seen() == [2.0, 2.0, 5.0]
    assert not (tmp_path / "t" / "versions" / first.rsplit("/", 1)[1]).exists()
    write(batch(9.0, []), 6)
    assert seen() == [2.0, 2.0, 5.0]


def test_work_dir_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = work_dir(spark, "x")
    assert path != work_dir(spark, "x")
    if root:
        assert path.startswith(root.rstrip("/") + "/")


def test_totals_by_customer_hold_groups_not_readings(spark):
    from loadlens.plans.catalog.exchange import totals_by_customer

    ts = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame(
        [("a", "A", ts, 1.0), ("a", "A", ts + dt.timedelta(hours=1), None), ("b", None, ts, None),
         (None, "B", ts, 2.0)],
        "customer_id string, contract_type string, ts timestamp_ntz, p_active_kwh double")
    out = totals_by_customer(d)
    got = {r.customer_id: (r.n, r.kwh, r.contract_type) for r in out.collect()}
    assert got == {"a": (2, 1.0, "A"), "b": (1, None, None), None: (1, 2.0, "B")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("functions=[partial_count"):]  # nothing that sorts lies below it
    assert "partial_sum" in first and "SortAggregate" not in first and "Sort [" not in first


def test_files_of_whole_utf8_are_surveyed_once(spark, tmp_path, monkeypatch):
    (tmp_path / "new.csv").write_bytes("이름,값\n가,1\n".encode())
    (tmp_path / "old.csv").write_bytes("이름,값\n가,1\n".encode("cp949"))
    asked, real = [], files.korean_damage
    monkeypatch.setattr(files, "korean_damage", lambda s, p: asked.append(p) or real(s, p))
    paths = [str(tmp_path / n) for n in ("new.csv", "old.csv")]
    seen = files.surveys(spark, paths)
    assert asked == [paths[1:]]
    assert [(s.charset, s.lines, s.lines_damaged) for s in seen.values()] == [("utf-8", 2, 0), ("cp949", 2, 0)]
