import json

import pytest
from pyspark.sql import functions as F

from veilframe.operators import guard, query, utility, verdict
from veilframe.operators.release import LeakError
from veilframe.sources import ingest
from veilframe.streaming import cells


def sample(spark, *values):
    return spark.createDataFrame([(float(v),) for v in values] or [], "v double")


def test_statistics(spark):
    assert utility.wasserstein(sample(spark, 0, 1, 2), sample(spark, 1, 2, 3)).first()[0] == pytest.approx(1)
    assert utility.ks(sample(spark, 0, 1), sample(spark, 5, 6)).first()[0] == 1
    assert utility.ks(sample(spark, 0, 1), sample(spark, 1, 2)).first()[0] == 0.5
    assert utility.wasserstein(sample(spark), sample(spark, 1)).first()[0] is None
    pairs = lambda *x: spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    assert utility.spearman(pairs((1, 1), (2, 4), (3, 9)), "a", "b").first()[0] == pytest.approx(1)
    assert utility.spearman(pairs((1, 3), (2, 2), (3, 1)), "a", "b").first()[0] == pytest.approx(-1)
    assert utility.spearman(pairs((1, 1)), "a", "b").first()[0] is None
    assert utility.spearman(pairs((1, 1), (1, 2)), "a", "b").first()[0] is None
    empty = spark.createDataFrame([], "k string")
    assert utility.jaccard(empty, empty).first()[0] is None
    got = spark.createDataFrame([(1.0, 0.0), (1.1, 1.0)], "a double, b double").select(utility.relative_error(F.col("a"), F.col("b"))).collect()
    assert got[0][0] is None and got[1][0] == pytest.approx(0.1)


@pytest.fixture(scope="module")
def registry(spark):
    ids = spark.createDataFrame([("358401234567", "244120000000001"), (None, " 244120000000002 ")], "msisdn string, imsi string")
    return guard.register(ids, ["msisdn", "imsi"]).cache()


def test_scrub_and_scan(spark, registry):
    assert guard.registry_size(registry).first()[0] == 3
    text = "call 358401234567\nor 99358401234567, not 12345678901"
    rows = spark.createDataFrame([(1, text), (2, None)], "i int, t string")
    got = {r.i: r.t for r in guard.scrub(rows, "i", "t", registry).collect()}
    assert got == {1: "call [REDACTED]\nor [DIGITS], not [DIGITS]", 2: ""}
    found = {(r.location, r.kind, r.n) for r in guard.scan_text(rows, "i", "t", registry).collect()}
    assert found == {("line 1", "registered_id", 1), ("line 2", "long_digit_run", 2)}


def test_guarded_writes(spark, registry, tmp_path):
    good = spark.createDataFrame([("a", 1)], "x string, n int")
    guard.write_table(good, str(tmp_path / "good"), registry)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    with pytest.raises(LeakError):
        guard.write_table(good.withColumn("x", F.lit("358401234567")), str(tmp_path / "bad"), registry)
    with pytest.raises(LeakError):
        guard.write_table(good.withColumnRenamed("x", "msisdn"), str(tmp_path / "bad"), registry)
    with pytest.raises(LeakError):
        guard.write_json({"a": "358401234567"}, str(tmp_path / "bad.json"), registry)
    guard.append_line({"a": 1}, str(tmp_path / "log"), registry)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["good", "log"]
    with pytest.raises(LeakError):
        guard.egress("hello 358401234567", str.upper, str(tmp_path / "audit"), registry)
    assert guard.egress("hello", str.upper, str(tmp_path / "audit"), registry) == "HELLO"


def test_notebook_texts():
    raw = json.dumps({"cells": [{"source": ["a"], "outputs": [{"text": ["b"], "data": {"image/png": "x", "text/plain": "c"}}]}]})
    assert guard.notebook_texts(raw) == ["a", "b", "c"]
    assert guard.notebook_texts("{") == ["{"]


def test_scan_folder_reads_files_by_kind(spark, registry, tmp_path):
    spark.createDataFrame([("358401234567",)] * 9, "x string").coalesce(1).write.option("compression", "gzip").parquet(str(tmp_path / "t"))
    (tmp_path / "c.csv").write_text('358401234567,b\n"x\n358401234567",y\n')
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"source": "358401234567", "outputs": [{"data": {"image/png": "99999999999999"}}]}]}, indent=1))
    (tmp_path / "r.txt").write_text("a\n12345678901")
    found = {(r.source.rsplit(".", 1)[-1], r.location, r.kind) for r in guard.scan_folder(spark, str(tmp_path), registry).collect() if "crc" not in r.source}
    assert found == {("parquet", "x", "registered_id"), ("csv", "<header>", "registered_id"), ("csv", "358401234567", "registered_id"), ("ipynb", "part 1", "registered_id"), ("txt", "line 2", "long_digit_run")}


def test_folder_plan_does_not_grow_with_its_files(spark, registry, tmp_path):
    """Files of one schema are one scan, and each keeps its own name in the findings."""

    def nodes(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation")

    for k in range(2):
        (tmp_path / f"a{k}.csv").write_text(f"id,said\n1,{'358401234567' if k else 'x'}\n")
        (tmp_path / f"n{k}.ipynb").write_text(json.dumps({"cells": [{"source": f"12345678901{k}"}]}))
    few = nodes(guard.scan_folder(spark, str(tmp_path), registry))
    for k in range(2, 30):
        (tmp_path / f"a{k}.csv").write_text("id,said\n1,358401234567\n")
        (tmp_path / f"n{k}.ipynb").write_text("358401234567")
    many = guard.scan_folder(spark, str(tmp_path), registry)
    assert nodes(many) == few
    found = [(r.source.rsplit("/", 1)[-1], r.location, r.kind) for r in many.collect()]
    assert sorted(f for f in found if f[0].endswith("csv")) == sorted((f"a{k}.csv", "said", "registered_id") for k in range(1, 30))
    assert sorted(f for f in found if f[0].endswith("ipynb")) == sorted((f"n{k}.ipynb", "part 1", "long_digit_run" if k < 2 else "registered_id") for k in range(30))


def release(spark):
    return spark.createDataFrame([("2027-04-30 12:00:00", "P", "4G", 30, 1.0), ("2027-04-30 12:15:00", "P", "5G", 5, 3.0)], "t string, province string, radio string, n_subscribers long, m double").withColumn("t", F.to_timestamp("t"))


def test_questions(spark):
    data, q = release(spark), query.AggregateQuery
    assert query.ask(data, q({"t": "12:00"}, ("t",), ("m",))).first()["t"] == "12:00"
    for wrong in (q({"t": "12:15"}), q({}, ("x",)), q({}, (), ("x",)), q({"radio": "6G"})):
        with pytest.raises(query.RefusedQuery):
            query.ask(data, wrong)
    assert query.ask(data, q({}, (), ("m",), True)).first()["m"] == pytest.approx(45 / 35)
    talk = query.Conversation(data)
    talk.step(q({}, (), ("m",)))
    with pytest.raises(query.RefusedQuery):
        talk.step(q({}, (), ("m",)))


def test_verdicts(spark):
    facts = spark.createDataFrame([(0.02, 2.0, 0.0, 90.0, 0.0, 54.0, 73.0)], "expected double, below_k double, disclosed double, homogeneous double, recovered double, accuracy double, bound double")
    got = {(r.criterion, r.release, r.approach): r.status for r in verdict.verdicts(facts, 10).collect()}
    assert len(got) == 12
    assert got["no_record_isolation", "record", "contextual"] == "pass"
    assert got["no_record_isolation", "record", "simplified"] == "fail"
    assert got["no_inference", "record", "simplified"] == "residual"
    assert got["no_inference", "aggregate", "simplified"] == "residual"


def test_proposals():
    good = '```json\n[{"field": "a", "class": "non_identifying", "confidence": 0.5, "rationale": "' + "w " * 40 + '"}]\n```'
    (row,) = verdict.validate_proposal(good, ["a"])
    assert len(row["rationale"].split()) == verdict.RATIONALE_WORDS
    for wrong in ("x", "{}", "[]", '[{"field": "a", "class": "z", "confidence": 1}]', '[{"field": "a", "class": "non_identifying", "confidence": 2}]', good.strip("`")[5:-1] + " and more", '[{"field": "a", "class": "non_identifying", "confidence": 1}] []'):
        with pytest.raises(verdict.InvalidProposal):
            verdict.validate_proposal(wrong, ["a"])
    assert verdict.review([row], {"a": "quasi_identifier"})[0]["decision"] == "override"


def test_ingest(spark, tmp_path):
    (tmp_path / "x.csv").write_text("msisdn,enb_id,time_start,tp_dl_avg\n 007 ,01,1809100800,1.5\n008,02,1809101400,x\n")
    got = ingest.read_csv(spark, str(tmp_path / "x.csv")).orderBy("msisdn").collect()
    assert [(r.msisdn, r.enb, r.tp_dl_avg, r.time_start.year) for r in got] == [("007", "01", 1.5, 2027), ("008", "02", None, 2027)]
    for value, unit in ((1809100800, "seconds"), (1809100800000, "millis"), (1809100800000000, "micros"), (1809100800000000000, "nanos")):
        df = spark.createDataFrame([(value,)], "time_start long")
        assert ingest.epoch_unit(df, "time_start") == unit
        assert ingest.parse_time(df).first()[0].year == 2027
    assert ingest.parse_time(spark.createDataFrame([("2027-01-02 03:04:05",), ("?",)], "time_start string")).where("time_start is null").count() == 1
    with pytest.raises(LeakError):
        ingest.guarded("/etc/passwd", str(tmp_path))
    assert ingest.read_json(str(tmp_path / "none")) is None


def test_stream_cells(spark, tmp_path):
    schema = "ts timestamp, user long, kind string, value double"
    rows = [(f"2024-01-01 {h:02d}:00:00", u, "a", 1.0) for h in (0, 1, 2, 12, 20) for u in range(3)]
    spark.createDataFrame(rows, "ts string, user long, kind string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    out = []
    stream = cells.windowed_cells(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", ["kind"], "user", "value")
    run = stream.writeStream.outputMode("append").foreachBatch(cells.publish(2, lambda df, n: out.extend(df.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert [(r.n_rows, r.n_subscribers, r.total) for r in out] == [(9, 3, 9.0), (3, 3, 3.0)]


def test_scrub_reaches_rows_without_an_id(spark):
    registry = spark.createDataFrame([("ABC123XYZ",), ("SECOND99",)], "token string")
    rows = [(None, "id ABC123XYZ"), (None, "or SECOND99"), (1, "id ABC123XYZ"), (1, "SECOND99 too"), (2, None), (2, ""), (None, "12345678901")]
    got = guard.scrub(spark.createDataFrame(rows, "id long, text string"), "id", "text", registry).collect()
    assert sorted((r.id is None, r.text) for r in got) == sorted([(True, "id [REDACTED]"), (True, "or [REDACTED]"), (False, "id [REDACTED]"), (False, "[REDACTED] too"), (False, ""), (False, ""), (True, "[DIGITS]")])


def test_sinks_replace_and_wipe(spark, registry, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2):
        guard.write_table(spark.range(n).withColumnRenamed("id", "n"), path, registry)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(LeakError):
        guard.write_table(spark.createDataFrame([("358401234567",)], "x string"), path, registry)
    assert spark.read.parquet(path).count() == 2  # what was there stays
    guard.write_text("héllo\n", str(tmp_path / "r.md"), registry)
    assert (tmp_path / "r.md").read_text() == "héllo\n"
    (tmp_path / ".stage-left").mkdir()
    assert guard.wipe(spark, str(tmp_path)) == 1 and guard.wipe(spark, str(tmp_path)) == 0


def test_digits_of_other_scripts(spark, registry):
    wide = "call ０１２３４５６７８９ now"
    rows = spark.createDataFrame([(1, wide)], "i int, t string")
    assert guard.scrub(rows, "i", "t", registry).first()["t"] == "call [DIGITS] now"
    assert [(r.kind, r.n) for r in guard.scan_text(rows, "i", "t", registry).collect()] == [("long_digit_run", 1)]


def test_reports(spark, registry, tmp_path):
    from veilframe.operators import reports
    from veilframe.operators.transforms import ReleaseConfig

    r1 = spark.createDataFrame([("b|c", 2.0), ("a", None)], "quasi string, pct double")
    text = reports.risk_report({"r1": r1})
    assert text.index("| a | not measured |") < text.index("| b\\|c | 2 |")
    assert text.count("\n## ") == len(reports.RISKS)
    config = ReleaseConfig(salt="secret")
    made = reports.transformations_report(config, 1440, r1)
    assert "secret" not in made and "| effective_bucket_minutes | 1440 |" in made
    assert "| k | 10 |" in made
    assert "| leak scan |" in reports.compliance_report(config, {"findings": 0})
    assert reports.utility_report({}).count("not measured") == len(reports.USES)
    with pytest.raises(ValueError):
        reports.utility_report({"u9": r1})
    with pytest.raises(ValueError):
        reports.frame(spark.range(reports.ROWS + 1))
    fields = spark.createDataFrame([("f", "drop"), ("g", "keep")], "field string, treatment string")
    put = reports.treatments(fields, spark.createDataFrame([("g", "bucket")], "field string, treatment string"))
    assert sorted(map(tuple, put.collect())) == [("f", "drop"), ("g", "bucket")]
    guard.write_text(made, str(tmp_path / "t.md"), registry)


def test_releases_are_checked_for_k(spark, monkeypatch):
    from veilframe.operators import release
    from veilframe.operators.roles import Roles
    from veilframe.operators.transforms import ReleaseConfig

    roles = Roles()
    row = spark.createDataFrame([("s1",)], f"{roles.key} string").withColumns({q: F.lit("x") for q in roles.quasi})
    monkeypatch.setattr(release, "k_anonymise", lambda df, roles, k: df)  # as if suppression failed
    for make in (release.record_release, release.session_release):
        with pytest.raises(LeakError):
            make(row, roles, ReleaseConfig(k=2))
