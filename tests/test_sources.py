"""File scans, table swaps, streams and rules on small exact cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import rules
from tessera.sources import files
from tessera.streaming import budget


def test_folder_scans(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.MD").write_bytes("﻿head".encode())
    (tmp_path / "a" / "y.txt").write_bytes("标准".encode("gb18030"))
    (tmp_path / "a" / "z.csv").write_text("no")
    found = files.discover(spark, str(tmp_path)).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["x.MD", "y.txt"]
    assert {r.text for r in files.read_texts(spark, str(tmp_path)).collect()} == {"head", "标准"}
    assert files.discover(spark, str(tmp_path / "none")).count() == files.read_texts(spark, str(tmp_path / "none")).count() == 0


def test_json_scans(spark, tmp_path):
    lines = ['{"question_id": "q1", "n": 1}', "", '{"question_id": "q2", "n": 2}', '{"question_id": "q1", "n": 3}']
    (tmp_path / "cases.jsonl").write_text("\n".join(lines))
    got = files.read_cases(spark, str(tmp_path / "cases.jsonl"), "question_id string, n int").collect()
    assert {r.question_id: r.n for r in got} == {"q1": 3, "q2": 2}
    (tmp_path / "bad.jsonl").write_text('{"question_id"')
    with pytest.raises(Exception):
        files.read_cases(spark, str(tmp_path / "bad.jsonl"), "question_id string, n int").collect()
    points = tmp_path / "points"
    points.mkdir()
    for name, text in [("a", '{"state": {"profile": "p"}}'), ("b", '{"profile": "r"}'), ("c", '{"profile": '), ("d", "{}")]:
        (points / f"{name}.json").write_text(text)
    assert sorted(r.profile for r in files.read_checkpoints(spark, str(points)).collect()) == ["p", "r"]
    deep = tmp_path / "runs" / "deep"
    deep.mkdir(parents=True)
    (deep / "R_retrieval_1.json").write_text(json.dumps({"mrr": 0.5}))
    (deep / "F_retrieval_2.json").write_text(json.dumps({"mrr": 0.25, "strategy": "P"}))
    (deep / "other.json").write_text("{}")
    assert {(r.strategy, r.mrr) for r in files.read_results(spark, str(tmp_path / "runs"), "mrr double, strategy string").collect()} == {("R", 0.5), ("P", 0.25)}


def test_table_swap(spark, tmp_path):
    path = str(tmp_path / "store")
    assert files.read_manifest(spark, path).count() == 0
    one = spark.createDataFrame([("a", "1")], "path string, sha256 string")
    assert files.rebuild(one, path) == 1
    assert files.rebuild(one.union(one), path) == 2
    with pytest.raises(ValueError):
        files.rebuild(one.where("false"), path)
    assert files.read_manifest(spark, path).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["store"]
    with pytest.raises(Exception):
        files.write_new(one, path)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "2024-01-01 10:00:00", 5), (2, "2024-01-01 23:59:59", 6), (3, "2024-01-02 00:00:00", 7)], "id int, ts string, tokens long").select("id", F.to_timestamp("ts").alias("ts"), "tokens").write.parquet(str(tmp_path / "in" / "t"))
    batch = spark.read.parquet(str(tmp_path / "in" / "t"))
    assert {(str(r.day), r.used, r.over) for r in budget.daily_usage(batch, "ts", "tokens", 10).collect()} == {("2024-01-01", 11, True), ("2024-01-02", 7, False)}
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in" / "t"))
    seen = []
    budget.ingest(stream, lambda b: seen.append(b.count()), str(tmp_path / "cp")).awaitTermination(60)
    assert sum(seen) == 3
    usage = budget.daily_usage(stream, "ts", "tokens", 10).writeStream.format("memory").queryName("usage").outputMode("update").trigger(availableNow=True).start()
    usage.awaitTermination(60)
    assert {(str(r.day), r.used) for r in spark.table("usage").collect()} == {("2024-01-01", 11), ("2024-01-02", 7)}


def test_undecodable_texts_fail(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"\xff\xff\xff")
    with pytest.raises(Exception, match="bad.txt"):
        files.read_texts(spark, str(tmp_path)).collect()


def test_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one page|@@@@ 1234 @@@@ 5678 @@@@||  two  ")
    (tmp_path / "b.md").write_text(" text \n")

    def pages(raw):
        yield from enumerate(raw.decode().split("|"))

    def ocr(raw, page):
        return "what the scanner saw on it" if page == 1 else None

    def rows(**more):
        return {(r.path.rsplit("/", 1)[1], r.page, r.text, r.by_ocr) for r in files.read_pages(spark, str(tmp_path), pages, **more).collect()}

    plain = {("a.pdf", 0, "one page", False), ("a.pdf", 3, "two", False), ("b.md", None, "text", False)}
    assert rows() == plain
    assert rows(ocr=ocr) == plain | {("a.pdf", 1, "what the scanner saw on it", True)}
    assert rows(ocr=ocr, ocr_empty=True) == plain | {("a.pdf", 1, "what the scanner saw on it", True)}
    assert files.read_pages(spark, str(tmp_path / "none"), pages).count() == 0


def test_manifest_survives_damage(spark, tmp_path):
    path = str(tmp_path / "manifest")
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    files.write_manifest(rows, path)
    files.write_manifest(rows.where("path = 'b'"), path)
    assert [tuple(r) for r in files.read_manifest(spark, path).collect()] == [("b", "2")]
    for part in (tmp_path / "manifest").glob("part-*"):
        part.write_bytes(b"PAR1 not a table PAR1")
    assert files.read_manifest(spark, path).count() == 0
    old = str(tmp_path / "old")
    files.write_manifest(rows, old)
    assert files.read_manifest(spark, path, old).count() == 2
    files.write_manifest(rows.where("false"), path)
    assert files.read_manifest(spark, path).count() == 0


def test_rebuild_asks_the_staged_table(spark, tmp_path):
    path = str(tmp_path / "store")
    one = spark.createDataFrame([("a", "1")], "path string, sha256 string")
    files.rebuild(one, path, lambda t: t.where("path = 'a'").count() == 1)
    with pytest.raises(ValueError):
        files.rebuild(one.selectExpr("'b' AS path", "sha256"), path, lambda t: t.where("path = 'a'").count() == 1)
    assert spark.read.parquet(path).collect()[0].path == "a"


def test_runs_and_question_sets(spark, tmp_path):
    run = tmp_path / "run.json"
    run.write_text(json.dumps({"rows": [{"q": "1", "generation_success": True}, {"q": "2"}, {"q": "3", "status": "provider_error"}]}))
    spec = files.run_labels(f"case_set=s, arm=a,round=2,path={run}")
    got = files.read_run(spark, spec["path"], "q string, status string, generation_success boolean", spec["case_set"], spec["arm"], int(spec["round"]))
    assert {(r.q, r.status, r.case_set, r.arm, r["round"]) for r in got.collect()} == {("1", "completed", "s", "a", 2), ("2", "failed", "s", "a", 2), ("3", "provider_error", "s", "a", 2)}
    with pytest.raises(ValueError):
        files.run_labels("case_set=s,arm=a")
    asked = tmp_path / "q.json"
    asked.write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert files.read_questions(spark, str(asked), "id int", 2).count() == 2
    with pytest.raises(Exception, match="not 35"):
        files.read_questions(spark, str(asked), "id int", 35).collect()
    bom = tmp_path / "bom.json"
    bom.write_bytes(b"\xef\xbb\xbf" + b'{"id": 7}')
    assert [r.id for r in files.read_json_documents(spark, str(bom), "id int").collect()] == [7]


def test_small_writers(spark, tmp_path):
    stats = spark.createDataFrame([(3, 1.5)], "chunk_count int, mean_chars double")
    assert files.write_metadata(spark, stats, str(tmp_path / "meta.json")) == json.loads((tmp_path / "meta.json").read_text())
    path = files.save_state(spark, str(tmp_path), "a/../b c", {"n": 1})
    files.save_state(spark, str(tmp_path), "a/../b c", {"n": 2})
    assert path.endswith("/a____b_c.json") and json.loads((tmp_path / "a____b_c.json").read_text()) == {"state": {"n": 2}}
    files.write_cases(stats, str(tmp_path / "cases"))
    assert [json.loads(x) for p in (tmp_path / "cases").glob("part-*") for x in p.read_text().splitlines()] == [{"chunk_count": 3, "mean_chars": 1.5}]
    web = files.web_results(spark, [{"url": "u", "body": "b"}, {"url": "u"}, {"body": "b"}]).collect()
    assert [(r.source, r.source_type, r.evidence_status) for r in web] == [("u", "web", "indirect")]


def test_checkpoints_are_in_order(spark, tmp_path):
    import os

    for k, name in enumerate(["z", "y", "x"]):
        (tmp_path / f"{name}.json").write_text(json.dumps({"profile": name}))
        os.utime(tmp_path / f"{name}.json", (1_700_000_000 + 10 * k,) * 2)
    assert [r.profile for r in files.read_checkpoints(spark, str(tmp_path)).collect()] == ["z", "y", "x"]


def test_settings(tmp_path):
    from tessera.sources import config

    (tmp_path / ".env").write_text("# note\nCHUNK_SIZE='900'\nRETRIEVER_ENTITY_GUARD=off\nCHUNK_OVERLAP=10\n")
    s = config.load(tmp_path / ".env", {"CHUNK_OVERLAP": "20", "OTHER": "x"})
    assert (s.chunk_size, s.chunk_overlap, s.retriever_entity_guard, s.retriever_top_k) == (900, 20, False, 10)
    assert not s.problems()
    with pytest.raises(ValueError, match="CHUNK_SIZE"):
        config.load(tmp_path / "none", {"CHUNK_SIZE": "many"})
    assert len(config.load(tmp_path / "none", {"TOOL_TIMEOUT_SECONDS": "500", "CHUNK_OVERLAP": "-1"}).problems()) == 2


def test_tools(spark):
    from tessera.sources import config

    tools = config.Registry(disabled=("off",))
    tools.add(config.Tool("twice", lambda x: 2 * x, {"x": int}, "int"))
    tools.add(config.Tool("off", lambda: 1))
    assert tools.call("twice", x=3) == 6
    for name, given, error in (("off", {}, KeyError), ("none", {}, KeyError), ("twice", {"x": "3"}, TypeError), ("twice", {"x": 3, "y": 1}, TypeError)):
        with pytest.raises(error):
            tools.call(name, **given)
    tools.register_sql(spark, "twice")
    assert spark.sql("SELECT twice(4) AS y").collect()[0].y == 8


def test_rules(spark):
    docs = spark.createDataFrame(
        [(1, "tds\\PP_R TDS", None, None), (2, "GB/T 16252—2023", "", "# Scope: cups"), (3, "x", "304", "\n## Part \nScope: hot drinks only."), (4, None, None, None)], "id int, path string, title string, content string"
    )
    got = {r.id: r for r in rules.document_metadata(docs).collect()}
    assert (got[1].source_category, got[1].evidence_level, got[1].material_grade, got[1].source_role_confidence) == ("material_tds", "supplier_data", "PP R", 0.95)
    assert (got[2].source_category, got[2].population, got[2].section) == ("standard", "adults", "Scope: cups")
    assert (got[3].material_grade, got[3].section, got[3].applicability) == ("304", "Part", "hot drinks only")
    assert (got[4].source_category, got[4].population, got[4].material_grade, got[4].applicability) == ("unknown",) * 4
    asked = rules.question_profile(spark.createDataFrame([(1, "PC 选材"), (2, "儿童 adult 尺寸"), (3, "gb/t16252-2023?"), (4, None)], "q int, question string"))
    rows = asked.crossJoin(rules.document_metadata(docs)).withColumn("relevance", F.lit(None).cast("double"))
    told = {(r.q, r.id): r.evidence_status for r in rules.classify_evidence(rows).collect()}
    assert told[1, 1] == "scope_mismatch" and told[2, 2] == "scope_mismatch" and told[3, 2] == "direct" and told[3, 1] == "indirect" and told[4, 4] == "indirect"
