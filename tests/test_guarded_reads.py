"""Readers that fail by themselves in the pass that uses their rows."""

import json

import pytest

from tessera.sources import files

GOOD = [{"question_id": f"q{i}", "case_type": "fact", "risk_level": "low", "slice_tags": ["t"], "flaky": False} for i in range(3)]


def put(tmp_path, rows, name="s.json"):
    (tmp_path / name).write_text(json.dumps(rows))
    return str(tmp_path / name)


def kinds():
    from tessera.operators import contracts

    return next(iter(contracts.CASE_TYPES)), next(iter(contracts.RISK_LEVELS))


@pytest.fixture
def good():
    case, risk = kinds()
    return [r | {"case_type": case, "risk_level": risk} for r in GOOD]


def test_good_slices_in_one_scan(spark, tmp_path, good):
    df = files.read_slices(spark, put(tmp_path, good))
    assert sorted(r.question_id for r in df.collect()) == ["q0", "q1", "q2"] and "twice" not in df.columns
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


@pytest.mark.parametrize("change", [{"question_id": None}, {"question_id": "q1"}, {"case_type": "odd"}, {"case_type": None}, {"risk_level": "odd"}, {"slice_tags": []}, {"flaky": None}])
def test_bad_slices_fail(spark, tmp_path, good, change):
    df = files.read_slices(spark, put(tmp_path, [*good[:2], good[2] | change]))
    for use in (lambda: df.collect(), lambda: df.select("slice_tags").collect(), lambda: df.write.parquet(str(tmp_path / "out"))):
        with pytest.raises(Exception, match="slice "):
            use()


def test_sizes(spark, tmp_path):
    path = put(tmp_path, [{"question": "a"}, {"question": "b"}])
    assert files.read_questions(spark, path, "question string", 2).count() == 2
    assert files.read_questions(spark, path, "question string").count() == 2
    with pytest.raises(Exception, match="has 2 rows, not 3"):
        files.read_questions(spark, path, "question string", 3).collect()
    none = put(tmp_path, [], "none.json")
    with pytest.raises(Exception, match="has 0 rows, not any"):
        files.read_questions(spark, none, "question string").collect()


def test_staged_writes_are_counted_while_written(spark, tmp_path):
    path = str(tmp_path / "t")
    scans = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame(spark.sparkContext.parallelize(range(10), 2).map(lambda x: (scans.add(1), (x,))[1]), "x int")
    assert files.rebuild(rows, path) == 10 and scans.value == 10
    with pytest.raises(ValueError):
        files.rebuild(rows.where("false"), path)
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
