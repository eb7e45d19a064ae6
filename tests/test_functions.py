from pyspark.sql import functions as F

from tessera.functions import stats, text
from tessera.operators import corpus, evaluation, retrieval


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("x")).collect()[0].x


def test_terms_keep_order_runs_and_bigrams(spark):
    assert one(spark, text.lexical_terms(F.lit("PP-304 a 高强度材料 pp-304 X2"))) == ["pp-304", "x2", "高强度材料", "高强", "强度", "度材", "材料"]


def test_garbled(spark):
    rows = spark.createDataFrame([("这是一段很正常的中文文本,没有问题,长度也足够了。",), ("Plain English prose of enough length here.",), ("",), ("1",), ("# $ % ^ & * ( ) 1 2 3 4 5 6 7 8 9",)], "t string")
    assert [r.g for r in rows.select(text.looks_garbled("t").alias("g")).collect()] == [False, False, False, False, True]


def test_error_classes(spark):
    rows = spark.createDataFrame([("Request timed out",), ("HTTP 429",), ("boom",), ("Deadline exceeded",), ("已超时",), ("限流",), (None,), ("",)], "m string")
    assert [r.c for r in rows.select(text.error_class(F.col("m")).alias("c")).collect()] == ["provider_timeout", "provider_rate_limit", "provider_error", "provider_timeout", "provider_timeout", "provider_rate_limit", None, None]


def test_percentile_conventions(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)] + [("a", None), ("b", 7.0), (None, 5.0)], "g string, v double")
    got = {r.g: r for r in stats.values_at(rows, ["g"], "v", {"near": ("nearest", 0.5), "floor": ("floored", 0.5), "low": ("lower_median", 0.5), "cut": ("cut", 0.95)}).collect()}
    # four values: places 1.5 to even = 2, 1, 1 and 3 - 1 = 2
    assert (got["a"].near, got["a"].floor, got["a"].low, got["a"].cut) == (3.0, 2.0, 2.0, 3.0)
    assert (got["b"].near, got["b"].cut, got[None].near) == (7.0, 7.0, 5.0)
    assert stats.values_at(rows.where("false"), ["g"], "v", {"x": ("nearest", 0.5)}).count() == 0


def test_percentiles_of_large_groups(spark, monkeypatch):
    """Only what lies near a place is told apart; ties and both ends included."""
    monkeypatch.setattr(stats, "WHOLE", 1_000)
    rows = spark.range(40_000).selectExpr("id % 2 AS g", "CAST(id * 7919 % 40009 AS DOUBLE) AS v").union(spark.range(9_000).selectExpr("0L", "20000.0D"))
    picks = {f"{k}{i}": (k, p) for k in stats.PLACES for i, p in enumerate((0.0, 0.5, 0.95, 1.0))}
    values = {g: sorted(r.v for r in rows.where(f"g = {g}").collect()) for g in (0, 1)}
    place = {"nearest": lambda n, p: round(p * (n - 1)), "floored": lambda n, p: int(p * (n - 1)), "cut": lambda n, p: max(0, int(p * n) - 1), "lower_median": lambda n, p: (n - 1) // 2}
    for r in stats.values_at(rows, ["g"], "v", picks).collect():
        v = values[r.g]
        assert {k: r[k] for k in picks} == {k: v[place[kind](len(v), p)] for k, (kind, p) in picks.items()}


def test_signed_rank_ties(spark):
    # ranks 2, 2, 2: the smaller sum is 2; of the ranks 1, 2, 3 three of eight sign patterns reach at most 2
    r = stats.wilcoxon(spark.createDataFrame([("g", d) for d in (1.0, 1.0, -1.0)], "g string, d double"), "g", "d").collect()[0]
    assert (r.n, r.statistic, r.p_value, r.significant) == (3, 2.0, 0.75, False)


def test_matchers(spark):
    rows = [("a b.pdf", "x\\AB.pdf"), ("", "x"), ("dir/", "my/dir"), ("n_1 (2).md", "q/N12.MD"), ("p/q.md", "z/q.md")]
    d = spark.createDataFrame(rows, "e string, a string")
    kinds = ("basename", "basename_or_contains", "bidirectional", "stripped", "substring")
    got = [tuple(r) for r in d.select(*[retrieval.matches(k, F.col("e"), F.col("a")).alias(k) for k in kinds]).collect()]
    assert got[0] == (False, True, False, True, False)
    assert got[1] == (False, True, False, True, True)
    assert got[2] == (False, False, True, True, False)
    assert got[3] == (False, False, False, True, False)
    assert got[4] == (True, True, True, True, False)


def test_gates_by_scope_and_band(spark):
    groups = spark.createDataFrame([("q", "m", 0.05, "higher_is_better", True), ("u", "m", 0.05, "higher_is_better", False), ("d", "lat", 1.0, "lower_is_better", True), ("n", "lat", 1.0, "lower_is_better", False), ("e", "none", 0.0, "higher_is_better", True), ("x", "gone", 0.0, "higher_is_better", True)], "group_name string, metric string, allowed_change double, direction string, declared boolean")
    deltas = spark.createDataFrame([("m", 0.17), ("lat", -9.0), ("none", None)], "metric string, delta double")
    got = {r.group_name: (r.verdict, r.reason, r.group_passed) for r in evaluation.gates(deltas, groups).collect()}
    assert got == {"q": ("breach", "beyond_tolerance", False), "u": ("breach", "out_of_scope", False), "d": ("ok", None, True), "n": ("breach", "out_of_scope", False), "e": ("no_baseline", None, True), "x": ("not_evaluated", None, True)}


def test_unit_statistics_by_hand(spark):
    rows = [("s", 1, 0, "a", 0.0), ("s", 1, 0, "b", 1.0), ("s", 1, 1, "a", 0.0), ("s", 1, 1, "b", 0.0), ("s", 2, 0, "a", 0.5), ("s", 2, 0, "b", 0.5), ("t", 1, 0, "a", 1.0), ("t", 1, 0, "b", 0.0), ("t", 2, 0, "a", 1.0)]
    d = spark.createDataFrame([(*r, "completed", i) for i, r in enumerate(rows)], "case_set string, question_id int, round int, arm string, metric double, status string, seq int")
    r = evaluation.unit_statistics(evaluation.paired(d, ("a", "b"))).collect()[0]
    # units: s/1 mean 0.5, s/2 0, t/1 -1: mean -1/6, deviation 0.7638, error 0.441
    assert (r.units, r["mean"], r.sd, r.se, r.mde) == (3, -0.167, 0.7638, 0.441, 0.8643)
    assert (r.pairs, r.dropped, r.wins, r.losses, r.ties, r.mean_by_pair) == (4, 1, 1, 1, 2, 0.0)
    one_unit = evaluation.unit_statistics(evaluation.paired(d.where("case_set = 't'"), ("a", "b"))).collect()[0]
    assert (one_unit.units, one_unit.sd, one_unit.mde) == (1, None, None)


def test_provider_gate_by_paired_cells(spark):
    rows = [("s", q, 0, arm, "completed" if q > 4 or arm == "a" else "failed", 1.0, q) for q in range(10) for arm in "ab"]
    d = spark.createDataFrame(rows, "case_set string, question_id int, round int, arm string, status string, metric double, seq int")
    r = evaluation.provider_gate(d, evaluation.paired(d, ("a", "b"))).collect()[0]
    assert (r.error, r.share, r.failed, r.passed) == (0.0, 0.5, "paired_cell_share", False)


def test_null_slices_have_their_dimension(spark):
    d = spark.createDataFrame([(1, None, "low", 1.0), (2, "fact", None, 0.0)], "question_id int, case_type string, risk_level string, metric double")
    got = {(r.dimension, r.group): r["mean"] for r in evaluation.slice_metrics(d, ["case_type", "risk_level"], ["metric"]).collect()}
    assert got == {("case_type", None): 1.0, ("case_type", "fact"): 0.0, ("risk_level", "low"): 1.0, ("risk_level", None): 0.0}


def test_wilcoxon_exact(spark):
    pairs = spark.createDataFrame([("g", d) for d in (1.0, 2.0, 3.0, 4.0, -5.0, 0.0)], "g string, d double")
    r = stats.wilcoxon(pairs, "g", "d").collect()[0]
    assert (r.n, r.statistic, r.p_value) == (5, 5.0, 20 / 32)


def test_mcnemar(spark):
    pairs = spark.createDataFrame([("g", True, False)] * 1 + [("g", False, True)] * 5 + [("g", True, True)], "g string, x boolean, y boolean")
    r = stats.mcnemar(pairs, "g", "x", "y").collect()[0]
    assert (r.b, r.c, r.p_value, r.method) == (1, 5, 0.2188, "exact")


def test_single_source_is_not_capped(spark):
    rows = spark.createDataFrame([(1, i, "s", i) for i in range(1, 5)] + [(2, i, "s" if i < 4 else "t", i) for i in range(1, 5)], "question_id int, doc_id int, source string, rank int")
    got = {(r.question_id, r.doc_id): r.disposition for r in retrieval.diversify(rows, 2, 3).collect()}
    assert [got[1, i] for i in range(1, 5)] == ["selected"] * 3 + ["outside_final_top_k"]
    assert [got[2, i] for i in range(1, 5)] == ["selected", "selected", "source_cap_filtered", "selected"]


def test_conflicts_and_coverage(spark):
    docs = spark.createDataFrame([(1, 1, "a", ["load", "max"], "load 5"), (1, 2, "b", ["load"], "load 7"), (1, 3, "b", ["load"], "load 5")], "group_id int, doc_id int, source string, words array<string>, text string")
    assert [(r.doc_a, r.doc_b, r.shared) for r in corpus.source_conflicts(docs).collect()] == [(1, 2, ["load"])]
    need = spark.createDataFrame([(1, "r1", ["load", "max"]), (1, "r2", ["max", "zzz"]), (1, "r3", ["none"])], "question_id int, requirement_id string, tokens array<string>")
    have = docs.selectExpr("group_id AS question_id", "doc_id", "words AS tokens")
    assert {r.requirement_id: r.status for r in corpus.requirement_coverage(need, have).collect()} == {"r1": "covered", "r2": "partial", "r3": "missing"}


def test_flaky_ignores_missing_verdicts(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (1, None), (2, True)], "question_id int, v boolean")
    assert [(r.question_id, r.flips, r.pairs) for r in evaluation.flaky(rows, "v").collect()] == [(1, 1, 1)]
