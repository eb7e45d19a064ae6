"""Guards and reserved seats against plain lists, small exact cases of plans, and reports."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import entities, guards, planning, retrieval, rounds, summaries

SCHEMA = "question_id long, doc_id long, source string, rank int, bm25_rank int, model_rank int, combined double, guardable array<string>, guards array<struct<canonical_id:string,priority:int,lane_rank:int>>"


def make(seed):
    rng = random.Random(seed)
    rows = []
    for q in range(80):
        n, share = rng.choice([3, 18, 25, 40]), rng.choice([0.02, 0.05, 0.12])
        plan = rng.sample("abcd", rng.randrange(4))
        for k in range(n):
            stands = [(e, rng.choice([-1, 60, 90, 100]), rng.choice([None, 1, 2, 3])) for e in plan if rng.random() < share]
            rows.append((q, 100 * q + k, f"s{rng.randrange(9)}", k + 1, rng.choice([None, rng.randrange(1, 30)]), rng.choice([None, rng.randrange(1, 30)]), round(1 - k / 100, 3), plan, stands))
    return rows


def able(row):
    return {e: (p, r) for e, p, r in row[8] if p >= 0 and r is not None}


def brute_guard(rows):
    """Each planned entity that nobody of the first twenty stands for moves its best candidate to place 15, 16, ..."""
    order, by = list(rows), {}
    if len(order) > 20:
        for entity in order[0][7]:
            if entity in by.values() or [r for r in order[:20] if entity in able(r)]:
                continue
            fits = [r for r in order[20:] if entity in able(r) and r[1] not in by]
            fits.sort(key=lambda r: (-able(r)[entity][0], able(r)[entity][1], r[4] or 10**9, r[5] or 10**9, r[1]))
            if fits:
                order.remove(fits[0])
                order.insert(min(14 + len(by), 19), fits[0])
                by[fits[0][1]] = entity
    return [(r, by.get(r[1])) for r in order]


def brute_reserve(ordered, cap=2, top=10):
    pool = ordered[:20]
    many = len({r[2] for r, _ in pool}) > 1
    chosen, fate = [], {}
    for i, (r, _) in enumerate(ordered):
        same = sum(c[2] == r[2] for c in chosen)
        if i >= 20:
            fate[r[1]] = "outside_rerank_top20"
        elif len(chosen) >= top:
            fate[r[1]] = "outside_final_top10"
        elif many and same >= cap:
            fate[r[1]] = "source_cap_filtered"
        else:
            fate[r[1]] = "selected"
            chosen.append(r)
    held = {r[1] for r, g in pool if g}
    reserved = {}
    if len(chosen) >= top:
        seen = {e for r in chosen for e in able(r)}
        for r, _ in pool:
            new = sorted(set(able(r)) - seen)
            if fate[r[1]] == "selected" or not new:
                continue
            weak = [c for c in chosen if sum(x[2] == c[2] for x in chosen) > 1 and c[1] not in held]
            if not weak:
                continue
            out = min(weak, key=lambda c: c[6])
            after = [r if c is out else c for c in chosen]
            if many and sum(c[2] == r[2] for c in after) > cap:
                continue
            chosen = after
            seen.add(new[0])
            reserved[r[1]] = new[0]
            held.add(r[1])
            fate[r[1]], fate[out[1]] = "selected", "outside_final_top10"
        chosen.sort(key=lambda c: -c[6])
    place = {c[1]: k + 1 for k, c in enumerate(chosen)}
    return {r[1]: (fate[r[1]], place.get(r[1]), reserved.get(r[1])) for r, _ in ordered}


@pytest.mark.parametrize("seed", [1, 2])
def test_guard_and_reserve(spark, seed):
    rows = make(seed)
    got = guards.reserve(guards.guard(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    moved = kept = 0
    for q in {r[0] for r in rows}:
        ordered = brute_guard([r for r in rows if r[0] == q])
        want = brute_reserve(ordered)
        mine = {r.doc_id: r for r in got if r.question_id == q}
        assert [d for d, _ in sorted(((d, r.combined_rank) for d, r in mine.items()), key=lambda x: x[1])] == [r[1] for r, _ in ordered]
        assert {d: r.guarded for d, r in mine.items()} == {r[1]: g for r, g in ordered}
        assert {d: (r.disposition, r.final_rank, r.reserved) for d, r in mine.items()} == want
        moved += sum(g is not None for _, g in ordered)
        kept += sum(w[2] is not None for w in want.values())
    assert moved and kept


def test_registered_guards_agree_with_lists(spark):
    from tessera.plans import catalog, ranking

    d = "/root/testdata/sf0.01"
    rows = ranking.guarded(spark, d).collect()
    final = {(r.question_id, r.doc_id): r for r in catalog.queries()["rank_guarded"](spark, d).collect()}
    for q in {r.question_id for r in rows}:
        mine = sorted((r for r in rows if r.question_id == q), key=lambda r: r["rank"])
        plain = [(r.question_id, r.doc_id, r.source, r["rank"], r.bm25_rank, r.model_rank, r.combined, r.guardable, [tuple(g) for g in r.guards]) for r in mine]
        ordered = brute_guard(plain)
        assert [r.doc_id for r in sorted(mine, key=lambda r: r.combined_rank)] == [r[1] for r, _ in ordered]
        want = brute_reserve(ordered)
        assert {i: (final[q, i].disposition, final[q, i].final_rank, final[q, i].reserved) for i in want} == want


def one(spark, c):
    return spark.range(1).select(c.alias("x")).collect()[0].x


def test_canonical_ids(spark):
    names = {"GB/T 26158-2010": "gb_26158_2010", "26158-2010-gbt": "gb_26158_2010", "GB 4806.7": "gb_4806_7_2023", "PP 3486-01": "pp_3486_01", "TX1001": "tritan_tx1001", "tritan tx1001": None, "GB/T 3326-2016": "gb_3326_2016", "pc": None}
    for name, want in names.items():
        assert one(spark, entities.canonical_id(F.lit(name))) == want
    assert one(spark, entities.canonical_ids(F.lit("see gb_t 10000-2023, 26158-2010-GBT and gb4806.7; tx-1001"))) == ["gb_10000_2023", "gb_26158_2010", "gb_4806_7_2023", "tritan_tx1001"]


def test_lanes_keep_ids_once_and_stop_at_the_limit(spark):
    got = one(spark, entities.lanes(F.lit("儿童手部尺寸 GB/T 26158-2010，比较 PP 与 Tritan 水杯材料")))
    assert [x.rule_id for x in got] == [None, "explicit_identifier", "cup_food_contact_compliance", "material_comparison_pp_tds"]
    assert one(spark, entities.lanes(F.lit("  "))) == []


def test_plans_by_hand(spark):
    q = F.lit("比较 PP、Tritan 和 PC，从成本与强度方面评价")
    assert one(spark, planning.intent(q)) == "comparison"
    assert one(spark, planning.candidates(q)) == ["Tritan", "PC", "从成本", "强度方面评价"]
    long = one(spark, planning.tasks(F.lit("推荐材料，按照强度评价，参考 ISO 8124")))
    assert len(long) == 8 and [t.operation for t in long[-2:]] == ["analyze", "recommend"]
    assert one(spark, planning.tasks(F.lit("计算 70 的容量"))) == []
    assert one(spark, planning.expansions(F.lit("PP"))) == ["PP", "PP LyondellBasell 3486-01 TDS Tritan TX1001 TDS 食品接触 GB 4806.7", "LyondellBasell PP 3486-01 Technical Data Sheet"]


def test_span_metrics_by_hand(spark):
    spans = spark.createDataFrame([(1, 1, "Alpha beta"), (1, 2, "gamma"), (2, 1, "none")], "question_id int, n int, span string")
    docs = spark.createDataFrame([(1, 1, "x"), (1, 2, "GAMMA."), (1, 7, "alpha, beta"), (2, 1, "y")], "question_id int, rank int, text string")
    got = {r.question_id: r for r in rounds.span_metrics(spans, docs).collect()}
    # the first span in contract order stands at 7: its reciprocal is taken, though the second stands at 2
    assert (got[1].recall_at_5, got[1].recall_at_10, got[1].mrr) == (0.5, 1.0, 0.143)
    assert got[1].ndcg_at_10 == round((2**-0.5 + 7**-0.5) / (1 + 2**-0.5), 3)
    assert (got[2].mrr, got[2].ndcg_at_10) == (0.0, 0.0)


def test_blend_modes_and_priors(spark):
    rows = [(1, 1, 0.9, 0, 0, 0.1, False, 0.0), (1, 2, 0.1, 1, 1, 0.2, False, 0.025), (1, 3, 0.9, 1, 0, 0.2, True, 0.0)]
    d = spark.createDataFrame(rows, "question_id int, doc_id int, rerank_score double, explicit int, weak int, rrf_score double, low_authority boolean, prior double")
    full = {r.doc_id: round(r.combined, 6) for r in retrieval.blend(d).collect()}
    assert full == {1: 0.82, 2: 0.205, 3: 0.819}
    assert {r.doc_id: round(r.combined, 6) for r in retrieval.blend(d, "reranker_only").collect()} == {1: 1.0, 2: 0.025, 3: 0.88}
    no_scores = d.withColumn("rerank_score", F.lit(None).cast("double"))
    assert {r.doc_id: round(r.base, 6) for r in retrieval.blend(no_scores, "reranker_only").collect()} == {1: 0.0, 2: 1.0, 3: 1.0}
    with pytest.raises(ValueError):
        retrieval.blend(d, "other")


def test_report(spark):
    d = spark.createDataFrame([(1, None), (2, "a|b\nc")], "n int, s string")
    assert summaries.report("T", {"One": d}) == "# T\n\n## One\n\n| n | s |\n|---|---|\n| 1 | — |\n| 2 | a\\|b c |\n"
    assert summaries.report("T", {"One": d}, rows=1).endswith("2 rows in all.\n")


def test_embeddings_are_unit_vectors(spark):
    from tessera.operators import replays

    d = spark.createDataFrame([(1, "alpha beta"), (2, "alpha  BETA"), (3, ""), (4, None)], "n int, t string")
    got = {r.n: r.v for r in d.select("n", replays.hashed_embedding("t").alias("v")).collect()}
    assert all(len(v) == replays.VECTOR_SIZE for v in got.values())
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[1] == got[2] and not any(got[3] + got[4])
