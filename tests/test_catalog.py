"""Every registered core query runs on the smallest tables and equals its SQL there."""

import math

import duckdb
import pytest

from tessera.functions import stats
from tessera.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return str(v)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    rel = sql.sql(catalog.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def exact_p(diffs):
    """(n, statistic, two-sided p) over all signs of the ranks; ranks are doubled, so that ties at mean rank stay whole."""
    d = [x for x in diffs if x]
    twice = [2 * sum(abs(y) < abs(x) for y in d) + sum(abs(y) == abs(x) for y in d) + 1 for x in d]
    low = min(sum(r for r, x in zip(twice, d) if x > 0), sum(r for r, x in zip(twice, d) if x < 0))
    ways = {0: 1}
    for r in twice:
        longer = dict(ways)
        for k, w in ways.items():
            longer[k + r] = longer.get(k + r, 0) + w
        ways = longer
    return len(d), low / 2, min(1.0, 2 * sum(w for k, w in ways.items() if k <= low) / 2 ** len(d))


def test_signed_rank_tests_every_question(spark):
    """The query ranks what its companion ranks, and p is near the exact one where a round has over 20 differences."""
    path = "/root/testdata/sf0.01"
    diffs = {}
    for r in catalog.queries()["eval_paired_cells"](spark, path).where("diff IS NOT NULL").collect():
        diffs.setdefault(r["round"], []).append(r["diff"])
    ranks = {r["round"]: (r["n"], r["statistic"]) for r in catalog.queries()["eval_signed_ranks"](spark, path).collect()}
    got = {r["round"]: r for r in catalog.queries()["eval_wilcoxon"](spark, path).collect()}
    assert {k: (r["n"], r["statistic"]) for k, r in got.items()} == ranks
    for k, r in got.items():
        n, statistic, p = exact_p(diffs[k])
        assert (r["n"], r["statistic"]) == (n, statistic) and abs(r["p_value"] - p) < 0.03


def test_signed_rank_above_twenty_differences(spark):
    diffs = [(-1) ** (k % 4 == 0) * (k + 1) / 8 for k in range(24)]
    got = stats.wilcoxon(spark.createDataFrame([(0, x) for x in diffs], "round int, diff double"), "round", "diff").collect()[0]
    n, statistic, p = exact_p(diffs)
    assert (got["n"], got["statistic"]) == (n, statistic) == (24, statistic) and abs(got["p_value"] - p) < 0.01
