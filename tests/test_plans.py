"""Plan shapes and properties of the analytic queries."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from crease.plans import analytics as A
from crease.plans.registry import FIXTURE_PARAMS
from crease.sources.fixtures import fixture_tables


@pytest.fixture(scope="module")
def tables(spark):
    return fixture_tables(spark, SF_SMALL)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_or_join_is_an_equi_join(tables):
    p = plan(A.q15_close_matches(tables))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_last_n_uses_window_group_limit(tables):
    df = A.q23_recent_form(tables)
    assert "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()


def test_year_filter_reaches_scan(spark, tmpdir_path):
    from crease.sources.tables import load_tables, write_tables
    write_tables(fixture_tables(spark, SF_SMALL), tmpdir_path, ["series"])
    p = plan(A.q08_series_in_year(load_tables(spark, tmpdir_path, ["series"])))
    assert "PushedFilters: [IsNotNull(start_date), GreaterThanOrEqual(start_date" in p


def test_q15_dedupe_never_counts_more(tables):
    a = {r.full_name: r.close_matches_played for r in A.q15_close_matches(tables).collect()}
    b = {r.full_name: r.close_matches_played for r in A.q15_close_matches(tables, dedupe=True).collect()}
    assert set(a) == set(b) and all(b[k] <= a[k] for k in a)


def test_q5_total_is_completed_matches_with_winner(tables):
    total = sum(r.total_wins for r in A.q05_team_wins(tables).collect())
    m = tables["matches"]
    assert total == m.where("match_status = 'Completed' AND winning_team IS NOT NULL").count()


def test_q21_preaggregate_option(tables):
    full = {(r.player_id, r.format): r for r in A.q21_performance_ranking(tables).collect()}
    pre = {(r.player_id, r.format): r for r in A.q21_performance_ranking(tables, preaggregate=True).collect()}
    assert set(full) == set(pre)
    assert all(pre[k].fielding_points is None or pre[k].fielding_points <= full[k].fielding_points for k in full)


def test_q25_first_quarter_is_stable(tables):
    rows = A.q25_quarterly_trend(tables).where("prev_avg_sr IS NULL").collect()
    assert rows and {r.trend for r in rows} == {"Stable"}


def test_case_insensitive_option(tables):
    a = A.q01_players_by_country(tables, country="nation_7", case_insensitive=True).count()
    b = A.q01_players_by_country(tables, **FIXTURE_PARAMS["q01_players_by_country"]).count()
    assert a == b > 0


def test_bucketed_fact_join_needs_no_exchange(spark, tmpdir_path):
    """Q14's bowling ⨝ matches join on co-bucketed tables reads buckets directly."""
    from crease.sources.tables import write_bucketed_tables
    src = fixture_tables(spark, SF_SMALL)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = write_bucketed_tables(spark, src, tmpdir_path, 4,
                                  ["matches", "bowling_stats", "players", "venues"], prefix="bkt_")
        df = A.q14_bowling_by_venue(t)
        p = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in p
        assert "hashpartitioning(match_id" not in p
        assert df.count() == A.q14_bowling_by_venue(src).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_runner_writes_a_named_question(spark, tmpdir_path):
    from crease import run
    from crease.sources.tables import write_tables
    write_tables(fixture_tables(spark, SF_SMALL), tmpdir_path, ["player_recent_form", "players"])
    out = f"{tmpdir_path}/out"
    assert run.main(["--tables", tmpdir_path, "--query", "q16_yearly_batting", "--out", out,
                     "--param", "since=1996-01-01", "--param", "min_matches=5"]) == 0
    assert spark.read.parquet(out).count() == A.q16_yearly_batting(fixture_tables(spark, SF_SMALL),
                                                                   since="1996-01-01").count()
    assert "q23_recent_form(short=5" in run.describe()


def test_every_question_same_on_bucketed_layout(spark, tmpdir_path):
    from crease.plans.registry import normalize_types
    from crease.sources.tables import write_bucketed_tables
    src = fixture_tables(spark, SF_SMALL)
    bucketed = write_bucketed_tables(spark, src, tmpdir_path, 4, prefix="all_")
    for name, fn in A.ALL_QUERIES.items():
        params = FIXTURE_PARAMS.get(name, {})
        a = sorted(map(tuple, normalize_types(fn(src, **params)).collect()), key=repr)
        b = sorted(map(tuple, normalize_types(fn(bucketed, **params)).collect()), key=repr)
        assert a == b, name


def test_questions_same_without_broadcast(spark, tables):
    """The sort-merge plans that large tables get return the same rows."""
    from crease.plans.registry import normalize_types

    def run_all():
        return {n: sorted(map(tuple, normalize_types(fn(tables, **FIXTURE_PARAMS.get(n, {}))).collect()), key=repr)
                for n, fn in A.ALL_QUERIES.items()}

    with_bc = run_all()
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        without = run_all()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert with_bc == without


def test_partitioned_layout_prunes_and_matches(spark, tmpdir_path):
    from crease.plans.registry import normalize_types
    from crease.sources.tables import PARTITIONING, load_tables, write_partitioned_tables
    src = fixture_tables(spark, SF_SMALL)
    names = list(PARTITIONING) + ["players", "teams", "venues", "fielding_stats"]
    write_partitioned_tables(src, tmpdir_path, names)
    part = load_tables(spark, tmpdir_path, names)
    assert dict(part["matches"].dtypes)["match_date"] == "date"
    q2 = A.q02_recent_matches(part, as_of="2001-08-01")
    assert "PartitionFilters: [isnotnull(match_date" in q2._jdf.queryExecution().executedPlan().toString()
    q18 = A.q18_economical_bowlers(part)
    assert "PartitionFilters: [format" in q18._jdf.queryExecution().executedPlan().toString() or \
        "PartitionFilters: [isnotnull(format" in q18._jdf.queryExecution().executedPlan().toString()
    for name in ("q02_recent_matches", "q03_top_run_scorers", "q16_yearly_batting", "q18_economical_bowlers",
                 "q19_consistent_batsmen", "q20a_format_counts", "q21_performance_ranking", "q22a_head_to_head",
                 "q23_recent_form", "k2_date_range"):
        fn, params = A.ALL_QUERIES[name], FIXTURE_PARAMS.get(name, {})
        a = sorted(map(tuple, normalize_types(fn(src, **params)).collect()), key=repr)
        b = sorted(map(tuple, normalize_types(fn(part, **params)).collect()), key=repr)
        assert a == b, name


def test_curve_clustering_skips_files_for_both_ranges(spark, tmpdir_path):
    """Files and rows left by the footers' ranges for a date filter (Q16, Q19) and for a player filter."""
    import glob

    import pyarrow.parquet as pq

    from crease.sources.tables import CLUSTERING, write_clustered
    prf = fixture_tables(spark, SF_SMALL)["player_recent_form"]
    prf = prf.unionByName(prf).unionByName(prf).coalesce(2)
    cols = CLUSTERING["player_recent_form"]
    paths = {n: f"{tmpdir_path}/{n}" for n in ("plain", "clustered")}
    prf.repartition(32).write.parquet(paths["plain"])
    write_clustered(prf, paths["clustered"], cols, files=32)
    since = sorted(r.match_date for r in prf.select("match_date").collect())[int(0.8 * prf.count())]
    players = (20, 30)

    def groups_met(path):
        dates = ids = 0
        for f in glob.glob(f"{path}/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            names = [meta.schema.column(k).name for k in range(meta.num_columns)]
            for g in range(meta.num_row_groups):
                stats = {n: meta.row_group(g).column(names.index(n)).statistics for n in cols}
                dates += stats["match_date"].max >= since
                ids += stats["player_id"].min <= players[1] and stats["player_id"].max >= players[0]
        return dates, ids

    plain, clustered = groups_met(paths["plain"]), groups_met(paths["clustered"])
    assert clustered[0] < 0.6 * plain[0] and clustered[1] < 0.5 * plain[1]
    both = [spark.read.parquet(p) for p in paths.values()]
    for some in (F.col("match_date") >= since, F.col("player_id").between(*players)):
        a, b = (sorted(x.where(some).select("player_id", "match_id", "match_date").collect()) for x in both)
        assert a == b
    read = both[1].where(F.col("match_date") >= since).select(F.input_file_name()).distinct().count()
    assert read < 32
