"""Property tests against small pure-Python models."""

import os
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crease.functions.semantics import round2
from crease.operators.changes import apply_changes
from crease.operators.keys import consecutive_ids, dedupe

# CREASE_EXAMPLES raises the example count for a deeper one-off run
SETTINGS = settings(max_examples=int(os.environ.get("CREASE_EXAMPLES", "12")), deadline=None,
                    suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.decimals(min_value=-10000, max_value=10000, places=6, allow_nan=False), min_size=1, max_size=40))
def test_round2_is_exact_half_up(spark, values):
    df = spark.createDataFrame([(str(v),) for v in values], "v string")
    got = [r.r for r in df.select(round2(F.col("v").cast("decimal(18,6)")).alias("r")).collect()]
    exp = [float(v.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)) for v in values]
    assert got == exp


@SETTINGS
@given(st.sets(st.text(alphabet="abcdefgh", min_size=1, max_size=5), min_size=1, max_size=60),
       st.integers(min_value=1, max_value=7), st.integers(min_value=0, max_value=100))
def test_consecutive_ids_model(spark, names, parts, start):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.id for r in consecutive_ids(df, ["name"], start=start, num_partitions=parts).collect()}
    assert got == {n: start + i for i, n in enumerate(sorted(names))}


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 50), st.text(alphabet="xyz", max_size=2)),
                min_size=1, max_size=60))
def test_dedupe_model(spark, rows):
    df = spark.createDataFrame(rows, "k int, o int, v string")
    got = {r.k: (r.o, r.v) for r in dedupe(df, ["k"], ["o", "v"]).collect()}
    exp = {}
    for k, o, v in rows:
        if k not in exp or (o, v) < exp[k]:
            exp[k] = (o, v)
    assert got == exp


def _model(base, changes):
    """One change after the other: the table, and the rejected inserts."""
    table, rejected = {k: dict(v) for k, v in base.items()}, []
    for op, _seq, key, name, country in sorted(changes, key=lambda c: c[1]):
        if op == "D":
            table.pop(key, None)
        elif op == "U" and key in table:
            if name is not None:
                table[key]["full_name"] = name
            if country is not None:
                table[key]["country"] = country
        elif op == "I" and key in table:
            rejected.append((key, "duplicate key"))
        elif op == "I" and key > 0 and (name or "").strip() and (country or "").strip():
            table[key] = {"full_name": name.strip(), "country": country.strip()}
        elif op == "I":
            rejected.append((key, "invalid row"))
    return table, sorted(rejected)


@SETTINGS
@given(st.dictionaries(st.integers(1, 12), st.tuples(st.sampled_from(["A", "B"]), st.sampled_from(["X", "Y"])),
                       max_size=8),
       st.lists(st.tuples(st.sampled_from(["I", "U", "D"]), st.integers(0, 10_000), st.sampled_from([-1, 1, 2, 2, 2, 13]),
                          st.one_of(st.none(), st.sampled_from([" N ", "M", "  "])),
                          st.one_of(st.none(), st.sampled_from(["Z", " W", ""]))),
                min_size=1, max_size=24, unique_by=lambda c: c[1]))
def test_apply_changes_model(spark, base_rows, changes):
    base = {k: {"full_name": n, "country": c} for k, (n, c) in base_rows.items()}
    b = spark.createDataFrame([(k, v["full_name"], v["country"]) for k, v in base.items()],
                              "player_id bigint, full_name string, country string")
    ch = spark.createDataFrame(changes, "op string, seq bigint, player_id bigint, full_name string, country string")
    out, rejected = apply_changes(b, ch, ["player_id"])
    got = {r.player_id: {"full_name": r.full_name, "country": r.country} for r in out.collect()}
    assert (got, sorted((r.player_id, r.reason) for r in rejected.collect())) == _model(base, changes)


_num = st.integers(0, 250).map(str)
_rate = st.decimals(min_value=0, max_value=1500, places=2, allow_nan=False).map(lambda d: f"{d:,}")
_batter = st.fixed_dictionaries({"id": st.integers(1, 99).map(str)},
                                optional={"runs": _num, "balls": _num, "strkrate": _rate,
                                          "outdec": st.sampled_from(["", "  ", "b X", "not out"])})
_bowler = st.fixed_dictionaries({"id": st.integers(1, 99).map(str)},
                                optional={"overs": st.decimals(min_value=0, max_value=50, places=2).map(str),
                                          "runs": _num, "wickets": st.integers(0, 10).map(str),
                                          "econ": st.decimals(min_value=0, max_value=36, places=2).map(str)})
_innings = st.fixed_dictionaries({}, optional={"batsman": st.lists(_batter, max_size=6),
                                               "bowler": st.lists(_bowler, max_size=4)})


def _source_batting(doc):
    """The source's batting loop, line by line in Python."""
    out = []
    for innings in doc["scorecard"]:
        for position, b in enumerate(innings.get("batsman", []), start=1):
            out.append((int(b["id"]), int(b.get("runs", 0)), int(b.get("balls", 0)),
                        float(b.get("strkrate", "0").replace(",", "")), position,
                        b.get("outdec", "").strip() != ""))
    return sorted(out)


def _source_bowling(doc):
    """The source's bowling loop; DECIMAL columns keep the text's value rounded half up."""
    q = lambda s, e: Decimal(str(float(s.replace(",", "")))).quantize(Decimal(e), rounding=ROUND_HALF_UP)
    out = []
    for innings in doc["scorecard"]:
        for b in innings.get("bowler", []):
            out.append((int(b["id"]), q(b.get("overs", "0"), "0.1"), int(b.get("runs", 0)),
                        int(b.get("wickets", 0)), q(b.get("econ", "0"), "0.01")))
    return sorted(out)


@SETTINGS
@given(st.lists(_innings, min_size=1, max_size=3))
def test_scorecard_extractors_follow_the_source_loops(spark, innings):
    import json

    from crease.operators import ingest as I
    from crease.sources.documents import parse_documents
    from crease.sources.schemas import doc_schema
    doc = {"matchId": "77", "scorecard": innings}
    good, _ = parse_documents(spark.createDataFrame([(json.dumps(doc),)], "value string"), "value",
                              doc_schema("scorecard"))
    bat = sorted((r.player_id, r.runs_scored, r.balls_faced, r.strike_rate, r.batting_position, r.is_out)
                 for r in I.extract_batting(good).collect())
    assert bat == _source_batting(doc)
    bowl = sorted((r.player_id, r.overs_bowled, r.runs_conceded, r.wickets_taken, r.economy_rate)
                  for r in I.extract_bowling(good).collect())
    assert bowl == _source_bowling(doc)
