"""bench.py prints exactly one JSON line with every question timed."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL

from crease.plans.analytics import ALL_QUERIES


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_OPERATOR_SECONDS="5")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600, check=True).stdout.strip().splitlines()
    assert len(out) == 1
    result = json.loads(out[0])
    assert result["unit"] == "sec" and result["sf"] == 0.001 and result["value"] > 0
    assert set(result["queries"]) == set(ALL_QUERIES) | {"build_tables"}
