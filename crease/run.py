"""Run one named question over stored tables (spark-submit entry point).

    spark-submit crease/run.py --tables /data/warehouse --query q23_recent_form \
        --out /data/results/q23 [--param as_of=2001-08-01 --param k=20] [--format parquet]

`--list` prints the available names with their parameters.  Tables are read
from `<tables>/<name>` Parquet folders; the result is written by the
executors (never collected), so it may be as large as the data allows.
"""

from __future__ import annotations

import argparse
import inspect
import json
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crease.plans.analytics import ALL_QUERIES  # noqa: E402


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def parse_params(pairs: list[str]) -> dict:
    out = {}
    for p in pairs or []:
        key, _, val = p.partition("=")
        out[key] = _value(val)
    return out


def describe() -> str:
    lines = []
    for name, fn in ALL_QUERIES.items():
        params = [f"{k}={v.default!r}" for k, v in inspect.signature(fn).parameters.items()
                  if k != "tables" and v.kind is not inspect.Parameter.VAR_KEYWORD]
        lines.append(f"{name}({', '.join(params)})")
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--tables")
    ap.add_argument("--query")
    ap.add_argument("--out")
    ap.add_argument("--param", action="append", default=[])
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--list", action="store_true")
    args = ap.parse_args(argv)
    if args.list:
        print(describe())
        return 0
    if not (args.tables and args.query and args.out):
        ap.error("--tables, --query and --out are required")
    if args.query not in ALL_QUERIES:
        ap.error(f"unknown query {args.query!r}; see --list")

    from crease.session import get_session
    from crease.sources.tables import load_tables

    spark = get_session(app=f"crease-{args.query}")
    df = ALL_QUERIES[args.query](load_tables(spark, args.tables), **parse_params(args.param))
    df.write.mode("overwrite").format(args.format).save(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
