"""Run one ingest workflow over landed JSON documents (spark-submit entry point).

    spark-submit crease/load.py --kind players --docs /landing/players --tables /data/warehouse
    spark-submit crease/load.py --kind venues --docs /landing/series_venues \
        --docs2 /landing/match_lists_flat --tables /data/warehouse

    spark-submit crease/load.py --kind master --docs /landing/scorecards \
        --docs2 /landing/batting_careers --docs3 /landing/bowling_careers --tables /data/warehouse

Documents are read line by line with the kind's explicit schema and parsed
once; malformed ones are counted as rejected and kept, with reason, file and
position, under <tables>/_rejects, as are rows with unreadable numbers.  Every
workflow stores only what is not stored yet, so a rerun adds nothing; a ledger
(<tables>/_loaded_files) lets a rerun skip files that have not changed
(--no-ledger reads all).  One JSON line per target table is printed:
{"table": ..., "inserted": ..., "rejected": ...}, with "updated" for replaced rows.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# kind -> (document schema, workflow); workflows take (docs, tables_dir)
KINDS = {
    "players": "player_lists",
    "teams": "team_list",
    "venues": "series_venues",
    "matches": "match_list",
    "batting": "scorecard",
    "bowling": "scorecard",
    "player_match": "player_matches",
    "master": "detailed_scorecard",
}


def run(spark, kind: str, docs_path: str, tables: str, docs2: str | None = None,
        multi_line: bool = False, docs3: str | None = None, ledger: bool = True) -> list[dict]:
    from crease.operators import loads as L
    from crease.operators.ingest import ingest_all
    from crease.session import delete_folder
    from crease.sources.documents import parse_documents, stage_documents
    from crease.sources.ledger import list_files, mark_loaded, new_files
    from crease.sources.schemas import doc_schema
    from crease.sources.sinks import keep_rejects

    loaded, scratch, bad_documents = [], [], 0

    def listed(path: str, name: str) -> list[tuple]:
        files = new_files(spark, path, name, tables) if ledger else list_files(spark, path, name)
        # names of files to open: what Spark's own listing of a path holds on the driver
        return [tuple(r) for r in files.collect()]

    def read(path: str, schema: str, name: str, found: list[tuple] | None = None):
        nonlocal bad_documents
        found = listed(path, name) if found is None else found
        if not found:
            empty = spark.createDataFrame([], "value string")
            return parse_documents(empty, "value", doc_schema(schema))[0]
        good, rejected, folder = stage_documents(spark, [f[1] for f in found], doc_schema(schema), multi_line)
        loaded.extend(found)
        scratch.append(folder)
        if bad := rejected.count():
            keep_rejects(rejected, tables, f"documents-{name}")
        bad_documents += bad
        return good

    docs = read(docs_path, KINDS[kind], kind)
    if kind == "players":
        reports = [L.load_players(docs, tables)]
    elif kind == "teams":
        reports = [L.load_teams(docs, tables)]
    elif kind == "venues":
        reports = [L.load_venues(docs, read(docs2, "match_list", "venues-matches") if docs2 else None, tables)]
    elif kind == "matches":
        reports = L.load_matches(docs, tables)
    elif kind == "batting":
        reports = L.load_batting(docs, tables)
    elif kind == "bowling":
        reports = L.load_bowling(docs, tables)
    elif kind == "master":
        # a summary takes a player's batting and bowling documents together: both folders are read if either has news
        names = ["master-batting", "master-bowling"]
        news = any(listed(path, name) for path, name in zip((docs2, docs3), names, strict=True))
        careers = [read(path, "career", name, [tuple(r) for r in list_files(spark, path, name).collect()] if news else [])
                   for path, name in zip((docs2, docs3), names, strict=True)]
        reports = ingest_all(docs, *careers, tables, staged=True)
    else:
        reports = [L.load_player_match(docs, tables)]
    if ledger and loaded:
        mark_loaded(spark.createDataFrame(loaded, "kind string, path string, modified timestamp, length bigint"), tables)
    for folder in scratch:
        delete_folder(spark, folder)
    return [{"table": r.table, "inserted": r.inserted, **({"updated": r.updated} if r.updated else {}),
             "rejected": bad_documents + r.rejected} for r in reports]


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--kind", required=True, choices=sorted(KINDS))
    ap.add_argument("--docs", required=True, help="file, folder or glob of JSON documents")
    ap.add_argument("--docs2", help="venues: flat match-list documents; master: batting careers")
    ap.add_argument("--docs3", help="master: bowling careers")
    ap.add_argument("--tables", required=True, help="folder of stored tables")
    ap.add_argument("--multi-line", action="store_true", help="one document per file")
    ap.add_argument("--no-ledger", action="store_true", help="read all files, also those loaded before")
    args = ap.parse_args(argv)
    if args.kind == "master" and not (args.docs2 and args.docs3):
        ap.error("--kind master needs --docs2 and --docs3")

    from crease.session import get_session

    spark = get_session(app=f"crease-load-{args.kind}")
    for line in run(spark, args.kind, args.docs, args.tables, args.docs2, args.multi_line, args.docs3,
                    not args.no_ledger):
        print(json.dumps(line))
    return 0


if __name__ == "__main__":
    sys.exit(main())
