"""Command line: run the whole job, or replay it from cached extracts.

    python -m adlift --launch 2026-03-18 --end 2026-04-30 --history-start 2025-03-18 \\
        --sources-root s3://bucket/sources --out s3://bucket/launch/2026-04-30
    python -m adlift ... --from-cache s3://bucket/launch/2026-04-30/extracts --out ...

Sources are either one Parquet folder per source under ``--sources-root``
or catalog tables given as ``--table name=db.table`` (all nine).  The
session comes from the cluster (``getOrCreate``); the settings the plans
are designed for are applied unless the session already sets them.
"""

from __future__ import annotations

import argparse
import json
from datetime import date

from pyspark.sql import SparkSession

from .config import LaunchConfig
from .plans.report import run_report
from .session import CLUSTER_CONF, RECOMMENDED_CONF
from .sources.registry import Sources


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="adlift", description="launch-impact analysis on Spark")
    p.add_argument("--launch", required=True, help="launch date, YYYY-MM-DD")
    p.add_argument("--end", required=True, help="last analysed day, YYYY-MM-DD")
    p.add_argument("--history-start", required=True, help="first day of the first-timer history")
    p.add_argument("--min-spend", type=float, default=None, help="minimum off-site-only spend after launch")
    p.add_argument("--window-policy", choices=("reference", "equal"), default="reference")
    p.add_argument("--sources-root", help="folder with one Parquet folder per source")
    p.add_argument("--table", action="append", default=[], metavar="NAME=TABLE", help="catalog table per source")
    p.add_argument("--out", required=True, help="output folder (shared storage)")
    p.add_argument("--cache-format", choices=("parquet", "csv", "json"), default="parquet")
    p.add_argument("--fold-root", help="daily fold store kept between runs (default: OUT/fold)")
    p.add_argument("--late-days", type=int, default=0, help="days at the end of the range that are folded again")
    p.add_argument("--restate", action="append", default=[], metavar="DAY", help="a day whose rows changed, YYYY-MM-DD")
    p.add_argument("--from-cache", help="replay: read cached extracts from this folder instead of the sources")
    return p


def main(argv: list[str] | None = None) -> dict:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("adlift").getOrCreate()
    local = spark.sparkContext.master.startswith("local")
    for k, v in {**RECOMMENDED_CONF, **({} if local else CLUSTER_CONF)}.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    kw = {"min_spend": args.min_spend} if args.min_spend is not None else {}
    cfg = LaunchConfig(args.launch, args.end, args.history_start, window_policy=args.window_policy, **kw)
    src = None
    if args.table:
        src = Sources.from_tables(spark, dict(t.split("=", 1) for t in args.table))
    elif args.sources_root:
        src = Sources.from_parquet(spark, args.sources_root)
    elif not args.from_cache:
        raise SystemExit("give --sources-root, --table NAME=TABLE (all nine), or --from-cache")
    result = run_report(
        src,
        cfg,
        args.out,
        cache_format=args.cache_format,
        replay_from=args.from_cache,
        fold_root=args.fold_root,
        late_days=args.late_days,
        restate=[date.fromisoformat(d) for d in args.restate],
    )
    print(json.dumps(result))
    return result


if __name__ == "__main__":
    main()
