"""``python -m tablepulse.cli``: check, cost, fix, watch, watch-trends, watch-status, demo, fleet, list and serve.

Exit codes: 0, 1 for critical findings or a finding without a fix, 2 if a table can't be loaded.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from . import config, render
from .plans import engine
from .sources.demo import NAME, demo_relations
from .server import serve
from .sources.reader import load
from .streaming.watching import Store, loop
from .tools import Tools


def session() -> SparkSession:
    return SparkSession.builder.appName("tablepulse").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tablepulse", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--warehouse")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("check")
    c.add_argument("table")
    c.add_argument("--checks", help="ids, comma-separated")
    c.add_argument("--format", choices=("pretty", "json", "github"), default="pretty")
    sub.add_parser("cost").add_argument("table")
    f = sub.add_parser("fix")
    f.add_argument("table")
    f.add_argument("finding")
    f.add_argument("--dry-run", action="store_true")
    w = sub.add_parser("watch")
    w.add_argument("--interval")
    w.add_argument("--cycles", type=int)
    for name in ("watch-trends", "watch-status"):
        t = sub.add_parser(name)
        t.add_argument("table", nargs="?")
        t.add_argument("--days", type=int, default=7)
    sub.add_parser("demo")
    g = sub.add_parser("fleet")
    g.add_argument("--namespace")
    g.add_argument("--dormant-days", type=int, default=90)
    sub.add_parser("list").add_argument("--namespace")
    sub.add_parser("serve", help="the tools over standard input and output")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    cfg = config.load(args.config) if args.config else config.Config()
    if args.warehouse:
        cfg = replace(cfg, catalog=config.Catalog("filesystem", args.warehouse))
    spark = spark or session()
    tools = Tools(spark, cfg)

    def show(got: dict, text=render.as_json) -> int:
        if "error" in got:
            print(got["error"], file=sys.stderr)
            return 2
        print(text(got))
        return 0

    if args.command == "check":
        got = tools.check_table(args.table, args.checks.split(",") if args.checks else None)
        code = show(got, {"pretty": render.pretty, "json": render.as_json, "github": render.github}[args.format])
        return code or int(got["overall"]["severity"] == "CRITICAL")
    if args.command == "cost":
        return show(tools.get_cost_report(args.table), lambda r: render.costs(r["table_name"], r["items"], r["currency"]))
    if args.command == "fix":
        got = (tools.dry_run_fix if args.dry_run else tools.get_fix)(args.table, args.finding)
        return show(got) and (1 if "no fix" in got["error"] else 2)
    if args.command == "watch":
        store = Store(spark, cfg.watch.history)
        loop(lambda: load(spark, tools.catalog, tools.catalog.list_tables(cfg.watch.namespace))[0], store, cfg.thresholds, args.interval or cfg.watch.interval, cfg.watch.webhook_url, args.cycles)
        return 0
    if args.command in ("watch-trends", "watch-status"):
        return show(tools.watch_status(args.table, args.days, True if args.command == "watch-trends" else None))
    if args.command == "demo":
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        rel = demo_relations(spark, now)
        found = engine.findings(rel, cfg.thresholds, now)
        row = engine.overall(found).first().asDict()
        print(render.pretty({"table_name": NAME, "overall": row, "summary": engine.summary(rel).first().asDict(), "findings": [r.asDict() for r in found.collect()]}))
        return 0
    if args.command == "serve":
        serve(tools)
        return 0
    if args.command == "fleet":
        return show(tools.check_fleet(args.namespace, args.dormant_days))
    for name in tools.catalog.list_tables(args.namespace):
        print(name)
    return 0


if __name__ == "__main__":
    sys.exit(main())
