"""python -m weirlog report|follow|clear-cache: the command line."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weirlog")
    commands = parser.add_subparsers(dest="command", required=True)
    source = argparse.ArgumentParser(add_help=False)
    source.add_argument("logs", nargs="+")
    source.add_argument("--attack-list")
    source.add_argument("--attack-pattern", action="append", default=[])
    source.add_argument("--bot-list")
    source.add_argument("--bot-pattern", action="append", default=[])
    source.add_argument("--geo", help="a place database (mmdb)")
    report = commands.add_parser("report", parents=[source], help="write an HTML report of some logs")
    report.add_argument("--out", default="-")
    report.add_argument("--cache")
    report.add_argument("--tags")
    report.add_argument("--legacy-tags", help="an older store's database, whose tags are taken over where there are none yet")
    report.add_argument("--top", type=int, default=10)
    report.add_argument("--no-static", action="store_true")
    report.add_argument("--classify", action="store_true", help="run the rules before")
    report.add_argument("--probe-list", help="a JSON list of uri and tag for the probe rule")
    report.add_argument("--days", type=float, default=0, help="only the last so many days")
    follow = commands.add_parser("follow", parents=[source], help="follow logs from their start, or from where it stopped, append them to a store, and print what isn't static")
    follow.add_argument("--load", nargs="*", default=[], help="older logs, also gzip, that are loaded first")
    follow.add_argument("--cache", required=True)
    follow.add_argument("--name", default="followed", help="of the store")
    follow.add_argument("--checkpoint", required=True, help="a folder that driver and executors share")
    follow.add_argument("--max-bytes", type=int, default=64 << 20, help="of a batch")
    follow.add_argument("--compact-after", type=int, default=50, help="batches")
    follow.add_argument("--once", action="store_true", help="up to the end of the logs")
    clear = commands.add_parser("clear-cache", help="remove the cache of some logs, or all of it")
    clear.add_argument("logs", nargs="*")
    clear.add_argument("--cache", required=True)
    clear.add_argument("--all", action="store_true")
    got = parser.parse_args(args)

    from weirlog.sources import store

    if got.command == "clear-cache":
        if bool(got.logs) == got.all:
            parser.error("give logs or --all") if got.logs else None
        print(*store.clear(got.cache, got.logs, got.all), sep="\n")
        return 0

    from pyspark.sql import SparkSession

    from weirlog.functions import lists
    from weirlog.operators.filters import last_days
    from weirlog.plans.report import render
    from weirlog.plans.rules import ProbeOnly, default_rules
    from weirlog.sources.geo import networks
    from weirlog.sources.tags import TagSet

    spark = SparkSession.builder.appName("weirlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rules = lists.attack_rules(lists.pattern_file(got.attack_list) if got.attack_list else None, got.attack_pattern)
    bots = lists.bot_patterns(lists.pattern_file(got.bot_list) if got.bot_list else None, got.bot_pattern)
    say = lambda phase, done, total: print(f"{phase} {done}/{total}", file=sys.stderr)
    places = networks(spark, got.geo) if got.geo else None
    if got.command == "follow":
        from weirlog.streaming.hub import Hub
        from weirlog.streaming.live import follow as start

        logs = store.LogStore(spark, got.load, got.cache, None, say, got.name, rules=rules, bots=bots, geo=places)
        hub = Hub()
        hub.subscribe(lambda row: print(row["ts"], row["ip"], row["method"], row["uri"], row["status"], row["malicious_reason"]), size=10_000)
        query = start(logs, got.logs, got.checkpoint, hub=hub, from_start=True, max_bytes=got.max_bytes, compact_after=got.compact_after, once=got.once)
        [s.drained() for s in hub.subscribers] if got.once else query.awaitTermination()
        return 0
    tags = TagSet(got.tags)
    if got.legacy_tags:
        tags.adopt(got.legacy_tags)
    logs = store.LogStore(spark, got.logs, got.cache, tags, say, rules=rules, bots=bots, geo=places)
    if got.classify:
        chosen = default_rules()
        if got.probe_list:
            chosen = [ProbeOnly(lists.probe_file(got.probe_list)) if isinstance(r, ProbeOnly) else r for r in chosen]
        for outcome in logs.run_rules(chosen):
            print(outcome, file=sys.stderr)
    page = render(last_days(logs.rows(), got.days), got.logs, top=got.top, static=not got.no_static)
    print(page) if got.out == "-" else Path(got.out).write_text(page, encoding="utf-8")
    logs.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
