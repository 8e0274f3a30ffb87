"""harvest, export, or both (run)."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .plans import export, harvest
from .plans.state import State
from .sources import config as configs
from .sources import fetch


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all went well, 1 if a source saw nothing, 2 without a configuration."""
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("command", nargs="?", default="run", choices=["run", "harvest", "export"])
    parser.add_argument("--config", default="config.toml")
    parser.add_argument("--source", action="append")
    parser.add_argument("--fixtures", help="a folder of canned responses instead of the network")
    parser.add_argument("--database", help="the state's folder, in place of the configured one")
    parser.add_argument("--output", help="the feed's place, in place of the configured one")
    parser.add_argument("-v", "--verbose", action="store_true", help="say what each source's run created, updated and cancelled")
    args = parser.parse_args(argv)
    if not os.path.exists(args.config):
        print(f"no configuration at {args.config}", file=sys.stderr)
        return 2
    config = configs.load(args.config)
    config.state, config.output = args.database or config.state, args.output or config.output
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(f"{config.state}/checkpoints")
    state, failed = State(spark, config.state), False
    if args.command != "export":
        delays = {h: s[6] for s in config.sources for h in s[5]}
        provider = fetch.canned(spark, args.fixtures) if args.fixtures else fetch.live(config.user_agent, config.timeout, config.max_bytes, delays)
        for r in harvest.run(spark, config, provider, state, datetime.now(UTC), args.source).runs:
            print(f"{r.source_id}: {r.coverage} events={r.events_seen} {r.notes}")
            if args.verbose:
                print(f"  created={r.created} updated={r.updated} cancelled={r.cancelled}")
            failed |= r.coverage == "PARTIAL" and r.events_seen == 0
    if args.command != "harvest":
        print(f"{export.write(state.read('events'), config.domain, config.output)} events in {config.output}")
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
