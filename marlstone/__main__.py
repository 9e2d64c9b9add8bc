"""``python -m marlstone [--config FILE] sync [DIR...] | search QUERY``"""

from __future__ import annotations

import argparse
import os

from marlstone import config as configs
from marlstone.engine import Engine
from marlstone.session import local_session
from marlstone.sources.walk import base_directories


def main() -> None:
    parser = argparse.ArgumentParser(prog="marlstone")
    parser.add_argument("--config", default="~/.marlstone/config.json")
    parser.add_argument("--log-level", default="ERROR")
    commands = parser.add_subparsers(dest="command", required=True)
    sync = commands.add_parser("sync")
    sync.add_argument("directories", nargs="*")
    sync.add_argument("--force", action="store_true")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--top-k", type=int)
    search.add_argument("--directory")
    search.add_argument("--file-pattern")
    watch = commands.add_parser("watch")
    watch.add_argument("--skip-sync", action="store_true")
    args = parser.parse_args()
    config = configs.load(args.config)
    spark = local_session()
    spark.sparkContext.setLogLevel(args.log_level)
    engine = Engine(spark, config)
    if args.command == "search":
        engine.search(args.query, args.top_k, args.directory, args.file_pattern).show(truncate=False)
        return
    if args.command == "sync" or not args.skip_sync:
        for d in getattr(args, "directories", None) or base_directories(config.document_patterns):
            print(d, engine.sync(d, getattr(args, "force", False)))
    if args.command == "watch":
        from marlstone.streaming.watch import watch as start

        start(engine, base_directories(config.document_patterns), config_path=os.path.expanduser(args.config)).awaitTermination()


if __name__ == "__main__":
    main()
