"""Command line: process a folder, report quality, check the surroundings."""

from __future__ import annotations

import argparse
import shutil
import sys


def doctor() -> list[tuple[str, bool, str]]:
    """(check, passed, detail) of converters, model services' tools and storage."""
    from .sources.convert import PROGRAMS

    out = [(f"converter:{name}", any(map(shutil.which, programs)), ", ".join(programs)) for name, programs in PROGRAMS.items()]
    free = shutil.disk_usage(".").free
    return [*out, ("storage:free", free > 1 << 30, f"{free >> 20} MiB")]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docspark")
    commands = parser.add_subparsers(dest="command", required=True)
    parse = commands.add_parser("process", help="files of a folder to models, texts and tables")
    parse.add_argument("source")
    parse.add_argument("target")
    parse.add_argument("--config", help="JSON with comments")
    parse.add_argument("--max-tokens", type=int)
    parse.add_argument("--locale", choices=("ru", "en"))
    quality = commands.add_parser("quality", help="statistics of the files of a folder")
    quality.add_argument("source")
    commands.add_parser("doctor", help="what is installed")
    args = parser.parse_args(argv)
    if args.command == "doctor":
        checks = doctor()
        print("\n".join(f"{'ok  ' if ok else 'none'} {name}: {detail}" for name, ok, detail in checks))
        return 0
    from pyspark.sql import SparkSession

    from . import engine
    from .config import Config, load

    spark = SparkSession.builder.appName("docspark").getOrCreate()
    if args.command == "quality":
        engine.process(spark, args.source).quality().show(1000, False)
    else:
        config = Config.of(load(args.config) if args.config else {}).override(max_tokens=args.max_tokens, locale=args.locale)
        engine.write(engine.process(spark, args.source, config), args.target)
    return 0


if __name__ == "__main__":
    sys.exit(main())
