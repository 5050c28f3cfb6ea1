"""Command line: python -m trigrail.cli [OPTION]... PATTERN..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from trigrail import __version__
from trigrail.plans.engine import Engine
from trigrail.plans.search import Query
from trigrail.session import session


class Parser(argparse.ArgumentParser):
    """Wrong options end with code 1."""

    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: {message}\n")


def parser() -> Parser:
    p = Parser(prog="trigrail", description="Search an index of file paths.")
    p.add_argument("patterns", nargs="*", metavar="PATTERN")
    p.add_argument("-d", "--database", metavar="DBPATH", default=os.path.expanduser("~/.trigrail"), help="folder of the database")
    p.add_argument("-i", "--ignore-case", action="store_true", help="ignore case distinctions")
    p.add_argument("-r", "--regexp", action="store_true", help="patterns are regular expressions")
    p.add_argument("-p", "--parents", action="store_true", help="leave out what lies below folders that you may not enter")
    p.add_argument("-u", "--update", action="store_true", help="scan the file system and rebuild the database; patterns are then not searched")
    p.add_argument("--root", default="/", help="where an update scans")
    p.add_argument("-v", "--version", action="version", version=__version__)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    try:
        a = p.parse_args(args)
        if not a.update and not a.patterns:
            p.error("a pattern is missing")
    except SystemExit as e:
        return int(e.code or 0)
    engine = Engine(spark or session(), a.database)
    if a.update:
        engine.update(a.root, include_folders=str(a.parents))
        print("Database updated.")
        return 0
    found = engine.search(Query(tuple(a.patterns), a.ignore_case, a.regexp, os.getuid(), os.getgid(), parents=a.parents)).collect()  # at most the limit
    if found:
        print(f"Found {len(found)} results:")
        for r in found:
            print(r.path)
    else:
        print("No matching files found.")
    return 0


if __name__ == "__main__":
    sys.exit(main())
