"""Command line: ``python -m marlstone search --listings FILE --criteria FILE``. 0 done, 1 issues, 2 unreadable input."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from marlstone.plans import local_search
from marlstone.session import session
from marlstone.sources.listings import UnreadableInput


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marlstone")
    search = parser.add_subparsers(dest="command", required=True).add_parser("search")
    search.add_argument("--listings", required=True)
    search.add_argument("--criteria", required=True)
    asked = parser.parse_args(argv)
    try:
        found = local_search.run(spark or session(), asked.listings, asked.criteria)
    except UnreadableInput as e:
        sys.stderr.write(f"{e.role}/{e.reason}\n")
        return 2
    if found.data is None:
        sys.stderr.write("".join(f"{category}/{code}/{path}\n" for _, _, path, category, code in found.issues))
        return 1
    sys.stdout.buffer.write(found.data)
    sys.stdout.buffer.flush()
    return 0
