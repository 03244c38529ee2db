"""``python -m quillveil scan PATH [--json] [--show-values] [--ner | --no-ner]``: exit code 2 if PATH or a layer that is asked for isn't there."""

import argparse
import json
import os
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillveil")
    sub = parser.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("path")
    scan.add_argument("--json", action="store_true")
    scan.add_argument("--show-values", action="store_true")
    scan.add_argument("--ner", action=argparse.BooleanOptionalAction, default=None)
    args = parser.parse_args(argv)

    from .operators import ner
    from .sources import directory, files

    try:  # no weights are part of the engine
        layer = ner.availability({None: "auto", True: "required", False: "off"}[args.ner], False, False)
    except RuntimeError as e:
        print(e, file=sys.stderr)
        return 2
    if not os.access(args.path, os.R_OK):
        print(f"cannot read {directory.display_path(args.path)}", file=sys.stderr)
        return 2

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quillveil").getOrCreate()
    found, totals, _ = files.scan(spark, args.path, args.show_values, local=True)
    if args.json:
        good = files.local_texts(spark, args.path)[0]
        parts = files.report(found, totals, good, args.show_values, layer)
        print('{"files":[', end="")
        for n, row in enumerate(parts.where("path is not null").orderBy("path").toLocalIterator()):
            print("," if n else "", row["report"], sep="", end="")
        print(']', json.dumps(json.loads(parts.where("path is null").first()["report"]))[1:], sep=",")
    else:
        print(files.render(found, totals, layer))
        for row in files.local_texts(spark, args.path)[2].orderBy("path").toLocalIterator():
            print(f"unreadable: {row['path']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
