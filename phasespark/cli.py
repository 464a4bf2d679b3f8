"""python -m phasespark.cli list | run NAME SF_DIR OUT | verify PATH COLUMN... | analyze CONFIG"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from phasespark.plans import cache, registry, workflow


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="phasespark", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("sf_dir")
    run.add_argument("out")
    verify = sub.add_parser("verify")
    verify.add_argument("path")
    verify.add_argument("columns", nargs="*")
    sub.add_parser("analyze").add_argument("config")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = SparkSession.builder.getOrCreate()
    try:
        if args.command == "analyze":
            workflow.run_workflow(spark, args.config)
        elif args.command == "run":
            if args.name not in registry.QUERIES:
                raise ValueError(f"no query {args.name}")
            registry.QUERIES[args.name](spark, args.sf_dir).write.mode("overwrite").parquet(args.out)
        else:
            found = cache.status(spark, args.path, args.columns)
            print(found)
            return int(found != "ok")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
