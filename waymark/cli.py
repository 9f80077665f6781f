"""python -m waymark.cli --master M [--master M2 ...] --requests R --out O [--coordinates C] [--geocodes G] [--inferences I] [--estimates E] [--log L [--batch B]] [--mode measured|estimated]

Of several masters the first that exists is read.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.ladder import resolve
from .shipping import ship
from .sources.tables import append_log, first_there, log_rows, read, standard_coordinates, standard_master


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--master", required=True, action="append")
    for name in ("requests", "out"):
        parser.add_argument(f"--{name}", required=True)
    for name in ("coordinates", "geocodes", "inferences", "estimates", "log", "batch", "row-no"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--mode", choices=["measured", "estimated"], default="measured")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("waymark").getOrCreate()
    ship(spark)
    tables = {n: read(spark, getattr(args, n)) if getattr(args, n) else None for n in ("coordinates", "geocodes", "inferences", "estimates")}
    if tables["coordinates"] is not None:
        tables["coordinates"] = standard_coordinates(tables["coordinates"])
    requests = read(spark, args.requests)
    answers = resolve(requests, standard_master(read(spark, first_there(spark, args.master)), args.row_no), mode=args.mode, **tables)
    answers.write.parquet(args.out)
    if args.log:
        append_log(log_rows(requests, spark.read.parquet(args.out)), args.log, args.batch)


if __name__ == "__main__":
    main()
