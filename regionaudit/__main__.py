"""``python -m regionaudit NAME FOLDER``: a query's rows; without arguments, the names."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans.catalog import QUERIES
from .session import ship


def main(arguments: list[str]) -> None:
    if len(arguments) != 2:
        print("\n".join(sorted(QUERIES)))
        return
    name, folder = arguments
    spark = ship(SparkSession.builder.appName("regionaudit").getOrCreate())
    QUERIES[name](spark, folder).show(1000, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
