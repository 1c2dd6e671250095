"""spark-submit hashloom/convert.py MAP_FOLDER INDEX_FOLDER --shape 720,150 --chunks 24,10 [--per-shard 6250]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from hashloom.operators import grid, store


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    sizes = lambda s: tuple(map(int, s.split(",")))
    parser = argparse.ArgumentParser(description="Move the chunk keys of a map to a sharded chunk index.")
    parser.add_argument("map_folder")
    parser.add_argument("index_folder")
    parser.add_argument("--shape", type=sizes, required=True)
    parser.add_argument("--chunks", type=sizes, required=True)
    parser.add_argument("--per-shard", type=int, default=6250)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("convert").getOrCreate()
    try:
        target = store.ShardStore(spark, args.index_folder, grid.Grid(args.shape, args.chunks, args.per_shard))
        root, _ = store.convert(store.MapStore(spark, args.map_folder, read_only=True), target)
    except Exception as e:
        print(f"not converted: {e}", file=sys.stderr)
        return 1
    print(root)
    return 0


if __name__ == "__main__":
    sys.exit(main())
