"""Print the formatted physical plan of catalogue queries (after one execution, so
adaptive re-planning is visible): ``python tools/explain.py <sf_dir> query [query ...]``."""
from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from foldspark.plans.catalog import load_all  # noqa: E402
from foldspark.session import get_spark  # noqa: E402


def main(sf_dir: str, *names: str) -> None:
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    reg = load_all()
    for n in names:
        df = reg[n].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        print(f"==== {n}")
        df.explain("formatted")


if __name__ == "__main__":
    main(*sys.argv[1:])
