"""Wall time of the registered queries; prints one JSON line.

BENCH_SF_DIR  tables to read (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names (default: all)

Each query runs into the ``noop`` sink, so every row is computed and none is
collected. Before that, untimed, the text tables are landed as several files,
as a large table comes, and one query warms the JVM up. Intermediate tables go
to a folder of this run and are removed after each query.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from beatwire.catalog import QUERIES
from beatwire.session import build_session, remove, remove_intermediate

TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def landed(spark, sf_dir: str, to: str, files: int) -> str:
    """The tables of ``sf_dir``, those of long texts in several files."""
    os.makedirs(to)
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        if table in TEXT_TABLES:
            (spark.read.parquet(f"{sf_dir}/{name}").repartition(files, TEXT_TABLES[table])
             .write.parquet(f"{to}/{name}"))
        else:
            os.symlink(f"{sf_dir}/{name}", f"{to}/{name}")
    return to


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    work = tempfile.mkdtemp(prefix="bench-")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": f"{work}/shared",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.path.basename(sf_dir).removeprefix("sf")
    sf_dir = landed(spark, sf_dir, f"{work}/tables", 2 * int(cpus))
    QUERIES["scan_articles"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as err:  # a failing query must not hide the others
            failed[name] = str(err).splitlines()[0][:200]
            continue
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
        remove_intermediate(spark)
    line = {"metric": "total wall time of all queries", "value": round(sum(seconds.values()), 3),
            "unit": "sec", "queries": seconds, "sf": sf}
    if failed:
        line["failed"] = failed
    print(json.dumps(line))
    remove(spark, work)
    spark.stop()


if __name__ == "__main__":
    main()
