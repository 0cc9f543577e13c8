"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line.

``build`` writes the whole index of the projected graph, with reverse edges and trigrams (rows a second are given). The verbs
then run over the stored index, as a user would have it; ``lookup_1000`` is 1000 names in one job. Operators that make the
index (aggregates, joins, ranks) run over the raw tables. Each runs once to warm up and then ``RUNS`` times; its figure
is the median wall time.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from statistics import median

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
#: Operators over the raw tables, by their key in the catalogue.
RAW = ("innermost_body", "sym_refine", "name_row_id", "trigram_dict", "merge_union", "completes_remap")


def verbs_of(g) -> dict:
    """Headline verbs over a stored index."""
    from tracelode.operators import resolve, verbs, walk
    from tracelode.plans.catalogue import CUSTOMER, NAME, PART

    return {
        "stat": lambda: verbs.stat(g),
        "def_exact": lambda: verbs.define(g, NAME),
        "def_substr": lambda: verbs.define(g, PART, substr=True),
        "ref_all": lambda: verbs.refs(g, NAME, max_hits=None),
        "callers": lambda: verbs.callers(g, NAME),
        "callers_in": lambda: verbs.callers(g, "ring", substr=True, in_="/NATION_1"),
        "sub_direct": lambda: verbs.subs(g, "ASIA"),
        "members": lambda: verbs.members(g, CUSTOMER, substr=True),
        "type_of": lambda: verbs.types(g, PART, substr=True),
        "sig_of": lambda: verbs.signatures(g, "order.1", substr=True),
        "names_prefix": lambda: resolve.prefix(g.names, "Brand#1"),
        "callgraph_down": lambda: walk.callgraph(g, CUSTOMER, substr=True, direction="down"),
        "callgraph_both": lambda: walk.callgraph(g, NAME, direction="both"),
        "inheritance_down": lambda: walk.inheritance(g, "ASIA", direction="down"),
        "lookup_every_name": lambda: verbs.sites_many(g, g.names.selectExpr("name as needle")),
    }


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tracelode.operators import verbs
    from tracelode.plans import catalogue, project
    from tracelode.sources import index

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        run()
        own = []
        for _ in range(RUNS):
            began = time.perf_counter()
            run()
            own.append(time.perf_counter() - began)
        times[name] = round(median(own), 4)

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    work = tempfile.mkdtemp(prefix="bench-")
    try:
        g = project.graph(spark, SF_DIR)
        rows = sum(df.count() for df in g.tables().values())
        began = time.perf_counter()
        index.write(g, f"{work}/graph.index")
        times["build"] = round(time.perf_counter() - began, 4)
        for name in RAW:
            timed(name, lambda q=catalogue.QUERIES[name]: noop(q(spark, SF_DIR)))
        stored = index.read(spark, f"{work}/graph.index")
        for name, verb in verbs_of(stored).items():
            timed(name, lambda v=verb: noop(v()))
        needles = stored.names.select(F.col("name").alias("needle")).distinct().orderBy(F.xxhash64("needle")).limit(1000).cache()
        needles.count()
        timed("lookup_1000", lambda: noop(verbs.sites_many(stored, needles)))
    finally:
        shutil.rmtree(work, ignore_errors=True)
    extra = {"build_rows": rows, "build_rows_per_s": round(rows / times["build"]), "lookup_us_per_name": round(times["lookup_1000"] * 1000, 1)}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]} | extra))
    spark.stop()


if __name__ == "__main__":
    main()
