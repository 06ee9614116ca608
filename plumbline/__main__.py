"""python -m plumbline {route,rank,pack,hygiene} FILE: one request's result on the standard output.

FILE holds one JSON request. A --file's own envelope (access, budget, query type) is
replaced by the options.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.plans import documents
from plumbline.plans.pipeline import Analysis, validation_errors
from plumbline.sources import candidates


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    parser.add_argument("command", choices=documents.DOCUMENTS)
    parser.add_argument("file")
    parser.add_argument("--token-budget", type=int, default=0)
    parser.add_argument("--query-type", default="")
    parser.add_argument("--clearance", default="internal")
    parser.add_argument("--allow-degraded", action=argparse.BooleanOptionalAction, default=True)
    parser.add_argument("--now-year", type=int, default=None)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    year = args.now_year or spark.sql("SELECT year(current_date()) AS y").first()["y"]
    requests = candidates.read_requests(spark, args.file, multiline=True)
    caller = F.expr(f"cast(NULL AS {candidates.ACCESS})")
    requests = requests.withColumns({"token_budget": F.lit(args.token_budget), "query_type": F.lit(args.query_type), "allow_degraded_plan": F.lit(args.allow_degraded), "access": caller})
    corpus = candidates.corpus(requests, year)
    corpus = replace(corpus, queries=corpus.queries.withColumn("clearance", F.lit(args.clearance)))
    if corpus.corrupt.limit(1).count() or not corpus.queries.limit(1).count():
        print("plumbline: the request doesn't parse", file=sys.stderr)
        return 1
    if error := validation_errors(corpus).first():
        print(f"plumbline: {error['error']}: {error['id']!r}", file=sys.stderr)
        return 1
    query_id = corpus.queries.first()["query_id"]
    analysis = Analysis(corpus)
    if args.command == "pack" and not args.allow_degraded and (status := analysis.responses.first()["status"]) != "ok":
        print(f"plumbline: {status}", file=sys.stderr)
        return 1
    out.write(documents.DOCUMENTS[args.command](analysis, query_id))
    return 0


if __name__ == "__main__":
    sys.exit(main())
