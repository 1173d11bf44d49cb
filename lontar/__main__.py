"""Command line: `python -m lontar read DOCS OUT` and `python -m lontar postal FOLDER OUT`.

`read` parses and assesses documents (Parquet, or JSON lines where the name ends
in .json or .jsonl, with doc_id, raw_text and, if there is one, requested_type)
into JSON lines, and prints how many have which type and decision.  `postal`
turns the four postal sheets of a folder into tab-separated text.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.plans import documents
from lontar.sources import spreadsheet, tables


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return docs if "requested_type" in docs.columns else docs.withColumn("requested_type", F.lit("AUTO"))


def read(spark: SparkSession, source: str, target: str) -> list[dict]:
    """Write the assessed records and give their counts by type and decision, as they were written."""
    assessed = documents.assess_documents(documents.parse_documents(read_documents(spark, source)))
    assessed.select("doc_id", "document_type", "schema_version", "fields", "warnings", "input_assessment", "score", "needs_review").write.mode("overwrite").json(target)
    kind = "document_type string, input_assessment struct<decision:string>"
    counts = spark.read.schema(kind).json(target).groupBy("document_type", F.col("input_assessment.decision").alias("decision")).count()
    return [r.asDict() for r in counts.orderBy("document_type", "decision").collect()]


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lontar", description=__doc__.split("\n", 1)[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name, source in (("read", "docs"), ("postal", "folder")):
        command = commands.add_parser(name)
        command.add_argument(source)
        command.add_argument("out")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("lontar").getOrCreate()
    if given.command == "read":
        for row in read(spark, given.docs, given.out):
            print(json.dumps(row))
    else:
        tables.write_postal_tsv(spreadsheet.read_postal_sheets(spark, given.folder), given.out)


if __name__ == "__main__":
    main()
