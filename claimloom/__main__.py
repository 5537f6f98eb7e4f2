"""python -m claimloom dataset CORPUS OUT | experiment CONFIGURATION.json DIRECTORY"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="claimloom")
    commands = parser.add_subparsers(dest="command", required=True)
    dataset = commands.add_parser("dataset", help="a verified corpus as N-Quads")
    dataset.add_argument("corpus")
    dataset.add_argument("out")
    experiment = commands.add_parser("experiment", help="a directory for one experiment")
    experiment.add_argument("configuration")
    experiment.add_argument("directory")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if given.command == "dataset":
        from .operators.quads import source_quads, write_dataset
        from .sources.corpus import read_corpus

        rows = read_corpus(spark, given.corpus)
        if bad := rows.where("diagnostic is not null").select("base_path", "diagnostic").limit(5).collect():
            raise SystemExit("; ".join(f"{r.base_path}: {r.diagnostic}" for r in bad))
        write_dataset(source_quads(rows.withColumn("text", F.decode("body", "UTF-8")), "content_id", "text", "source_json_sha256"), given.out, given.corpus)
    else:
        from .sources.lineage import initialise

        with open(given.configuration, encoding="utf-8") as text:
            print(initialise(spark, given.directory, text.read()))


if __name__ == "__main__":
    main()
