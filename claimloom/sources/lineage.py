"""A lineage: a directory of its own for one experiment, which names the configuration it runs by."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession

from . import artefacts


def initialise(spark: SparkSession, directory: str, configuration: str) -> str:
    """Makes directory, stores the configuration (a JSON object) and names it; gives its identity. A directory that holds anything is refused."""
    if not isinstance(json.loads(configuration), dict):
        raise ValueError("a configuration must be a JSON object")
    if os.path.isdir(directory) and os.listdir(directory):
        raise FileExistsError(f"{directory} is not empty")
    os.makedirs(directory, exist_ok=True)
    rows = spark.createDataFrame([(configuration,)], "payload string")
    identity = artefacts.write(rows, f"{directory}/artefacts", "configuration").first().reference.identity
    with open(f"{directory}/lineage.json", "x", encoding="utf-8") as out:
        json.dump({"configuration": identity, "schema_version": "1"}, out, sort_keys=True)
    return identity


def configuration(spark: SparkSession, directory: str) -> str:
    """The configuration's JSON, its bytes verified."""
    with open(f"{directory}/lineage.json", encoding="utf-8") as held:
        identity = json.load(held)["configuration"]
    rows = artefacts.read(spark, f"{directory}/artefacts", "configuration").where(f"sha256 = '{identity.removeprefix('sha256:')}'")
    return artefacts.require_valid(artefacts.verified(rows)).first().payload
