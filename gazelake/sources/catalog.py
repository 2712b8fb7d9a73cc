"""Named datasets with an optional sampling suffix."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import prepare
from . import readers


def parse_name(name: str) -> tuple[str, float]:
    """``set%25`` -> ``("set", 0.25)``; no suffix means all rows."""
    found = re.search(r"%(\d+)$", name)
    return (name[:found.start()], int(found.group(1)) / 100.0) if found else (name, 1.0)


class Catalog:
    """Datasets by name: each an annotation path (or builder) and a data path."""

    def __init__(self, entries: dict[str, dict]):
        self.entries = dict(entries)

    def resolve(self, names: str) -> list[dict]:
        """Configurations of a comma-separated list; an unknown name is an error."""
        out = []
        for name, rate in (parse_name(n.strip()) for n in names.split(",")):
            if name not in self.entries:
                raise ValueError(f"no dataset {name}")
            out.append({**self.entries[name], "name": name, "sampling_rate": rate})
        return out

    def load(self, spark: SparkSession, names: str, key: str, seed=0) -> DataFrame:
        """Union of the named datasets, sampled exactly, tagged with ``data_path``."""
        parts = None
        for entry in self.resolve(names):
            source = entry["annotations"]
            df = source(spark) if callable(source) else readers.read_annotations(spark, source)
            if entry["sampling_rate"] < 1.0:
                df = prepare.exact_sample(df, key, rate=entry["sampling_rate"], seed=seed)
            df = df.withColumn("data_path", F.lit(entry["data_path"]))
            parts = df if parts is None else parts.unionByName(df, allowMissingColumns=True)
        return parts
