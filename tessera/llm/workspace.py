"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import delete, discard, new_path, passed_on, shared_dir, written

__all__ = ["delete", "discard", "fresh", "new_path", "passed_on", "row_hash", "shared_dir", "table", "unit_hash", "written"]


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores until no column (of any case) has it."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def unit_hash(column: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the value alone; null has a value of its own too."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), column), 11) / F.lit(float(1 << 53))


def row_hash(*columns: str) -> Column:
    """A hash of the columns' values.  With doc_id and text it tells rows apart whose doc_id is null or repeated."""
    return F.xxhash64(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
