"""The latest row of each key, kept up to date over a stream.

Late rows never replace later ones, so the result does not depend on the order of arrival; state is one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(rows: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """A streaming aggregation for the ``update`` or ``complete`` output modes."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(by, tie)).alias("row")).select(key, "row.*")

