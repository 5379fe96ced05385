"""Hook for a scorer that is not part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series] | None, reason: str = "SCORER_NOT_AVAILABLE") -> DataFrame:
    """``df`` with score and score_reason. Without a scorer: null and the reason. A scorer gets batches of rows."""
    if scorer is None:
        return df.withColumn("score", F.lit(None).cast("double")).withColumn("score_reason", F.lit(reason))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=scorer(b).astype("float64"), score_reason=None)

    return df.mapInPandas(run, type(df.schema)([*df.schema.fields]).add("score", "double").add("score_reason", "string"))
