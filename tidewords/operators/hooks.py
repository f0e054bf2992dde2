"""Where a model of one's own is called on segments or windows, batch by batch, inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def recognise(segments: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, most_rows: int = 8) -> DataFrame:
    """What a model makes of segments: ``load`` runs once in a task, its model is given up to ``most_rows`` segments at a time.

    The model maps rows of segments to rows of ``schema`` (words, tokens or embeddings); rows keep no order over tasks.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            for k in range(0, len(part), most_rows):
                yield model(part.iloc[k : k + most_rows])

    return segments.mapInPandas(run, schema)
