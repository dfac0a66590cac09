"""Score rows arriving on a stream with a model fitted on batch data."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def score_stream(stream: DataFrame, model, keep: list[str], sink: Callable[[DataFrame, int], None],
                 checkpoint: str, trigger_once: bool = True):
    """Start a query applying ``model.transform`` to every micro-batch.

    ``model`` is any fitted object with ``transform(df, keep)`` (a
    ``PreprocessorModel``, reducer or pipeline model). ``checkpoint`` must be a
    shared folder so the query restarts where it stopped.
    """
    scored = model.transform(stream, keep=keep)
    w = scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
