"""Window assembly over embedding series and batch scoring by user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .joins import halo

# Rows of a window, their stride, frames per embedding, frame step.
WINDOW_ROWS = 16
STRIDE = 8
SPAN = (WINDOW_ROWS - 1) * STRIDE
EMBEDDING_FRAMES = 76
FRAME_MS = 10.0

Model = Callable[[np.ndarray], np.ndarray]
_BLOCK = 16 * SPAN


def strided_windows(bank: DataFrame, key: str, pos: str, vector: str, step: int = 1) -> DataFrame:
    """Windows of 16 vectors, 8 apart, ending at every ``step``-th position from 120 on.

    ``bank`` has one vector per frame. Rows near a block edge are copied to the
    next block (120 of 1920), so a long take spreads over tasks and no vector is
    sent 16 times. ``time_ms`` is the end of the last frame.
    """
    w = W.partitionBy(key, "_blk").orderBy(pos)
    lags = [F.lag(vector, STRIDE * i).over(w) for i in range(WINDOW_ROWS - 1, 0, -1)]
    built = (
        halo(bank.select(key, pos, vector), pos, _BLOCK, SPAN, 0)
        .withColumn("window", F.array(*lags, F.col(vector)))
        .filter("_core").filter((F.col(pos) >= SPAN) & ((F.col(pos) - SPAN) % step == 0))
    )
    return built.select(key, pos, ((F.col(pos) + EMBEDDING_FRAMES) * FRAME_MS).alias("time_ms"), "window")


def score_windows(windows: DataFrame, keys: Sequence[str], models: Mapping[str, Callable[[], Model]],
                  decimals: int | None = None) -> DataFrame:
    """Score every window with every model, in Arrow batches.

    ``models`` maps a name to a factory that loads the model inside the task
    (once per task). A model that fails yields rows with ``error`` set and no
    score; the others go on.
    """
    fields = [windows.schema[c] for c in keys]
    schema = T.StructType([*fields, T.StructField("model", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("error", T.StringType())])
    names = list(keys)
    loaders = dict(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Model | Exception] = {}
        for name, load in loaders.items():
            try:
                ready[name] = load()
            except Exception as error:  # kept as a row, see below
                ready[name] = error
        for batch in batches:
            rows = batch.num_rows
            if rows == 0:
                continue
            nested = batch.column("window")
            flat = nested.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            tensor = flat.reshape(rows, WINDOW_ROWS, -1)
            carried = [batch.column(c) for c in names]
            for name, model in ready.items():
                error, scores = None, None
                if isinstance(model, Exception):
                    error = str(model)
                else:
                    try:
                        scores = np.asarray(model(tensor), dtype=np.float64)
                        if decimals is not None:
                            scores = np.round(scores, decimals)
                    except Exception as failed:
                        error = str(failed)
                yield pa.RecordBatch.from_arrays(
                    [*carried, pa.array([name] * rows, pa.string()),
                     pa.nulls(rows, pa.float64()) if scores is None else pa.array(scores, pa.float64()),
                     pa.array([error] * rows, pa.string())],
                    names=[*names, "model", "score", "error"])

    return windows.select(*names, "window").mapInArrow(run, schema)


def linear_head(weights: np.ndarray) -> Callable[[], Model]:
    """A logistic head over the flattened window."""

    def load() -> Model:
        def model(tensor: np.ndarray) -> np.ndarray:
            return 1.0 / (1.0 + np.exp(-np.tensordot(tensor, weights, axes=([1, 2], [0, 1]))))

        return model

    return load


def failing_head(message: str) -> Callable[[], Model]:
    """A model that cannot be loaded, to show that errors stay per model."""

    def load() -> Model:
        raise FileNotFoundError(message)

    return load
