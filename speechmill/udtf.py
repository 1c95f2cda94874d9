"""Table functions for SQL users; small helpers beside the native plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BURST = T.StructType([T.StructField("start_ms", T.DoubleType()), T.StructField("end_ms", T.DoubleType())])
_HIT = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])


class EnergyBursts:
    """``energy_bursts(samples, rate)``: sound bursts of one clip."""

    def eval(self, samples, rate):
        if samples is None or len(samples) == 0 or rate <= 0:
            return
        x = np.asarray(samples, dtype=np.float64)
        frame = max(int(np.floor(0.02 * rate + 0.5)), 1)
        starts = np.arange(0, len(x), frame)
        sizes = np.minimum(frame, len(x) - starts)
        env = np.sqrt(np.add.reduceat(x * x, starts) / sizes)
        floor, top = np.sort(env)[int(len(env) * 0.10)], env.max()
        if top - floor < 1.0:
            return
        level = np.where(env >= floor + 0.22 * (top - floor), 1, np.where(env < floor + 0.12 * (top - floor), 0, -1))
        known = np.maximum.accumulate(np.where(level >= 0, np.arange(len(env)), -1))
        voiced = np.where(known >= 0, level[known], 0)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], voiced, [0]])))
        step, total = frame * 1000.0 / rate, len(x) * 1000.0 / rate
        merged: list[list[float]] = []
        for a, z in zip(edges[::2] * step, np.minimum(edges[1::2] * step, total)):
            if merged and a - merged[-1][1] < 350.0:
                merged[-1][1] = z
            else:
                merged.append([a, z])
        for a, z in merged:
            if z - a >= 80.0:
                yield float(max(a - 100.0, 0.0)), float(min(z + 180.0, total))


class PhraseHits:
    """``phrase_hits(words, phrase)``: every occurrence of a normal phrase in normal words."""

    def eval(self, words, phrase):
        if words is None or phrase is None or len(phrase) == 0:
            return
        words, phrase = list(words), list(phrase)
        n = len(phrase)
        for i in range(len(words) - n + 1):
            if words[i:i + n] == phrase:
                yield i, i + n - 1


def register(spark: SparkSession) -> None:
    spark.udtf.register("energy_bursts", F.udtf(EnergyBursts, returnType=_BURST, useArrow=True))
    # its rows are whole texts: Arrow would hold ten thousand of them at once, plain rows come by the hundred
    spark.udtf.register("phrase_hits", F.udtf(PhraseHits, returnType=_HIT, useArrow=False))
