"""Bringing together the classes that share a token, without pairs and with bounded groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (token, class) in order: those of tokens with two classes or more, with the first as lead."""
    held: tuple[int, int, bool] | None = None  # token and lead of the last run, and whether it was sent
    for batch in batches:
        token, own = (batch.column(c).to_numpy() for c in ("token", "class"))
        if not len(token):
            continue
        if held is not None:  # the run goes on from the batch before
            token, own = np.insert(token, 0, held[0]), np.insert(own, 0, held[1])
        head = np.ones(len(token), bool)
        head[1:] = token[1:] != token[:-1]
        run = np.cumsum(head) - 1
        lead = own[head]
        several = np.maximum.reduceat(own, np.flatnonzero(head)) > lead
        sent_before = bool(held and held[2])
        if sent_before:
            several[0] = True
        keep = several[run]
        if sent_before:
            keep[0] = False
        rows = [pa.array(c[keep]) for c in (token, own, lead[run])]
        held = (int(token[-1]), int(lead[-1]), bool(several[-1]))
        yield pa.RecordBatch.from_arrays(rows, names=["token", "class", "lead"])


def route(sent: DataFrame, weights: DataFrame, most: int, buckets: int) -> DataFrame:
    """(lead, class, bucket) for (lead, class): where each class has to go to meet the others of its lead.

    Leads of at most ``most`` weight share buckets. A heavier one is dealt into blocks, and each pair of
    its blocks is a group, so every two classes meet and no group holds more than about twice ``most``.
    ``weights`` has (class, weight).
    """
    heavy = sent.join(weights, "class").groupBy("lead").agg(F.ceil(F.sum("weight") / most).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.concat_ws("-", F.col("lead"), F.least(i, block), F.greatest(i, block))
    )
    small = F.array(F.pmod(F.xxhash64("lead"), F.lit(buckets)).cast("string"))
    target = F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(small)).alias("bucket")
    return sent.join(heavy, "lead").select("lead", "class", target)
