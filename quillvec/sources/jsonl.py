"""Bulk ingest of JSON lines: one record `{"id", "vector", "metadata"}` a line."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.model import InvalidArgument
from quillvec.ship import ship

BATCH_BYTES = 1 << 20


def read_puts(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Puts in file order: `(ord, batch, op, id, vector, metadata)`.

    Blank lines are skipped and metadata defaults to `{}`.  A batch takes lines of a
    file as long as they are `batch_bytes` together, however Spark splits the file;
    only the end of a file ends a batch early.  A task sees the line sizes of one
    split.  It says what becomes of every batch that may come in from the split
    before; one task passes over these tables, each of at most the lines of
    `batch_bytes`, and lines are numbered split by split again.  A line over
    `batch_bytes`, a line that is no record and a file without records are errors.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    lines = lines.where(F.trim("value") != "").withColumn("_bytes", F.octet_length("value") + 1)
    parsed = lines.withColumn("_j", F.try_parse_json("value"))
    vector = F.try_variant_get("_j", "$.vector", "array<float>")
    identity = F.try_variant_get("_j", "$.id", "string")
    metadata = F.coalesce(F.to_json(F.try_variant_get("_j", "$.metadata", "variant")), F.lit("{}"))
    row = parsed.select(
        "_file", "_block", "_line", "_bytes", F.lit("put").alias("op"),
        F.when(identity.isNotNull(), identity).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.substring("value", 1, 80)))).alias("id"),
        F.when(vector.isNotNull(), vector).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.substring("value", 1, 80)))).alias("vector"),
        metadata.alias("metadata"),
    )
    summary = lines.agg(F.count("*").alias("n"), F.max("_bytes").alias("most")).first()
    if not summary["n"]:
        raise InvalidArgument(f"{path} holds no records")
    if summary["most"] > batch_bytes:
        raise InvalidArgument(f"a line of {path} is longer than {batch_bytes} bytes")
    ship(spark)
    sizes = lines.select("_file", "_block", "_line", F.col("_bytes").cast("long").alias("_bytes"))
    split = ["_file", "_block"]
    passages = sizes.groupBy(*split).applyInPandas(lambda d: passage(d, batch_bytes), "_file string, _block long, cuts array<long>, begun array<long>, fills array<long>")
    entries = passages.repartition(1).sortWithinPartitions(*split).mapInPandas(lambda ds: entered(ds, batch_bytes), "_file string, _block long, _fill long, _before long")
    taken = sizes.join(entries, split).groupBy(*split).applyInPandas(lambda d: numbered(d, batch_bytes), "_file string, _block long, _line long, batch long")
    placed = row.join(taken, ["_file", "_block", "_line"])
    return placed.select(F.struct("_file", "_block", "_line").alias("ord"), "batch", "op", "id", "vector", "metadata")


def following(total: np.ndarray, limit: int) -> np.ndarray:
    """For each line the one that begins the next batch if it begins one; `total` are the bytes before each line, and of all."""
    return np.searchsorted(total, total[:-1] + limit, "right") - 1


def totals(d: pd.DataFrame) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(d["_bytes"].to_numpy())])


def passage(d: pd.DataFrame, limit: int) -> pd.DataFrame:
    """How batches pass through a split.

    A batch that comes in with `fill` bytes takes all lines up to the first whose end
    is over `limit - fill`.  `cuts` are the bytes before each line that may be that
    one, and last those of the whole split if a batch may go through it; `begun` and
    `fills` say how many batches then begin here and how full the last one is.
    """
    d = d.sort_values("_line")
    total = totals(d)
    lines, step = len(d), following(total, limit)
    last = np.where(step == lines, np.arange(lines), step)
    begun = (step < lines).astype(np.int64)
    while True:  # twice as many batches ahead each time
        further = last[last]
        if np.array_equal(further, last):
            break
        begun, last = begun + begun[last], further
    most = np.searchsorted(total, limit, "right") - 1
    through = most == lines
    chosen = np.arange(min(most + 1, lines))
    cuts, counts, fills = total[chosen].tolist(), (begun[chosen] + 1).tolist(), (total[-1] - total[last[chosen]]).tolist()
    if through:
        cuts.append(int(total[-1]))
        counts.append(0)
        fills.append(int(total[-1]))
    return pd.DataFrame({"_file": [d["_file"].iloc[0]], "_block": [d["_block"].iloc[0]], "cuts": [cuts], "begun": [counts], "fills": [fills]})


def entered(passages: Iterable[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """How full the batch is that comes into each split, and how many have begun before; splits come in order."""
    name, fill, before = None, limit, 0
    for d in passages:
        rows = []
        for r in d.itertuples(index=False):
            if r[0] != name:
                name, fill = r[0], limit
            rows.append((r[0], r[1], fill, before))
            at = int(np.searchsorted(np.asarray(r[2]), limit - fill, "right")) - 1
            fill = int(r[4][at]) + (fill if r[3][at] == 0 else 0)
            before += int(r[3][at])
        yield pd.DataFrame(rows, columns=["_file", "_block", "_fill", "_before"])


def numbered(d: pd.DataFrame, limit: int) -> pd.DataFrame:
    """The batch of each line of a split."""
    d = d.sort_values("_line")
    total = totals(d)
    step, starts = following(total, limit), []
    at = int(np.searchsorted(total, limit - d["_fill"].iloc[0], "right")) - 1
    while at < len(d):
        starts.append(at)
        at = int(step[at])
    own = np.searchsorted(np.array(starts, np.int64), np.arange(len(d)), "right")
    return d[["_file", "_block", "_line"]].assign(batch=d["_before"].to_numpy() + own - 1)
