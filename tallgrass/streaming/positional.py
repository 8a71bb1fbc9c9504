"""Positional aggregation as a stream: groups are given out once position has passed their end (ST1).

Rows carry a position, the end of their group and a member that a group may have once. The watermark is the greatest
position of earlier micro-batches. It moves by clock rows, one per Arrow batch of input; the data rows have no event time
of their own, so that Spark drops none of them: a row of a group whose end the watermark has reached is reported as late,
and a member that a live group has already is reported as repeated. A group is dealt to shards by its members, each with
its own state and timer, so that a hot group is not one key; shards are summed when the output is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Columns of input rows (position and end in milliseconds), and of what the stream gives out.
ROWS = "group_id string, member string, position long, end long, value long"
OUT = "kind string, group_id string, member string, position long, n long, value long"
COLUMNS = [f.split(" ")[0] for f in OUT.split(", ")]
#: Parts of a group by its members' hashes.
SHARDS = 16
#: The group of clock rows.
CLOCK = ""


def window_counts(events: DataFrame, time: str, keys: list[str], width: str, delay: str) -> DataFrame:
    """Counts and sums per window and keys. On a stream a window is emitted once the watermark has passed its end."""
    d = events.withWatermark(time, delay) if events.isStreaming else events
    return d.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("rows"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), *keys, "rows", "value")


def with_clock(rows: DataFrame) -> DataFrame:
    """The rows with no event time t, and a clock row with the greatest position of every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            last = np.nanmax(b.column(2).to_numpy(zero_copy_only=False).astype("float64"))
            none = pa.nulls(b.num_rows, pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([*b.columns, none], names=[*b.schema.names, "t"])
            if last == last:
                at = int(last)
                clock = [[CLOCK], [""], [at], [at], [0]]
                columns = [*(pa.array(c, f.type) for c, f in zip(clock, b.schema, strict=True)), pa.array([at * 1000], pa.timestamp("us", "UTC"))]
                yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "t"])

    return rows.select("group_id", "member", "position", "end", "value").mapInArrow(run, f"{ROWS}, t timestamp")


def shard(member: str = "member", shards: int = SHARDS):
    return F.pmod(F.xxhash64(member), F.lit(shards)).cast("int")


def positional_aggregate(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The stream's output rows: kind group (n members and the sum of their values in a shard), late or repeated.

    The position of a group is its end. Rows of one micro-batch and shard are taken in the order of their positions.

    Open groups stay in the state until a later position comes; a last file with one row far ahead closes all.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        group, out = key[0], []
        if state.hasTimedOut:
            n, value, end, _ = state.get
            state.remove()
            yield pd.DataFrame([("group", group, None, end, n, value)], columns=COLUMNS)
            return
        if group == CLOCK:
            return
        now = state.getCurrentWatermarkMs()
        n, value, end, seen = state.get if state.exists else (0, 0, 0, "[]")
        members = set(json.loads(seen))
        for row in pd.concat(frames).sort_values(["position", "value"]).itertuples(index=False):
            if row.end <= now:
                out.append(("late", group, row.member, row.position, 1, row.value))
            elif row.member in members:
                out.append(("repeated", group, row.member, row.position, 1, row.value))
            else:
                members.add(row.member)
                n, value, end = n + 1, value + row.value, row.end
        if n and end <= now:  # late rows came before the timer
            out.append(("group", group, None, end, n, value))
            state.remove()
        elif n:
            state.update((n, value, end, json.dumps(sorted(members))))
            state.setTimeoutTimestamp(end - 1)  # timers fire once the watermark is past them: at end
        yield pd.DataFrame(out, columns=COLUMNS)

    keyed = with_clock(rows).withColumn("shard", shard("member", shards)).withWatermark("t", "0 seconds")
    state = "n long, value long, end long, members string"
    return keyed.groupBy("group_id", "shard").applyInPandasWithState(step, OUT, state, "append", GroupStateTimeout.EventTimeTimeout)


def totals(out: DataFrame) -> DataFrame:
    """Groups with their shards summed, and late and repeated rows: kind, group_id, member, position, n, value."""
    return out.groupBy("kind", "group_id", "member", "position").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))


def replay(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """What the stream gives for rows in numbered micro-batches, as a batch, all groups closed.

    A row is late if its group's end is at most the greatest position of earlier micro-batches.
    """
    clock = rows.groupBy(batch).agg(F.max("position").alias("last"))
    clock = clock.withColumn("now", F.max("last").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)))  # a row per micro-batch
    d = rows.join(clock.select(batch, "now"), batch)
    late = F.coalesce(F.col("end") <= F.col("now"), F.lit(False))
    order = Window.partitionBy("group_id", "member", late).orderBy(batch, "position", "value")
    kind = F.when(late, "late").when(F.row_number().over(order) > 1, "repeated").otherwise("group")
    d = d.withColumn("kind", kind)
    plain = F.col("kind") == "group"
    d = d.withColumns({"member": F.when(~plain, F.col("member")), "position": F.when(plain, F.col("end")).otherwise(F.col("position"))})
    return d.groupBy("kind", "group_id", "member", "position").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what there is, appends Parquet, and ends."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
