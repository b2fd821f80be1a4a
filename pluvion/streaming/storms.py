"""Sessions of activity by keyed streaming timers.

The state holds the active hours of the open sessions, each hour once. A micro-batch adds its hours; an hour within the gap extends a session and resets its
timer. When the watermark passes the gap behind a session's last hour, no hour can join it any more: the timer expires and the session is emitted with its
start, end and number of active hours. So a session is emitted once, and how the feed is cut into micro-batches changes nothing, as long as no hour arrives
later than the watermark's delay. Series share state keys, whose number grows with the data; a key's timer stands at the first end among its open sessions.

A table is replayed in slices of time, oldest first, so that the state holds the sessions of a slice or two and not those of the whole table.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pluvion.scratch import shared_path, written

#: The marker row of the end of a bounded replay: it moves the watermark past every timer. The latest year that pandas can hold.
END_OF_INPUT = "2262-01-01 00:00:00"
HOUR_MS = 3_600_000
#: Rows of a slice of a replay, of a part of a slice, and of a state key in one.
SLICE_ROWS, PART_ROWS, KEY_ROWS = 50_000_000, 1_000_000, 8192


def packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def runs(rows: pd.DataFrame, keys: list[str], hour: str, gap: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The distinct hours in order, and the sessions that they form: keys, from_i, to_i, n_active. Sessions follow the order of the hours."""
    rows = rows.drop_duplicates().sort_values([*keys, hour], ignore_index=True)
    at = rows[hour].to_numpy()
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = at[1:] - at[:-1] > gap
    for k in keys:
        v = rows[k].to_numpy()
        fresh[1:] |= v[1:] != v[:-1]
    first = np.flatnonzero(fresh)
    end = np.append(first[1:], len(rows))
    out = rows.iloc[first][keys].reset_index(drop=True)
    out["from_i"], out["to_i"], out["n_active"] = at[first], at[end - 1], end - first
    return rows, out


def sessions(events: DataFrame, keys: list[str], hour: str, gap: int, delay: str = "0 seconds", state_keys: int = 4096) -> DataFrame:
    """One row per session of a streaming ``events`` (columns: keys, ``hour``, ``event_ts``, the end of the hour): keys, from_i, to_i, n_active.

    Two hours belong together unless they lie more than ``gap`` hours apart. Repeated hours count once. Hours are 0 or more. An hour that arrives more than
    ``delay`` behind the latest one seen in earlier micro-batches is late and not counted.
    """
    types = {f.name: f.dataType for f in events.schema.fields}
    columns = [*keys, "from_i", "to_i", "n_active"]
    out = T.StructType([T.StructField(k, types[k]) for k in keys] + [T.StructField(n, T.IntegerType()) for n in columns[len(keys) :]])
    held = T.StructType([T.StructField("hours", T.BinaryType())])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            return
        rows = [unpacked(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            # distinct hours of each arrow batch first, so that repeated rows never pile up
            rows += [b[[*keys, hour]].drop_duplicates() for b in batches]
        rows, found = runs(pd.concat(rows), keys, hour, gap)
        ends = (found["to_i"].to_numpy(np.int64) + gap + 1) * HOUR_MS
        done = ends <= state.getCurrentWatermarkMs()
        if done.all():
            state.remove()
        else:
            state.update((packed(rows[np.repeat(~done, found["n_active"])]),))
            state.setTimeoutTimestamp(max(int(ends[~done].min()), state.getCurrentWatermarkMs() + 1))
        if done.any():
            yield found.loc[done, columns].astype({c: "int32" for c in columns[len(keys) :]})

    # the marker of the end only moves the watermark; it has a key of its own
    shared = F.when(F.col(keys[0]).isNotNull(), F.pmod(F.xxhash64(*keys), F.lit(state_keys))).otherwise(-1).cast("int").alias("_shared")
    return (
        events.withWatermark("event_ts", delay)
        .select(shared, *keys, hour, "event_ts")
        .groupBy("_shared")
        .applyInPandasWithState(update, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    )


def feed(rows: DataFrame, keys: list[str], bounds: list[int], slice_rows: int) -> tuple[str, int]:
    """Writes the hours to the shared folder, one slice of time after the other, and the marker last; gives the folder and the files of a slice on average.

    The slices are shuffled apart first, each in parts of about ``PART_ROWS`` rows, so that the number of files grows with the rows only.
    """
    slices = len(bounds) + 1
    spark = rows.sparkSession
    path = shared_path(spark, "hours")
    if slices == 1:
        rows.write.parquet(path)
    else:
        no = F.lit(0)
        for b in bounds:
            no = no + F.when(F.col("_hour") > b, 1).otherwise(0)
        part = F.pmod(F.xxhash64(*keys), F.lit(max(1, slice_rows // PART_ROWS)))
        staged = written(rows.withColumn("_slice", no).repartition("_slice", part), "staged-hours", ["_slice"])
        for i in range(slices):
            staged.where(F.col("_slice") == i).select(*rows.columns).write.mode("append").parquet(path)
    files = -(-len(spark.read.schema(rows.schema).parquet(path).inputFiles()) // slices)
    marker = spark.range(1).select(*[F.lit(END_OF_INPUT).cast("timestamp").alias(f.name) if f.name == "event_ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    marker.coalesce(1).write.mode("append").parquet(path)
    return path, max(1, files)


def replay_sessions(table: DataFrame, active: Column, keys: list[str], hour: str, gap: int = 24, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Sessions of a stored table, replayed as a stream: keys, from_i, to_i, n_active.

    ``active`` is the condition that makes a row an event. NULL keys or hours are no events; an empty table gives no rows; other columns are ignored, and
    repeated rows count once. The slices are cut at quantiles of the hour, so that each has about ``slice_rows`` rows.
    """
    spark = table.sparkSession
    event = active & F.col(hour).isNotNull()
    for k in keys:
        event = event & F.col(k).isNotNull()
    # the end of the hour: the first watermark is 1970-01-01 and hour 0 must not be late for it
    stamp = F.timestamp_seconds((F.col(hour).cast("long") + 1) * (HOUR_MS // 1000)).alias("event_ts")
    rows = table.where(event).select(*keys, F.col(hour).cast("int").alias("_hour"), stamp)
    n, lo, hi = rows.agg(F.count("*"), F.min("_hour"), F.max("_hour")).first()
    slices = max(1, -(-n // slice_rows))
    bounds = []
    if slices > 1:
        # as many numbers as slices less one
        bounds = sorted(set(rows.agg(F.percentile_approx("_hour", [i / slices for i in range(1, slices)], 100 * slices)).first()[0]))
    path, files = feed(rows, keys, bounds, slice_rows)
    # files are read in the order in which they were written; a micro-batch that ends within a slice must not make the rest of it late
    span = max(b - a for a, b in zip([lo, *bounds], [*bounds, hi])) if bounds else 0
    per_key = 64 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    found = sessions(events, keys, "_hour", gap, f"{span} hours", max(per_key, min(n, slice_rows) // KEY_ROWS, n // (64 * KEY_ROWS)))
    out, log = shared_path(spark, "sessions"), shared_path(spark, "sessions-log")
    run = found.writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)
