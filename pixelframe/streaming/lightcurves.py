"""Light curves from a stream of measurements (src, value, ts): windows with watermarks, and running fits as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string"


def measurements(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The stream: files that appear in a folder. Times are cast so that a watermark may be set."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return raw.select(F.col("user_id").alias("src"), "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


def tumbling(stream: DataFrame, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and mean value of each window and kind; a window is emitted once the watermark passes its end."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Measurements of one source closer than `gap` form a session."""
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "src").agg(F.count(F.lit(1)).alias("n"))
    return out.select("src", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_flux(stream: DataFrame) -> DataFrame:
    """Flux of each source so far, as the state of its normal equations: sum of weights and of weighted values. Three numbers a source."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a, b, n = state.get if state.exists else (0.0, 0.0, 0)
        for p in parts:
            a, b, n = a + len(p), b + float(p.value.sum()), n + len(p)
        state.update((a, b, n))
        yield pd.DataFrame({"src": [key[0]], "flux": [b / a if a else 0.0], "n": [n]})

    return stream.groupBy("src").applyInPandasWithState(update, "src long, flux double, n long", "a double, b double, n long", "update", GroupStateTimeout.NoTimeout)


#: Sources whose open visits are one state: a call of Python costs some milliseconds, whatever its rows.
BLOCK = 64
_VISIT = ["src", "first", "last", "n", "t", "tt", "v", "tv"]


def _visits(rows: pd.DataFrame, idle: float) -> pd.DataFrame:
    """One row for each run of a source's measurements without a longer gap, in order: its times and the sums of a line's normal equations about the first."""
    rows = rows[["src", "us", "value"]].sort_values(["src", "us"])
    src, us, v = rows.src.to_numpy("int64"), rows.us.to_numpy("int64"), rows.value.to_numpy(float)
    at = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (us[1:] - us[:-1] > idle * 1e6)]))
    n = np.diff(np.append(at, len(us)))
    h = (us - np.repeat(us[at], n)) / 3.6e9
    sums = [np.add.reduceat(x, at) for x in (h, h * h, v, h * v)]
    return pd.DataFrame(dict(zip(_VISIT, (src[at], us[at], us[at + n - 1], n, *sums), strict=True)))


def _about(s: pd.DataFrame, first: pd.Series) -> pd.DataFrame:
    """The same visits with their sums about earlier first times."""
    d = (s["first"] - first) / 3.6e9
    return s.assign(first=first, t=s.t + s.n * d, tt=s.tt + 2 * d * s.t + s.n * d * d, tv=s.tv + d * s.v)


def visit_fits(stream: DataFrame, idle: float, late: str) -> DataFrame:
    """src, start, end, n, flux, slope of each visit that has ended: a line through the values of one source, as long as none comes more than `idle` seconds after the one before.

    The state of a source is its open visit: times of its first and last measurement, and the sums
    of a line's normal equations about the first, whatever their number. A measurement after a
    longer gap closes a visit, and so does a timer once the watermark has passed its end by
    `idle`. flux is the mean value; slope, per hour, is null where all times are equal. Rows without
    a time, value or source are left out. Batches must come in the order of their times, to within
    `idle`; inside a batch any order will do. BLOCK sources with neighbouring numbers share a state
    and its timer, set for the first of their visits to end; a task holds their rows of one batch.
    """

    def ended(s: pd.DataFrame) -> pd.DataFrame:
        det = s.n * s.tt - s.t * s.t
        slope = ((s.n * s.tv - s.t * s.v) / det.where(det > 0)).where(s["last"] > s["first"])
        first, last = (pd.to_datetime(s[c].astype("int64"), unit="us") for c in ("first", "last"))
        return pd.DataFrame({"src": s.src.astype("int64"), "start": first, "end": last, "n": s.n.astype("int64"), "flux": s.v / s.n, "slope": slope})

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = pd.DataFrame(dict(zip(_VISIT, map(np.array, state.get), strict=True))) if state.exists else None
        mark, out = state.getCurrentWatermarkMs(), []
        rows = None if state.hasTimedOut else pd.concat(list(parts))
        if open_ is not None:
            over = open_["last"] // 1000 + int(idle * 1000) < mark
            if rows is not None:
                over &= ~open_.src.isin(rows.src)
            out.append(open_[over])
            open_ = open_[~over]
        if rows is not None:
            made = _visits(rows, idle)
            if open_ is not None and len(open_):
                head = made.drop_duplicates("src").reset_index().set_index("src", drop=False)  # each source's first visit of the batch
                had = open_.set_index("src", drop=False)
                both = had.index.intersection(head.index)
                on = both[(head.loc[both, "first"] - had.loc[both, "last"] <= idle * 1e6).to_numpy()]
                if len(on):  # the open visit goes on
                    first = np.minimum(had.loc[on, "first"], head.loc[on, "first"])
                    x, y = _about(had.loc[on], first), _about(head.loc[on, _VISIT], first)
                    sums = ["n", "t", "tt", "v", "tv"]
                    x[sums] += y[sums]
                    x["last"] = np.maximum(x["last"], y["last"])
                    made.loc[head.loc[on, "index"], _VISIT] = x[_VISIT].to_numpy()
                out.append(had.loc[both.difference(on)])
                open_ = had.drop(both)
            last = ~made.src.duplicated(keep="last")
            out.append(made[~last])
            open_ = made[last] if open_ is None or not len(open_) else pd.concat([open_, made[last]])
        if len(open_):
            state.update(tuple([(int if c in _VISIT[:4] else float)(x) for x in open_[c]] for c in _VISIT))
            state.setTimeoutTimestamp(max(int(open_["last"].min()) // 1000 + int(idle * 1000), mark + 1))
        else:
            state.remove()
        out = [ended(s) for s in out if len(s)]
        if out:
            yield pd.concat(out)

    rows = stream.withWatermark("ts", late).where("src IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL").select("src", "ts", "value", F.unix_micros("ts").alias("us"), F.floor(F.col("src") / BLOCK).alias("block"))
    state = "src array<long>, first array<long>, last array<long>, n array<long>, t array<double>, tt array<double>, v array<double>, tv array<double>"
    out = "src long, start timestamp_ntz, end timestamp_ntz, n long, flux double, slope double"
    return rows.groupBy("block").applyInPandasWithState(update, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet with a checkpoint in the shared folder, and read the result."""
    spark = stream.sparkSession
    out, mark = f"{folder}/{name}-out", f"{folder}/{name}-mark"
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
