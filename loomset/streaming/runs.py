"""Running peaks and speeds of a request, with resets: an arbitrary stateful processor.

Samples wait in the state until the watermark has passed them and are then
taken in order of time, so batch borders and the order of arrival leave no
trace. A run ends with a reset row, or after ``idle`` without a sample; it is
emitted once, and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = "us bigint, reset boolean, cpu double, system_memory double"
_RUN = "first_us bigint, last_us bigint, n bigint, n_times bigint, cpu_sum double, cpu_n bigint, cpu_max double, peak double"
_OUT = "run_start bigint, run_end bigint, n_samples bigint, cpu_avg double, cpu_max double, system_memory_peak double, sample_speed double"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which ``stream_runs`` needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Runs(StatefulProcessor):
    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.run = handle.getValueState("run", _RUN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        taken = [(row.us, row.reset, row.cpu, row.system_memory) for row in rows if row.us is not None]
        if taken and key[0] is not None:
            self.waiting.appendList(taken)
            self._wake(min(row[0] for row in taken))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(row) for row in self.waiting.get()] if self.waiting.exists() else []
        # A reset at the time of a sample comes before it.
        due = sorted((row for row in rows if row[0] < passed), key=lambda row: (row[0], not row[1]))
        rest = [row for row in rows if row[0] >= passed]
        run = list(self.run.get()) if self.run.exists() else None
        ended = []
        for us, reset, cpu, memory in due:
            if run and (reset or us - run[1] > self.idle_us):
                ended.append(run)
                run = None
            if not reset:
                run = _with(run, us, cpu, memory)
        if run and run[1] + self.idle_us < passed:
            ended.append(run)
            run = None
        if due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if run:
            self.run.update(tuple(run))
        else:
            self.run.clear()
        if rest:
            self._wake(min(row[0] for row in rest))
        if run:
            self._wake(run[1] + self.idle_us)
        return iter([_summary(key[0], *run) for run in ended])

    def _wake(self, us: int) -> None:
        """A timer for when the watermark has passed that time."""
        self.handle.registerTimer(us // 1000 + 1)


def _with(run: list | None, us: int, cpu: float | None, memory: float | None) -> list:
    """The run with one more sample, whose time is not before the last."""
    if run is None:
        run = [us, us, 0, 1, 0.0, 0, None, 0.0]
    first, last, n, times, cpu_sum, cpu_n, cpu_max, peak = run
    if cpu is not None:
        cpu_sum, cpu_n, cpu_max = cpu_sum + cpu, cpu_n + 1, cpu if cpu_max is None else max(cpu_max, cpu)
    return [first, us, n + 1, times + (us > last), cpu_sum, cpu_n, cpu_max, max(peak, memory or 0.0)]


def _summary(request, first, last, n, times, cpu_sum, cpu_n, cpu_max, peak) -> Row:
    return Row(
        request_id=request,
        run_start=first,
        run_end=last,
        n_samples=n,
        cpu_avg=cpu_sum / cpu_n if cpu_n else None,
        cpu_max=cpu_max,
        system_memory_peak=peak,
        sample_speed=(times - 1) * 1e6 / (last - first) if times > 1 else None,
    )


def stream_runs(samples: DataFrame, idle_seconds: int = 30, delay: str = "10 seconds") -> DataFrame:
    """One row per run of samples (request_id, ts, reset, cpu, system_memory); batch twin ``operators.telemetry.run_summary``.

    A row with ``reset`` true is no sample: it ends the run before it. Rows
    without time or request take no part; a NULL ``reset`` is none, missing
    readings do not count. Columns: request_id, run_start, run_end, n_samples,
    cpu_avg, cpu_max, system_memory_peak, sample_speed (times per second after
    the first). A request's state holds the rows of one ``delay`` and a single
    running row. Start the query inside ``state_on_disk``.
    """
    rows = samples.withWatermark("ts", delay).select(
        "request_id",
        "ts",
        F.unix_micros("ts").alias("us"),
        F.coalesce("reset", F.lit(False)).alias("reset"),
        F.col("cpu").cast("double").alias("cpu"),
        F.col("system_memory").cast("double").alias("system_memory"),
    )
    out = StructType([samples.schema["request_id"], *StructType.fromDDL(_OUT).fields])
    runs = rows.groupBy("request_id").transformWithState(
        statefulProcessor=_Runs(idle_seconds * 1_000_000), outputStructType=out, outputMode="append", timeMode="eventTime"
    )
    return runs.withColumns({c: F.timestamp_micros(c) for c in ("run_start", "run_end")})
