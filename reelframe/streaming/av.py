"""Streaming forms: live packet counts, stateful reassembly, bounded re-ordering, and the player's late-frame policy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_packets(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of packet rows from Parquet files that arrive below a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, every: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts by tumbling window of event time; rows later than the watermark are dropped (an extension of ours)."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def _fold(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(pdfs), ignore_index=True).sort_values("seq", kind="stable")


def reassemble(fragments: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """Fragments (path, stream_index, seq, start, size) as finished units; state is the open unit of each stream.

    A unit comes out when the next one starts; what is open when a stream has had no rows for idle_ms comes out then, and
    fragments that follow belong to no unit until one starts. Units are numbered on through such pauses.
    """

    def run(key, pdfs, state: GroupState):
        unit, first, n, size = state.get if state.exists else (0, 0, 0, 0)
        out = []
        if state.hasTimedOut:  # the open unit is done; the number stays, so that later units go on from it
            state.update((unit, 0, 0, 0))
            yield pd.DataFrame([(*key, unit, n, size, first)] if n else [], columns=names)
            return
        for r in _fold(pdfs).itertuples(index=False):
            if r.start:
                if n:
                    out.append((*key, unit, n, size, first))
                unit, first, n, size = unit + 1, int(r.seq), 0, 0
            if n or r.start:
                n, size = n + 1, size + int(r.size)
        state.update((unit, first, n, size))
        if n:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    names = ["path", "stream_index", "unit", "fragments", "bytes", "first_seq"]
    kinds = dict(fragments.dtypes)
    return fragments.groupBy("path", "stream_index").applyInPandasWithState(run, f"path {kinds['path']}, stream_index {kinds['stream_index']}, unit long, fragments long, bytes long, first_seq long", "unit long, first long, n long, size long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def reorder(frames: DataFrame, depth: int = 4, idle_ms: int = 60_000) -> DataFrame:
    """Frames (path, seq, poc[, last]) in the order of showing: each stream holds back `depth` frames, the smallest go out.

    All that are held go out when a frame is marked `last` (an optional column), and when a stream has had no frames for
    idle_ms.
    """
    marked = "last" in frames.columns

    def run(key, pdfs, state: GroupState):
        held, shown = (list(zip(state.get[0], state.get[1], strict=True)), state.get[2]) if state.exists else ([], 0)
        out = []

        def drain():
            nonlocal held, shown
            for poc, seq in sorted(held):
                out.append((*key, seq, poc, shown))
                shown += 1
            held = []

        if state.hasTimedOut:
            drain()
            state.update(([], [], shown))
            yield pd.DataFrame(out, columns=names)
            return
        for r in _fold(pdfs).itertuples(index=False):
            held.append((int(r.poc), int(r.seq)))
            if len(held) > depth:
                held.sort()
                poc, seq = held.pop(0)
                out.append((*key, seq, poc, shown))
                shown += 1
            if marked and r.last:
                drain()
        state.update(([p for p, _ in held], [s for _, s in held], shown))
        if held:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    names, kinds = ["path", "seq", "poc", "shown"], dict(frames.dtypes)
    return frames.groupBy("path").applyInPandasWithState(run, f"path {kinds['path']}, seq long, poc long, shown long", "pocs array<long>, seqs array<long>, shown long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def late_drop(frames: DataFrame, nominal: float = 0.04) -> DataFrame:
    """Frames (path, seq, time, arrival) with shown: whether a player that is at `arrival` still shows the frame.

    A frame is dropped if another is waiting and the clock is past the frame's timer plus its duration; durations that
    aren't positive or exceed ten seconds count as nominal.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        times, arrivals = pdf["time"].tolist(), pdf["arrival"].tolist()
        timer, out = None, []
        for i, (t, clock) in enumerate(zip(times, arrivals, strict=True)):
            step = t - times[i - 1] if i else nominal
            step = step if 0 < step <= 10 else nominal
            timer = clock if timer is None else timer + step
            waiting = i + 1 < len(times) and arrivals[i + 1] <= clock
            out.append(not (waiting and clock > timer + step))
            if clock - timer > 0.1:
                timer = clock
        return pdf[["path", "seq"]].assign(shown=out)

    kinds = dict(frames.dtypes)
    return frames.select("path", "seq", "time", "arrival").groupBy("path").applyInPandas(run, f"path {kinds['path']}, seq {kinds['seq']}, shown boolean")
