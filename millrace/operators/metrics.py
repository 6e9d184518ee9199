"""Run statistics that are gathered while another action runs, so that nothing is read twice."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def chunk_metrics(text: str = "text", duration: str | None = None) -> dict[str, Column]:
    """Aggregates over chunks: their number, empty ones, sizes and, with ``duration`` (a column of seconds), durations.

    The medians and 95th percentiles are sketches, right to a thousandth of the rows.
    """
    size = F.coalesce(F.length(text), F.lit(0))
    found = {
        "n_chunks": F.count(F.lit(1)), "n_empty": F.count_if(size == 0), "n_chars": F.coalesce(F.sum(size), F.lit(0)), "n_bytes": F.coalesce(F.sum(F.octet_length(text)), F.lit(0)),
        "longest": F.max(size), "size_median": F.percentile_approx(size, 0.5, 1000), "size_95": F.percentile_approx(size, 0.95, 1000),
    }
    if duration:
        found |= {"seconds": F.sum(duration), "most_seconds": F.max(duration), "seconds_median": F.percentile_approx(duration, 0.5, 1000), "seconds_95": F.percentile_approx(duration, 0.95, 1000)}
    return found


def media_stats(chunks: DataFrame, group: str = "media_id", text: str = "text", duration: str | None = None) -> DataFrame:
    """``chunk_metrics`` of each media item, as a table."""
    return chunks.groupBy(group).agg(*[c.alias(n) for n, c in chunk_metrics(text, duration).items()])


def observed(df: DataFrame, metrics: dict[str, Column], name: str = "run") -> tuple[DataFrame, Observation]:
    """``df``, and what its first action finds besides: ``observation.get`` once that has run."""
    observation = Observation(name)
    return df.observe(observation, *[c.alias(n) for n, c in metrics.items()]), observation


def observed_stream(df: DataFrame, metrics: dict[str, Column], name: str = "run") -> DataFrame:
    """A stream whose batches report ``metrics`` to listeners under ``name``."""
    return df.observe(name, *[c.alias(n) for n, c in metrics.items()])


class StreamMetrics(StreamingQueryListener):
    """Keeps what the batches of observed streams report: by name a list of (batch, values). Register it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.found: dict[str, list[tuple[int, dict]]] = {}
        self._lock = threading.Lock()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        with self._lock:
            for name, row in event.progress.observedMetrics.items():
                self.found.setdefault(name, []).append((event.progress.batchId, row.asDict()))

    def total(self, name: str) -> dict:
        """Counts and sums added up, maxima taken, over batches that have rows; a batch that Spark repeats counts once."""
        with self._lock:
            rows = [r for _, r in sorted(dict(self.found.get(name, [])).items()) if r["n_chunks"]]
        most = lambda k: max((r[k] for r in rows if r[k] is not None), default=None)
        return {k: sum(r[k] for r in rows) for k in ("n_chunks", "n_empty", "n_chars", "n_bytes")} | {"longest": most("longest")}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
