"""``spark.read`` and ``readStream`` of logs that transcribers append to: ``format("chunk_log")``.

A log is a folder of ``*.jsonl`` files, each written by one transcriber, a JSON object a line: ``media_id``, ``idx``,
``text`` and, if known, ``ts`` (seconds). Spark's own file source reads a file once and misses what is added to it later;
this one's offset is the bytes read of each file, so a stream goes on behind the last whole line, after a restart too.
A line without its end waits for it. A broken line or one without ``media_id`` and ``idx`` is passed over.

Options: ``path``, and ``splitBytes``, the size of the pieces that one task reads (64 MB).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SPLIT_BYTES, BLOCK = 64 << 20, 1 << 16


class Piece(InputPartition):
    """Bytes of a file: the lines that begin in them."""

    def __init__(self, name: str, begin: int, end: int, most: int) -> None:
        self.name, self.begin, self.end, self.most = name, begin, end, most  # ``most``: what may be read of the file


class _Log:
    def __init__(self, options: dict[str, str]) -> None:
        path = options["path"]
        self.uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def sizes(self) -> dict[str, int]:
        """Each file's bytes up to its last line's end."""
        from pyarrow import fs

        files, folder = self.open()
        out = {}
        for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if not f.base_name.endswith(".jsonl") or f.base_name[0] in "._":
                continue
            with files.open_input_file(f.path) as held:
                end = f.size
                while end > 0:  # backwards to the last line's end
                    begin = max(0, end - BLOCK)
                    held.seek(begin)
                    at = held.read(end - begin).rfind(b"\n")
                    if at >= 0:
                        end = begin + at + 1
                        break
                    end = begin
            if end:
                out[f.base_name] = end
        return out

    def pieces(self, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
        out = []
        for name, most in sorted(end.items()):
            first = start.get(name, 0)
            out += [Piece(name, at, min(at + self.split, most), most) for at in range(first, most, self.split)]
        return out

    def rows(self, piece: Piece) -> Iterator[tuple]:
        files, folder = self.open()
        with files.open_input_file(f"{folder}/{piece.name}") as held:
            at = piece.begin
            if at:  # a line belongs to the piece that it begins in
                held.seek(at - 1)
                at += len(_line(held)) - 1
            held.seek(at)
            while at < min(piece.end, piece.most):
                line = _line(held)
                if not line:
                    return
                at += len(line)
                held.seek(at)
                row = _row(line)
                if row is not None:
                    yield row


def _line(held) -> bytes:
    """From where the file stands to the line's end."""
    parts = []
    while part := held.read(BLOCK):
        end = part.find(b"\n")
        parts.append(part if end < 0 else part[: end + 1])
        if end >= 0:
            break
    return b"".join(parts)


def _row(line: bytes) -> tuple | None:
    try:
        got = json.loads(line)
        text, ts = got.get("text"), got.get("ts")
        when = None if ts is None else datetime.fromtimestamp(float(ts), UTC)
        return int(got["media_id"]), int(got["idx"]), None if text is None else str(text), "failed" if text is None else "ok", when
    except (ValueError, TypeError, KeyError, AttributeError, OverflowError):
        return None


class _Batch(DataSourceReader):
    def __init__(self, log: _Log) -> None:
        self.log = log

    def partitions(self) -> list[Piece]:
        return self.log.pieces({}, self.log.sizes())

    def read(self, partition: Piece | None) -> Iterator[tuple]:
        if partition is not None:  # an empty log has none
            yield from self.log.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, log: _Log) -> None:
        self.log = log

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.log.sizes()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.log.pieces(start, end)

    def read(self, partition: Piece) -> Iterator[tuple]:
        yield from self.log.rows(partition)

    def commit(self, end: dict) -> None:
        pass  # the files stay


class ChunkLog(DataSource):
    """``media_id``, ``idx``, ``text``, ``status`` (ok, or failed without a text), ``ts``."""

    @classmethod
    def name(cls) -> str:
        return "chunk_log"

    def schema(self) -> str:
        return "media_id long, idx int, text string, status string, ts timestamp"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(_Log(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(_Log(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ChunkLog)
