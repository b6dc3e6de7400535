"""Folders of raw daily trade files as a Spark data source, for batches and for streams.

A file is a partition.  Conditions on ``day`` and ``symbol`` are taken into the
listing, so that only the files they leave are opened; archives are read as they
decompress, a bounded chunk at a time.  As a stream, the files come in the order
of their days; the offset is the last day that was taken.

    spark.dataSource.register(DailyTrades)
    spark.read.format("daily_trades").load(folder).where("day >= DATE'2024-01-05'")

Options: ``path``, ``limitFiles`` (the first so many by name), ``daysPerBatch``
(streams: days to a micro-batch; by default all that are there), ``progress`` (a
file that keeps the last day taken, for a stream with ``daysPerBatch`` that is
to be started again).  Files without
a day in their name have a null day and are no part of streams.  A folder
without files raises; one whose files a condition leaves out gives no rows.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Fixed value: the columns of a headerless daily trade file, by position.
RAW_COLUMNS = ["trade_id", "price", "qty", "quote_qty", "time", "is_buyer_maker", "is_best_match"]
#: Lines that are decompressed and parsed together.
CHUNK = 100_000
_COMPARE = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


@dataclass
class DayFile(InputPartition):
    """One file: where it is, its day, and what stands before ``-trades-`` in its name."""

    path: str
    day: dt.date | None
    symbol: str | None


def _day_in(name: str) -> dt.date | None:
    m = re.search(r"\d{4}-\d{2}-\d{2}", name)
    try:
        return dt.date.fromisoformat(m[0]) if m else None
    except ValueError:
        return None


def list_days(folder: str) -> list[DayFile]:
    """All csv and zip files under a folder that have any bytes, by name."""
    system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    found = system.get_file_info(root)
    entries = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    out = []
    for f in entries:
        if f.type == fs.FileType.File and f.size and f.base_name.endswith((".csv", ".zip")):
            m = re.match(r"(.+)-trades-", f.base_name)
            out.append((f.base_name, f.path, _day_in(f.base_name), m[1] if m else None))
    return [DayFile(path, day, symbol) for _, path, day, symbol in sorted(out, key=lambda x: x[:2])]


def _lines(path: str, file) -> Iterator[pd.DataFrame]:
    for part in pd.read_csv(file, header=None, dtype=str, chunksize=CHUNK):
        if part.shape[1] != len(RAW_COLUMNS):
            raise ValueError(f"{path}: {part.shape[1]} columns, not {len(RAW_COLUMNS)}")
        if part[len(RAW_COLUMNS) - 1].isna().any():
            raise ValueError(f"{path}: a line of fewer than {len(RAW_COLUMNS)} columns")
        yield part


def read_day(folder: str, file: DayFile) -> Iterator[pa.RecordBatch]:
    """The rows of one file as text, a chunk at a time; the archive itself is never held."""
    system, _ = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")

    def chunks() -> Iterator[pd.DataFrame]:
        with system.open_input_file(file.path) as raw:
            if file.path.endswith(".csv"):
                yield from _lines(file.path, raw)
                return
            with zipfile.ZipFile(raw) as archive:
                for name in archive.namelist():
                    if not name.endswith("/"):
                        with archive.open(name) as inner:
                            yield from _lines(file.path, inner)

    for part in chunks():
        columns = [pa.array(part[i].where(part[i].notna(), None), pa.string()) for i in range(len(RAW_COLUMNS))]
        n = len(part)
        columns += [pa.array([file.path] * n, pa.string()), pa.array([file.symbol] * n, pa.string()), pa.array([file.day] * n, pa.date32())]
        yield pa.RecordBatch.from_arrays(columns, [*RAW_COLUMNS, "path", "symbol", "day"])


class DailyTrades(DataSource):
    """The source ``daily_trades``."""

    @classmethod
    def name(cls) -> str:
        return "daily_trades"

    def schema(self) -> str:
        return ", ".join([*(f"{c} string" for c in RAW_COLUMNS), "path string", "symbol string", "day date"])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.most = options["path"], int(options.get("limitfiles", options.get("limitFiles", 0)))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of ``day`` and ``symbol`` with values; leaves all others to Spark."""
        for f in filters:
            if isinstance(f, (*_COMPARE, In)) and f.attribute in (("day",), ("symbol",)):
                self.tests.append(f)
            else:
                yield f

    def _stays(self, file: DayFile) -> bool:
        for f in self.tests:
            have = getattr(file, f.attribute[0])
            if have is None or not (have in f.value if isinstance(f, In) else getattr(have, _COMPARE[type(f)])(f.value)):
                return False
        return True

    def partitions(self) -> list[DayFile]:
        files = list_days(self.folder)
        if not files:
            raise FileNotFoundError(f"no csv or zip files under {self.folder}")
        # a limit is on the files that are left, so that it is the same with a condition as with those files alone
        return [f for f in files if self._stays(f)][: self.most or None] or [DayFile("", None, None)]

    def read(self, partition: DayFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from read_day(self.folder, partition)


class _StreamReader(DataSourceStreamReader):
    """Days as offsets: a batch has the files of the days after ``start``, up to ``end``."""

    def __init__(self, options: dict):
        self.folder, self.step = options["path"], int(options.get("daysperbatch", options.get("daysPerBatch", 0)))
        self.progress = options.get("progress")
        self.at: str | None = None

    def _noted(self) -> str:
        """The last day that a query before this one has finished, where ``progress`` keeps it."""
        if not self.progress:
            return ""
        system, path = fs.FileSystem.from_uri(self.progress if "://" in self.progress else f"file://{self.progress}")
        if system.get_file_info(path).type != fs.FileType.File:
            return ""
        with system.open_input_stream(path) as file:
            return file.read().decode()

    def initialOffset(self) -> dict:
        return {"day": ""}

    def latestOffset(self) -> dict:
        days = sorted({f.day.isoformat() for f in list_days(self.folder) if f.day})
        if not self.step:
            return {"day": days[-1] if days else ""}
        self.at = self._noted() if self.at is None else self.at
        ahead = [d for d in days if d > self.at][: self.step]
        self.at = ahead[-1] if ahead else self.at
        return {"day": self.at}

    def partitions(self, start: dict, end: dict) -> list[DayFile]:
        if end["day"] < start["day"]:
            raise ValueError(f"the query has taken days up to {start['day']}: go on without daysPerBatch, or with the progress file of its first run")
        return [f for f in list_days(self.folder) if f.day and start["day"] < f.day.isoformat() <= end["day"]]

    def read(self, partition: DayFile) -> Iterator[pa.RecordBatch]:
        yield from read_day(self.folder, partition)

    def commit(self, end: dict) -> None:
        if self.progress:
            system, path = fs.FileSystem.from_uri(self.progress if "://" in self.progress else f"file://{self.progress}")
            with system.open_output_stream(path) as file:
                file.write(end["day"].encode())
