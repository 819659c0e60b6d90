"""Process samples of the own machine by name: a batch reader over /proc and a Python data source for streams."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

SCHEMA = "tick long, pid long, name string, memory long, cpu long, cpu_time long, virtual long"


def sample(name: str = "", root: str = "/proc") -> list[tuple]:
    """(pid, name, memory, cpu ticks, cpu seconds, virtual) of processes whose name contains ``name``; one that ends meanwhile is left out."""
    page, hertz = os.sysconf("SC_PAGE_SIZE"), os.sysconf("SC_CLK_TCK")
    out = []
    for d in Path(root).iterdir():
        if not d.name.isdigit():
            continue
        try:
            head, _, rest = (d / "stat").read_text().rpartition(")")
        except OSError:
            continue
        f, title = rest.split(), head.partition("(")[2]
        if name in title and len(f) > 21:
            used = int(f[11]) + int(f[12])
            out.append((int(d.name), title, int(f[21]) * page, used, used // hertz, int(f[20])))
    return sorted(out)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.name = options.get("name", "")

    def read(self, partition) -> Iterator[tuple]:
        now = int(time.time())
        yield from ((now, *r) for r in sample(self.name))


class _Stream(SimpleDataSourceStreamReader):
    """One sample of the driver's machine per trigger; the offset counts the samples."""

    def __init__(self, options: dict):
        self.name, self.taken = options.get("name", ""), {}

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = start["tick"] + 1
        self.taken[end] = [(end, *r) for r in sample(self.name)]
        return iter(self.taken[end]), {"tick": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for k in range(start["tick"] + 1, end["tick"] + 1) for r in self.taken.get(k, [])])

    def commit(self, end: dict) -> None:
        self.taken = {k: v for k, v in self.taken.items() if k > end["tick"]}


class ProcessSource(DataSource):
    """``spark.dataSource.register(ProcessSource)``, then format "processes" with option ``name``."""

    @classmethod
    def name(cls) -> str:
        return "processes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)
