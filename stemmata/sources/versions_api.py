"""Versions behind a paged web interface as a Spark data source: a partition for each agent, newest pages first.

The client is anything with agents() and page(agent, before): a page is a list of (id, at, text) in falling order of id,
all below `before` (none: from the newest), empty at the end. It is named by its factory, module:function, so every task
makes its own and no connection is sent around. A filter on the agent leaves the other agents' pages unread, a lower
bound on the id ends a reading early, and `newest` is how many versions of an agent are read at most.

    spark.dataSource.register(VersionsSource)
    spark.read.format("versions").option("client", "my_api:connect").option("newest", 10).load()

Spark pushes filters down, and reads such a source at all, only with spark.sql.python.filterPushdown.enabled; session() sets it.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

TRIES, PAUSE = 4, 0.5


def connect(factory: str):
    module, _, name = factory.partition(":")
    return getattr(import_module(module), name)()


@dataclass
class Agent(InputPartition):
    """What one task reads."""

    name: str

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class VersionsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.client = options["client"]
        self.newest = int(options["newest"]) if "newest" in options else None
        self.pause = float(options.get("pause", PAUSE))
        self.only: set[str] | None = None
        self.above: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  a name of the interface
        """Takes over filters on agent and lower bounds on id; gives the rest back. With `newest`, only those on agent: what is newest is asked before other filters."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("agent",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            elif isinstance(f, In) and f.attribute == ("agent",):
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            elif self.newest is None and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("id",):
                least = f.value + isinstance(f, GreaterThan)
                self.above = least if self.above is None else max(self.above, least)
            else:
                yield f

    def partitions(self) -> list[Agent]:
        return [Agent(a) for a in sorted(set(connect(self.client).agents())) if self.only is None or a in self.only]

    def _page(self, client, agent: str, before: int | None) -> list[tuple]:
        """One page; a call that fails is made again after a pause that doubles, so a task seldom has to start anew."""
        for attempt in range(TRIES):
            try:
                return client.page(agent, before)
            except Exception:  # noqa: BLE001  whatever the client raises
                if attempt + 1 == TRIES:
                    raise
                time.sleep(self.pause * 2**attempt)
        raise AssertionError

    def read(self, partition: Agent) -> Iterator[tuple]:
        client, before, n = connect(self.client), None, 0
        while page := self._page(client, partition.name, before):
            for number, at, text in page:
                if self.above is not None and number < self.above or self.newest is not None and n >= self.newest:
                    return
                yield partition.name, number, at, text
                n += 1
            if before is not None and page[-1][0] >= before:
                raise ValueError(f"pages of {partition.name} do not fall")
            before = page[-1][0]


class VersionsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "versions"

    def schema(self) -> str:
        return "agent string, id long, at long, text string"

    def reader(self, schema) -> VersionsReader:
        return VersionsReader(self.options)
