"""Providers as data sources: a plug-in says what its partitions are and what it observes in one, Spark does the rest.

    class Ours(ProviderPlugin):
        identity = ("ours", "1.0.0", "deterministic")
        def partitions(self, options): ...
        def observe(self, partition, options): ...

    register(spark, Ours)
    spark.read.format("ours").option("revision", sha).load()

A plug-in runs in the executors, one task for each partition. Equality filters on the revision, the predicate and the provider's
id are pushed down: a plug-in whose revision or identity is another is never called, and a predicate reaches it as an option.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ..schemas import OBSERVATION

#: Filters that a plug-in's reader takes over, and the option each becomes.
_PUSHED = {("repository", "commitSha"): "revision", ("provider", "id"): "provider", ("predicate",): "predicate"}


class ProviderPlugin:
    """What a provider has to say. Instances are made in the driver and in every task, without arguments."""

    identity: tuple[str, str, str]

    def partitions(self, options: dict[str, str]) -> list[Any]:
        """Parts that may be read apart; each is pickled and sent to a task."""
        return [None]

    def observe(self, partition: Any, options: dict[str, str]) -> Iterator[dict]:
        """Observations of a part: dicts with subject, predicate, object, path, and span, native if there are any.

        subject is (id, kind); object is such a pair or a string. ``options["predicate"]``, if there, is the only predicate
        that is wanted; rows of others do no harm.
        """
        raise NotImplementedError

    def revision(self, options: dict[str, str]) -> str:
        """The revision that this provider has analysed."""
        return options["revision"]


@dataclass
class _Part(InputPartition):
    value: Any


@dataclass
class _Reader(DataSourceReader):
    plugin: type[ProviderPlugin]
    options: dict[str, str]
    pushed: dict[str, str] = field(default_factory=dict)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - the interface's name
        for f in filters:
            name = _PUSHED.get(tuple(f.attribute)) if isinstance(f, EqualTo) else None
            if name and name not in self.pushed:
                self.pushed[name] = f.value
            if name != "revision":  # the rest is checked again, a plug-in needn't heed it
                yield f

    def _wanted(self) -> bool:
        p = self.plugin()
        return self.pushed.get("provider", p.identity[0]) == p.identity[0] and self.pushed.get("revision", p.revision(self.options)) == p.revision(self.options)

    def partitions(self) -> list[InputPartition]:
        return [_Part(x) for x in self.plugin().partitions(self._given())] if self._wanted() else [_Part(_NOTHING)]

    def _given(self) -> dict[str, str]:
        return self.options | {k: v for k, v in self.pushed.items() if k == "predicate"}

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value == _NOTHING:
            return
        p = self.plugin()
        repository, options = (self.options.get("source", ""), p.revision(self.options)), self._given()
        for o in p.observe(partition.value, options):
            said = o["object"]
            object_ = (None, said) if isinstance(said, str) else (tuple(said), None)
            native = json.dumps(o["native"] if "native" in o else {k: o[k] for k in ("subject", "predicate", "object")}, separators=(",", ":"), sort_keys=True)
            yield (1, tuple(o["subject"]), o["predicate"], object_, p.identity, repository, (o["path"], o.get("span")), p.identity[2], native)


_NOTHING = "\x00nothing"


def data_source(plugin: type[ProviderPlugin]) -> type[DataSource]:
    """The data source of a plug-in, under its provider's id."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return plugin.identity[0]

        def schema(self) -> str:
            return OBSERVATION

        def reader(self, schema) -> DataSourceReader:
            return _Reader(plugin, dict(self.options))

    return Source


def register(spark: SparkSession, *plugins: type[ProviderPlugin]) -> None:
    """Make plug-ins known to the session; filters are pushed down from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for p in plugins:
        spark.dataSource.register(data_source(p))


@dataclass
class PluginProvider:
    """A registered plug-in as a provider of a run. Only observations of ``revision`` are read."""

    identity: tuple[str, str, str]
    revision: str
    options: dict[str, str] = field(default_factory=dict)

    def is_available(self) -> bool:
        return True

    def execute(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.format(self.identity[0]).options(**{"revision": self.revision, **self.options}).load()
        return rows.where(F.col("repository.commitSha") == self.revision)
