"""Pages and model lists as Spark data sources: `spark.read.format("pages")` and `format("models")` after register()."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from graniteleaf.operators.ratelimit import PROVIDERS
from graniteleaf.sources.tables import ship

#: Seconds that an answer may take, addresses of one partition, and what a sound page holds.
TIMEOUT, PER_PARTITION, MARK = 60, 16, "eli-subdivision"


class ErrorPage(ValueError):
    """A page came that is not the document: it lacks the mark."""


def fetched(url: str, headers: dict[str, str] | None = None, timeout: float = TIMEOUT) -> bytes:
    """What an http, https or file address gives."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "graniteleaf", **(headers or {})}), timeout=timeout) as got:
        return got.read()


class _Addresses(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


def _wanted(filters: list[Filter], column: str) -> tuple[set | None, list[Filter]]:
    """Values of a column that the filters leave (None: any), and the filters that are not of that kind."""
    kept, rest = None, []
    for f in filters:
        own = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
        if own is None or f.attribute != (column,):
            rest.append(f)
        else:
            kept = own if kept is None else kept & own
    return kept, rest


class Pages(DataSource):
    """url, html of the addresses in option `urls` (one a line), `PER_PARTITION` of them a partition (option `per_partition`); option `mark` must stand in each page ('' for none). Options `accept` and `language` are sent as headers.

    Filters on url leave the other addresses alone. A page that cannot be read or lacks the mark fails the query: part of a corpus is no corpus. Repeated addresses are read
    and returned each; no addresses give no rows. Bytes that are no UTF-8 are replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(self.options)


class _PagesReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u.strip() for u in options.get("urls", "").splitlines() if u.strip()]
        self.mark, self.many, self.timeout = options.get("mark", MARK), int(options.get("per_partition", PER_PARTITION)), float(options.get("timeout", TIMEOUT))
        self.headers = {"Accept": options.get("accept", "application/xhtml+xml"), "Accept-Language": options.get("language", "eng")}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kept, rest = _wanted(filters, "url")
        if kept is not None:
            self.urls = [u for u in self.urls if u in kept]
        return rest

    def partitions(self) -> list[_Addresses]:
        return [_Addresses(self.urls[a : a + self.many]) for a in range(0, len(self.urls), self.many)] or [_Addresses([])]

    def read(self, partition: _Addresses) -> Iterator[tuple]:
        for url in partition.urls:
            html = fetched(url, self.headers, self.timeout).decode("utf-8", "replace")
            if self.mark not in html:
                raise ErrorPage(f"no {self.mark} in {url}")
            yield url, html


class Models(DataSource):
    """provider, model: what the providers' /models addresses list, one partition a provider. Options: `providers` (names by commas, all by default), `base_<provider>` for another address, `timeout`.

    Keys come from the environment of the worker. Filters on provider leave the other services alone. A service that does not answer, or not with a list, has no rows: a list of models is only a hint.
    """

    @classmethod
    def name(cls) -> str:
        return "models"

    def schema(self) -> str:
        return "provider string, model string"

    def reader(self, schema) -> DataSourceReader:
        return _ModelsReader(self.options)


class _ModelsReader(DataSourceReader):
    def __init__(self, options):
        known = {p: (base, key) for p, base, key in PROVIDERS}
        names = [p.strip() for p in options.get("providers", ",".join(known)).split(",") if p.strip()]
        self.services = {p: (options.get(f"base_{p}", known.get(p, ("", None))[0]), known.get(p, ("", None))[1]) for p in names}
        self.timeout = float(options.get("timeout", TIMEOUT))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kept, rest = _wanted(filters, "provider")
        if kept is not None:
            self.services = {p: s for p, s in self.services.items() if p in kept}
        return rest

    def partitions(self) -> list[_Addresses]:
        return [_Addresses([p]) for p in self.services] or [_Addresses([])]

    def read(self, partition: _Addresses) -> Iterator[tuple]:
        for provider in partition.urls:
            base, key = self.services[provider]
            value = os.environ.get(key or "", "")
            try:
                got = json.loads(fetched(f"{base}/models", {"Authorization": f"Bearer {value}"} if value else {}, self.timeout))
                names = sorted({m["id"] for m in got["data"]})
            except (OSError, ValueError, KeyError, TypeError):
                continue
            for n in names:
                yield provider, n


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, with filter pushdown."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Pages, Models):
        spark.dataSource.register(source)
