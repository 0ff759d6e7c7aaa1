"""Captured registry pages as a data source: every chain of cursors is followed in a task of its own.

A capture is a folder `registry=<name>/chain=<name>/` of JSON lines, each the
cursor that was asked for and the body that came back: {"cursor": .., "body": ..}.
Lines may stand in any order and repeat (the first capture of a cursor counts).
A chain starts at the empty cursor and ends where its registry says so, at its
limit of pages, or at a cursor met before; pages that no cursor leads to aren't
read. A cursor that was never captured is an error, or the end of the chain with
the option `missing` set to `stop`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairnfield.sources import files

PAGE_LIMIT = 2000  # fixed value
SCHEMA = "registry STRING, chain STRING, page INT, cursor STRING, servers INT, body STRING"
_PLACE = re.compile(r"/registry=([^/]+)/chain=([^/]+)/[^/]+$")


def next_cursor(registry: str, page: dict, cursor: str) -> str | None:
    """The cursor after a page: a token (official), the end of a connection (glama), or a page number up to a total (smithery)."""

    def inside(key: str) -> dict:
        found = page.get(key)
        return found if isinstance(found, dict) else {}

    if registry == "smithery":
        total = inside("pagination").get("totalPages", 1)
        number = int(cursor or 1) + 1
        return str(number) if isinstance(total, int | float) and number <= total else None
    if registry == "glama":
        found = inside("pageInfo").get("endCursor") if inside("pageInfo").get("hasNextPage") is True else None
    else:
        found = inside("metadata").get("nextCursor")
    return found if isinstance(found, str) and found else None


class Chain(InputPartition):
    def __init__(self, registry: str, chain: str, paths: list[str]) -> None:
        super().__init__((registry, chain))
        self.registry, self.chain, self.paths = registry, chain, paths


class Page(NamedTuple):
    registry: str
    chain: str
    page: int
    cursor: str
    servers: int
    body: str


class ChainReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.only = options.get("registry")
        self.limit = int(options.get("limit", PAGE_LIMIT))
        self.missing = options.get("missing", "fail")

    def partitions(self) -> list[InputPartition]:
        found: dict[tuple[str, str], list[str]] = {}
        for path in files.listed(self.path):
            place = _PLACE.search(path)
            if place and self.only in (None, place[1]):
                found.setdefault((place[1], place[2]), []).append(path)
        return [Chain(*key, paths) for key, paths in sorted(found.items())]

    def _captures(self, chain: Chain) -> Iterator[tuple[str, str]]:
        for path in chain.paths:
            for line in files.lines_of(files.stream(path)):
                if line.strip():
                    row = json.loads(line)
                    yield row.get("cursor") or "", row["body"]

    def read(self, chain: Chain) -> Iterator[tuple]:
        held: dict[str, str] = {}
        want: str | None = ""
        seen, page = set(), 0
        for cursor, body in self._captures(chain):
            if cursor in seen:
                continue
            held.setdefault(cursor, body)  # out of order until its turn comes
            while want in held:
                text = held.pop(want)
                known = json.loads(text)
                known = known if isinstance(known, dict) else {}
                servers = known.get("servers")
                yield tuple(Page(chain.registry, chain.chain, page, want, len(servers) if isinstance(servers, list) else 0, text))
                seen.add(want)
                page += 1
                want = next_cursor(chain.registry, known, want)
                if want is None or want in seen or page >= self.limit:
                    return
        if self.missing != "stop":
            raise ValueError(f"{chain.registry}, chain {chain.chain}: no capture of cursor {want!r}")


class RegistryPages(DataSource):
    """spark.read.format("registry_pages"): options path, registry (one of them only), limit, missing (fail or stop)."""

    @classmethod
    def name(cls) -> str:
        return "registry_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChainReader:
        return ChainReader(dict(self.options))


def read_registry(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pages of all chains in a folder of captures, each chain in a partition and in the order of its cursors."""
    spark.dataSource.register(RegistryPages)
    return spark.read.format("registry_pages").options(**options).load(path)


def write_captures(captures: DataFrame, path: str, cursor: Column, body: Column) -> None:
    """Captures (registry, chain, and a cursor and a body) in the layout that is read here."""
    line = F.to_json(F.struct(F.coalesce(cursor, F.lit("")).alias("cursor"), body.alias("body")))
    captures.select("registry", "chain", line.alias("value")).write.partitionBy("registry", "chain").mode("append").text(path)
