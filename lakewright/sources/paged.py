"""Paged answers of an API as a data source, batch and stream: pages that landed in any order, read in the order of their links.

A page is a JSON object in a file named after its token: `data` (its records), and the token of the next page under
`next_page` or `continue` (a text, a number, or an object, whose values are joined), absent at the last one. The chain
begins at the token of the option `first`.

    spark.dataSource.register(PagedAnswers)
    spark.read.format("paged").option("path", folder).option("first", "1").load()          # token, place, record
    spark.readStream.format("paged")...                                                    # goes on at the first page that isn't there yet

What goes through the driver are tokens, one file after the other, as only a page names the next; records are read by
tasks, a run of pages each. The folder is any that PyArrow can open (local, shared, hdfs://, s3://, gs://). A chain that
ends at a page which isn't there is read as far as it goes in a stream; in a batch it is an error that names the page,
or, with the option `partial`, ends there. A chain that comes back to a page is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "token string, place long, record string"
#: Pages that one micro-batch takes.
PER_BATCH = 1000
#: Pages that one task of a batch reads.
PER_TASK = 200


def token_of(page: dict) -> str | None:
    """The token of the page after this one."""
    t = page.get("next_page", page.get("continue"))
    if isinstance(t, dict):
        t = "|".join(str(t[k]) for k in sorted(t))
    return None if t in (None, "", False) else str(t)


class Folder:
    """The landed pages: {folder}/{token}.json."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def read(self, token: str) -> dict | None:
        from urllib.parse import quote

        try:
            with self.fs.open_input_stream(f"{self.root}/{quote(token, safe='')}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None


def chain(folder: Folder, token: str | None, most: int | None = None) -> tuple[list[str], str | None]:
    """The tokens from one on, as far as their pages are there, and the next token (None: the chain is over)."""
    found: list[str] = []
    seen = set()
    while token is not None and (most is None or len(found) < most):
        page = folder.read(token)
        if page is None:
            break
        if token in seen:
            raise ValueError(f"page {token!r} comes again")
        seen.add(token)
        found.append(token)
        token = token_of(page)
    return found, token


@dataclass
class Page(InputPartition):
    token: str
    place: int


@dataclass
class Pages(InputPartition):
    tokens: list[str]
    place: int


def records(folder: Folder, page: Page) -> Iterator[tuple]:
    for r in (folder.read(page.token) or {}).get("data") or []:
        yield page.token, page.place, json.dumps(r, sort_keys=True, separators=(",", ":"))


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.path, self.first, self.partial = options["path"], options.get("first", "1"), options.get("partial", "false").lower() == "true"

    def partitions(self) -> list[Pages]:
        tokens, left = chain(Folder(self.path), self.first)
        if left is not None and not self.partial:
            raise FileNotFoundError(f"page {left!r} hasn't landed")
        return [Pages(tokens[k : k + PER_TASK], k) for k in range(0, len(tokens), PER_TASK)] or [Pages([], 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        folder = Folder(self.path)
        for k, t in enumerate(partition.tokens):
            yield from records(folder, Page(t, partition.place + k))


class _Stream(DataSourceStreamReader):
    """An offset is the token to go on at and its place; it is over when the token is null."""

    def __init__(self, options):
        self.path, self.first, self.most = options["path"], options.get("first", "1"), int(options.get("perbatch", PER_BATCH))
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"token": self.first, "place": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        start = self.at or self.initialOffset()
        tokens, left = chain(Folder(self.path), start["token"], self.most)
        self.at = {"token": left, "place": start["place"] + len(tokens)}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.at = end
        tokens, _ = chain(Folder(self.path), start["token"], end["place"] - start["place"])
        return [Page(t, start["place"] + k) for k, t in enumerate(tokens)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return records(Folder(self.path), partition)


class PagedAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def missing_ids(records: DataFrame, wanted: DataFrame, key: str, group: list[str]) -> DataFrame:
    """The wanted keys that no record of their group (a language, a set) has: what is still to be fetched."""
    return wanted.join(records.select(key, *group).distinct(), [key, *group], "left_anti")


def land(rows: DataFrame, path: str, record, token, following) -> None:
    """Writes rows as pages, by tasks: one file for each token; following: the next token, null at the last page. A page has a bounded number of rows."""

    def write(pages) -> Iterator:
        import pandas as pd

        folder = Folder(path)
        folder.fs.create_dir(folder.root, recursive=True)
        for pdf in pages:
            for t, after, data in zip(pdf["token"], pdf["following"], pdf["data"], strict=True):
                body = {"data": [json.loads(r) for r in data]} | ({"next_page": after} if after is not None else {})
                with folder.fs.open_output_stream(f"{folder.root}/{t}.json") as f:
                    f.write(json.dumps(body).encode())
            yield pd.DataFrame({"token": pdf["token"]})

    pages = rows.groupBy(token.alias("token")).agg(F.max(following).alias("following"), F.array_sort(F.collect_list(F.to_json(record))).alias("data"))
    pages.mapInPandas(write, "token string").write.format("noop").mode("overwrite").save()
