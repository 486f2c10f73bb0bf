"""A catalogue read request by request as a Spark data source, in batches and as a stream.

``spark.read.format("paged_index").option("path", …)`` reads what a search service would give: documents of one
artist added since a day. The service here is a folder of Parquet files, and a request is one row group of one of
them; a real one replaces :func:`requests` and :func:`fetch`. Only the files' footers are read to plan the requests,
a group whose newest day lies before the bound is not requested, and every group is read once, by the executor whose
task it is, a page of documents at a time. Nothing is sorted and nothing but the list of groups is held by the driver.

As a stream, an offset is the number of requests that were read in full, in the order in which the files came.
Nothing is skipped however much is new (the reference's mark could pass over unread documents); a file that comes
later is read later. The day bound is inclusive; replays are dropped by key downstream.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "id long, indexer string, release_id string, artist string, added string"
_ADDED = "data.added"


class Request(InputPartition):
    """One row group of one file."""

    def __init__(self, path: str, group: int):
        self.path, self.group = path, group


def requests(path: str, since: str = "") -> list[Request]:
    """All requests that may have documents since a day, by the time their files came; from the files' footers alone."""
    import pyarrow.parquet as pq

    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")] if os.path.isdir(path) else [path]
    out = []
    for file in sorted(files, key=lambda f: (os.path.getmtime(f), f)):
        footer = pq.read_metadata(file)
        for group in range(footer.num_row_groups):
            columns = (footer.row_group(group).column(k) for k in range(footer.num_columns))
            stats = next((c.statistics for c in columns if c.path_in_schema == _ADDED), None)
            if not since or stats is None or not stats.has_min_max or stats.max >= since:
                out.append(Request(file, group))
    return out


def fetch(request: Request, artist: str | None, since: str, rows: int) -> Iterator:
    """The documents of one request, as record batches of ``rows`` at most. Documents without a day are none."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    want = ["id", "indexer", "release_id", "data.artist", _ADDED]
    for batch in pq.ParquetFile(request.path).iter_batches(rows, row_groups=[request.group], columns=want):
        data = batch.column("data")
        names, added = pc.struct_field(data, "artist"), pc.struct_field(data, "added")
        keep = pc.fill_null(pc.greater_equal(added, since), False)
        if artist:
            keep = pc.and_(keep, pc.fill_null(pc.equal(names, artist), False))
        page = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("indexer"), batch.column("release_id"), names, added], names=["id", "indexer", "release_id", "artist", "added"])
        yield page.filter(keep)


class _Options:
    def __init__(self, options: dict):
        self.path, self.artist, self.since = options["path"], options.get("artist"), options.get("since", "")
        self.rows = int(options.get("rows", 100))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = _Options(options)

    def partitions(self) -> list[Request]:
        return requests(self.options.path, self.options.since) or [Request("", -1)]

    def read(self, partition: Request) -> Iterator:
        o = self.options
        if partition.path:
            yield from fetch(partition, o.artist, o.since, o.rows)


class PagedStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = _Options(options)

    def _between(self, start: int, end: int) -> Iterator[tuple]:
        # Spark keeps and copies what a request gave, so it must be whole: one row group.
        o, out = self.options, []
        for request in requests(o.path)[start:end]:
            for page in fetch(request, o.artist, o.since, o.rows):
                out += zip(*(page.column(k).to_pylist() for k in range(page.num_columns)))
        return iter(out)

    def initialOffset(self) -> dict:
        return {"read": 0}

    def read(self, start: dict):
        end = min(start["read"] + 1, len(requests(self.options.path)))
        return self._between(start["read"], end), {"read": max(end, start["read"])}

    def readBetweenOffsets(self, start: dict, end: dict):
        return self._between(start["read"], end["read"])


class PagedIndex(DataSource):
    """The data source. Options: path, artist, since (yyyy-mm-dd, inclusive), rows (a page's size)."""

    @classmethod
    def name(cls) -> str:
        return "paged_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PagedStream(self.options)
