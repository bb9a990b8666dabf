"""Search results as a source: landed result files a domain, read by Spark as a table or a stream.

Files lie below ``<path>/domain=<code>/`` as JSON lines of items; names sort by the time they landed, so the
last is the newest. A search asks for a text and a number of results a domain, newest first: the text, the
domains and the earliest file are pushed into the reader, and each domain's partition stops as soon as it has its results.
As a stream, offsets name the last file of each domain; a file counts once, also over restarts.

    spark.dataSource.register(search.LandedSearch)
    spark.read.format("landed_search").option("path", folder).option("search_text", "charizard").option("limit", 30).load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull

#: ``file`` is the file's name, ``pos`` the item's place in it; ``json`` goes to ``listings.from_api``.
SCHEMA = "domain string, file string, pos long, listing_id string, title string, json string"


@dataclass
class Files(InputPartition):
    """Files of one domain, newest first."""

    domain: str
    names: tuple[str, ...]


class _Landed:
    """What a folder holds, by options: path, domains (comma-separated), search_text, limit."""

    def __init__(self, options: dict):
        self.path, self.text = options["path"], (options.get("search_text") or "").lower()
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.domains = {d.strip() for d in options["domains"].split(",")} if options.get("domains") else None
        self.since: tuple[str, bool] | None = None  # the earliest file, and whether it counts

    def files(self) -> dict[str, list[str]]:
        """domain -> names of its files, oldest first."""
        store, root = fs.FileSystem.from_uri(self.path)
        out: dict[str, list[str]] = {}
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            key, _, domain = info.base_name.partition("=")
            if info.type == fs.FileType.Directory and key == "domain" and (self.domains is None or domain in self.domains):
                names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(info.path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
                if self.since:
                    bound, counts = self.since
                    names = [n for n in names if n > bound or counts and n == bound]
                if names:
                    out[domain] = names
        return out

    def rows(self, files: Files, limit: int | None) -> Iterator[tuple]:
        """Items with an id, whose title or description holds the text; as many as are asked for."""
        store, root = fs.FileSystem.from_uri(self.path)
        left = limit
        for name in files.names:
            with store.open_input_stream(f"{root}/domain={files.domain}/{name}") as stream:
                for pos, line in enumerate(_lines(stream)):
                    item = _item(line)
                    if item is None or self.text not in f"{item.get('title') or ''} {item.get('description') or ''}".lower():
                        continue
                    if left is not None:
                        if left <= 0:
                            return
                        left -= 1
                    yield files.domain, name, pos, str(item["id"]), item.get("title"), line


def _lines(stream) -> Iterator[str]:
    held = b""
    while block := stream.read(1 << 20):
        *whole, held = (held + block).split(b"\n")
        yield from (x.decode(errors="replace") for x in whole)
    if held:
        yield held.decode(errors="replace")


def _item(line: str) -> dict | None:
    """An item that can be made a listing; anything else is dropped, as a search does."""
    try:
        found = json.loads(line)
    except ValueError:
        return None
    return found if isinstance(found, dict) and found.get("id") not in (None, "") else None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.landed = _Landed(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Domains and files are settled here; what isn't is left to Spark. With a limit nothing may filter behind it but what is pushed."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("domain",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("domain",):
                self._only(set(f.value))
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("file",) and self.landed.since is None:
                self.landed.since = (f.value, isinstance(f, GreaterThanOrEqual))
            elif not (isinstance(f, IsNotNull) and f.attribute in (("domain",), ("file",))):  # they never are null
                yield f

    def _only(self, domains: set) -> None:
        self.landed.domains = domains if self.landed.domains is None else self.landed.domains & domains

    def partitions(self) -> list[Files]:
        """With a limit a domain is one partition, newest file first; without, every file is."""
        found = sorted(self.landed.files().items())
        if self.landed.limit is not None:
            return [Files(d, tuple(reversed(names))) for d, names in found]
        return [Files(d, (n,)) for d, names in found for n in names]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.landed.rows(partition, self.landed.limit)


class _Stream(DataSourceStreamReader):
    """Offsets: domain -> its last file."""

    def __init__(self, options: dict):
        self.landed = _Landed({k: v for k, v in options.items() if k != "limit"})

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {d: names[-1] for d, names in self.landed.files().items()}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return [Files(d, (n,)) for d, names in sorted(self.landed.files().items()) for n in names if start.get(d, "") < n <= end.get(d, "")]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.landed.rows(partition, None)

    def commit(self, end: dict) -> None:
        pass


class LandedSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options))
