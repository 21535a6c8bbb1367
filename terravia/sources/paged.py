"""Recorded answers of services that return a box in tiles and pages, as a Spark data source.

`spark.read.format("recorded_pages").option("path", folder)` reads a folder of `tile=<number>/page=<number>/` with one JSON file each:
an object with a list `features`, and `exceededTransferLimit` where there is more to come. Each tile is a partition,
read page by page: it ends with a page that is shorter than `page_size`, or that says nothing of more. What is no JSON, an object that names an
error, and a page that was promised and is not there, are not an end: they fail the read and say which tile and page.
A filter on `tile` skips the other tiles' partitions before anything is opened.

Options: path; mirrors (other folders, comma-separated, asked in turn for a page that cannot be had); page_size; attempts and
backoff_s (each mirror is tried so often, with a pause that grows by backoff_s). A request that is refused as wrong (error code 400) is not tried again.

Rows: tile, page, nth (of the feature in its page), feature (its JSON).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "tile int, page int, nth int, feature string"
NAME = "recorded_pages"


class PageError(RuntimeError):
    """A page that could not be had, and why."""


class RefusedError(PageError):
    """The request itself is wrong; asking again does not help."""


def persistent(calls: Iterable[Callable[[], dict]], attempts: int, backoff_s: float, sleep: Callable[[float], None] = time.sleep) -> dict:
    """What the first call returns that succeeds. Each is made up to `attempts` times, with longer pauses between them and none after the last."""
    why: PageError | None = None
    for call in calls:
        pauses = [backoff_s * k for k in range(1, attempts)] + [0.0]
        for pause in pauses:
            try:
                return call()
            except RefusedError:
                raise
            except PageError as error:
                why = error
            if pause:
                sleep(pause)
    raise PageError(f"nobody could answer; last: {why}") from why


def parse_page(raw: bytes, where: str) -> dict:
    """The object in an answer; services also answer with pages of HTML that report success."""
    head = raw[:200].decode("utf-8", "replace").strip()
    if head[:1] != "{":
        raise PageError(f"{where}: no JSON in {len(raw)} bytes: {head[:80]!r}")
    try:
        page = json.loads(raw)
    except ValueError as error:
        raise PageError(f"{where}: broken JSON in {len(raw)} bytes: {error}") from error
    if wrong := page.get("error"):
        kind = RefusedError if isinstance(wrong, dict) and wrong.get("code") == 400 else PageError
        raise kind(f"{where}: {json.dumps(wrong)[:200]}")
    if not isinstance(page.get("features"), list):
        raise PageError(f"{where}: no list of features")
    return page


def _folder(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    return system.get_file_info(fs.FileSelector(path, allow_not_found=True))


def _read_page(root: str, tile: int, page: int) -> dict:
    where = f"tile {tile}, page {page} of {root}"
    try:
        system, path = fs.FileSystem.from_uri(root)
        files = [f for f in _folder(system, f"{path}/tile={tile}/page={page}") if f.is_file and f.base_name[0] not in "._"]
        if len(files) != 1:
            raise PageError(f"{where}: {len(files)} files")
        with system.open_input_stream(files[0].path) as stream:
            raw = stream.read()
    except OSError as error:
        raise PageError(f"{where}: {error}") from error
    return parse_page(raw, where)


@dataclass
class Tile(InputPartition):
    number: int


class RecordedPagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [options["path"], *(m.strip() for m in options.get("mirrors", "").split(",") if m.strip())]
        self.page_size = int(options.get("page_size", 1000))
        self.attempts, self.backoff_s = int(options.get("attempts", 1)), float(options.get("backoff_s", 0))
        self.wanted: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("tile",):
                numbers = {f.value}
            elif isinstance(f, In) and f.attribute == ("tile",):
                numbers = set(f.value)
            else:
                yield f
                continue
            self.wanted = numbers if self.wanted is None else self.wanted & numbers

    def partitions(self) -> list[Tile]:
        system, path = fs.FileSystem.from_uri(self.roots[0])
        numbers = sorted(int(f.base_name[5:]) for f in _folder(system, path) if f.type == fs.FileType.Directory and f.base_name.startswith("tile=") and f.base_name[5:].isdigit())
        return [Tile(n) for n in numbers if self.wanted is None or n in self.wanted]

    def read(self, partition: Tile) -> Iterator[tuple[int, int, int, str]]:
        if partition is None or isinstance(partition, InputPartition) and not isinstance(partition, Tile):
            return
        page, more = 0, True
        while more:
            found = persistent([lambda root=root, page=page: _read_page(root, partition.number, page) for root in self.roots], self.attempts, self.backoff_s)
            for nth, feature in enumerate(found["features"]):
                yield partition.number, page, nth, json.dumps(feature, separators=(",", ":"))
            more = len(found["features"]) >= self.page_size and bool(found.get("exceededTransferLimit"))
            page += 1


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordedPagesReader:
        return RecordedPagesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedPages)
