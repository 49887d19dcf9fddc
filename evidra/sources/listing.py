"""A data source for paged listings: packages in numbered pages, read in parallel by ranges of pages, with filters and a limit in the reader.

A listing is a folder of pages, ``page-<n>.json``, each ``{"packages": [{"packageId": ..., "lastModified": ...}, ...]}`` as a listing service
sends them, and ``pages.json``, a line for each page with the range of its ids and dates. ``prefix`` and a date bound that a query asks for are
compared with these ranges before any page is opened, so pages that can hold nothing aren't read, and a task that has found ``limit`` packages opens
no further page. Pages are read where the tasks run, through the file systems that Arrow knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, StringStartsWith

SCHEMA = "package_id string, last_modified string, page int"
#: Pages of a partition unless the option ``pages`` says otherwise.
PAGES = 16
#: After the last character of any id.
_END = "\U0010ffff"


def _open(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return store.open_input_stream(at)


@dataclass
class Pages(InputPartition):
    numbers: list[int] = field(default_factory=list)


class ListingReader(DataSourceReader):
    """Options: ``path``; ``prefix`` and ``since``; ``limit`` (packages at most for each partition, 0 for all); ``pages`` (pages of a partition).

    With the option ``filters`` those of the query are taken too; the session must allow it (``spark.sql.python.filterPushdown.enabled``).
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.limit, self.each = options["path"].rstrip("/"), int(options.get("limit", 0)), int(options.get("pages", PAGES))
        self.prefixes: list[str] = [options["prefix"]] if options.get("prefix") else []
        self.since: list[tuple[str, bool]] = [(options["since"], True)] if options.get("since") else []  # a bound, and whether it is itself in

    def _may_hold(self, page: dict) -> bool:
        ids = all(page["last_id"] >= p and page["first_id"] <= p + _END for p in self.prefixes)
        return ids and all(page["last_date"] >= d if inside else page["last_date"] > d for d, inside in self.since)

    def _wanted(self, package: dict) -> bool:
        date = package.get("lastModified") or ""
        return all((package.get("packageId") or "").startswith(p) for p in self.prefixes) and all(date >= d if inside else date > d for d, inside in self.since)

    def partitions(self) -> list[Pages]:
        with _open(f"{self.path}/pages.json") as f:
            pages = [json.loads(line) for line in f.read().decode().splitlines() if line]
        some = sorted(p["page"] for p in pages if self._may_hold(p))
        return [Pages(some[a : a + self.each]) for a in range(0, len(some), self.each)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        found = 0
        for n in partition.numbers:
            with _open(f"{self.path}/page-{n}.json") as f:
                packages = json.loads(f.read())["packages"]
            for p in packages:
                if p.get("packageId") and self._wanted(p):
                    yield p["packageId"], p.get("lastModified"), n
                    found += 1
                    if found == self.limit:
                        return


class FilteringReader(ListingReader):
    """Also takes filters of the query, where the session lets sources in Python do so."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes a prefix of ids, an id, and lower bounds of dates; others stay with Spark."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("package_id",):
                self.prefixes.append(f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("last_modified",):
                self.since.append((f.value, isinstance(f, GreaterThanOrEqual)))
            else:
                if isinstance(f, EqualTo) and f.attribute == ("package_id",):
                    self.prefixes.append(f.value)  # prunes pages; Spark compares
                yield f


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "package_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return (FilteringReader if self.options.get("filters", "false") == "true" else ListingReader)(self.options)


def read_listing(spark: SparkSession, path: str, prefix: str | None = None, since: str | None = None, limit: int | None = None, pages: int = PAGES) -> DataFrame:
    """``package_id, last_modified, page`` of a paged listing. ``limit``: any packages of the wanted ones, as many at most; tasks stop there
    early. Packages without an id are left out."""
    spark.dataSource.register(Listing)
    given = {"path": path, "prefix": prefix or "", "since": since or "", "limit": limit or 0, "pages": pages}
    out = spark.read.format(Listing.name()).options(**given).load()
    return out.limit(limit) if limit else out


def write_listing(packages: DataFrame, path: str, size: int = 1000) -> int:
    """Write packages ``package_id, last_modified`` as a paged listing, in order of their ids, and return how many pages there are.

    Rows are cut into pages within ranges of ids, by all tasks, so a page has ``size`` rows at most.
    """
    rows = packages.repartitionByRange("package_id").sortWithinPartitions("package_id")

    def paged(batches):
        import pandas as pd
        from pyspark import TaskContext

        task, k, held = TaskContext.get().partitionId(), 0, []
        for b in (*batches, None):
            held += [] if b is None else list(zip(b["package_id"], b["last_modified"]))
            while len(held) >= size or (b is None and held):
                page, held = held[:size], held[size:]
                dates = [d for _, d in page if d]
                line = json.dumps({"packages": [{"packageId": i, "lastModified": d} for i, d in page]})
                yield pd.DataFrame([(task, k, line, page[0][0], page[-1][0], min(dates, default=""), max(dates, default=""))], columns=["task", "k", "line", "first_id", "last_id", "first_date", "last_date"])
                k += 1

    made = rows.mapInPandas(paged, "task int, k int, line string, first_id string, last_id string, first_date string, last_date string")
    made.write.mode("overwrite").parquet(f"{path}/_made")
    spark, jvm = packages.sparkSession, packages.sparkSession.sparkContext._jvm
    made = spark.read.parquet(f"{path}/_made")
    before = {r["task"]: r["n"] for r in made.groupBy("task").agg(F.count("*").alias("n")).collect()}  # a row for each task
    start, offsets = 0, {}
    for t in sorted(before):
        offsets[t], start = start, start + before[t]
    at = F.element_at(F.create_map(*(F.lit(x) for t, o in offsets.items() for x in (t, o))), F.col("task")) if offsets else F.lit(0)
    made = made.withColumn("page", (at + F.col("k")).cast("int"))

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        for b in batches:
            for n, line in zip(b["page"], b["line"]):
                with store.open_output_stream(f"{base}/page-{n}.json") as f:  # a task that runs again writes the same
                    f.write(line.encode())
            yield b[["page", "first_id", "last_id", "first_date", "last_date"]]

    index = made.mapInPandas(write, "page int, first_id string, last_id string, first_date string, last_date string")
    index.coalesce(1).write.mode("overwrite").json(f"{path}/_index")  # a short line for each page
    conf, p = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path
    store = p(path).getFileSystem(conf)
    store.delete(p(f"{path}/pages.json"), False)
    parts = [s.getPath() for s in store.listStatus(p(f"{path}/_index")) if s.getPath().getName().startswith("part-")]
    if parts:
        store.rename(parts[0], p(f"{path}/pages.json"))
    else:
        store.create(p(f"{path}/pages.json"), True).close()
    for name in ("_made", "_index"):
        store.delete(p(f"{path}/{name}"), True)
    return start
