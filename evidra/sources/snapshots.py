"""Tables that batches are merged into: snapshots with a manifest, rows dealt into parts by a hash of their key, and only the parts that a
batch touches written anew.

A store is a folder. ``data/<table>/<generation>/part=<p>`` holds rows, ``manifest/<version>.json`` says which generation each part of
each table is read from, and which batch of each source came last. A merge writes the new parts first and then the next manifest, under
another name and moved into place, so readers see all of a batch or nothing, in all tables at once; a merge that loses the race for a
version fails and has changed nothing. A batch that is delivered again is known by its number and skipped.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators.lineage import remove
from evidra.operators.merge import latest, latest_known

#: Parts of a table unless it is declared with others; each should fit a task.
PARTS = 32
#: Columns that rows are dealt out by: the part, and shares of it.
DEALT = ("part", "_share")
#: Versions whose files stay when old ones are removed.
KEPT = 2


def _without(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose keys, nulls included, are not among those of a batch."""
    gone = rows.select(*(F.col(k).alias(f"_gone{i}") for i, k in enumerate(keys))).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_gone{i}")) for i, k in enumerate(keys)]
    return old.join(gone, reduce(Column.__and__, same), "left_anti")


@dataclass(frozen=True)
class Rule:
    """How rows of a batch meet stored ones. ``keys`` name a row; ``by`` the columns that parts follow (``keys`` if not given).

    * ``replace``: the batch's row of a key stands for the stored one;
    * ``known``: each column has its last value that isn't null;
    * ``set``: equal rows are one;
    * ``group``: the batch's rows of a value of ``by`` stand for all stored ones of that value; a row whose ``keys`` are null only names it.

    ``order`` is the batch's column by which its last row of a key counts; it isn't stored. ``strict``: a batch with two rows of a
    key is an error that names the key.
    """

    kind: str
    keys: tuple[str, ...]
    by: tuple[str, ...] = ()
    order: str | None = None
    strict: bool = False
    parts: int = PARTS

    def part(self):
        return F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.parts)).cast("int")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows dealt out by ``part``, and by ``_share`` where the session has more tasks than the table has parts. What is then grouped by
        both and a key needs no other shuffle, nor does a write by part. Tasks are as many as the session has: those that are put together to
        one a core hold too much each."""
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        share = F.pmod(F.hash(*(self.by or self.keys)), F.lit(-(-tasks // self.parts)))
        return rows.withColumn("part", self.part()).withColumn("_share", share).repartition(tasks, *DEALT)

    def single(self, new: DataFrame) -> DataFrame:
        """What counts of a batch: one row for each key, dealt out, without ``order``; of a set all rows. Of those that tie in ``order`` the
        greatest counts, or where columns count by themselves always the same."""
        keys, columns = list(self.keys), [c for c in new.columns if c != self.order]
        if self.kind == "set":
            return self.dealt(new.select(*columns))
        plain = [F.col(c) for c in sorted(columns) if new.schema[c].dataType.typeName() != "map"]
        order = F.struct(F.col(self.order), F.xxhash64(*plain)) if self.kind == "known" and self.order else F.struct(*([F.col(self.order)] if self.order else []), *plain)
        rows = self.dealt(new).withColumn("_order", order).select(*DEALT, *columns, "_order")
        if self.kind == "known":
            return latest_known(rows, keys, "_order", DEALT)
        if self.kind == "group":
            keys = [*self.by, *(k for k in keys if k not in self.by)]
        return latest(rows, keys, "_order", self.strict, DEALT).drop("_order")

    def met(self, old: DataFrame | None, rows: DataFrame) -> DataFrame:
        """Stored rows after those of a batch, which ``single`` gave or which were read again; they have their ``part``."""
        keys, by = list(self.keys), list(self.by or self.keys)
        named = " and ".join(f"`{k}` is not null" for k in keys)
        if old is None and (self.kind != "set" or "_share" in rows.columns):
            return rows.dropDuplicates() if self.kind == "set" else rows.where(named) if self.kind == "group" else rows
        rows = rows.drop(*DEALT)
        if self.kind == "set":
            return self.dealt(rows if old is None else old.unionByName(rows)).dropDuplicates()
        if self.kind == "known":
            return latest_known(self.dealt(old.withColumn("_order", F.lit(0)).unionByName(rows.withColumn("_order", F.lit(1)))), keys, "_order", DEALT)
        stays = _without(old, rows, by if self.kind == "group" else keys)
        return self.dealt(stays.unionByName(rows.where(named) if self.kind == "group" else rows))


@dataclass
class Store:
    """Tables at ``path``, each with its rule."""

    spark: SparkSession
    path: str
    rules: dict[str, Rule]

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._at(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"version": -1, "batches": {}, "tables": {}}
        at, fs = self._at(f"{self.path}/manifest/{found[-1] if version is None else version}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        """The next manifest, moved into place: the store lets one of two writers do so."""
        at, fs = self._at(f"{self.path}/manifest/{manifest['version']}.json")
        tmp, _ = self._at(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        stream = fs.create(tmp, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if fs.exists(at) or not fs.rename(tmp, at):
            fs.delete(tmp, False)
            raise RuntimeError(f"another writer has made version {manifest['version']} of {self.path}")

    def _rows(self, manifest: dict, name: str, parts: list[int] | None = None) -> DataFrame | None:
        held = manifest["tables"].get(name, {"files": {}})
        at = [f"{self.path}/data/{name}/{g}/part={p}" for p, g in held["files"].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(held["schema"]).parquet(*at) if at else None

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version; the last one if not given. One that has had no rows is an error."""
        rows = self._rows(self.manifest(version), name)
        if rows is None:
            raise LookupError(f"no rows have been merged into {name}")
        return rows

    def passed(self, source: str, number: int | None) -> bool:
        """Whether a batch of this number was merged before."""
        return number is not None and number <= self.manifest()["batches"].get(source, -1)

    def _write(self, rows: DataFrame, at: str) -> list[int]:
        """The parts that rows were written to, in a folder each."""
        rows.drop("_share").write.partitionBy("part").parquet(at)
        at, fs = self._at(at)
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return [int(n.removeprefix("part=")) for n in names if n.startswith("part=")]

    def merge(self, batches: dict[str, DataFrame], source: str = "", number: int | None = None) -> bool:
        """Merge a batch of each table, all in one version. False, and nothing done, for a number that the source has passed.

        A batch is worked out once: into a table without rows its own are written as they count; else they are written aside, which tells
        the parts that they touch, and met with the stored rows of those. Tables that get no rows stay as they are. Rows of a batch without
        an ``order`` of their rule tie, and the greatest counts.
        """
        was = self.manifest()
        if number is not None and number <= was["batches"].get(source, -1):
            return False
        now = {"version": was["version"] + 1, "batches": was["batches"] | ({source: number} if number is not None else {}), "tables": json.loads(json.dumps(was["tables"]))}
        for name, batch in batches.items():
            rule = self.rules[name]
            at, generation = f"{self.path}/data/{name}", f"{now['version']}-{uuid.uuid4().hex[:8]}"
            rows, aside = rule.single(batch), None
            touched = []
            if was["tables"].get(name, {}).get("files"):
                aside = f"{at}/{generation}-batch"
                touched = self._write(rows, aside)
                rows = self.spark.read.schema(rows.drop(*DEALT).schema).parquet(aside)
                if not touched:
                    remove(self.spark, aside)
                    continue
            met = rule.met(self._rows(was, name, touched) if touched else None, rows)
            written = self._write(met, f"{at}/{generation}")
            if not written and not touched:
                continue
            held = now["tables"].setdefault(name, {"files": {}})
            held["schema"] = met.drop(*DEALT).schema.toDDL()
            for p in touched:
                held["files"].pop(str(p), None)
            held["files"] |= {str(p): generation for p in written}
            if aside:
                remove(self.spark, aside)
        self._put(now)
        return True

    def vacuum(self, keep: int = KEPT) -> None:
        """Remove the files and manifests that none of the last ``keep`` versions needs."""
        found = self.versions()
        needed = {(n, g) for v in found[-keep:] for n, t in self.manifest(v)["tables"].items() for g in t["files"].values()}
        for name in self.rules:
            at, fs = self._at(f"{self.path}/data/{name}")
            for s in fs.listStatus(at) if fs.exists(at) else []:
                if (name, s.getPath().getName()) not in needed:
                    fs.delete(s.getPath(), True)
        for v in found[:-keep]:
            remove(self.spark, f"{self.path}/manifest/{v}.json")
