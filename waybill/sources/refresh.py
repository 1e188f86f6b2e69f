"""Keeping a stored fact table up to date by rebuilding the months that changed.

A manifest beside the facts names every source file the table was built from, with size,
time and the months its rows belong to.  A refresh lists the source folders, reads the
files that are new and takes the months of files that are gone from the manifest.  The
months together are rebuilt from all sources and swapped in by dynamic partition
overwrite: other months keep their files.

The months to rebuild are written down before the first one is touched and struck off
after the manifest is renewed.  So a refresh that was interrupted at any point is
finished by running it again; readers see each month old or new, though not all months
switch at one moment.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from waybill.functions.timing import year_month
from waybill.plans.facts import build_facts
from waybill.schemas import SOURCE_SCHEMAS
from waybill.session import delete_path
from waybill.sources.sinks import read_facts
from waybill.sources.tables import Sources

# How the rows of a source name the orders they change; other sources feed no fact column.
_LEADS_TO = {
    "orders": "order_id", "items": "order_id", "payments": "order_id", "reviews": "order_id", "customers": "customer_id",
}
_ENTRY = "source string, file string, size long, changed long, months array<string>"
# Source, name, size and time of a file.
File = tuple[str, str, int, int]


def _in_months(ts: Column, months: set[str]) -> Column:
    """Whether a time lies in one of the months, as ranges that reach the Parquet reader.

    Months that follow each other make one range.
    """
    found = ts.isNull() if "NaT" in months else F.lit(False)
    numbers = {12 * int(m[:4]) + int(m[5:]) - 1 for m in months - {"NaT"}}
    starts, ends = (sorted(n for n in numbers if n + step not in numbers) for step in (-1, 1))
    for start, end in zip(starts, ends, strict=True):
        first, beyond = (F.lit(f"{n // 12:04}-{n % 12 + 1:02}-01 00:00:00").cast("timestamp") for n in (start, end + 1))
        found = found | ((ts >= first) & (ts < beyond))
    return found


@dataclass
class StoredFacts:
    """A fact table at ``path``, built from one flat Parquet folder per source below ``sources``.

    ``schemas`` gives the sources' columns where they differ from the fixed ones.
    """

    spark: SparkSession
    sources: str
    path: str
    schemas: dict[str, StructType | str] | None = None

    def tables(self, months: set[str] | None = None) -> Sources:
        """The sources, reduced to the orders of some months."""
        if months is None:
            return Sources(**{name: partial(self._scan, name) for name in SOURCE_SCHEMAS})
        orders = self._scan("orders").filter(_in_months(F.col("order_purchase_timestamp"), months))
        kept = orders.select("order_id")
        some = {name: partial(self._scan, name) for name in ("customers", "products", "sellers")}
        for name in ("items", "payments", "reviews"):
            some[name] = self._scan(name).join(kept, "order_id", "left_semi")
        return Sources(orders=orders, **some)

    def read(self) -> DataFrame:
        facts = build_facts(self.tables(set()))
        return read_facts(self.spark, self.path, facts.schema).select(facts.columns)

    def refresh(self) -> list[str]:
        """Bring the facts up to date; returns the months that were rebuilt, in order."""
        now, known = self._listing(), self._manifest()
        added, gone = [f for f in now if f not in known], known.keys() - set(now)
        fresh = self._months_of(added)
        months = self._pending().union(*fresh.values(), *(known[f] for f in gone))
        if not known or any(source != "orders" for source, *_ in gone):
            # Which orders a file led to may have changed since it was noted; only the
            # months of orders themselves are sure.
            months |= self._stored_months() | self._months_of_orders(None)
        if months or added or gone:
            self._write([(m,) for m in sorted(months)], "month string", "pending")
            self._rebuild(months)
            entries = [(*f, sorted(known[f] if f in known else fresh.get(f, ()))) for f in now]
            self._write(entries, _ENTRY, "manifest")
            delete_path(self.spark, self._beside("pending"))
        return sorted(months)

    def _rebuild(self, months: set[str]) -> None:
        if not months:
            return
        facts = build_facts(self.tables(months))
        writer = facts.hint("rebalance", "ym").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("ym").parquet(self.path)
        for month in months - self._months_of_orders(months):  # nothing was written for these
            delete_path(self.spark, f"{self.path}/ym={month}")

    def _scan(self, name: str, *files: str) -> DataFrame:
        schema = (self.schemas or {}).get(name, SOURCE_SCHEMAS[name])
        folder = f"{self.sources}/{name}"
        return self.spark.read.schema(schema).parquet(*([f"{folder}/{f}" for f in files] or [folder]))

    def _children(self, path: str) -> list:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return list(system.listStatus(folder)) if system.exists(folder) else []

    def _listing(self) -> list[File]:
        return [
            (name, f.getPath().getName(), f.getLen(), f.getModificationTime())
            for name in _LEADS_TO
            for f in self._children(f"{self.sources}/{name}")
            if f.isFile() and f.getPath().getName()[0] not in "._"
        ]

    def _stored_months(self) -> set[str]:
        names = (f.getPath().getName() for f in self._children(self.path))
        return {n.removeprefix("ym=") for n in names if n.startswith("ym=")}

    def _months_of_orders(self, months: set[str] | None) -> set[str]:
        orders = self.tables(months).orders
        return {r.m for r in orders.select(year_month(F.col("order_purchase_timestamp")).alias("m")).distinct().collect()}

    def _months_of(self, files: list[File]) -> dict[File, set[str]]:
        """The months that the rows of each file belong to; only these files and orders are read."""
        out: dict[File, set[str]] = {}
        month = year_month(F.col("order_purchase_timestamp")).alias("month")
        for source, key in _LEADS_TO.items():
            own = {f[1]: f for f in files if f[0] == source}
            if not own:
                continue
            rows = self._scan(source, *own).select("*", F.col("_metadata.file_name").alias("file"))
            if source == "orders":
                found = rows.select("file", month)
            else:
                found = rows.select("file", key).distinct().join(self._scan("orders").select(key, month), key)
            # At most as many months as there are for each file.
            for row in found.groupBy("file").agg(F.collect_set("month").alias("months")).collect():
                out[own[row.file]] = set(row.months)
        return out

    def _beside(self, name: str) -> str:
        return f"{self.path}/_refresh/{name}"

    def _finished(self, name: str) -> bool:
        return any(f.getPath().getName() == "_SUCCESS" for f in self._children(self._beside(name)))

    def _write(self, rows: list[tuple], schema: str, name: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(self._beside(name))

    def _manifest(self) -> dict[File, set[str]]:
        if not self._finished("manifest"):
            return {}
        rows = self.spark.read.schema(_ENTRY).parquet(self._beside("manifest")).collect()
        return {tuple(r[:4]): set(r.months) for r in rows}

    def _pending(self) -> set[str]:
        if not self._finished("pending"):
            return set()
        return {r.month for r in self.spark.read.schema("month string").parquet(self._beside("pending")).collect()}
