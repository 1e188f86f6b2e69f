"""Named sources in a folder of Parquet and CSV files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from waybill.schemas import SOURCE_SCHEMAS
from waybill.sources.tables import Sources

FALLBACK_ENCODING = "ISO-8859-1"
# What Spark's batch writers and its streaming file sink leave in a finished folder.
COMMIT_MARKS = ("_SUCCESS", "_spark_metadata")

# Fields of a CSV file that mean "missing".
MISSING_FIELDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def typed(columns: Sequence[str], schema: StructType, wanted: Sequence[str] | None) -> list[Column]:
    """The schema's columns, cast; an absent column or unreadable value is null."""
    return [
        (F.col(f.name) if f.name in columns else F.lit(None).cast("string"))
        .try_cast(f.dataType)
        .alias(f.name)
        for f in schema.fields
        if wanted is None or f.name in wanted
    ]


def _exists(scan) -> DataFrame | None:
    """The scan's DataFrame, or None when its path does not exist."""
    try:
        return scan()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _utf8(text: Column) -> Column:
    """A field read byte by byte as Latin-1, in UTF-8 where its bytes are valid UTF-8."""
    raw = F.encode(text, FALLBACK_ENCODING).cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(text)


def _header(name: str) -> str:
    raw = name.encode("latin-1", "replace")
    try:
        return raw.decode("utf-8").removeprefix("\ufeff")
    except UnicodeDecodeError:
        return name


def parsed(raw: DataFrame, schema: StructType, columns: Sequence[str] | None, decode: bool) -> DataFrame:
    """Text columns of CSV files as the schema's columns; batch and stream share it."""
    names = [_header(c) if decode else c for c in raw.columns]
    fields = [F.col(f"`{c}`") for c in raw.columns]
    values = [_utf8(f) if decode else f for f in fields]
    known = [F.when(~v.isin(MISSING_FIELDS), v).alias(n) for v, n in zip(values, names, strict=True)]
    return raw.select(*known).select(*typed(names, schema, columns))


def read_csv(
    spark: SparkSession, path: str, schema: StructType, columns: Sequence[str] | None = None,
    encoding: str | None = None, free_text: bool = False,
) -> DataFrame:
    """Scan CSV files with a header under a fixed schema.

    Columns are matched by header name.  Fields that do not parse become null.
    Without a given encoding every field is read as UTF-8 where its bytes are valid
    and as Latin-1 elsewhere, in the one scan.  ``free_text`` allows line breaks
    inside quoted fields; such a file cannot be split over tasks.
    """
    # Every header column is read as text and picked by name, then cast: the
    # file may hold more columns than the schema, in any order.
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding=encoding or FALLBACK_ENCODING,
                         multiLine=free_text, escape='"')
    return parsed(raw, schema, columns, decode=encoding is None)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: a single file, or a folder with a
    commit mark of a batch or a streaming writer.

    A folder that holds data without a mark raises an error, unless what it holds is
    what ``Catalogue.materialise`` began; an empty folder counts as absent.
    """
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return False
    if files.isFile(place) or any(files.exists(jvm.org.apache.hadoop.fs.Path(place, m)) for m in COMMIT_MARKS):
        return True
    if not files.exists(_begun(spark, path)):
        held = [f.getPath().getName() for f in files.listStatus(place)]
        if any(not name.startswith(("_", ".")) for name in held):
            raise ValueError(f"{path} holds data but no commit mark ({', '.join(COMMIT_MARKS)}): read it with commit_mark=False")
    return False


def _begun(spark: SparkSession, path: str):
    """The mark beside a table that says that its conversion was begun and not ended."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{place.getName()}.begun")


@dataclass
class Catalogue:
    """Logical source names mapped to files under one folder.

    ``files`` maps a source name to its file stem where that differs from the
    name.  A Parquet table ``<stem>.parquet`` is preferred over ``<stem>.csv``;
    a source with neither is an empty table with the right schema.
    """

    spark: SparkSession
    root: str
    files: Mapping[str, str] = field(default_factory=dict)
    schemas: Mapping[str, StructType] = field(default_factory=lambda: dict(SOURCE_SCHEMAS))
    # Sources whose files carry comments with line breaks; each such file is one task.
    free_text: frozenset[str] = frozenset()
    # Off for folders of other tools, which leave no commit mark.
    commit_mark: bool = True

    def path(self, name: str, kind: str) -> str:
        return f"{self.root.rstrip('/')}/{self.files.get(name, name)}.{kind}"

    def parquet(self, name: str, columns: Sequence[str] | None = None) -> DataFrame | None:
        path = self.path(name, "parquet")
        if self.commit_mark and not is_complete(self.spark, path):
            return None
        found = _exists(lambda: self.spark.read.parquet(path))
        if found is None:
            return None
        return found.select(*typed(found.columns, self.schemas[name], columns))

    def csv(self, name: str, columns: Sequence[str] | None = None) -> DataFrame | None:
        path = self.path(name, "csv")
        if _exists(lambda: self.spark.read.text(path)) is None:
            return None
        return read_csv(self.spark, path, self.schemas[name], columns,
                        free_text=name in self.free_text)

    def empty(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        frame = self.spark.createDataFrame([], self.schemas[name])
        return frame if columns is None else frame.select(*columns)

    def read(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """Parquet if there, else CSV, else empty."""
        for scan in (self.parquet, self.csv):
            found = scan(name, columns)
            if found is not None:
                return found
        return self.empty(name, columns)

    def materialise(self, name: str) -> bool:
        """Convert a CSV source to Parquet once; False when nothing was to do.

        What an interrupted conversion left is written anew; other data is not
        overwritten.
        """
        if self.parquet(name) is not None:
            return False
        source = self.csv(name)
        if source is None:
            return False
        path = self.path(name, "parquet")
        begun = _begun(self.spark, path)
        files = begun.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.create(begun, True).close()
        source.write.mode("overwrite").parquet(path)
        # Without a _SUCCESS (success marks can be off) the table has no mark to be read by.
        done = self.spark._jvm.org.apache.hadoop.fs.Path(path, COMMIT_MARKS[0])
        if not files.exists(done):
            files.create(done, True).close()
        files.delete(begun, False)
        return True

    def materialise_all(self) -> list[str]:
        return [name for name in self.schemas if self.materialise(name)]

    def sources(self) -> Sources:
        return Sources(**{name: partial(self.read, name) for name in SOURCE_SCHEMAS})

    def register(self) -> None:
        """Expose every source to SQL as a temporary view under its name."""
        for name in self.schemas:
            self.read(name).createOrReplaceTempView(name)

    def counts(self) -> DataFrame:
        return count_rows({name: self.read(name) for name in self.schemas})


def count_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: its name and number of rows."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
