"""Small tables with the odd rows every operator must stand."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside; a table may have them too.
CLASHING = ("row", "key", "n", "rep", "label", "size", "taken", "target", "segment", "words", "_row", "score")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(LOWER))


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in each column, empty and very long texts, ties and repeated rows."""
    long_text = prose(1, 60_000)
    return [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 3), (None, "No id here at all", "en", "b", 17),
        (5, "one", "de", None, 3), (6, "Two words", None, None, 9), (7, long_text, "en", "b", len(long_text)),
        (8, "x" * 200_000, "fr", "c", 200_000), (9, "twice the same row", "en", "c", None), (9, "twice the same row", "en", "c", None),
        (10, "tie tie tie tie", "en", "", 15), (11, "tie tie tie tie", "en", "", 15), (12, "Ünïcode 漢字 🙂 end", "de", "d", 18),
        (-4, "negative id, 0 letters", "en", "d", 22), (14, "!!! 123 ???", "en", "d", 11),
    ]


def documents(spark: SparkSession, rows: list[tuple], clashing: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    if clashing:
        df = df.select("*", *(F.lit(k).alias(name) for k, name in enumerate(CLASHING)))
    return df


def rows_of(df: DataFrame) -> list[tuple]:
    """All rows with the columns in name order, sorted."""
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
