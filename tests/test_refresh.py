"""Month-wise refresh of stored facts, and what is read from their files alone."""

import os

import pytest

from tests.compare import _plain
from waybill.plans.facts import build_facts
from waybill.schemas import SOURCE_SCHEMAS
from waybill.sources.refresh import StoredFacts
from waybill.sources.sinks import stored_date_bounds

DAYS = {1: "2020-01-05", 2: "2020-01-20", 3: "2020-02-03", 4: "2020-04-09", 5: None}


def order(k, day=None, customer="c1"):
    day = day or DAYS[k]
    return (f"o{k}", customer, "delivered", day and f"{day} 10:00:00", None, None, None, None)


def deliver(spark, root, name, rows):
    """Append one file to a source folder; times are given as text."""
    schema = SOURCE_SCHEMAS[name]
    text = spark.createDataFrame(rows, ", ".join(f"{f.name} string" for f in schema)) if rows else None
    df = text.selectExpr(*(f"CAST({f.name} AS {f.dataType.simpleString()}) {f.name}" for f in schema)) if rows else spark.createDataFrame([], schema)
    df.coalesce(1).write.mode("append").parquet(f"{root}/{name}")


@pytest.fixture
def stored(spark, tmp_path):
    root = str(tmp_path / "sources")
    for name in SOURCE_SCHEMAS:
        deliver(spark, root, name, {
            "orders": [order(k) for k in DAYS], "items": [(f"o{k}", "1", "p", "s", str(10 * k), "1") for k in DAYS],
            "payments": [("o1", "1", "card", "2", "11")], "reviews": [("o3", "4")],
            "customers": [("c1", "SP"), ("c2", "RJ")],
        }.get(name, []))
    return StoredFacts(spark, root, str(tmp_path / "facts"))


def same(stored):
    got, wanted = stored.read(), build_facts(stored.tables())
    assert got.columns == wanted.columns

    def rows(df):
        return sorted(tuple(map(_plain, r)) for r in df.collect())

    assert rows(got) == rows(wanted)


def files(stored):
    return {m: sorted(f for f in os.listdir(f"{stored.path}/{m}") if f.endswith(".parquet")) for m in os.listdir(stored.path) if m.startswith("ym=")}


def test_only_touched_months_are_rebuilt(spark, stored):
    assert stored.refresh() == ["2020-01", "2020-02", "2020-04", "NaT"]
    same(stored)
    before = files(stored)
    assert stored.refresh() == [] and files(stored) == before
    deliver(spark, stored.sources, "reviews", [("o3", "1"), ("o9", "2")])
    deliver(spark, stored.sources, "orders", [order(6, "2020-05-01", "c2")])
    assert stored.refresh() == ["2020-02", "2020-05"]
    same(stored)
    after = files(stored)
    assert {m for m in after if before.get(m) != after[m]} == {"ym=2020-02", "ym=2020-05"}
    # The late order of an item that is there already, and a state that changes.
    deliver(spark, stored.sources, "items", [("o7", "1", "p", "s", "5", "1")])
    assert stored.refresh() == []
    deliver(spark, stored.sources, "orders", [order(7, "2020-04-30")])
    assert stored.refresh() == ["2020-04"]
    same(stored)


def test_files_that_vanish(spark, stored):
    deliver(spark, stored.sources, "orders", [order(8, "2020-07-01")])
    stored.refresh()
    last = max((f for f in os.listdir(f"{stored.sources}/orders") if f.startswith("part")),
               key=lambda f: os.path.getmtime(f"{stored.sources}/orders/{f}"))
    os.remove(f"{stored.sources}/orders/{last}")
    assert stored.refresh() == ["2020-07"]
    assert "ym=2020-07" not in files(stored)
    same(stored)
    for f in os.listdir(f"{stored.sources}/payments"):
        if f.startswith("part"):
            os.remove(f"{stored.sources}/payments/{f}")
    deliver(spark, stored.sources, "payments", [("o2", "1", "slip", "1", "7")])
    assert stored.refresh() == ["2020-01", "2020-02", "2020-04", "NaT"]
    same(stored)


@pytest.mark.parametrize("broken", ["_rebuild", "manifest", "pending"])
def test_an_interrupted_refresh_is_finished_by_the_next(spark, stored, monkeypatch, broken):
    stored.refresh()
    deliver(spark, stored.sources, "payments", [("o3", "1", "card", "3", "30")])
    whole = stored._write

    def fail(rows, schema, name):
        if name == broken:
            raise OSError("lost")
        whole(rows, schema, name)

    def lost(months):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if broken == "_rebuild":
            m.setattr(stored, "_rebuild", lost)
        else:
            m.setattr(stored, "_write", fail)
        with pytest.raises(OSError):
            stored.refresh()
    assert "2020-02" in stored.refresh()
    same(stored)
    assert stored.refresh() == []


def test_bounds_come_from_file_statistics(spark, stored):
    stored.refresh()
    bounds = stored_date_bounds(spark, stored.path, stored.read().schema)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = bounds._jdf.queryExecution().explainString(mode)
    assert "PushedAggregation: [MIN(purchase_date), MAX(purchase_date)]" in plan
    assert [tuple(map(str, r)) for r in bounds.collect()] == [("2020-01-05", "2020-04-09")]
