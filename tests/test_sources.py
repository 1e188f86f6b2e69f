"""Scans, their fallbacks, and sinks."""

import os
import time
import uuid
from datetime import date, datetime
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from waybill import session
from waybill.operators.filters import in_period, in_year
from waybill.plans.facts import build_facts
from waybill.schemas import SOURCE_SCHEMAS
from waybill.session import clear_scratch, shared_dir, stage
from waybill.sources.catalogue import Catalogue, read_csv
from waybill.sources.sinks import read_facts, write_bucketed, write_facts
from waybill.streaming.ingest import ingest_new_csv

ORDERS = (
    "order_id,customer_id,order_status,order_purchase_timestamp,extra\n"
    "o1,c1,delivered,2017-10-02 10:56:33,x\n"
    "o2,c2,shipped,not a date,y\n"
    "o3,,NA,,z\n"
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "shop_orders.csv").write_text(ORDERS)
    (tmp_path / "items.csv").write_text("order_id,order_item_id,product_id,price\no1,1,p1,12.5\no1,2,p2,oops\n")
    (tmp_path / "reviews.csv").write_text('order_id,comment,review_score\no1,"two\nlines, ""quoted""",4\no1,ok,5\n')
    return tmp_path


def catalogue(spark, folder):
    return Catalogue(spark, str(folder), files={"orders": "shop_orders"}, free_text=frozenset({"reviews"}))


def test_csv_is_read_by_header_name_under_the_fixed_schema(spark, folder):
    orders = catalogue(spark, folder).read("orders")
    assert orders.schema == SOURCE_SCHEMAS["orders"]
    got = {r.order_id: r for r in orders.collect()}
    assert got["o1"].order_purchase_timestamp == datetime(2017, 10, 2, 10, 56, 33)
    assert got["o2"].order_purchase_timestamp is None
    assert (got["o3"].customer_id, got["o3"].order_status) == (None, None)
    assert catalogue(spark, folder).read("orders", ["order_id"]).columns == ["order_id"]
    assert [r.price for r in catalogue(spark, folder).read("items").orderBy("order_item_id").collect()] == [12.5, None]


def test_quoted_line_breaks(spark, folder):
    assert sorted(r.review_score for r in catalogue(spark, folder).read("reviews").collect()) == [4.0, 5.0]


def test_each_file_is_read_in_its_own_encoding(spark, tmp_path):
    text = "customer_id,customer_state\nc1,São Paulo\nc2,plain\n"
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "u.csv").write_bytes(("\ufeff" + text).encode("utf-8"))
    (folder / "l.csv").write_bytes(text.encode("latin-1"))
    for path in (folder / "u.csv", folder / "l.csv", folder):
        found = read_csv(spark, str(path), SOURCE_SCHEMAS["customers"]).collect()
        assert {(r.customer_id, r.customer_state) for r in found} == {("c1", "São Paulo"), ("c2", "plain")}
    given = read_csv(spark, str(folder / "u.csv"), SOURCE_SCHEMAS["customers"], encoding="UTF-8")
    assert sorted(r.customer_state for r in given.collect()) == ["São Paulo", "plain"]


def test_absent_sources_are_empty_tables(spark, folder):
    sellers = catalogue(spark, folder).read("sellers")
    assert sellers.count() == 0 and sellers.schema == SOURCE_SCHEMAS["sellers"]
    facts = build_facts(catalogue(spark, folder).sources())
    assert {(r.order_id, r.gross_revenue) for r in facts.collect()} == {("o1", 12.5), ("o2", 0.0), ("o3", 0.0)}
    assert facts.count() == 4


def test_parquet_is_made_once_and_preferred(spark, folder):
    cat = catalogue(spark, folder)
    assert sorted(cat.materialise_all()) == ["items", "orders", "reviews"]
    assert cat.materialise_all() == []
    (Path(folder) / "shop_orders.csv").write_text(ORDERS.replace("o1", "changed"))
    assert {r.order_id for r in cat.read("orders").collect()} == {"o1", "o2", "o3"}
    counts = {r.source: r.rows for r in cat.counts().collect()}
    assert (counts["orders"], counts["items"], counts["reviews"], counts["sellers"]) == (3, 2, 2, 0)


def test_an_interrupted_conversion_is_done_again(spark, folder):
    cat = catalogue(spark, folder)
    cat.materialise("items")
    written = Path(folder) / "items.parquet"
    (written / "_SUCCESS").unlink()
    next(written.glob("part-*")).unlink()
    assert cat.parquet("items") is None and cat.read("items").count() == 2
    assert cat.materialise("items") and cat.parquet("items").count() == 2
    assert Catalogue(spark, str(folder), commit_mark=False).parquet("items").count() == 2


def test_sources_are_visible_to_sql(spark, folder):
    catalogue(spark, folder).register()
    assert spark.sql("SELECT count(*) AS n FROM orders JOIN items USING (order_id)").first().n == 2


@pytest.fixture
def whole_plans(spark):
    """Plans printed without shortening."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_filters_reach_the_parquet_reader(spark, tmp_path, capsys, whole_plans):
    path = str(tmp_path / "facts")
    facts = spark.range(100).select(
        F.col("id").alias("order_id"),
        F.timestamp_seconds(1483228800 + F.col("id") * 86400 * 7).alias("purchase_dt"),
    ).withColumn("ym", F.date_format("purchase_dt", "yyyy-MM"))
    write_facts(facts, path)
    stored = spark.read.schema("order_id long, purchase_dt timestamp, ym string").parquet(path)
    part = in_period(stored, date(2017, 3, 1), date(2017, 4, 30))
    assert part.count() == facts.filter("ym in ('2017-03', '2017-04')").count() > 0
    part.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(ym" in plan and "GreaterThanOrEqual(purchase_dt" in plan
    in_year(stored, 2018, "purchase_dt").select("order_id").explain()
    plan = capsys.readouterr().out
    assert "LessThan(purchase_dt" in plan and "struct<order_id:bigint,purchase_dt:timestamp>" in plan


def test_unused_sources_are_not_read(spark, capsys, whole_plans):
    from contract.queries import facts_of
    folder = "/root/testdata/sf0.001"
    facts_of(spark, folder, "on_time").explain()
    plan = capsys.readouterr().out
    assert "orders.parquet" in plan and "lineitem.parquet" not in plan and "customer.parquet" not in plan
    # Asked for everything, Catalyst still drops the joins a report does not use.
    facts_of(spark, folder).agg(F.max("purchase_dt")).explain()
    plan = capsys.readouterr().out
    assert "orders.parquet" in plan and "lineitem.parquet" not in plan and "Join" not in plan


def test_bucketed_sources_join_without_exchange(spark, capsys):
    orders = spark.range(1000).select(F.col("id").alias("order_id"), F.lit(1).alias("x"))
    try:
        write_bucketed(orders, "waybill_b_orders", "order_id", 4, "overwrite")
        write_bucketed(orders.withColumnRenamed("x", "y"), "waybill_b_items", "order_id", 4, "overwrite")
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table("waybill_b_orders").join(spark.table("waybill_b_items"), "order_id", "left")
        joined.explain()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "Exchange" not in capsys.readouterr().out
        assert joined.count() == 1000
    finally:
        spark.sql("DROP TABLE IF EXISTS waybill_b_orders")
        spark.sql("DROP TABLE IF EXISTS waybill_b_items")


def test_staging_goes_to_the_shared_folder(spark):
    staged = stage(spark.range(5))
    assert staged.count() == 5
    assert shared_dir(spark).replace("file:", "") in staged.inputFiles()[0]
    place = Path(staged.inputFiles()[0].removeprefix("file://")).parent
    clear_scratch(spark)
    assert not place.exists()


def test_each_csv_file_is_ingested_once(spark, tmp_path):
    incoming, target, name = tmp_path / "in", str(tmp_path / "out"), f"test-{uuid.uuid4().hex}"
    incoming.mkdir()

    def run():
        query = ingest_new_csv(spark, str(incoming), target, SOURCE_SCHEMAS["sellers"], name)
        assert query.awaitTermination(120)
        return sorted(r.seller_id for r in spark.read.parquet(target).collect())

    (incoming / "1.csv").write_text("seller_id,seller_state\ns1,SP\ns2,RJ\n")
    assert run() == ["s1", "s2"]
    assert run() == ["s1", "s2"]
    (incoming / "2.csv").write_text("seller_id,seller_state\ns3,MG\n")
    assert run() == ["s1", "s2", "s3"]
    # Another session, under another name, goes on with the same target.
    name = f"test-{uuid.uuid4().hex}"
    (incoming / "3.csv").write_bytes("seller_id,seller_state\ns4,NA\ns5,Pará\n".encode("latin-1"))
    assert run() == ["s1", "s2", "s3", "s4", "s5"]
    states = {r.seller_id: r.seller_state for r in spark.read.parquet(target).collect()}
    assert states["s4"] is None and states["s5"] == "Pará"


class _Session:
    """Just enough of a session for the folder look-up."""

    def __init__(self, master, folder=None):
        self.settings = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.applicationId = uuid.uuid4().hex
        self.master = master
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


def test_a_cluster_needs_a_named_shared_folder():
    assert shared_dir(_Session("yarn", "hdfs:///tmp/x/")) == "hdfs:///tmp/x"
    for folder in (None, "file:///tmp/x", "/tmp/x"):
        with pytest.raises(ValueError):
            shared_dir(_Session("yarn", folder))
    assert shared_dir(_Session("local[2]", "/tmp/x")) == "/tmp/x"
    local = _Session("local[4]")
    assert shared_dir(local) == shared_dir(local) and Path(shared_dir(local)).is_dir()


class _Cluster(_Session):
    """A cluster whose jobs run in the tests' session."""

    defaultParallelism = 3

    def __init__(self, spark, folder=None, warehouse=None):
        super().__init__("spark://host:7077", folder)
        if warehouse:
            self.settings["spark.sql.warehouse.dir"] = warehouse
        self.range, self.read, self._jvm, self._jsc = spark.range, spark.read, spark._jvm, spark._jsc


@pytest.mark.parametrize("scheme", ["file://", "file:", ""])
def test_a_mounted_folder_serves_where_tasks_have_reached_it(spark, tmp_path, scheme):
    folder = f"{scheme}{tmp_path}"
    cluster = _Cluster(spark, f"{folder}/")
    assert shared_dir(cluster) == folder
    # Nothing is left of the trial.
    assert [*(tmp_path / f"waybill-{cluster.applicationId}").iterdir()] == []
    assert shared_dir(_Cluster(spark, warehouse=folder)) == folder
    local = _Session("local-cluster[3,2,3000]", folder)
    assert shared_dir(local) == folder


def test_a_folder_that_tasks_do_not_reach_is_refused(spark, tmp_path):
    (tmp_path / "file").write_text("no folder")
    for cluster in (_Cluster(spark, f"file://{tmp_path}/file"), _Cluster(spark)):
        with pytest.raises(ValueError):
            shared_dir(cluster)
    # Tasks on machines of their own leave nothing that the driver sees.
    lossy = _Cluster(spark, f"file://{tmp_path}/lossy")
    lossy.range = lambda start, end, step, tasks: spark.range(start, end - 1, step, tasks)
    with pytest.raises(ValueError, match="not shared"):
        shared_dir(lossy)


def test_the_warehouse_serves_where_the_named_folder_is_not_shared(spark, tmp_path):
    (tmp_path / "file").write_text("no folder")
    warehouse = f"file://{tmp_path}/warehouse"
    assert shared_dir(_Cluster(spark, f"file://{tmp_path}/file", warehouse)) == warehouse
    # A folder of each machine's own, as an installation's default may name.
    lossy, calls = _Cluster(spark, f"{tmp_path}/own", warehouse), []

    def written(start, end, step, tasks):
        calls.append(tasks)
        return spark.range(start, end - (len(calls) == 1), step, tasks)

    lossy.range = written
    assert shared_dir(lossy) == shared_dir(lossy) == warehouse
    assert len(calls) == 2  # both tried, once


def test_the_folder_is_tried_again_with_executors_that_came_later(spark, tmp_path, monkeypatch):
    own, warehouse, here = f"{tmp_path}/own", f"{tmp_path}/warehouse", {"driver:1", "same:2"}
    monkeypatch.setattr(session, "_executors", lambda _: set(here))
    cluster, calls = _Cluster(spark, own, warehouse), []
    cluster.range = lambda start, end, step, tasks: calls.append(tasks) or spark.range(start, end, step, tasks)
    assert shared_dir(cluster) == shared_dir(cluster) == own
    here.add("other:3")  # shares the folder too
    assert shared_dir(cluster) == shared_dir(cluster) == own
    assert len(calls) == 2
    # The next one has a folder of its own: its rows are not in the driver's.
    here.add("other:4")
    cluster.range = lambda start, end, step, tasks: calls.append(tasks) or spark.range(start, end - (len(calls) == 3), step, tasks)
    with pytest.raises(ValueError, match="came later"):
        shared_dir(cluster)
    assert shared_dir(cluster) == warehouse
    assert calls == [3, 3, 4, 4]  # a task for each executor at least


def test_a_folder_that_late_executors_alone_refuse_is_not_kept(spark, tmp_path, monkeypatch):
    here = {"driver:1", "same:2"}
    monkeypatch.setattr(session, "_executors", lambda _: set(here))
    cluster = _Cluster(spark, f"{tmp_path}/own")
    assert shared_dir(cluster) == f"{tmp_path}/own"
    here.add("other:3")
    cluster.range = lambda start, end, step, tasks: spark.range(start, end - 1, step, tasks)
    for _ in range(2):
        with pytest.raises(ValueError, match="not shared"):
            shared_dir(cluster)


def test_the_trial_waits_for_the_executors_asked_for(spark, tmp_path, monkeypatch):
    came = []

    def executors(_):
        came.append(f"machine:{len(came)}")
        return set(came)

    monkeypatch.setattr(session, "_executors", executors)
    cluster = _Cluster(spark, str(tmp_path))
    began = time.time()
    context = SimpleNamespace(isLocal=lambda: False, startTime=lambda: began * 1000)
    cluster._jsc = SimpleNamespace(sc=lambda: context, hadoopConfiguration=spark._jsc.hadoopConfiguration)
    cluster.set("spark.executor.instances", "3")
    tasks = []
    cluster.range = lambda start, end, step, n: tasks.append(n) or spark.range(start, end, step, n)
    assert shared_dir(cluster) == str(tmp_path)
    assert tasks[0] > 4  # the driver and three executors had been seen before the trial
    # Without that number those of a young application have some time to come.
    monkeypatch.setattr(session, "REGISTERING", 2)
    young = _Cluster(spark, str(tmp_path))
    young._jsc, began = cluster._jsc, time.time()
    assert shared_dir(young) == str(tmp_path) and time.time() >= began + 2


def test_stored_facts_keep_the_month_as_text(spark, tmp_path):
    facts = spark.createDataFrame([("o", "2018-09"), ("p", "NaT")], "order_id string, ym string")
    write_facts(facts, str(tmp_path / "f"))
    assert sorted(r.ym for r in read_facts(spark, str(tmp_path / "f"), facts.schema).collect()) == ["2018-09", "NaT"]


def test_ingested_tables_are_read_and_unmarked_data_is_not_lost(spark, tmp_path):
    incoming, root = tmp_path / "in", tmp_path / "tables"
    incoming.mkdir()
    root.mkdir()
    (incoming / "1.csv").write_text("seller_id,seller_state\ns1,SP\ns2,RJ\n")
    (root / "sellers.csv").write_text("seller_id,seller_state\nold,SP\n")
    target = str(root / "sellers.parquet")
    query = ingest_new_csv(spark, str(incoming), target, SOURCE_SCHEMAS["sellers"], f"test-{uuid.uuid4().hex}")
    assert query.awaitTermination(120)
    cat = Catalogue(spark, str(root))
    assert not cat.materialise("sellers")
    assert {r.seller_id for r in cat.read("sellers").collect()} == {"s1", "s2"}
    # A writer with success marks turned off.
    cat.read("sellers").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/plain.parquet")
    (root / "plain.parquet" / "_SUCCESS").unlink(missing_ok=True)
    (root / "plain.csv").write_text("seller_id,seller_state\nold,SP\n")
    other = Catalogue(spark, str(root), files={"sellers": "plain"})
    for call in (other.read, other.materialise):
        with pytest.raises(ValueError, match="commit mark"):
            call("sellers")
    assert spark.read.parquet(f"{root}/plain.parquet").count() == 2
    # What a conversion began and left is written anew.
    (root / "_plain.parquet.begun").touch()
    assert other.materialise("sellers") and [r.seller_id for r in other.read("sellers").collect()] == ["old"]


def test_a_scope_deletes_what_was_staged_in_it_but_what_is_kept(spark):
    from waybill.session import scratch_scope, stage

    df = spark.range(5).toDF("k")
    with scratch_scope(spark) as outer:
        with scratch_scope(spark) as keep:
            lost, kept = stage(df, "lost"), keep(df, "kept")
            inside = lost.inputFiles()
        assert inside and not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in inside)
        assert kept.count() == 5
        last = outer(df, "last")
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in kept.inputFiles())
    assert last.count() == 5
