"""Every registered query agrees with its SQL twin on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from __spark_entry__ import entry
from contract.oracle import ORACLE
from contract.queries import QUERIES
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
NO_TWIN = {"risk_top_features", "risk_model_quality"}


@pytest.fixture(scope="module")
def twins():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_twin(spark, twins, name):
    assert differences(QUERIES[name](spark, FOLDER), twins, ORACLE[name]) == []


def test_only_fitted_models_lack_a_twin():
    assert set(QUERIES) - set(ORACLE) == NO_TWIN
    assert set(ORACLE) <= set(QUERIES)


def test_entry_imports_without_the_text_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for name in ("waybill", "contract"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; from contract.queries import QUERIES as q; assert e.queries().keys() == q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["facts_table", "rfm_scores", "delivery_box_by_score", "risk_split_sizes"])
def test_partition_count_changes_nothing(spark, twins, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert differences(QUERIES[name](spark, FOLDER), twins, ORACLE[name]) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
