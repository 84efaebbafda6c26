"""Several pages under one URL: each keeps its own row."""

import os

import pytest
from oracle import TABLES, check
from pyspark.sql import functions as F

from gossamer.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """The tables with each page a second time: another id and text, the same URL."""
    out = tmp_path_factory.mktemp("twice")
    for t in TABLES:
        if t != "pages":
            os.symlink(f"{SF}/{t}.parquet", out / f"{t}.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    more = pages.select((F.col("page_id") + 1001).alias("page_id"), "url", F.concat(F.repeat("html", F.when(F.col("page_id") % 2 == 0, 1).otherwise(9)), F.lit("<!-- again -->")).alias("html"))
    pages.unionByName(more).toPandas().to_parquet(out / "pages.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["bounded_fetch", "browser_escalation_merge"])
def test_query_equals_its_sql_where_urls_repeat(spark, twice, name):
    assert check(spark, registry.queries()[name], registry.oracle_sql()[name], twice)
