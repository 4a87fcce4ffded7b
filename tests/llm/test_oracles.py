"""The operators' queries against their DuckDB SQL, on the driver's table and on odd rows."""

import pytest
from pyspark.sql import functions as F

from tests.differential import check, connect
from veldrift.llm import oracle, queries

from .cases import frame

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    check(spark, SMALL, queries.queries()[name], oracle.oracle_sql()[name], connect(SMALL))


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op5_license_scan", "op10_substring_dedup"])
def test_query_equals_its_sql_on_odd_rows(spark, name, tmp_path):
    docs = frame(spark).drop("a.b")
    at = lambda k, text: docs.limit(1).select(*[F.lit(text).alias(c) if c == "text" else F.lit(k).cast("long").alias(c) if c == "doc_id" else c for c in docs.columns])
    for k, text in enumerate(["Released under BSD.", "MIT license mit License. Distributed under Apache 2.0; gpl v2", "neither the name of A nor the names of its contributors", "under the MIT License " * 3]):
        docs = docs.unionByName(at(9000 + k, text))
    docs.coalesce(1).write.parquet(f"{tmp_path}/t")
    (one,) = (tmp_path / "t").glob("*.parquet")
    one.rename(tmp_path / "documents.parquet")
    check(spark, str(tmp_path), queries.queries()[name], oracle.oracle_sql()[name], connect(str(tmp_path)))
