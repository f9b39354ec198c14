"""Columns of the caller that have the names the operators use inside."""

import pytest
from pyspark.sql import functions as F

from blockweave.llm import decontaminate, line_quality, mixing, near_dedup, secrets
from blockweave.llm.common import free_names
from tests.llm.helpers import docs

NAMES = ("_key", "_KEY2", "_good", "_bad", "_gone", "_k", "_h", "_n", "_most", "rid", "h", "deal", "tie", "range", "at", "node", "bucket", "label", "key", "size_", "whole")


@pytest.fixture
def many(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(12)]
    return docs(spark, texts).select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"w3x{j}" for j in range(20)))], "item_id long, text string")


@pytest.mark.parametrize("stage", ["remove", "dedupe", "keep_good", "clean", "mix", "redact"])
def test_columns_are_passed_on(spark, many, stage):
    run = {
        "remove": lambda: decontaminate.remove(many, bench(spark)), "dedupe": lambda: near_dedup.dedupe(many), "keep_good": lambda: line_quality.keep_good(many),
        "clean": lambda: line_quality.clean(many), "mix": lambda: mixing.mix(many), "redact": lambda: secrets.redact(many, None),
    }[stage]
    out = run()
    assert [c for c in out.columns if c in many.columns] == many.columns
    rows = out.collect()
    assert len(rows) == (11 if stage == "remove" else 12)
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES)


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "_KEY int, __key int")
    assert free_names(df, "_key", "_key", "a") == ["___key", "____key", "a"]
