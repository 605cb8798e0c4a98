"""A report that is asked for alone: it neither waits for the fact table nor computes columns that it doesn't read."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from fieldproof.operators import scoring
from fieldproof.plans import claims
from fieldproof.sources import working

SF = "/root/testdata/sf0.001"
#: What a query's plan has no use for: edit distances are for error types, whole forms for support, the factor for rounding the overlap.
ALONE = {
    "counterfactual_consistency": ("levenshtein", "bbox"), "document_scores": (), "answer_signals": ("levenshtein", "whole"), "group_parity": ("whole", "1.34217729E8"), "failure_sample": ("whole", "1.34217729E8"),
    "right_values_cited_badly": ("whole",)}


@pytest.fixture
def nothing_made(monkeypatch):
    monkeypatch.setattr(working, "_made", {})


def scored_plan(df) -> str:
    """The plan above Python's evaluation."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]


@pytest.mark.parametrize("name", ALONE)
def test_a_lone_report_reads_no_written_table(spark, nothing_made, name):
    made = entry.queries()[name](spark, SF)
    assert not working._made
    plan = scored_plan(made)
    assert not [word for word in ALONE[name] if word in plan]


def test_a_report_reads_the_fact_table_where_there_is_one(spark, nothing_made):
    alone = entry.queries()["group_parity"](spark, SF).collect()
    claims.facts(spark, SF)
    made = entry.queries()["group_parity"](spark, SF)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString() and sorted(made.collect()) == sorted(alone)


def test_bundles_score_the_chosen_documents_only(spark, nothing_made):
    made = entry.queries()["replay_bundles"](spark, SF)
    assert not working._made
    scans = [line for line in made._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line and "o_orderkey" in line]
    assert scans and all("LessThanOrEqual(o_orderkey,200)" in line for line in scans)


def test_rows_without_joins_are_those_of_the_joins(spark):
    joined, plain = claims.scored_rows(spark, SF), claims.scored_of(claims.unwritten(spark, SF))
    assert set(scoring.META) <= set(plain.columns) and sorted(plain.columns) == sorted(joined.columns)
    both = joined.select(*plain.columns)
    assert both.exceptAll(plain).count() == plain.exceptAll(both).count() == 0
