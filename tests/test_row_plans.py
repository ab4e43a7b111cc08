"""Queries on one document's lattice work it out in its row: nothing is shuffled by document, so the work grows with the documents only."""

import re

import pytest

from ratefid.operators import evidence as evd
from ratefid.plans import input_queries as inp
from ratefid.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"
IN_ROW = ["e05_scored_list_answers", "g02_optimal_actions", "g07_histories_with_costs", "g08_on_policy_audit", "g32_history_dependence", "g24_tail_cost_edges", "f17_oracle_rows", "f11_frontier_summary", "i04_pair_accuracy", "i01_arm_rows", "g20_linear_extensions", "c08_policy_on_dev", "c05_linked_title_pair", "b19_evidence_certificate", "g34_neutral_exchanges", "h17_fragment_provenance"]


@pytest.mark.parametrize("name", IN_ROW)
def test_no_shuffle_by_document(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [doc_id" not in plan
    assert not re.search(r"\(doc_id#\d+L? = doc_id#\d+L?\)", plan)


def test_reruns_of_every_arm_with_levels_and_cost(spark):
    got = registry.QUERIES["i18_rerun_agreement"](spark, SF).toPandas()
    assert set(got.arm) == {"learned", "control"} and {"level_flips", "level_agreement", "cost"} <= set(got.columns)
    assert (got.cost[got.depth > 0] > 0).all() and got.level_flips.sum() > 0


def test_proofs_are_judged_once_before_the_ranking(spark, monkeypatch):
    written, write = [], evd.round_trip
    monkeypatch.setattr(evd, "round_trip", lambda df, name: written.append(name) or write(df, name))
    rows = spark.createDataFrame([(1, "eligible", ["a"], ["u"]), (2, "too few", ["b"], ["v"]), (3, "eligible", ["c"], ["w"])], "doc_id long, fate string, keys array<string>, units array<string>")
    got = evd.hash_ordered(rows, "doc_id", "pool").toPandas()
    assert written == ["eligible", "records"] and sorted(got.position) == [0, 1] and set(got.doc_id) == {1, 3}


def test_texts_are_read_once_for_all_folds(spark, monkeypatch):
    written, write = [], inp.files.round_trip
    monkeypatch.setattr(inp.files, "round_trip", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(inp.bd, "held_out_probe", lambda rows, *rest: rows)
    got = inp.k15_held_out_probe(spark, SF)
    assert written == ["probe"] and "documents" not in "".join(got.inputFiles()) and got.count() == got.select("doc_id").distinct().count() > 0
