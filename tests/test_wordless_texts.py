"""Texts without words: their whole has no tokens, so shares of it are 0 of 0."""

import re

import duckdb
import numpy as np
import pytest

from ratefid.plans import registry

registry.load()
WORDS = ["A b c. D. E f g h. I j. K l. M n", "M b. E f g. E f g. I j. K l. M n", "b", "X y. Z. A c d. A. B. A  d ! A c. "]
WORDLESS = [None, "", " . ", "\n\t!? --"]


def both(spark, folder, name, texts):
    """The query's table and the SQL's, in one order."""
    con = duckdb.connect()
    for t, df in (("documents", spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), ("benchmark", spark.createDataFrame([(0, "m b"), (1, "a d x")], "item_id long, text string"))):
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    frames = registry.QUERIES[name](spark, str(folder)).toPandas(), con.sql(registry.oracles()[name]).to_df()
    return [f[sorted(f.columns)].sort_values(["arm", "depth"]).reset_index(drop=True) for f in frames]


@pytest.mark.parametrize("texts", [WORDS, WORDLESS, WORDS + WORDLESS * 3], ids=["words", "wordless", "both"])
def test_keep_rates(spark, tmp_path, texts):
    got, want = both(spark, tmp_path, "i23_keep_rate_table", texts)
    assert len(got) == 14 and list(zip(got.arm, got.depth)) == list(zip(want.arm, want.depth))
    for c in ("keep_rate", "fidelity", "delta"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=0, atol=1e-12)
    assert got.keep_rate.isna().all() == (texts != WORDS) and got.fidelity.notna().all()


def test_keep_rates_are_worked_out_in_the_row(spark):
    plan = registry.QUERIES["i23_keep_rate_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not re.search(r"\(doc_id#\d+L? = doc_id#\d+L?\)", plan)
