"""What the plans must and must not hold."""

import os
import re

import pytest

from quillvec.llm import common, decontamination, line_dedup, lines, packing, quality_classifier, queries, simhash, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def every_plan(monkeypatch, spark):
    """The plans of all tables that a query writes on its way, and of its result."""

    def run(name):
        seen = []
        real = common.durable

        def spy(df):
            seen.append(plan(df))
            return real(df)

        for module in (decontamination, toxicity, quality_classifier, lines, line_dedup, substring_dedup, simhash, packing, common):
            if hasattr(module, "durable"):
                monkeypatch.setattr(module, "durable", spy)
        return plan(queries.QUERIES[name](spark, SF)), seen

    return run


@pytest.mark.parametrize("name", ["op5_quality_rules", "op7_decontamination", "op10_pii"])
def test_native_operators_run_no_python(every_plan, name):
    last, written = every_plan(name)
    assert not any(re.search("Python|Pandas|Arrow", p) for p in [last, *written])
    assert name != "op7_decontamination" or any("documents.parquet" in p for p in written)


@pytest.mark.parametrize("name", ["op5_quality_rules", "op9_token_counts", "op10_pii"])
def test_row_operators_do_not_shuffle(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert "Exchange" not in text and re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op3_line_dedup", "op4_toxicity", "op6_quality_classifier", "op8_simhash", "op9_token_counts"])
def test_texts_go_to_python_once(every_plan, name):
    """Of all plans that read whole documents, one has a Python step, and just one step."""
    last, written = every_plan(name)
    steps = [p.count("ArrowEvalPython") for p in [*written, last] if "documents.parquet" in p and "ArrowEvalPython" in p]
    assert steps == [1]


def test_tables_are_written_to_the_shared_folder_and_the_session_stays_as_it_was(spark):
    before = spark.conf.get(common.BATCH_SETTING)
    out = common.durable(spark.range(10).toDF("x"))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert all(folder in f for f in out.inputFiles())
    assert spark.conf.get(common.BATCH_SETTING) == before and out.count() == 10
    common.discard(out)
    assert not os.path.exists(out._table_path.removeprefix("file://"))


def test_every_operator_has_a_query():
    assert [n for n in queries.QUERIES] == [f"op{k}_{n}" for k, n in enumerate(("packing", "substring_dedup", "line_dedup", "toxicity", "quality_rules", "quality_classifier", "decontamination", "simhash", "token_counts", "pii"), 1)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
