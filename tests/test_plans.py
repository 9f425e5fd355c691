import pytest

import __spark_entry__ as entry
from colloquy.operators.align import attribute_words
from colloquy.sources import fixtures as fx
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "AggregateInPandas", "ArrowAggregatePython", "WindowInPandas",
                "ArrowWindowPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow",
                "FlatMapCoGroupsInPandas", "FlatMapCoGroupsInArrow", "PythonUDF", "PythonUDTF")
# the core but for the completion hook, which runs the user's client
NATIVE = sorted(set(entry.QUERIES) - {"note_calls"})


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract_keys_align():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 24


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["session_id", "transcript"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_registered_plans(spark, name):
    p = plan(entry.queries()[name](spark, SF_SMALL))
    assert not any(n in p for n in PYTHON_NODES), name


def test_projection_pushed_to_scan(spark):
    p = plan(entry.queries()["redact_documents"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_attribution_clustered_by_session_and_block(spark):
    f = fx.all_fixtures(spark, SF_SMALL)
    p = plan(attribute_words(f["words"], f["turns"]))
    assert "hashpartitioning(session_id" in p and "_blk" in p
