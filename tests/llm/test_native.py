"""Operators that use DataFrame functions alone plan no Python worker."""

import pytest

from pyspark.sql import DataFrame

from colloquy.llm import chat_tools, common, entropy_mix, queries
from tests.test_plans import PYTHON_NODES, plan


@pytest.mark.parametrize("name", ["op2_chat_tools", "op4_secrets", "op13_mix"])
def test_no_python_in_any_plan(spark, monkeypatch, name):
    """Neither in the result's plan nor in those of the tables written on the way."""
    seen = []
    for owner in (common.Workspace, common, chat_tools, entropy_mix):
        write = owner.saved
        monkeypatch.setattr(owner, "saved", lambda *a, write=write: (seen.append(plan(next(x for x in a if isinstance(x, DataFrame)))), write(*a))[1])
    seen.append(plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001")))
    assert len(seen) > (0 if name == "op4_secrets" else 5)
    assert not any(n in p for n in PYTHON_NODES for p in seen)


def test_other_operators_do_plan_python(spark):
    """The list of nodes knows the ones that are used."""
    assert any(n in plan(queries.QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001")) for n in PYTHON_NODES)
