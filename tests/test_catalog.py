"""Every named query: a callable, SQL only for known names, and no plan that gathers everything in one task."""

import ast
from pathlib import Path

import pytest

from nightloom.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_names():
    assert set(catalog.sql()) <= set(catalog.queries())
    assert {"p1_found", "p2_found", "hyp_sleep_stats", "ebe_agreement", "ev_cooccurring"} <= set(catalog.queries())


def test_core_never_imports_the_addon():
    for path in (ROOT / "nightloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["hyp_periods", "hyp_sleep_stats", "hyp_transition_probs", "ev_compare_detection", "ev_cooccurring", "ev_coincidence", "ebe_agreement", "sig_moving_corr"])
def test_plans(spark, name):
    plan = catalog.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    for bad in ("SinglePartition", "NestedLoop", "CartesianProduct", "BatchEvalPython"):
        assert bad not in plan, bad
