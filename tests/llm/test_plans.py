"""What the physical plans of the training-data queries must not contain."""

import pytest

from newsloom.llm.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
NATIVE = ("op3_quality_rules", "op5_mixing", "op9_license_scan")
PYTHON = ("MapInArrow", "MapInPandas", "FlatMapGroups", "FlatMapCoGroups", "PythonUDF")


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_cross_join_and_no_row_python(spark, name):
    text = REGISTRY[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text
    if name in NATIVE:
        assert not [p for p in PYTHON if p in text]
