"""Plan properties that must hold at any scale, checked on every
registered query's physical plan."""

import pytest

import __spark_entry__ as E

# builders that land data or run a stream while building the DataFrame
SIDE_EFFECTS = ("src1", "src2", "src3", "src4", "src6", "x1_stream", "x2_stream", "x4_stream", "x5_stream",
                "x6_stream")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(E.queries()) if not n.startswith(SIDE_EFFECTS)])
def test_no_cartesian_or_nested_loop(spark, sf, name):
    p = plan_of(E.queries()[name](spark, sf))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_top_k_is_a_group_limit(spark, sf):
    assert "WindowGroupLimit" in plan_of(E.queries()["w3_top_k_filter"](spark, sf))
    assert "WindowGroupLimit" in plan_of(E.queries()["o4_recent_distinct"](spark, sf))


def test_scan_prunes_columns(spark, sf):
    p = plan_of(E.queries()["w5_greedy_token"](spark, sf))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in p


def test_python_only_in_codec_and_json(spark, sf):
    """JVM first: among the queries without side effects, only the
    log codec and the rereading of odd JSON run Python (Arrow-batched)."""
    with_python = []
    for name in sorted(E.queries()):
        if name.startswith(SIDE_EFFECTS):
            continue
        p = plan_of(E.queries()[name](spark, sf))
        if any("_reread(" not in line for line in p.splitlines() if "ArrowEvalPython" in line):
            with_python.append(name)
        assert "BatchEvalPython" not in p  # never row-at-a-time UDFs
    assert set(with_python) <= {"t6_encode_log", "t6_decode_log"}
