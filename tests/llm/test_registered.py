"""What the entry point adds of this folder."""

import __spark_entry__


def test_all_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert {n for n in __spark_entry__.oracle_sql() if n.startswith("op")} == {"op2_quality_rules", "op3_near_dedup", "op4_licenses", "op11_warc"}
