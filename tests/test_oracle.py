"""Registered driver queries against their DuckDB oracle SQL on sf0.001."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = ["m1_closed_customer", "m1_closed_lineitem", "m5_closed_fp_customer",
         "m4_frequent_fp_events", "m8_rules_customer", "j6_closed_only_words",
         "a4_itemset_closure_lineitem", "m2_approx_closed_events", "m6_apriori_brands",
         "s6_size_variants_customer", "a5_dataset_closure", "a6_grouped_closure_lineitem",
         "a7_frequent_among_customer", "a13_level_union_words", "f2_min_support_words",
         "j6_closed_any_words", "m7_son_words", "s1_bigint_parts", "s1_hashed_brands", "s1_line_ids_parts",
         "p1_sample_text_brands",
         "s5_s1_roundtrip_lineitem", "s8_lattice_roundtrip_customer"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    ok, msg = compare(spark, duck(SF), name, SF)
    assert ok, msg


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["itemset", "support"]
    assert df.count() > 0


def test_entry_without_the_training_data_operators(tmp_path):
    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "basketry", tmp_path / "basketry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
    assert out.stdout.split() == ["True", "False"], out.stderr
