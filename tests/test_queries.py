"""A query of each kind against its SQL on the smallest data; catalog.checks runs them all."""
import os

import pytest

import __spark_entry__ as entry
from catalog import checks

SF = "/root/testdata/sf0.001"
NAMES = ["d02_axes", "d12_localisation_summary", "e06_family_scores", "f02_cross_bag_null", "g01_bootstrap_by_arm", "g09_delong_per_bag",
         "h12_selection_rules", "h14_faithfulness", "i02_patch_coverage", "j01_stratified_split", "j07_place_stamps", "p03_gated_attention", "a04_flat_dump"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert checks.compare(entry.queries()[name](spark, SF), checks.duck(SF), entry.oracle_sql()[name]) == []


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 15
