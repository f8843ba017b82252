
import pytest

from tidemark.operators.sequences import tree_levels


def test_deep_trees_are_not_cut(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(3)], "parent long, child long")
    assert sorted(tuple(r) for r in tree_levels(edges, 0, 3).collect()) == [(i, i) for i in range(4)]
    with pytest.raises(ValueError, match="below level 2"):
        tree_levels(edges, 0, 2)
