import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle_check import rows_of_query, rows_of_sql  # noqa: E402

from tidemark.plans.oracle import oracle  # noqa: E402
from tidemark.plans.registry import QUERIES  # noqa: E402

ORACLE = oracle()
ITERATIVE = {"communities", "video_communities", "video_modules", "video_communities_greedy"}  # partitions, held by video_partition_checks and tests


def test_every_relation_has_sql_or_is_iterative():
    assert set(QUERIES) - set(ORACLE) <= ITERATIVE
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_relation_matches_sql(spark, small, name):
    assert rows_of_query(QUERIES[name](spark, small)) == rows_of_sql(ORACLE[name], small)
