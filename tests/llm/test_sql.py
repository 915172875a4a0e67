import pytest

from cashtide.llm import queries
from tests.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op9_jaccard_join", "op10_embedding_near_dedup"])
def test_similarity_joins_equal_their_sql(spark, name):
    assert differences(spark, SF, queries.queries()[name], queries.oracle_sql()[name]) is None
