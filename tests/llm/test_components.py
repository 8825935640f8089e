"""Components are whole or an error."""

import pytest

from folioscan.llm.graph import components


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain, most_rounds=1)
    assert components(chain.where("a < 0"), most_rounds=1).isEmpty()
