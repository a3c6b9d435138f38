import pytest

import __spark_entry__
from helpers import same
from keyloom.oracles import ORACLES
from keyloom.queries import QUERIES


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["key", "value"]
