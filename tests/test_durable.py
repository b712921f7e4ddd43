import os

import pytest

from newsweave.plans.durable import durable, scratch


def where(table):
    return table.durable_path.removeprefix("file:")


def test_scratch_deletes_what_is_not_kept(spark):
    with scratch(spark) as keep:
        first = durable(spark.range(10), "first")
        with scratch(spark) as keep_inner:
            lost, handed = durable(first.where("id > 2"), "lost"), keep_inner(durable(first.where("id > 5"), "handed"))
            result = keep_inner(durable(lost.unionByName(handed), "result"))
        assert not os.path.exists(where(lost)) and os.path.exists(where(handed))
        keep(result)
    assert not os.path.exists(where(first)) and not os.path.exists(where(handed))
    assert result.count() == 11
    after = durable(spark.range(1), "after")
    assert os.path.exists(where(after))


def test_scratch_deletes_all_when_it_raises(spark):
    made = []
    with pytest.raises(ValueError), scratch(spark) as keep:
        made.append(keep(durable(spark.range(3), "made")))
        raise ValueError
    assert not os.path.exists(where(made[0]))
