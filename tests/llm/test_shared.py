from pathlib import Path

import pytest

from folioflow.llm.shared import drop, keep, shared_dir, tidy


def tables(spark):
    at = Path(shared_dir(spark).removeprefix("file://")) / "tables"
    return {p.name for p in at.iterdir()} if at.exists() else set()


def test_tables_of_a_failure_go(spark):
    before = tables(spark)

    @tidy
    def works():
        return keep(spark.range(3))

    @tidy
    def fails():
        works()
        keep(spark.range(2))
        raise ValueError("late")

    with pytest.raises(ValueError):
        fails()
    assert tables(spark) == before
    kept = works()
    assert kept.count() == 3 and len(tables(spark) - before) == 1
    drop(kept)
    assert tables(spark) == before
    with pytest.raises(Exception, match="(?i)by zero"):
        tidy(lambda: keep(spark.sql("select 1 / (id - id) as x from range(3)")))()
    assert tables(spark) == before
