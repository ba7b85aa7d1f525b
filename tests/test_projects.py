import os
import threading
from pathlib import Path

import pytest
from conftest import TINY, same_rows

from palisade import projects
from palisade.plans import pipeline


@pytest.mark.parametrize("name", sorted(projects.queries()))
def test_query_equals_oracle(name, spark, duck, capsys):
    same_rows(projects.queries()[name](spark, TINY), duck, projects.oracle_sql()[name])
    capsys.readouterr()


def test_outcomes_of_runs_side_by_side(spark, duck, monkeypatch):
    """Runs share the cluster, not their views, and what they wrote goes; the variable is set for no run that isn't strict."""
    run, lock, now, most, strict = pipeline.run, threading.Lock(), [], [], []

    def watched(session, root, select=None):
        with lock:
            now.append(root)
            most.append(len(now))
            strict.append(("strict: false" in (Path(root) / "palisade.yaml").read_text(), os.environ.get("PALISADE_STRICT")))
        try:
            return run(session, root, select)
        finally:
            with lock:
                now.remove(root)

    monkeypatch.setattr(pipeline, "run", watched)
    spark.catalog.dropTempView("stg_orders")
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")) / "palisade"
    before = set(shared.iterdir()) if shared.exists() else set()
    same_rows(projects.queries()["project_outcomes"](spark, TINY), duck, projects.oracle_sql()["project_outcomes"])
    assert len(most) == 15 and max(most) > 1
    assert sorted(strict, key=str).count((True, None)) == 1 and (True, "1") in strict
    assert not spark.catalog.tableExists("stg_orders")
    assert set(shared.iterdir()) == before
    assert "PALISADE_STRICT" not in os.environ
