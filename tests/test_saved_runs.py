"""Runs on disk: saved, loaded in another session, refreshed there; torn ones refused."""

import pytest
from pyspark.sql import functions as F

from factloom.plans import engine
from factloom.sources import files as sources

FILES = {"src/a.ts": "export class A { foo() { bar(); } }\n", "src/b.ts": "import { A } from './a';\nfunction bar() { return new A(); } // don't\n", "package.json": '{"dependencies": {"express": "1"}}'}


def given(spark, own):
    return sources.in_memory(spark, own).withColumn("snapshot_id", F.lit("s1"))


def told(run):
    return sorted((r["kind"], r["component_id"], r["value_json"]) for r in run["facts"].collect())


def test_save_load_refresh(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    run = engine.analyse("2024", given(spark, FILES))  # a name that looks like a number stays a name
    run.save(root)
    other = spark.newSession()
    again = engine.load(other, root, "2024")
    assert again.run_id == "2024" and set(again.tables) == set(run.tables) and told(again) == told(run)
    assert all(again[t].columns == run[t].columns for t in run.tables)
    assert [r["run_id"] for r in engine.saved_runs(other, root).collect()] == ["2024"]
    changed = FILES | {"src/a.ts": "export class A { foo() { bar(); baz(); } }\n"}
    how, after = engine.refresh("r2", again, given(other, changed))
    assert how == "incremental" and told(after) == told(engine.analyse("r3", given(spark, changed)))
    with pytest.raises(ValueError, match="catalogue"):
        engine.load(spark, root, "r9")
    # a writer that died while it saved the run again
    engine.write_artifact(run["facts"].limit(2).withColumn("run_id", F.lit("2024")), root, "facts")
    with pytest.raises(ValueError, match="isn't what was saved"):
        engine.load(spark, root, "2024")
    engine.Run("bad", run.tables | {"evidence": run["evidence"].limit(1)}).save(root)
    with pytest.raises(ValueError, match="don't fit"):
        engine.load(spark, root, "bad")
