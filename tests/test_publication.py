"""Publishers that die, that fail and that meet."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import publish


def files(spark, text):
    return spark.createDataFrame([("a.md", text), ("b/c.md", "two")], "path string, content string")


def told(df):
    return {r["path"]: r["content"] for r in df.collect()}


def test_failed_check_leaves_the_name_free(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/out"
    with monkeypatch.context() as m:
        m.setattr(publish, "same_edition", lambda *_: False)
        with pytest.raises(IOError):
            publish.publish(files(spark, "one"), root, "e1")
    assert not (tmp_path / "out/editions").exists() and not any((tmp_path / "out/staging").iterdir())
    publish.publish(files(spark, "one"), root, "e1")
    assert told(publish.current(spark, root))["a.md"] == "one"
    publish.publish(files(spark, "one"), root, "e1")  # the same files again
    with pytest.raises(ValueError, match="other files"):
        publish.publish(files(spark, "other"), root, "e1")
    assert told(publish.current(spark, root))["a.md"] == "one"


def test_dead_publisher(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    dead = publish.FolderTarget(spark, root, "json")
    lease = publish.Lease(spark, root)
    left = dead.stage(files(spark, "dead").withColumn("edition_id", F.lit("e1")), lease.number)
    assert left.count() == 2
    with pytest.raises(RuntimeError, match="being published to"):
        publish.publish(files(spark, "one"), publish.FolderTarget(spark, root, "json"), "e1")
    lease.check()
    # its time is over
    target = publish.FolderTarget(spark, root, "json", seconds=0)
    publish.publish(files(spark, "one"), target, "e1")
    with pytest.raises(RuntimeError, match="taken over"):
        lease.check()
    dead.point_to("e0", lease.number)  # too late
    assert told(publish.current(spark, target)) == {"a.md": "one", "b/c.md": "two"}
    lease.give_back()
    with publish.locked(spark, root) as next_, pytest.raises(RuntimeError):
        assert next_.number == 3
        publish.Lease(spark, root)
    assert not any((tmp_path / "out/staging").iterdir())
    # lost between promotion and pointer: publishing again points to what is there
    with target.lease() as again:
        target.stage(files(spark, "two").withColumn("edition_id", F.lit("e2")), again.number)
        target.promote(again.number, "e2")
    publish.publish(files(spark, "two"), target, "e2", keep=1)
    assert told(publish.current(spark, target))["a.md"] == "two" and not target.has("e1")
