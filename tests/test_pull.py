"""The pull: a run that is killed goes on where it was, a later run asks only for what is new, and failures are asked again."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrystone.streaming import pull
from tests import pull_stub


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "s").mkdir()
    with open("/tmp/quarrystone_pull_stub", "w") as f:
        f.write(str(tmp_path / "s"))
    yield tmp_path
    os.remove("/tmp/quarrystone_pull_stub")


def run(spark, folder):
    spark.dataSource.register(pull.PullSource)
    rows = spark.readStream.format("pull").options(folder=str(folder / "pull"), service="tests.pull_stub:service", every="5").load()
    q = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", str(folder / "c")).format("parquet").start(str(folder / "out"))
    q.awaitTermination()
    return spark.read.parquet(str(folder / "out"))


def targets(spark, names):
    return spark.createDataFrame([(n, e) for n in names for e in ("filings", "charges")], "entity string, endpoint string")


def test_resumes(spark, folder):
    names = [f"c{i}" for i in range(60)] + ["bad"]
    wanted = targets(spark, names).unionByName(targets(spark, ["c1"])).unionByName(spark.createDataFrame([(None, "filings")], "entity string, endpoint string"))
    assert pull.enlist(wanted, str(folder / "pull"), slice_=20) == 1
    assert pull.enlist(wanted, str(folder / "pull"), slice_=20) == 1  # nothing new
    (folder / "s/stop").write_text("70")
    with pytest.raises(Exception, match=r"(?i)exit|crash|EOF"):
        run(spark, folder)
    first = pull_stub.calls(str(folder / "s"))
    assert 40 <= len(first) <= 90
    (folder / "s/stop").unlink()
    out = run(spark, folder)
    calls = Counter(pull_stub.calls(str(folder / "s")))
    assert len(calls) == 122 and sum(calls.values()) <= 122 + 7 * 4 * 5  # what was kept is not asked again: at most the open files of the tasks that broke off
    assert sum(n > 1 for n in calls.values()) < len(first)
    assert out.count() == 122 and out.where("error is null").count() == 120 and {r.entity for r in out.where("error like 'Unanswered%'").collect()} == {"bad"}
    assert {r["items"] for r in out.where("entity = 'c59'").collect()} == {3}

    before = sum(calls.values())
    assert run(spark, folder).count() == 122 and sum(Counter(pull_stub.calls(str(folder / "s"))).values()) == before  # nothing is asked for
    pull.enlist(targets(spark, [*names, "new"]), str(folder / "pull"))
    (folder / "s/well").write_text("")
    assert pull.retry(out, str(folder / "pull")) == 3
    out = run(spark, folder)
    assert sorted(r.entity for r in out.where("round > 0").collect()) == ["bad", "bad", "new", "new"]
    assert sum(Counter(pull_stub.calls(str(folder / "s"))).values()) == before + 4
    assert pull.progress(out).count() == 124
    got = pull.histories(out, "charges", "array<struct<type: string, date: string>>")
    assert got.groupBy("entity").count().agg(F.count("*"), F.sum("count")).first()[:] == (62, sum(len(n) for n in [*names, "new"]))
    pull.PullReader({"folder": str(folder / "pull")}).commit({"rounds": 3})
    assert not os.listdir(folder / "pull/kept")


def test_no_targets(spark, folder):
    assert pull.enlist(targets(spark, []), str(folder / "pull")) == 0
    assert pull.rounds(str(folder / "pull")) == 0
