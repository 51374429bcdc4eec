from pathlib import Path

from cirque.functions.frames import held, settled, shared_folder


def test_shuffle_files_go_when_a_frame_is_held(spark):
    files = lambda: set(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))
    before = files()
    got = spark.range(1000).repartition(3).groupBy("id").count()
    out = held(got)
    assert not files() - before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert out.where("count = 1").count() == 1000 and len(got.collect()) == 1000  # a frame can be used after it was held


def test_what_was_held_on_the_way_goes(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before, most = set(folder.glob("held_*")), []

    def make():
        x = held(spark.range(5))
        y = settled(lambda: held(x.selectExpr("id + 1 as id")).selectExpr("id * 2 as id"))
        most.append(len(set(folder.glob("held_*")) - before))
        return x.join(y, "id")

    assert sorted(r.id for r in settled(make).collect()) == [2, 4] and most == [2]
    assert len(set(folder.glob("held_*")) - before) == 1
