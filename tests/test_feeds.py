"""Cursors of the feed of all pages, time budgets of streams, protected words."""

import time

from pyspark.sql import functions as F

from ancestra.functions import analysis
from ancestra.sources import wiki as W
from ancestra.streaming import incremental as I


def test_all_pages_in_turns(spark):
    pages = spark.createDataFrame([(str(i), i % 2) for i in (2, 10, 9, 30, 100)], "page_id string, namespace int")

    def turn(after, most, roll_over, **more):
        tasks = W.all_page_tasks(pages, after, most, **more)
        return sorted(int(r.page_id) for r in tasks.collect()), tuple(W.all_pages_cursor(tasks, after, most, roll_over).first())

    assert turn("0", 2, False) == ([2, 9], ("9", False))
    assert turn("9", 2, False) == ([10, 30], ("30", False))
    assert turn("30", 2, False) == ([100], ("100", True)) and turn("30", 2, True) == ([100], ("0", False))
    assert turn("100", 2, False) == ([], ("100", True)) and turn("100", 2, True) == ([], ("0", False))
    assert turn("0", 10, True, namespaces=(1,)) == ([9], ("0", False))


def test_stream_within_a_budget(spark, tmp_path):
    for i in range(4):
        spark.createDataFrame([(i,)], "x int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(seconds, pause, name):
        stream = spark.readStream.schema("x int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(lambda b, n: (time.sleep(pause), b.write.mode("overwrite").parquet(str(tmp_path / f"out/{name}={n}")))[0]).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        return I.finish_within(q, seconds), q.isActive

    assert run(2, 1.5, "a") == (False, False)
    assert run(300, 0, "a") == (True, False)
    assert sorted(r.x for r in spark.read.parquet(*[str(p) for p in (tmp_path / "out").iterdir()]).select("x").collect()) == [0, 1, 2, 3]


def test_protected_words(spark):
    run = analysis.make("text", stem=lambda x: F.regexp_replace(x, "s$", ""), protected=("dontstems",))
    assert spark.range(1).select(run(F.lit("Reeds dontstems onths"))).first()[0] == ["reed", "dontstems", "onth"]


def test_a_pages_state_is_read_by_one_call_and_frames_that_pass_whole_are_not_copied():
    import pandas as pd

    from ancestra.streaming.stateful import Revisions

    class Seen:
        calls, value = [], None

        def get(self):
            self.calls.append("get")
            return self.value

        def exists(self):
            self.calls.append("exists")
            return self.value is not None

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    guard = Revisions()
    guard.seen = Seen()
    frame = lambda *rows: pd.DataFrame(rows, columns=["action", "rev_id"])
    given = frame((0, 5), (0, 3), (0, None))
    whole = frame((0, 7), (0, 0))
    out = list(guard.handleInputRows(("p",), iter([given, whole]), None))
    assert [x["rev_id"].tolist() for x in out] == [[5, 3], [7, 0]] and out[1] is whole
    assert guard.seen.calls == ["get"] and guard.seen.value == (7,)
    assert [x["rev_id"].tolist() for x in guard.handleInputRows(("p",), iter([frame((0, 7), (0, 8)), frame((0, 1))]), None)] == [[8]] and guard.seen.value == (8,)
    assert len(list(guard.handleInputRows(("p",), iter([frame((1, 0), (0, 9))]), None))[0]) == 2 and guard.seen.value is None
