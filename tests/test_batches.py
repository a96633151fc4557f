"""Batches that meet broken files, fail midway and count themselves."""

import json

import pytest
from pyspark.sql import functions as F

from touchline.operators import batches, quality
from touchline.operators.counters import Counters, counting, success_rate
from touchline.sources import commits, readers


def event(kind, player, minute, **more):
    return {"id": f"{kind}{player}{minute}", "minute": minute, "type": {"name": kind}, "player": {"id": player, "name": f"p{player}"}, "team": {"id": player % 2 + 1, "name": "t"}, **more}


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "events"
    at.mkdir()
    shot = {"shot": {"statsbomb_xg": 0.25, "outcome": {"name": "Goal"}}}
    fine = [event("Shot", 7, 3, **shot), event("Pass", 8, 4), event("Pass", 9, 90)]
    (at / "1.json").write_text(json.dumps(fine))
    (at / "2.json").write_text(json.dumps(fine)[:-30])  # ends inside an event
    (at / "3.json").write_text(json.dumps([event("Pass", 7, 1), event("Shot", 8, "late", **shot), event("Pass", 9, 12), {"minute": {"no": 1}}]))
    (at / "4.json").write_text("[]")
    (at / "5.json").write_text("")
    (at / "notes.json").write_text("not a match")
    return str(tmp_path)


def test_a_broken_file_or_event_costs_itself(spark, folder):
    wanted = spark.createDataFrame([(m,) for m in (1, 2, 3, 4, 5, 6)], "match_id int")
    got = batches.process(readers.events_checked(spark, folder), wanted)
    reasons = {(r.match_id, r.player_id, r.reason, r.n) for r in got.errors.collect()}
    assert reasons == {(2, None, "broken file", 1), (3, 8, "unreadable event", 1), (3, None, "unreadable event", 1), (4, None, "no events", 1), (5, None, "absent file", 1), (6, None, "absent file", 1)}
    players = {(r.match_id, r.player_id): (r.goals, r.xg, r.passes_attempted, r.minutes_played) for r in got.players.collect()}
    assert players == {(1, 7): (1, 0.25, 0, 90), (1, 8): (0, 0.0, 1, 90), (1, 9): (0, 0.0, 1, 90), (3, 7): (0, 0.0, 1, 12), (3, 9): (0, 0.0, 1, 12), (3, 8): (0, 0.0, 0, 0)}
    assert {r.match_id: r.total_events for r in got.matches.collect()} == {1: 3, 2: 0, 3: 2, 4: 0, 5: 0, 6: 0}


def test_a_missing_folder_is_no_rows(spark, tmp_path):
    assert readers.events_checked(spark, str(tmp_path / "nowhere")).count() == 0
    assert readers.events(spark, str(tmp_path / "nowhere")).count() == 0
    got = batches.process(readers.events_checked(spark, str(tmp_path)), spark.createDataFrame([(1,)], "match_id int"))
    assert [(r.match_id, r.reason) for r in got.errors.collect()] == [(1, "absent file")] and got.players.count() == 0


def test_isolated_rows(spark):
    rows = spark.createDataFrame([(1, '{"k": 1}'), (2, '{"k": "x"}'), (3, '{"k"'), (4, None), (5, "{}")], "i int, t string")
    good, bad = batches.isolated(rows, "t", "k int")
    assert {(r.i, r.k) for r in good.collect()} == {(1, 1), (5, None)} and {r.i for r in bad.collect()} == {2, 3}


def broken(df):
    return df.withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("midway")).cast("int")).otherwise(F.col("v")))


def test_batches_are_all_or_nothing(spark, tmp_path):
    root, rows = str(tmp_path), lambda *x: spark.createDataFrame(list(x), "k int, p string, v int")
    read = lambda table, upto=None: sorted(map(tuple, commits.committed(spark, root, table, "k int, p string, v int", upto).collect()))
    assert commits.batches(spark, root) == [] and read("a") == []
    assert commits.commit(spark, root, 1, {"a": rows((1, "x", 1)), "b": rows((9, "y", 9))})
    # the second table fails when the first is written: neither is seen
    with pytest.raises(Exception, match="midway"):
        commits.commit(spark, root, 2, {"a": rows((2, "x", 2)), "b": broken(rows((3, "y", 3)))})
    assert commits.batches(spark, root) == [1] and read("a") == [(1, "x", 1)] and read("b") == [(9, "y", 9)]
    assert commits.commit(spark, root, 2, {"a": rows((2, "x", 2)), "b": rows((3, "y", 3))})
    # run again: committed once
    assert not commits.commit(spark, root, 2, {"a": rows((2, "x", 2)), "b": rows((3, "y", 3))})
    assert read("a") == [(1, "x", 1), (2, "x", 2)] and read("b") == [(3, "y", 3), (9, "y", 9)] and read("a", 1) == [(1, "x", 1)]


def test_partitions_are_replaced_and_rows_updated(spark, tmp_path):
    root, schema = str(tmp_path), "k int, p string, v int"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    read = lambda upto=None: sorted(map(tuple, commits.committed(spark, root, "t", schema, upto).collect()))
    first = [(1, "x", 1), (2, "x", 2), (3, "y/z", 3), (4, "w", 4)]
    commits.commit(spark, root, 10, {"t": rows(*first)}, {"t": "p"})
    commits.commit(spark, root, 11, {"t": rows((5, "x", 5))}, {"t": "p"})
    assert read() == [(3, "y/z", 3), (4, "w", 4), (5, "x", 5)] and read(10) == first
    assert commits.update(spark, root, 12, "t", schema, rows((5, "x", 50), (6, "y/z", 6)), ["k"], "p")
    assert read() == [(3, "y/z", 3), (4, "w", 4), (5, "x", 50), (6, "y/z", 6)]
    assert commits.update(spark, root, 13, "t", schema, rows((6, "w", 7)), ["k"], "p")  # a key moves
    assert read() == [(3, "y/z", 3), (4, "w", 4), (5, "x", 50), (6, "w", 7)]
    with pytest.raises(ValueError):
        commits.update(spark, root, 14, "t", schema, rows((3, "w", 1)), ["k"], "p")
    assert commits.batches(spark, root) == [10, 11, 12, 13]


def test_counters(spark):
    c, done = Counters(), lambda df: df.write.format("noop").mode("overwrite").save()
    rows = counting(spark).range(1000).withColumn("m", F.col("id") % 10)
    assert c.run("one", done, rows, F.col("id") % 4 == 0, "m") and c.run("two", done, rows.where("id < 10"), F.lit(None).cast("boolean"))
    assert not c.run("bad", done, rows.withColumn("x", F.raise_error(F.lit("no"))))
    one = c.of("one")
    assert (one["events"], one["failed"], one["matches"], one["success_rate"]) == (1000, 250, 10, 75.0) and one["seconds"] > 0
    s = c.summary()
    assert (s["completions"], s["failures"], s["total_events"], s["failed_events"], s["events_per_batch"], s["success_rate"]) == (2, 1, 1010, 250, 505.0, 75.25)
    # a model that was fitted in the session itself can still be shipped
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["id"], outputCol="features").transform(spark.range(20).withColumn("label", (F.col("id") > 9).cast("double")))
    assert LogisticRegression().fit(data).transform(data).where("prediction = label").count() > 15
    assert "no" in s["failure_reasons"]["bad"] and success_rate(0, 0) == 100.0 and Counters().summary()["success_rate"] == 100.0


def test_dates_by_column(spark):
    """A column of one format takes its odd values by it; choosing value by value would read them otherwise."""
    mostly = ["25/01/2020"] * 9 + ["01/25/2020"]
    mixed = ["2020-01-05", "Jan 5, 2020", "05/01/2020", "5/1/2020", "13/01/2020", "01/13/2020", "no date", None, "2020-1-5", "Feb 30, 2020"]
    df = spark.createDataFrame(list(zip(range(10), mostly, mixed)), "i int, a string, b string")
    got = {r.i: (str(r.a), str(r.b)) for r in quality.with_dates(df, ["a", "b"]).collect()}
    assert got[0][0] == "2020-01-25" and got[9][0] == "None"
    assert [got[i][1] for i in range(10)] == ["2020-01-05"] * 4 + ["2020-01-13"] * 2 + ["None"] * 2 + ["2020-01-05", "None"]
    report = {r.column_name: (r.format, r.null_share) for r in quality.date_report(df, ["a", "b"]).collect()}
    assert report == {"a": ("d/M/yyyy", 0.1), "b": (None, pytest.approx(0.3))}
    exactly = spark.createDataFrame([("2020-01-05",)] * 8 + [(None,)] * 2, "a string")  # 80 percent aren't more than 80
    assert quality.date_report(exactly, ["a"]).first().format is None
    assert quality.with_dates(df.where("false"), ["a", "b"]).count() == 0
