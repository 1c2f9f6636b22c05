"""The latest delivery of each key, against a plain rule."""

from inkwell.operators.delivery import latest_delivery

SCHEMA = "id bigint, at int, text string, __n string"


def test_latest(spark):
    rows = [(1, 1, "a", "x"), (1, 3, "b", "x"), (1, None, "c", None), (2, 1, "d", None), (None, 1, "e", None), (None, 2, "e", None), (3, None, "f", None), (3, None, "f", None), (4, 5, "g", None), (4, 5, "h", None), (4, 1, "i", None)]
    got = latest_delivery(spark.createDataFrame(rows, SCHEMA), "id", "at", "text")
    assert got.columns == ["id", "at", "text", "__n"]
    assert sorted(map(str, ((r.id, r.text) for r in got.collect()))) == sorted(map(str, [(1, "b"), (2, "d"), (None, "e"), (None, "e"), (3, "f"), (4, "g")]))
    same = [sorted(r.text for r in latest_delivery(spark.createDataFrame(x, SCHEMA).repartition(3), "id", "at").collect()) for x in (rows, rows[::-1])]
    assert same[0] == same[1] and len(same[0]) == 6
    assert latest_delivery(spark.createDataFrame(rows, SCHEMA).limit(0), "id", "at").count() == 0
    once = latest_delivery(spark.createDataFrame(rows[3:6], SCHEMA), "id", "at")
    assert once.count() == 3
