import pyarrow as pa

from vexel.llm import common
from vexel.llm.common import SLICE_ROWS, fresh, hub_join, materialize, salted_join, scratch_dir, text_slices


def test_slices_are_bounded_and_whole():
    texts = ["a"] * 700 + ["x" * 9_000_000] + [None] * 3 + ["b" * 2_000_000] * 5
    batch = pa.record_batch({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    parts = list(text_slices(iter([batch, batch.slice(0, 0)]), ["id", "text"]))
    assert [i for ids, _ in parts for i in ids] == list(range(len(texts))) and [t for _, own in parts for t in own] == texts
    assert all(len(ids) <= SLICE_ROWS and (len(ids) == 1 or sum(len(t or "") for t in own) < 6_000_000) for ids, own in parts)


def test_materialize_keeps_schema_and_place(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (None, None)], "a long, b array<int>")
    back = materialize(rows, "test")
    assert back.schema == rows.schema and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert back.inputFiles()[0].replace("file://", "").startswith(scratch_dir(spark).replace("file://", ""))


def test_fresh_names(spark):
    assert fresh(spark.range(1), "row") == "row" and fresh(spark.range(1).selectExpr("id AS ROW", "id AS row_"), "row") == "row__"


def test_hub_joins(spark, monkeypatch):
    """Keys with most of the rows, met by broadcast or in cuts, give what a plain join gives."""
    monkeypatch.setattr(common, "HUB_ROWS", 10)
    rows = spark.range(300).selectExpr("IF(id % 3 = 0, 7, id % 40) AS k", "id AS x")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    keyed = counts.selectExpr("k", "n", "k * 2 AS m").where("k <> 5")
    plain = sorted(map(tuple, rows.join(keyed.drop("n"), "k").collect()))
    assert sorted(map(tuple, hub_join(rows, keyed, "k", 300).select("k", "x", "m").collect())) == plain
    assert sorted(map(tuple, salted_join(rows, keyed.drop("n"), "k", "x", 300).select("k", "x", "m").collect())) == plain


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    run = common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(run) == 2 and next(run) == 3 and not seen
    assert list(run) == [] and seen == ["back"]
    monkeypatch.undo()
    common.give_back()
