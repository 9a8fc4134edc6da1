"""Detection looks at the heads of files only, and its plan stays small."""

import pyarrow as pa
from pyspark.sql import functions as F

from frameloom.plans.dialects import detect
from frameloom.sources import textlog


def batch(file, split, size, whole, lines):
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([split] * n, pa.int64()), pa.array([size] * n, pa.int64()), pa.array([whole] * n, pa.int64()), pa.array(lines)], ["file", "split", "split_bytes", "file_bytes", "line"])


def test_a_task_ends_with_the_head_of_its_split():
    read = []

    def source(batches):
        for b in batches:
            read.append(b.num_rows)
            yield b

    first = [batch("a", 0, 100, 1000, ["x"] * 7) for _ in range(9)]
    got = pa.Table.from_batches(textlog._heads(source(first), 10)).to_pydict()
    assert got["place"] == list(range(10)) and len(read) == 2  # not the seven batches behind
    read.clear()
    assert list(textlog._heads(source([batch("a", 100, 100, 1000, ["x"] * 7)] * 9), 10)) == [] and len(read) == 1
    small = [batch("a", 0, 30, 30, ["1", "2", "3"]), batch("b", 0, 30, 30, ["4"]), batch("c", 900, 100, 1000, ["5"]), batch("d", 0, 30, 30, ["6", "7"])]
    got = pa.Table.from_batches(textlog._heads(source(small), 2)).to_pydict()
    assert list(zip(got["file"], got["place"], got["line"])) == [("a", 0, "1"), ("a", 1, "2"), ("b", 0, "4"), ("d", 0, "6"), ("d", 1, "7")]


def test_plans_of_detection_and_parse_stay_small(spark, tmp_path):
    (tmp_path / "a.log").write_text("// head\n" + "0.1 CAN 1 Rx 1A2 M 2 AB CD\n" * 3)
    raw = textlog._raw(spark, str(tmp_path / "a.log"))
    heads = raw.select(*textlog._PLACE, "line").mapInArrow(lambda b: textlog._heads(b, 9), "file string, place long, line string")
    for df in (textlog._first_dialects(heads), detect(heads, F.col("line"))):
        assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert [tuple(r) for r in textlog.detect_dialects(raw).select("dialect").collect()] == [("FILTER",)]
    late = tmp_path / "late.log"
    late.write_text("no frame\n" * 50 + "0.1 CANFD 1 Rx 1A2 M 1 0 2 2 AB CD\n")
    assert [r["dialect"] for r in textlog.detect_dialects(textlog._raw(spark, str(late)), 10).collect()] == ["CANOE"]
