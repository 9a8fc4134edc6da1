import pytest
from pyspark.sql import functions as F

from frameloom.plans.dialects import parse
from frameloom.sources.textlog import parse_line, parse_log, parse_text, read_lines

BYTES8 = "00 01 02 03 04 05 06 07"
BYTES16 = " ".join(f"{k:02X}" for k in range(16))
LINES = [
    (f"0.100000 CANFD 1 Rx 1A2 MsgA 1 0 8 8 {BYTES8}", "CANOE", 0.1, 418, 0, 8, "0001020304050607", "1"),
    (f"2024-01-01 00:00:00.100 0.100000 1 CANFD 2 1A2 Tx MsgA 1 8 {BYTES8}", "CANOE_FULL", 0.1, 418, 1, 8, "0001020304050607", "2"),
    ("0.100000 1 1A2x Rx d 4 DE AD BE EF", "CANOE_CMP", 0.1, 418, 0, 4, "DEADBEEF", "1"),
    ("2024-01-01 00:00:00.100 0.100000 1 CAN 1 1A2 Rx MsgA x 2 AB CD", "CANCMD", 0.1, 418, 0, 2, "ABCD", ""),
    ("0.100000 CAN 1 Tx 1A2 MsgA 2 AB CD", "FILTER", 0.1, 418, 1, 2, "ABCD", ""),
    ("0.100000 1 1A2 Rx MsgA 2 AB CD", "CANSUKE", 0.1, 418, 0, 2, "ABCD", ""),
    (f"12399\t1\t1A2\tMsgA\tA\t{BYTES16}\tRx\tCANFD\t1", "CANCMD_T2", 12.399, 418, 0, 16, BYTES16.replace(" ", ""), "1"),
    (f"12399 1 1A2 8 {BYTES8} Rx CANFD 1", "CANCMD_T3", 12.399000000000001, 418, 0, 8, "0001020304050607", "1"),
    ("0.1 1 1A2 Rx FACE 2 AB CD", "FILTER", 0.1, 64206, 0, 2, "ABCD", ""),
    ("0.1 CANFD 1 Rx 1A2 MsgA 0 12 00 01", "CANOE", 0.1, 418, 0, 0, "", "1"),
    ("12399 1 1A2 A 08 11 12 13 14 15 16 17 18 1A 1B 1C 1D 1E 1F 2A Rx CANFD 1", "CANCMD_T3", 12.399000000000001, 418, 0, 8, "1112131415161718", "1"),
    ("12399\t1\t1A2\tM\t9\t00 01 02\tRx", "CANCMD_T3", 12.399000000000001, 418, 0, 0, "", "1"),
    ("12399\t1\t1A2\tM\t8\t00 01 02\tRx", "CANCMD_T2", 12.399, 418, 0, 3, "000102", "1"),
    ("\t1\t1A2\tM\t2\t00 01\tTx", "CANCMD_T2", 0.0, 418, 1, 2, "0001", "1"),
    ("5. CAN 1 Rx 0x7FFxX M 1 AB", "FILTER", 5.0, 2047, 0, 1, "AB", ""),
    ("0.1 CAN 1 Rx 123456789 M 1 AB", "FILTER", 0.1, 591751049, 0, 1, "AB", ""),
    ("0.1 1 1A2 Rx d 0", None),
    ("1e3 CAN 1 Rx 1A2 M 2 AB CD", None),
    ("0.1 CAN 1 Rx 1A2 MsgA 2 AB", None),
    ("// comment", None), ("# c", None), ("; c", None), ("", None),
]


def test_lines_of_every_dialect_and_trap(spark):
    text = "\n".join(x[0] for x in LINES)
    got = {r["line_number"]: r for r in parse_text(spark, text).collect()}
    for k, (line, dialect, *values) in enumerate(LINES, 1):
        if dialect is None:
            assert k not in got, line
        else:
            r = got[k]
            assert (r["dialect"], r["timestamp"], r["can_id"], r["direction"], r["data_len"], bytes(r["data"]).hex().upper(), r["channel"]) == (dialect, *values), line


def test_known_dialect_rejects_what_detection_passes_on(spark):
    rows = parse(spark.createDataFrame([("12399\t1\t1A2\tM\t9\t00 01 02\tRx",)], "line string"), F.col("line"), "CANCMD_T2", "x")
    assert rows.first()["x"] is None
    assert parse_line(spark, "nothing here") is None and parse_text(spark, None).count() == 0


@pytest.mark.parametrize("size", ["1k", "64m"])
def test_numbers_do_not_depend_on_splits(spark, tmp_path, size):
    lines = [f"{k}.5 CAN 1 Rx {0x100 + k % 3:X} M 1 {k % 256:02X}" if k % 4 else f"# note {k}" for k in range(700)]
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        numbered = {r["line_number"]: r["line"] for r in read_lines(spark, str(tmp_path / "log.txt")).collect()}
        assert numbered == dict(enumerate(lines, 1))
        frames = parse_log(spark, str(tmp_path / "log.txt"), "a").orderBy("row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["row_idx"] for r in frames] == list(range(525))
    assert [r["line_number"] for r in frames] == [k + 1 for k in range(700) if k % 4]
