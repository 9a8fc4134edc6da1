"""BLF files by byte ranges: the same rows at any cut."""

import random
import struct
import zlib

import pytest

from frameloom.sources import files


def message(k: int, rng) -> bytes:
    """An object: a frame, or now and then one of another kind; payloads hold marks."""
    data = rng.choice((b"LOBJ\x20\0\1\0", b"LOBJ\x10\0\1\0", rng.randbytes(8), b"LOLOBJ\0\0"))
    if k % 7 == 3:
        body, kind = rng.randbytes(rng.randrange(90)), 65
    elif k % 5 == 1:
        data = (data * 8)[: rng.choice((12, 20, 64))]
        body, kind = struct.pack("<HBBIIBBBxxxxx", 2, k % 2, 9, 300 + k % 9, 0, 0, 1, len(data)) + data, files.CAN_FD_MESSAGE
    else:
        body, kind = struct.pack("<HBBI", 1, k % 2, 8, 256 + k % 9) + data, files.CAN_MESSAGE
    size = 32 + len(body)
    return struct.pack("<4sHHIIIHHQ", b"LOBJ", 32, 1, size, kind, 2, 0, 0, k * 1000) + body + b"\0" * (size % 4)


def blf(n: int, seed: int, method: int, piece: int) -> bytes:
    """n messages in containers of about `piece` bytes, cut anywhere."""
    rng = random.Random(seed)
    stream, out = b"".join(message(k, rng) for k in range(n)), struct.pack("<4sI", b"LOGG", 144) + b"\0" * 136
    while stream:
        size = rng.randrange(1, 2 * piece)
        part, stream = stream[:size], stream[size:]
        data = zlib.compress(part) if method == 2 else part
        out += struct.pack("<4sHHIIHHIII", b"LOBJ", 16, 1, 32 + len(data), 10, method, 0, 0, len(part), 0) + data + b"\0" * ((32 + len(data)) % 4)
    return out


def rows_of(data: bytes) -> list[tuple]:
    return [(k, k + 1, *m[:4], m[4], m[5], m[6]) for k, m in enumerate(files.blf_messages(data))]


@pytest.mark.parametrize(("method", "piece", "cuts"), [(2, 700, (2000, 1 << 20)), (0, 700, (3000,)), (2, 20, (6000,)), (2, 4000, (900,))])
def test_blf_rows_are_equal_at_any_cut(spark, tmp_path, method, piece, cuts):
    data = blf(400, piece + method, method, piece)
    (tmp_path / "a.blf").write_bytes(data)
    want, before = rows_of(data), spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert len(want) > 300 and any(b"LOBJ" in row[6] for row in want)
    for cut in cuts:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        try:
            out = files.read_blf(spark, str(tmp_path / "a.blf"), "x")
            got = [(r["row_idx"], r["line_number"], r["timestamp"], r["can_id"], r["direction"], r["data_len"], bytes(r["data"]), r["channel"], r["is_fd"]) for r in out.orderBy("row_idx").collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == want, cut


def test_blf_folders_and_files_that_are_none(spark, tmp_path):
    one, two = blf(40, 1, 2, 500), blf(30, 2, 2, 90)
    (tmp_path / "a.blf").write_bytes(one)
    (tmp_path / "b.blf").write_bytes(two)
    rows = files.read_blf(spark, str(tmp_path), "x").orderBy("row_idx").collect()
    a, b = rows_of(one), rows_of(two)
    assert [(r["row_idx"], r["line_number"], r["can_id"]) for r in rows] == [(r[0], r[1], r[3]) for r in a] + [(len(a) + r[0], r[1], r[3]) for r in b]
    (tmp_path / "c.blf").write_text("no such file")
    with pytest.raises(Exception, match="not a BLF file"):
        files.read_blf(spark, str(tmp_path / "c.blf"), "x").count()
