"""Record files: checksums, damage, and fields of messages."""

import io
import struct

import pytest

from lanewise.sources import records
from lanewise.sources.records import Field


def test_known_checksums():
    assert records.crc32c(b"123456789") == 0xE3069283
    assert records.crc32c(bytes(32)) == 0x8A9136AA
    assert records.crc32c(b"\xff" * 32) == 0x62A8AB43
    assert records.crc32c(b"") == 0


@pytest.mark.parametrize("n", [4095, 4096, 5000, 70_001])
def test_lanes_equal_one_byte_at_a_time(n):
    data = bytes(i * i % 251 for i in range(n))
    state = 0xFFFFFFFF
    for b in data:
        state ^= b
        for _ in range(8):
            state = state >> 1 ^ (records.POLYNOMIAL if state & 1 else 0)
    assert records.crc32c(data) == state ^ 0xFFFFFFFF


def varint(x):
    x &= (1 << 64) - 1
    out = b""
    while x > 127:
        out += bytes([x & 127 | 128])
        x >>= 7
    return out + bytes([x])


def entry(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 1) + struct.pack("<d", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


FIELDS = [Field("scene", (1, 1), "string"), Field("time", (2,), "long"), Field("pose", (3, 1), "double", True), Field("camera", (4, 1), "long", True), Field("image", (4, 2), "bytes", True), Field("weight", (9,), "float")]


def message(k):
    pose = [k + i / 10 for i in range(16)]
    packed = k % 2 == 0
    transform = entry(1, struct.pack("<16d", *pose)) if packed else b"".join(entry(1, x) for x in pose)
    out = entry(1, entry(1, f"scene {k}".encode()) + entry(7, 3)) + entry(2, -k if k % 3 else 10**15 + k) + entry(3, transform)
    for c in range(k % 4):
        out += entry(4, entry(1, c) + entry(2, bytes([c]) * 3000))
    return out + entry(15, b"unknown"), (f"scene {k}", -k if k % 3 else 10**15 + k, pose, list(range(k % 4)), [bytes([c]) * 3000 for c in range(k % 4)], None)


def test_fields_of_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    want = []
    for name, ks in (("a.tfrecord", range(5)), ("deep/b.tfrecord", range(5, 9)), ("empty.tfrecord", ())):
        with (tmp_path / name).open("wb") as f:
            for i, k in enumerate(ks):
                data, row = message(k)
                f.write(records.framed(data))
                want.append((str(tmp_path / name), i, *row))
    (tmp_path / "other.txt").write_text("no record")
    df = records.read_records(spark, str(tmp_path), FIELDS, expected=3)
    assert df.rdd.getNumPartitions() == 3
    got = [(*r[:6], [bytes(x) for x in r[6]], r[7]) for r in df.collect()]
    assert sorted(got) == sorted(want)
    plain = records.read_records(spark, str(tmp_path / "a.tfrecord")).orderBy("record").collect()
    assert [bytes(r.payload) for r in plain] == [message(k)[0] for k in range(5)]
    with pytest.raises(Exception, match="202 are expected"):
        records.read_records(spark, str(tmp_path), expected=202).collect()


@pytest.mark.parametrize(("at", "says"), [(3, "length of record 1"), (30, "record 1 doesn't fit"), (-2, "record 1 doesn't fit"), (None, "cut off")])
def test_damage_is_an_error(spark, tmp_path, at, says):
    first, second = records.framed(b"x" * 100), bytearray(records.framed(b"y" * 200))
    if at is None:
        second = second[:-10]
    else:
        second[at] ^= 1
    (tmp_path / "a.tfrecord").write_bytes(first + second)
    with pytest.raises(Exception, match=says):
        records.read_records(spark, str(tmp_path)).collect()
    if at == 30:
        assert records.read_records(spark, str(tmp_path), check=False).count() == 2


def test_a_stream_is_read_a_record_at_a_time():
    class Slow(io.BytesIO):
        most = 0

        def read(self, n=-1):
            Slow.most = max(Slow.most, n)
            return super().read(min(n, 7))

    f = Slow(b"".join(records.framed(bytes([k]) * 50) for k in range(20)))
    assert [m[0] for m in records.messages(f, "f")] == list(range(20)) and Slow.most == 50
