import random
import struct

import pytest

from plantflow.sources import captures
from plantflow.sources.captures import CaptureError, capture_spans, read_captures, records


def block(kind, body):
    body += b"\0" * (-len(body) % 4)
    size = struct.pack("<I", len(body) + 12)
    return struct.pack("<I", kind) + size + body + size


SECTION = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
FRAME = b"f" * 61


def read(path, data):
    path.write_bytes(data)
    return list(records(str(path)))


def test_simple_packets_and_packets_without_an_interface(tmp_path):
    simple, enhanced = block(3, struct.pack("<I", 61) + FRAME), block(6, struct.pack("<IIIII", 0, 0, 7, 61, 61) + FRAME)
    assert read(tmp_path / "a", SECTION + simple + enhanced) == [(1, 0, FRAME), (1, 7, FRAME)]
    short = block(1, struct.pack("<HHI", 1, 0, 20))
    assert read(tmp_path / "b", SECTION + short + simple) == [(1, 0, FRAME[:20])]


def test_a_record_cut_short_names_the_file(tmp_path):
    classic = b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 1, 2, 61, 61) + FRAME
    assert read(tmp_path / "c", classic) == [(1, 1_000_002, FRAME)]
    for name, data in (("d", classic[:-1]), ("e", classic + b"x"), ("g", (SECTION + block(3, struct.pack("<I", 61) + FRAME))[:-5])):
        with pytest.raises(CaptureError, match=f"/{name}: truncated"):
            read(tmp_path / name, data)


def frame(k, payload):
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 28 + len(payload), 0, 0, 64, 17, 0, bytes([10, 0, k >> 8, k & 255]), bytes([10, 1, 0, 1]))
    return b"\2" * 12 + b"\x08\0" + ip + struct.pack(">HHHH", 1000 + k, 502, 8 + len(payload), 0) + payload


def classic_record(k, payload=b"", order="<"):
    data = frame(k, payload)
    return struct.pack(order + "IIII", k, 5, len(data), len(data)) + data


def enhanced(k, which=0, payload=b""):
    data = frame(k, payload)
    return block(6, struct.pack("<IIIII", which, 0, k, len(data), len(data)) + data)


def test_spans_of_bytes_give_the_rows_of_one_reader(spark, tmp_path):
    """Payloads that hold captures of their own mislead the search, and the chain of spans sets it right."""
    rng = random.Random(4)
    inner = b"".join(classic_record(9000 + k) for k in range(12))
    header = lambda order: struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    mixed = lambda k: rng.choice([b"", b"\0" * 300, inner, rng.randbytes(rng.randint(1, 900))])
    (tmp_path / "a").write_bytes(header("<") + b"".join(classic_record(k, mixed(k)) for k in range(300)))
    (tmp_path / "b").write_bytes(header(">") + b"".join(classic_record(k, mixed(k), ">") for k in range(100)))
    nano = block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + bytes(4))
    plain = block(1, struct.pack("<HHI", 1, 0, 0))
    nested = SECTION + plain + b"".join(enhanced(7000 + k) for k in range(9))
    blocks = [SECTION, plain, *(enhanced(k, 0, rng.choice([b"", nested, mixed(k)])) for k in range(150)), nano, *(enhanced(k, k % 2) for k in range(150, 250)), SECTION, nano, *(enhanced(k) for k in range(250, 350))]
    (tmp_path / "c").write_bytes(b"".join(blocks))
    (tmp_path / "d").write_bytes(header("<"))
    whole = sorted(read_captures(spark, str(tmp_path)).collect())
    assert len(whole) == 750
    for size in (6000, 60_000):
        spans = capture_spans(spark, str(tmp_path), size)
        assert spans.count() > 4
        assert sorted(read_captures(spark, str(tmp_path), size).collect()) == whole


def test_misleading_payloads_are_met(tmp_path):
    path = tmp_path / "a"
    inner = b"".join(classic_record(9000 + k) for k in range(12))
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(classic_record(k, inner) for k in range(40))
    path.write_bytes(data)
    start = 24 + len(classic_record(0, inner)) + 60
    guess, *_ = captures.follow(str(path), start, start + 300)
    assert guess is not None and (guess - 24) % len(classic_record(0, inner))


def test_damage_in_a_span_is_an_error(spark, tmp_path):
    data = SECTION + block(1, struct.pack("<HHI", 1, 0, 0)) + b"".join(enhanced(k) for k in range(50))
    (tmp_path / "a").write_bytes(data + struct.pack("<II", 6, 4) + data)
    (tmp_path / "b").write_bytes(b"no capture" * 300)
    for name, told in (("a", "truncated or damaged"), ("b", "not a packet capture")):
        with pytest.raises(Exception, match=told):
            read_captures(spark, str(tmp_path / name), 1000).collect()
