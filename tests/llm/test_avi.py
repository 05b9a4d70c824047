import hashlib
import struct
import zlib

import numpy as np
import pytest
from loomgraph.llm import avi

TEXTS = ["", None, "a", "x" * 192, "é✓🙂" * 500, "long words " * 20_000, "\x00\xff" * 700]


def test_every_text_comes_back(spark):
    rows = [(i, t, b"clash") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (2, "a", None)]
    got = avi.digests(avi.films(spark.createDataFrame(rows, "doc_id long, text string, media binary"))).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t for i, t, _ in rows if i == r.doc_id)
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_bytes > r.payload_bytes
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 2}) == 1
    assert avi.digests(avi.films(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_any_huffman_table_is_decoded_like_the_fast_one():
    frame = np.random.default_rng(0).integers(0, 256, (1, avi.HEIGHT, avi.WIDTH)).astype(np.uint8)
    jpeg = avi.encode_frames(frame)[0]
    found, scan = avi._segments(jpeg)
    slow = avi._differences(scan, found["tables"][0], frame.size)
    other = jpeg[:2] + b"\xff\xfe\x00\x04hi" + jpeg[2:]  # a comment first: the header isn't the encoder's own
    assert (avi.decode_frames([other, jpeg]) == np.concatenate([frame, frame])).all()
    assert slow.min() >= -255 and slow.max() <= 255
    with pytest.raises(ValueError):
        avi._segments(b"\xff\xd8\xff\xc2\x00\x04ab")


def baseline(planes, sampling, restart=0):
    """A baseline JPEG file of planes whose sides are multiples of eight times their sampling; every code has ten bits."""
    zigzag = avi._ZIGZAG
    dht = lambda n, symbols: b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), n) + bytes([0] * 9 + [len(symbols)] + [0] * 6) + bytes(symbols)
    symbols = list(range(240))
    quant = np.arange(1, 65)
    high, wide = planes[0].shape
    out = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes(quant.tolist()) + dht(0, list(range(12))) + dht(16, symbols)
    out += b"\xff\xdd" + struct.pack(">HH", 4, restart) if restart else b""
    out += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(planes), 8, high, wide, len(planes)) + b"".join(bytes([i + 1, s[0] << 4 | s[1], 0]) for i, s in enumerate(sampling))
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(planes), len(planes)) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\0\x3f\0"
    h, v = sampling[0]
    across, down = wide // (8 * h), high // (8 * v)
    bits, last, scan, marks = "", [0] * len(planes), b"", 0
    number = lambda x: (0, "") if not x else ((n := abs(x).bit_length()), format(x if x > 0 else x + (1 << n) - 1, f"0{n}b"))

    def flush():
        padded = bits + "1" * (-len(bits) % 8)
        return bytes(int(padded[i : i + 8], 2) for i in range(0, len(padded), 8)).replace(b"\xff", b"\xff\0")

    for n in range(across * down):
        if restart and n and n % restart == 0:
            scan += flush() + bytes([0xFF, 0xD0 + marks % 8])
            bits, last, marks = "", [0] * len(planes), marks + 1
        for i, (p, (a, b)) in enumerate(zip(planes, sampling, strict=True)):
            for k in range(a * b):
                y, x = (n // across * b + k // a) * 8, (n % across * a + k % a) * 8
                block = p[y : y + 8, x : x + 8].astype(float) - 128
                flat = np.rint((avi._COSINE.T @ block @ avi._COSINE).reshape(-1)[zigzag] / quant).astype(int).tolist()
                size, extra = number(flat[0] - last[i])
                last[i] = flat[0]
                bits += format(size, "010b") + extra
                zeros = 0
                for c in flat[1:]:
                    if not c:
                        zeros += 1
                        continue
                    while zeros > 14:
                        bits, zeros = bits + format(symbols.index(0xE0), "010b") + "", zeros - 15
                    size, extra = number(c)
                    bits, zeros = bits + format(symbols.index(zeros << 4 | size), "010b") + extra, 0
                bits += format(symbols.index(0), "010b") if zeros else ""
    return out + scan + flush() + b"\xff\xd9"


def test_baseline_frames_are_decoded(spark):
    y, x = np.mgrid[0:32, 0:48]
    smooth = (128 + 60 * np.sin(x / 7) + 40 * np.cos(y / 5)).astype(np.uint8)
    grey = baseline([smooth], [(1, 1)])
    assert np.abs(avi.decode_frames([grey])[0].astype(int) - smooth).max() <= 24 and np.abs(avi.decode_frames([grey])[0].astype(float) - smooth).mean() < 4
    again = avi.decode_frames([baseline([smooth], [(1, 1)], restart=3), avi.encode_frames(smooth[None])[0]])
    assert (again[0] == avi.decode_frames([grey])[0]).all() and (again[1] == smooth).all()
    half = smooth[:16, :24]
    colour = avi.decode_frames([baseline([smooth, half, half], [(2, 2), (1, 1), (1, 1)])])[0]
    assert (colour == avi.decode_frames([grey])[0]).all()
    film = avi.write_avi([grey] * 3 + [baseline([255 - smooth // 4], [(1, 1)])] * 2, {})
    rows = spark.createDataFrame([(1, film), (2, None), (3, b"RIFF"), (4, film[:-200].replace(b"idx1", b"idx2")), (5, film.replace(b"\xff\xc0", b"\xff\xc2"))], "doc_id long, media binary")
    assert [(r.doc_id, r.clip, r.frames) for r in avi.clip_rows(rows).orderBy("doc_id", "clip").collect() if r.doc_id < 4] == [(1, 0, 3), (1, 1, 2)]
    got = {r.doc_id: r for r in avi.digests(rows).collect()}
    assert len(got) == 5 and got[1].feature and got[2].media_sha256 is None and all(got[i].feature is None and got[i].media_bytes for i in (3, 5))


def test_index_is_followed_and_may_be_missing():
    frames = avi.encode_frames(np.random.default_rng(1).integers(0, 256, (3, avi.HEIGHT, avi.WIDTH)).astype(np.uint8))
    film = avi.write_avi(frames, {b"ISBJ": b"12"})
    got, period, info = avi.read_avi(film)
    assert got == frames and period == 0.04 and info == {b"ISBJ": b"12"}
    at = film.index(b"idx1")
    bare = film[:4] + struct.pack("<I", at - 8) + film[8:at]
    assert avi.read_avi(bare)[0] == frames
    swapped = film[: at + 8] + film[at + 24 : at + 40] + film[at + 8 : at + 24] + film[at + 40 :]
    assert avi.read_avi(swapped)[0] == [frames[1], frames[0], frames[2]]


def test_shots_and_clip_rows(spark):
    rng = np.random.default_rng(2)
    scene = lambda level, n: np.clip(rng.normal(level, 6, (n, avi.HEIGHT, avi.WIDTH)), 0, 255).astype(np.uint8)
    frames = np.concatenate([scene(40, 10), scene(120, 7), scene(200, 12)])
    assert avi.shots(frames) == [(0, 10), (10, 17), (17, 29)]
    film = avi.write_avi(avi.encode_frames(frames), {})
    rows = avi.clip_rows(spark.createDataFrame([(1, film), (2, None), (3, b"")], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.clip, r.start_s, r.end_s, r.frames) for r in rows] == [(1, 0, 0.0, 0.4, 10), (1, 1, 0.4, 0.68, 7), (1, 2, 0.68, 1.16, 12)]
    assert avi.shots(frames[:0]) == []
