"""Media columns: AVI motion-JPEG.

Reading: parse the RIFF tree and its idx1 index, decode the intra frames, compare their histograms and cut the film
into shots where the difference rises over a running mean and deviation; each shot is a timed clip row.

Frames are lossless JPEG (ITU-T T.81 process 14, SOF3): 8-bit samples, each predicted from its left neighbour (at a
line's start from the one above), the difference coded as a Huffman category with its extra bits. The encoder here
gives category s the code length 9 - s, so that code and extra bits always come to nine bits together and whole
batches are coded and decoded by array operations; the decoder reads any other table symbol by symbol. Frames of others
may be baseline DCT (SOF0, 8 bits, any sampling, restart intervals); of these the first component, the luminance, is read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches, text_bytes, with_text

#: Bytes that a payload is padded to a multiple of, with spaces.
UNIT = 192
#: Frame size; a film's last frame is filled up with spaces.
WIDTH, HEIGHT = 48, 32
RATE = 25
BINS = 16
#: A cut: the difference is over MEAN + FACTOR * deviation of the last RECENT ones, and over FLOOR.
RECENT, FACTOR, FLOOR = 12, 3.0, 0.12
PIECE = 1 << 20
#: What reading a broken film may end in.
BROKEN = (ValueError, IndexError, KeyError, OverflowError, StopIteration, ZeroDivisionError, struct.error)


# -- lossless JPEG


@lru_cache(1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The nine bits of each difference (-255..255, at +255), and the difference of each nine bits."""
    code = np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << (9 - s)) - 2 if s else 510  # 0, 10, 110, ...: category 8 has the one-bit code
        extra = d if d > 0 else d + (1 << s) - 1
        code[d + 255] = (prefix << s) | extra if s else 510
    back = np.zeros(512, np.int64)
    back[code] = np.arange(511) - 255
    return code, back


def _header() -> bytes:
    lengths = [sum(1 for s in range(9) if 9 - s == n) for n in range(1, 17)]
    symbols = bytes(sorted(range(9), key=lambda s: 9 - s))
    dht = bytes([0, *lengths]) + symbols
    out = b"\xff\xd8" + b"\xff\xc4" + struct.pack(">H", 2 + len(dht)) + dht
    out += b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    return out + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of frames (n, HEIGHT, WIDTH) of bytes."""
    x = samples.astype(np.int64)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    c = _codes()[0][d + 255].reshape(len(x), -1, 8).astype(np.uint16)
    out = np.empty((*c.shape[:2], 9), np.uint8)
    for i in range(9):  # byte i holds the low bits of code i - 1 and the high bits of code i
        high = (c[:, :, i] >> (i + 1)) if i < 8 else 0
        low = (c[:, :, i - 1] << (8 - i)) if i else 0
        out[:, :, i] = (high | low) & 255
    head, scans = _header(), out.reshape(len(x), -1)
    return [head + s.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for s in scans]


def _segments(jpeg: bytes) -> tuple[dict, bytes]:
    """Frame and scan parameters, and the scan's bytes as they stand."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, found = 2, {"tables": {}, "quant": {}, "restart": 0}
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker in (0xC0, 0xC3):
            found["process"] = marker
            found["bits"], found["height"], found["width"], n = struct.unpack_from(">BHHB", body)
            found["parts"] = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        elif marker == 0xC4:
            while body:
                end = 17 + sum(body[1:17])
                found["tables"][body[0]], body = body[1:end], body[end:]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                found["quant"][body[0] & 15], body = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64), body[1 + (128 if wide else 64) :]
        elif marker == 0xDD:
            found["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            found["scan"] = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            found["predictor"], found["shift"] = body[-3], body[-1] & 15
            return found, jpeg[at : jpeg.rindex(b"\xff\xd9")]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"JPEG process {marker:x} is neither lossless nor baseline sequential")


class _Bits:
    """Reads codes and extra bits of one stretch of a scan."""

    def __init__(self, scan: bytes):
        self.bits, self.pos = np.unpackbits(np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist(), 0

    def code(self, table: dict[tuple[int, int], int]) -> int:
        code = length = 0
        while (length, code) not in table:
            code, length, self.pos = code << 1 | self.bits[self.pos], length + 1, self.pos + 1
        return table[length, code]

    def extra(self, s: int) -> int:
        value = 0
        for b in self.bits[self.pos : self.pos + s]:
            value = value << 1 | b
        self.pos += s
        return value if not s or value >> (s - 1) else value - (1 << s) + 1


def _codewords(table: bytes) -> dict[tuple[int, int], int]:
    """Symbols by (length, code)."""
    found, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            found[length, code] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return found


def _differences(scan: bytes, table: bytes, n: int) -> np.ndarray:
    """Differences of n samples under any Huffman table, symbol by symbol."""
    bits, words = _Bits(scan), _codewords(table)
    return np.array([bits.extra(bits.code(words)) for _ in range(n)], np.int64)


_ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
_COSINE = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.125**0.5) for u in range(8)] for x in range(8)])


def _luminance(found: dict, scan: bytes) -> np.ndarray:
    """The first component's samples of a baseline DCT frame, at full height and width."""
    parts = {i: (h, v, q) for i, h, v, q in found["parts"]}
    wide, high = (max(p[k] for p in parts.values()) for k in (0, 1))
    height, width, first = found["height"], found["width"], found["parts"][0][0]
    h, v, q = parts[first]
    if len(found["scan"]) != len(parts):
        raise ValueError("only frames of one scan are read")
    if len(parts) == 1:  # blocks then stand line by line, whatever the sampling
        wide = high = h = v = 1
        parts = {first: (1, 1, q)}
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    tables = {i: (_codewords(found["tables"][dc]), _codewords(found["tables"][16 | ac])) for i, dc, ac in found["scan"]}
    blocks = np.zeros((down * v, across * h, 64), np.int64)
    stretches = iter(re.split(rb"\xff[\xd0-\xd7]", scan))
    bits, last = _Bits(next(stretches)), dict.fromkeys(parts, 0)
    for n in range(across * down):
        if found["restart"] and n and n % found["restart"] == 0:
            bits, last = _Bits(next(stretches)), dict.fromkeys(parts, 0)
        for i, (own_h, own_v, _) in ((i, parts[i]) for i, _, _ in found["scan"]):
            dc, ac = tables[i]
            for k in range(own_h * own_v):
                row = [0] * 64
                last[i] += bits.extra(bits.code(dc))
                row[0], at = last[i], 1
                while at < 64:
                    symbol = bits.code(ac)
                    if not symbol:
                        break
                    at += symbol >> 4
                    row[_ZIGZAG[at]] = bits.extra(symbol & 15)
                    at += 1
                if i == first:
                    blocks[n // across * v + k // h, n % across * h + k % h] = row
    scale = np.empty(64, np.int64)
    scale[_ZIGZAG] = found["quant"][q]
    flat = np.einsum("xu,abuv,yv->axby", _COSINE, (blocks * scale).reshape(*blocks.shape[:2], 8, 8).astype(float), _COSINE)
    samples = np.clip(np.rint(flat + 128), 0, 255).astype(np.uint8).reshape(blocks.shape[0] * 8, -1)
    return samples.repeat(high // v, 0).repeat(wide // h, 1)[:height, :width]


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """Samples (n, height, width) of grey lossless or baseline JPEG files of one size."""
    if not jpegs:
        return np.zeros((0, HEIGHT, WIDTH), np.uint8)
    own, plain, rest, whole = _header(), [], {}, {}
    height, width = HEIGHT, WIDTH
    for i, jpeg in enumerate(jpegs):
        if jpeg.startswith(own):
            plain.append(jpeg[len(own) : -2].replace(b"\xff\x00", b"\xff"))
            continue
        found, scan = _segments(jpeg)
        height, width = found["height"], found["width"]
        if found["bits"] != 8:
            raise ValueError("only samples of 8 bits are read")
        if found["process"] == 0xC0:
            whole[i] = _luminance(found, scan)
            continue
        if len(found["parts"]) != 1 or found["shift"] or found["predictor"] != 1 or found["restart"]:
            raise ValueError("of lossless frames only grey ones with predictor 1 are read")
        rest[i] = _differences(scan, found["tables"][found["scan"][0][1]], height * width)
    d = np.zeros((len(jpegs), height * width), np.int64)
    if plain:
        b = np.frombuffer(b"".join(plain), np.uint8).reshape(len(plain), -1, 9).astype(np.uint16)
        codes = np.empty((*b.shape[:2], 8), np.uint16)
        for i in range(8):
            codes[:, :, i] = (b[:, :, i] << (i + 1) | b[:, :, i + 1] >> (7 - i)) & 511
        d[[i for i in range(len(jpegs)) if i not in rest and i not in whole]] = _codes()[1][codes].reshape(len(plain), -1)
    for i, row in rest.items():
        d[i] = row
    d = d.reshape(-1, height, width)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], 1)
    out = (np.cumsum(d, 2) & 255).astype(np.uint8)
    for i, samples in whole.items():
        out[i] = samples
    return out


# -- RIFF


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], info: dict[bytes, bytes]) -> bytes:
    """An AVI 1.0 file of one MJPG stream, with an idx1 index and an INFO list."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    tags = _chunk(b"LIST", b"INFO" + b"".join(_chunk(k, v) for k, v in info.items()))
    body, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(_chunk(b"00dc", f))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + tags + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float, dict[bytes, bytes]]:
    """Frames by the idx1 index (without one, by the order of the chunks), seconds per frame, INFO tags."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    info: dict[bytes, bytes] = {}
    movi, index, period = (0, 0), b"", 1 / RATE

    def walk(at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            yield name, at + 8, min(at + 8 + size, end)
            at += 8 + size + (size & 1)

    for name, a, b in walk(12, 8 + struct.unpack_from("<I", data, 4)[0]):
        kind = data[a : a + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            period = next((struct.unpack_from("<I", data, x)[0] / 1e6 for n, x, _ in walk(a + 4, b) if n == b"avih"), period)
        elif kind == b"INFO":
            info |= {n: data[x:y] for n, x, y in walk(a + 4, b)}
        elif kind == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = data[a:b]
    frames = []
    if index:
        base = None
        for name, _, at, size in struct.iter_unpack("<4sIII", index):
            if base is None:  # offsets count from the list's type or from the file's start
                base = movi[0] if data[movi[0] + at : movi[0] + at + 4] == name else 0
            if name[2:] in (b"dc", b"db"):
                frames.append(data[base + at + 8 : base + at + 8 + size])
    else:
        frames = [data[x:y] for n, x, y in walk(movi[0] + 4, movi[1]) if n[2:] in (b"dc", b"db")]
    return frames, period, info


# -- shots


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each shot. A cut needs a histogram difference that stands out from the recent ones."""
    n = len(samples)
    if not n:
        return []
    rows = np.repeat(np.arange(n), samples[0].size) * BINS + (samples.reshape(-1) >> 4)
    hist = np.bincount(rows, minlength=n * BINS).reshape(n, BINS) / samples[0].size
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    cuts, start = [0], 0
    for i, d in enumerate(diff.tolist()):
        recent = diff[max(start, i - RECENT) : i]
        limit = FLOOR if len(recent) < 2 else max(FLOOR, float(recent.mean() + FACTOR * recent.std()))
        if d > limit:
            cuts.append(i + 1)
            start = i + 1
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def encode_payload(payload: bytes, text_bytes_: int) -> bytes:
    """The payload as a film; its length and the text's stand among the tags."""
    size = WIDTH * HEIGHT
    filled = payload + b" " * (-len(payload) % size)
    frames = encode_frames(np.frombuffer(filled, np.uint8).reshape(-1, HEIGHT, WIDTH))
    return write_avi(frames, {b"ISBJ": b"%d" % len(payload), b"ISRC": b"%d" % text_bytes_})


def clips_of(data: bytes) -> tuple[list[dict], bytes, int]:
    """A film's clip rows (clip, start_s, end_s, frames, mean), its payload and its text's length."""
    frames, period, info = read_avi(data)
    samples = decode_frames(frames)
    clips = [{"clip": k, "start_s": round(a * period, 6), "end_s": round(b * period, 6), "frames": b - a, "mean": round(float(samples[a:b].mean()), 4)} for k, (a, b) in enumerate(shots(samples))]
    return clips, samples.tobytes()[: int(info.get(b"ISBJ", b"-1"))] if b"ISBJ" in info else samples.tobytes(), int(info.get(b"ISRC", b"0"))


CLIPS = "array<struct<clip:int,start_s:double,end_s:double,frames:int,mean:double>>"


def films(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary): each text as a film. UTF-8, padded with spaces to a positive multiple of UNIT; null
    counts as empty. Other columns are ignored; repeated rows and rows without doc_id are stored like others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                data, off = text_bytes(part.column(1))
                raw = data.tobytes()
                out = []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    out.append(encode_payload(raw[a:b] + b" " * (-(b - a) % UNIT if b > a else UNIT), b - a))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["doc_id", "media"])

    return small_batches(with_text(docs)).mapInArrow(run, "doc_id long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_s, end_s, frames, mean: a row for each shot of each film (doc_id, media). A film that is null
    or can't be read has none."""
    return digests(media).selectExpr("doc_id", "inline(clips)")


def digests(media: DataFrame) -> DataFrame:
    """For each film (doc_id, media), read back: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (its shots as text) and clips. What can't be told of a null or broken film is null."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("mean", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", PIECE):
                rows = []
                for key, film in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    try:
                        clips, payload, n = clips_of(film or b"")
                    except BROKEN:
                        rows.append((key, *[None] * 4, *((len(film), hashlib.sha256(film).hexdigest()) if film is not None else (None, None)), None, None))
                        continue
                    feature = ";".join(f"{c['start_s']:g}-{c['end_s']:g}:{c['mean']:g}" for c in clips)
                    rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(film), hashlib.sha256(film).hexdigest(), feature, clips))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips {CLIPS}"
    return small_batches(media.select("doc_id", "media")).mapInArrow(run, schema)
