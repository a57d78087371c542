"""Media columns: AVI motion-JPEG written and read with numpy alone.

A payload is laid out as 8x8 blocks, one byte per quantised DCT coefficient
(the format's unit), in zigzag order.  The Huffman tables are chosen so that
code and amplitude of every coefficient have a fixed total width: frames are
ordinary baseline JPEGs, yet encode and decode as whole arrays.  Foreign
baseline grey frames with other tables take a sequential decoder.

Reading parses the RIFF tree and its ``idx1`` index, decodes each intra frame,
and cuts shots where the histogram difference of two frames exceeds an
adaptive threshold (mean plus ``k`` deviations of the differences before it).

Edge cases: a null or empty text is a payload of 64 zero bytes; a medium that
is null gives a null payload and no clips; broken media raise ``ValueError``
in :func:`read_avi` and give null results in :func:`read_media`; repeated rows
and null ids come out each; an empty table gives no rows.  Only the named
columns are read, so others may have any name.  A text is held whole: one of n
bytes takes about 15 n bytes of a worker (measured at 8 MB), and is stored as
one medium.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import rolling as r

#: Zigzag order of an 8x8 block (row-major index of the k-th coefficient), by its rule: diagonals in turn.
ZIGZAG = np.array([y * 8 + x for d in range(15) for y, x in sorted(((y, d - y) for y in range(8) if 0 <= d - y < 8), reverse=d % 2 == 0)])
FRAME_BLOCKS_WIDE, FRAME_BLOCKS_HIGH, FPS = 8, 8, 25
DC_BITS, AC_BITS = 10, 9


def _fixed_width(bits: int, sizes: range) -> tuple[np.ndarray, bytes]:
    """Codeword of each value from -256 to 256 at ``bits`` in all, and the DHT body: longer codes for smaller sizes."""
    table = np.zeros(513, np.uint16)
    for v in range(-256, 257):
        s = abs(v).bit_length()
        if s in sizes:
            ones = bits - s - 1
            table[v + 256] = (((1 << ones) - 1) << 1 << s) | (v if v > 0 else v + (1 << s) - 1 if v else 0)
    lengths = sorted((bits - s, s) for s in sizes)
    counts = [sum(n == k for n, _ in lengths) for k in range(1, 17)]
    return table, bytes(counts) + bytes(s for _, s in lengths)


DC_CODES, DC_TABLE = _fixed_width(DC_BITS, range(0, 10))
AC_CODES, AC_TABLE = _fixed_width(AC_BITS, range(1, 9))
#: A byte is a coefficient other than zero: 0..127 become 1..128, 128..255 become -128..-1.
TO_COEFFICIENT = np.concatenate([np.arange(1, 129), np.arange(-128, 0)]).astype(np.int16)
TO_BYTE = np.zeros(257, np.uint8)
TO_BYTE[TO_COEFFICIENT + 128] = np.arange(256)
BYTE_AC = AC_CODES[TO_COEFFICIENT + 256]

_k = np.arange(8)
_dct = np.cos((2 * _k[:, None] + 1) * _k[None, :] * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)
#: 64 pixels of a block from its 64 zigzag coefficients.
IDCT = np.einsum("yv,xu->vuyx", _dct, _dct).reshape(64, 64)[ZIGZAG].astype(np.float32)


def _bits(codes: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(codes.astype(">u2")[..., None].view(np.uint8), axis=-1)[..., 16 - width :]


def jpeg_header(wide: int, high: int) -> bytes:
    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    return (
        b"\xff\xd8" + segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\1\x11\0")
        + segment(0xC4, b"\0" + DC_TABLE) + segment(0xC4, b"\x10" + AC_TABLE) + segment(0xDA, b"\1\1\0\0\x3f\0")
    )


def encode_frame(blocks: np.ndarray, header: bytes) -> bytes:
    """A baseline JPEG whose coefficients are the bytes of ``blocks`` (n, 64)."""
    dc = TO_COEFFICIENT[blocks[:, 0]]
    out = np.empty((len(blocks), DC_BITS + 63 * AC_BITS), np.uint8)
    out[:, :DC_BITS] = _bits(DC_CODES[np.diff(dc, prepend=np.int16(0)) + 256], DC_BITS)
    out[:, DC_BITS:] = _bits(BYTE_AC[blocks[:, 1:]], AC_BITS).reshape(len(blocks), -1)
    flat = out.reshape(-1)
    if pad := -len(flat) % 8:
        flat = np.concatenate([flat, np.ones(pad, np.uint8)])
    return header + np.packbits(flat).tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def _codes(table: bytes) -> list[tuple[int, int, int]]:
    """(length, code, symbol) of a DHT body in canonical order."""
    code, at, out = 0, 16, []
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out.append((length, code, table[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _value_table(codes: list[tuple[int, int, int]], widest: int) -> tuple[int, np.ndarray] | None:
    """Value by whole codeword if code and amplitude have one total width, else None."""
    widths = {n + s for n, _, s in codes}
    if len(widths) != 1 or any(s > widest for _, _, s in codes):
        return None
    width = widths.pop()
    out = np.zeros(1 << width, np.int16)
    for _, code, s in codes:
        amp = np.arange(1 << s)
        out[(code << s) + amp] = np.where(amp >= (1 << s) >> 1, amp, amp - (1 << s) + 1) if s else 0
    return width, out


def _sequential(bits: np.ndarray, n: int, dc: list, ac: list) -> np.ndarray:
    """Coefficients by walking the bits one code at a time."""
    tables = [{(n_, c): s for n_, c, s in t} for t in (dc, ac)]
    seq, at, out, last = bits.tolist(), 0, np.zeros((n, 64), np.int16), 0

    def symbol(table: dict) -> int:
        nonlocal at
        code = 0
        for length in range(1, 17):
            code = code << 1 | seq[at]
            at += 1
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such Huffman code")

    def amplitude(s: int) -> int:
        nonlocal at
        v = int("".join(map(str, seq[at : at + s])) or "0", 2)
        at += s
        return v if not s or v >> (s - 1) else v - (1 << s) + 1

    for b in range(n):
        last += amplitude(symbol(tables[0]))
        out[b, 0], k = last, 1
        while k < 64:
            run, s = divmod(symbol(tables[1]), 16)
            if not s and run < 15:
                break
            k += run
            if s and k < 64:
                out[b, k] = amplitude(s)
            k += 1
    return out


_TABLES: dict[bytes, tuple] = {}


def decode_frame(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Width and height in blocks, quantised coefficients (n, 64) in zigzag order, and the quantiser."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, tables, quant, wide, high = 2, {}, np.ones(64, np.int16), 0, 0
    while True:
        if at + 4 > len(data):
            raise ValueError("frame ends early")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quant = np.frombuffer(body, np.uint8, 64, 1).astype(np.int16)
        elif marker == 0xC0:
            _, h, w, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("only grey frames")
            wide, high = -(-w // 8), -(-h // 8)
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif marker == 0xDD and any(body):
            raise ValueError("restart intervals are not read")
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline frames")
        elif marker == 0xDA:
            break
    n, scan = wide * high, np.frombuffer(data[at : data.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff"), np.uint8)
    key = tables[0] + tables[16]
    if key not in _TABLES:
        dc, ac = _codes(tables[0]), _codes(tables[16])
        _TABLES[key] = dc, ac, _value_table(dc, 11), _value_table(ac, 10)
    dc, ac, dc_fixed, ac_fixed = _TABLES[key]
    bits = np.unpackbits(scan)
    if not (dc_fixed and ac_fixed and all(s for _, _, s in ac)):
        return wide, high, _sequential(bits, n, dc, ac), quant
    dw, aw = dc_fixed[0], ac_fixed[0]
    rows = bits[: n * (dw + 63 * aw)].reshape(n, -1)

    def numbers(x: np.ndarray, width: int) -> np.ndarray:
        wide_bits = np.zeros((*x.shape[:-1], 16), np.uint8)
        wide_bits[..., 16 - width :] = x
        return np.packbits(wide_bits.reshape(-1)).view(">u2").reshape(x.shape[:-1])

    out = np.empty((n, 64), np.int16)
    out[:, 0] = np.cumsum(dc_fixed[1][numbers(rows[:, :dw], dw)])
    out[:, 1:] = ac_fixed[1][numbers(rows[:, dw:].reshape(n, 63, aw), aw)]
    return wide, high, out, quant


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file that holds ``payload`` (a positive multiple of 64 bytes) in the coefficients of its frames."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    wide = min(FRAME_BLOCKS_WIDE, len(blocks))
    high = min(FRAME_BLOCKS_HIGH, -(-len(blocks) // wide))
    per = wide * high
    if short := -len(blocks) % per:
        blocks = np.concatenate([blocks, np.zeros((short, 64), np.uint8)])
    header = jpeg_header(wide, high)
    frames = [encode_frame(blocks[k : k + per], header) for k in range(0, len(blocks), per)]
    movi, index, at = [], [], 4
    for f in frames:
        chunk = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk)
        at += len(chunk)
    w, h, n = wide * 8, high * 8, len(frames)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, w, h, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0, 0, 0, 0, w, h)
    strf = struct.pack("<IIIHH4sIIIII", 40, w, h, 1, 8, b"MJPG", w * h, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d" % len(payload)))
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[int, int, list[bytes]]:
    """Microseconds a frame, bytes of payload (-1 if not said), and the frames that ``idx1`` names in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found = {"per": 1_000_000 // FPS, "payload": -1, "movi": None, "index": None}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", data, at)
            body = at + 8
            if body + size > end:
                raise ValueError("a chunk runs past its parent")
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    found["movi"] = (body, body + size)
                else:
                    walk(body + 4, body + size)
            elif name == b"avih":
                found["per"] = struct.unpack_from("<I", data, body)[0]
            elif name == b"ICMT" and data[body : body + 8] == b"payload=":
                found["payload"] = int(data[body + 8 : body + size].rstrip(b"\0"))
            elif name == b"idx1":
                found["index"] = (body, size // 16)
            at = body + size + size % 2

    walk(12, len(data))
    if found["movi"] is None:
        raise ValueError("no movi list")
    base, end = found["movi"]
    frames = []
    if found["index"]:
        at, n = found["index"]
        for k in range(n):
            name, flags, offset, size = struct.unpack_from("<4sIII", data, at + 16 * k)
            if name[2:] in (b"dc", b"db") and flags & 0x10:
                frames.append(data[base + offset + 8 : base + offset + 8 + size])
    else:
        at = base + 4
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", data, at)
            if name[2:] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    return found["per"], found["payload"], frames


def shots(histograms: np.ndarray, k: float = 3.0, floor: float = 0.25) -> list[int]:
    """First frames of the shots: where the half L1 difference exceeds the adaptive threshold."""
    starts, seen = [0], []
    for i in range(1, len(histograms)):
        d = float(np.abs(histograms[i] - histograms[i - 1]).sum()) / 2
        limit = max(floor, (np.mean(seen) + k * np.std(seen)) if seen else floor)
        if d > limit:
            starts.append(i)
            seen = []
        else:
            seen.append(d)
    return starts


def decode(data: bytes) -> tuple[bytes, list[tuple[int, int, int, float]], list[int]]:
    """The payload, clips (start ms, end ms, frames, mean luminance) and the total 16-bin histogram."""
    per, size, frames = read_avi(data)
    parts, hist, mean = [], [], []
    for f in frames:
        _, _, c, quant = decode_frame(f)
        parts.append(TO_BYTE[np.clip(c, -128, 128) + 128].tobytes())
        pixels = np.clip(np.rint((c * quant).astype(np.float32) @ IDCT) + 128, 0, 255).astype(np.uint8)
        hist.append(np.bincount((pixels >> 4).reshape(-1), minlength=16))
        mean.append(float(pixels.mean()))
    counts = np.array(hist).reshape(-1, 16)
    starts = shots(counts / np.maximum(counts.sum(1, keepdims=True), 1)) if frames else []
    clips = [(a * per // 1000, b * per // 1000, b - a, round(sum(mean[a:b]) / (b - a), 3)) for a, b in zip(starts, [*starts[1:], len(frames)], strict=True)]
    payload = b"".join(parts)
    return payload if size < 0 else payload[:size], clips, counts.sum(0).tolist()


def padded(text: bytes) -> bytes:
    return text + b"\0" * ((-len(text) % 64) or (0 if text else 64))


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as an AVI."""

    def go(batches):
        for batch in batches:
            for s in r.slices(batch, "doc_id", "text"):
                texts = [s.text(k) for k in range(len(s.ids))]
                yield pa.record_batch([
                    batch.column("doc_id").slice(s.rows.start, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_avi(padded(t)) for t in texts], pa.binary()),
                ], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(go, "doc_id long, n_bytes long, media binary")


READ = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ("clips", pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("frames", pa.int64()), ("luminance", pa.float64())]))),
])
READ_SQL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start_ms:long,end_ms:long,frames:long,luminance:double>>"


def _read_one(blob: bytes | None) -> tuple:
    if blob is None:
        return (None,) * 6 + ([],)
    try:
        payload, clips, hist = decode(blob)
    except (ValueError, KeyError, IndexError, struct.error):
        return (None, None, None, len(blob), hashlib.sha256(blob).hexdigest(), None, [])
    feature = f"frames={sum(c[2] for c in clips)};shots={len(clips)};hist={','.join(map(str, hist))}"
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature,
        [dict(zip(("start_ms", "end_ms", "frames", "luminance"), c, strict=True)) for c in clips],
    )


def read_media(media: DataFrame) -> DataFrame:
    """Digests, features and timed clips of a table (doc_id, n_bytes, media)."""

    def go(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                cols = list(zip(*(_read_one(None if (v := m.as_buffer()) is None else v.to_pybytes()) for m in part.column("media")), strict=True))
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, READ.types[2:], strict=True))], schema=READ)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(go, READ_SQL)


def clip_rows(read: DataFrame) -> DataFrame:
    """One row per timed clip of each medium."""
    return read.select("doc_id", F.posexplode("clips").alias("clip_no", "clip")).select("doc_id", "clip_no", "clip.*")
