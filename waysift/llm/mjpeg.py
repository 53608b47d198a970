"""Media columns: AVI files of motion JPEG, written, indexed, decoded and cut into clips.

Frames are grey, 16 x 12 samples of 8 bits, each one an intra-coded lossless JPEG
(SOF3, predictor 1) in a '00dc' chunk that the file's 'idx1' index lists. The Huffman
table gives difference category k a code of 9 - k bits, so that a sample always takes
nine bits and whole batches of frames are coded and decoded as arrays; frames with
other tables or sizes are decoded bit by bit. Shots end where the difference of
neighbouring frames' histograms exceeds what is usual around it.

Defined cases: a null text counts as empty and takes one frame of blanks; equal texts
give equal files; repeated rows and null ids are separate rows; an empty table gives
none; a file that isn't an AVI of such frames is an error; a null file gives null
payload and clips; other columns of the input are not looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_text, sliced

WIDTH, HEIGHT, FPS = 16, 12, 25
FRAME = WIDTH * HEIGHT
_SIZES = [1] * 9 + [0] * 7  # codes of each length from 1 to 16
HEAD = (
    b"\xff\xd8"
    + b"\xff\xc4" + struct.pack(">HB", 28, 0) + bytes(_SIZES) + bytes(range(8, -1, -1))
    + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
)
TAIL = b"\xff\xd9"


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The nine bits of each difference from -255 to 255, and back."""
    code, diff = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        code[d + 255] = 512 - (2 << k) + (d if d >= 0 else d + (1 << k) - 1)
        diff[code[d + 255]] = d
    return code, diff


CODE, DIFF = _codes()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of frames (n x FRAME, 8 bits)."""
    x = samples.reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    d += 255
    v = CODE[d.reshape(-1, 8)]
    out = np.zeros((len(v), 9), np.uint8)
    for k in range(8):
        out[:, k] |= (v[:, k] >> (k + 1)).astype(np.uint8)
        out[:, k + 1] |= (v[:, k] << (7 - k)).astype(np.uint8)
    raw, size = out.tobytes(), FRAME * 9 // 8
    return [HEAD + raw[i : i + size].replace(b"\xff", b"\xff\x00") + TAIL for i in range(0, len(raw), size)]


def decode_frames(files: list[bytes]) -> np.ndarray:
    """Frames (n x FRAME, 8 bits) of JPEG files of this size; others go through decode_any()."""
    n, size, own = len(HEAD), FRAME * 9 // 8, []
    other: dict[int, np.ndarray] = {}
    for k, f in enumerate(files):
        data = f[n:-2].replace(b"\xff\x00", b"\xff") if f.startswith(HEAD) and f.endswith(TAIL) else b""
        if len(data) != size:
            other[k], data = decode_any(f), bytes(size)
        own.append(data)
    b = np.frombuffer(b"".join(own), np.uint8).reshape(-1, 9).astype(np.uint16)
    v = np.empty((len(b), 8), np.uint16)
    for k in range(8):
        v[:, k] = (b[:, k] << (k + 1) | b[:, k + 1] >> (7 - k)) & 511
    d = DIFF[v].reshape(-1, HEIGHT, WIDTH)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16)
    x = np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8).reshape(-1, FRAME)
    for k, frame in other.items():
        if frame.size != FRAME:
            raise ValueError("frames of one file differ in size")
        x[k] = frame.reshape(-1)
    return x


def decode_any(f: bytes) -> np.ndarray:
    """The samples of a lossless grey JPEG of 8 bits and predictor 1 with any Huffman table, bit by bit."""
    at, table, shape = 2, {}, None
    while True:
        if f[at : at + 1] != b"\xff" or at + 4 > len(f):
            raise ValueError("not a lossless JPEG")
        mark, size = f[at + 1], int.from_bytes(f[at + 2 : at + 4], "big")
        body = f[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xC4:
            code, k = 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif mark == 0xC3:
            shape = struct.unpack(">HH", body[1:5])
            if body[0] != 8 or body[5] != 1:
                raise ValueError("only grey frames of 8 bits")
        elif mark == 0xDA:
            if body[-3] != 1 or shape is None:
                raise ValueError("only predictor 1")
            break
    end = f.rindex(TAIL)
    bits = iter(np.unpackbits(np.frombuffer(f[at:end].replace(b"\xff\x00", b"\xff"), np.uint8)).tolist())
    out = np.zeros(shape, np.uint8)
    for y in range(shape[0]):
        for x in range(shape[1]):
            length = code = 0
            while (length, code) not in table or not length:
                length, code = length + 1, code << 1 | next(bits)
                if length > 16:
                    raise ValueError("a code that the table doesn't have")
            k, e = table[length, code], 0
            for _ in range(k):
                e = e << 1 | next(bits)
            d = e if not k or e >> (k - 1) else e - (1 << k) + 1
            near = int(out[y, x - 1]) if x else int(out[y - 1, 0]) if y else 128
            out[y, x] = (near + d) & 255
    return out


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """An AVI file of JPEG frames, with its index."""
    chunks = [_chunk(b"00dc", f) for f in frames]
    size = np.array([len(f) for f in frames], np.int64)
    index = np.empty((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, size
    index[:, 2] = 4 + np.r_[0, np.cumsum(8 + size + (size & 1))[:-1]] if len(frames) else 0
    most = int(size.max(initial=0))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sI2H8I4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", index.tobytes()))


def read_avi(media: bytes) -> tuple[list[bytes], float]:
    """The JPEG files of an AVI's frames, by its index, and the frames per second."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, usec = 12, None, None, 1_000_000 // FPS
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        kind = media[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"LIST" and kind == b"hdrl" and media[at + 12 : at + 16] == b"avih":
            usec = int.from_bytes(media[at + 20 : at + 24], "little") or usec
        elif name == b"idx1":
            index = np.frombuffer(media, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("an AVI file without frames or index")
    return [media[movi + o + 8 : movi + o + 8 + n] for c, _, o, n in index.tolist() if c.to_bytes(4, "little")[2:] == b"dc"], 1e6 / usec


def shots(frames: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.25) -> list[int]:
    """First frames of all shots but the first. A cut is where the difference of 16-bin histograms (0 to 1) is at least least, the largest among its neighbours', and over the mean plus factor standard deviations of the differences within window frames on both sides."""
    n = len(frames)
    if n < 3:
        return []
    hist = np.zeros((n, 16), np.float64)
    np.add.at(hist, (np.repeat(np.arange(n), frames.shape[1]), (frames >> 4).reshape(-1)), 1)
    d = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * frames.shape[1])
    high = np.flatnonzero(d >= least)
    if not len(high):
        return []
    lo, hi = np.maximum(high - window, 0), np.minimum(high + window + 1, len(d))
    s, q = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    m = hi - lo - 1
    keep = m > 0
    high, lo, hi, m = high[keep], lo[keep], hi[keep], m[keep]
    mean = (s[hi] - s[lo] - d[high]) / m
    dev = np.sqrt(np.maximum((q[hi] - q[lo] - d[high] ** 2) / m - mean**2, 0))
    pad = np.r_[-1, d, -1]
    cut = (d[high] > mean + factor * dev) & (d[high] >= pad[high]) & (d[high] > pad[high + 2])
    return (high[cut] + 1).tolist()


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text as UTF-8), media (an AVI file that holds it, filled with blanks up to whole frames). No shuffle."""
    bound_batches(df.sparkSession)

    @sliced
    def run(batches: Iterable) -> Iterator:
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            full = [r.ljust(max(1, -(-len(r) // FRAME)) * FRAME) for r in raw]
            frames = iter(encode_frames(np.frombuffer(b"".join(full), np.uint8))) if full else iter(())
            media = [write_avi([next(frames) for _ in range(len(f) // FRAME)]) for f in full]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media as given; payload (the samples of all frames), n_frames, clips (array of struct: clip, first_frame, n_frames, start_s, end_s). One row per file; explode clips for clip rows."""
    bound_batches(df.sparkSession)
    kind = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int64()), ("n_frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    @sliced
    def run(batches: Iterable) -> Iterator:
        for b in batches:
            parsed = [None if m is None else read_avi(m) for m in b.column("media").to_pylist()]
            every = [f for p in parsed if p for f in p[0]]
            x = decode_frames(every) if every else np.zeros((0, FRAME), np.uint8)
            at, payload, count, found = 0, [], [], []
            for p in parsed:
                if p is None:
                    payload.append(None), count.append(None), found.append(None)
                    continue
                n, fps = len(p[0]), p[1]
                own = x[at : at + n]
                at += n
                edges = [0, *shots(own), n]
                payload.append(own.tobytes()), count.append(n)
                found.append([{"clip": k, "first_frame": i, "n_frames": j - i, "start_s": i / fps, "end_s": j / fps} for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i])
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), b.column("media"), pa.array(payload, pa.binary()), pa.array(count, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_bytes", "media", "payload", "n_frames", "clips"])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, n_frames long, clips array<struct<clip int, first_frame long, n_frames long, start_s double, end_s double>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of clips()' rows, by built-in functions. feature: frames, clips, and each clip's first frame."""
    firsts = F.array_join(F.transform("clips", lambda c: c["first_frame"].cast("string")), ",")
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("frames="), F.col("n_frames"), F.lit(";clips="), F.size("clips"), F.lit(";first="), firsts).alias("feature"),
    )
