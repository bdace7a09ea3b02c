"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE containers, decoded to PCM and resampled.

The stored form is a WAVE file whose data chunk is the payload as it is, so storing loses nothing. Decoding expands
mu-law and A-law through tables built by rule and steps ADPCM through all blocks of a batch at once with numpy. Resampled
sound is stored in a lossless code (``pack_sound``), which needs nothing but itself to give back every sample.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stage

#: Bytes of an ADPCM block, and what payloads are padded to.
UNIT = 576
RATE = 8000
#: Bytes of texts or files worked on at a time (PCM takes up to 8 times as many), ADPCM blocks decoded at a time, bytes of
#: a row group of stored files.
PORTION, IMA_BLOCKS, FILE_BYTES = 256 << 10, 1024, 8 << 20
#: How files and sounds are stored: pages as large as row groups, so that repeats lie within reach, and a thorough zstd.
PARQUET = {"parquet.block.size": FILE_BYTES, "parquet.page.size": FILE_BYTES, "parquet.compression.codec.zstd.level": 9}
#: Of a packed sound: samples, distinct values of every second one (0: these are kept as they are), whether the others differ
#: from what is expected of them.
HEAD = struct.Struct("<QH?")
#: Format tags of WAVE files.
ALAW, MULAW, IMA = 6, 7, 17
NAMES = {ALAW: "alaw", MULAW: "mulaw", IMA: "ima"}
#: Step sizes and index changes of IMA ADPCM.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37,
    41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209,
    230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
STEP = np.array(STEPS, dtype=np.int32)
CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


@cache
def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 255
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def ima_blocks(blocks: np.ndarray) -> np.ndarray:
    """(n, size) bytes to (n, 2 * size - 7) samples, all blocks a step at a time.

    A block starts with its first sample (16 bits), the step index and a reserved byte; an index over 88 counts as 88.
    """
    head = blocks[:, :2].copy().view("<i2").reshape(-1).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = value = head
    for k in range(2 * len(codes)):
        code = (codes[k >> 1] >> (4 * (k & 1))) & 15
        step = STEP[index]
        size = (((code & 7).astype(np.int32) * 2 + 1) * step) >> 3
        value = np.clip(value + np.where(code & 8, -size, size), -32768, 32767)
        out[k + 1] = value
        index = np.clip(index + CHANGE[code], 0, 88)
    return out.T


def wav(payload: bytes, tag: int, rate: int = RATE) -> bytes:
    """A WAVE file around ``payload``: mono, 8 bits a sample, or ADPCM blocks of 576 bytes."""
    if tag == IMA:
        samples = 2 * UNIT - 7
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * UNIT // samples, UNIT, 4, 2, samples)
    else:
        form = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(data: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and the bytes of the data chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", data, at + 8)
        elif name == b"data":
            return tag, rate, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@cache
def sinc_taps(up: int, down: int, half: int = 8) -> np.ndarray:
    """Hann-windowed sinc for each of ``up`` phases in units of 2**-14; rows sum to one exactly."""
    cut = min(1.0, up / down)
    reach = math.ceil(half / cut)
    rows = []
    for phase in range(up):
        t = np.arange(-reach + 1, reach + 1) - phase / up
        row = np.sinc(cut * t) * np.cos(np.pi * t / (2 * reach + 2)) ** 2
        row = np.rint(row / row.sum() * 16384).astype(np.int64)
        row[reach - 1] += 16384 - row.sum()
        rows.append(row)
    return np.array(rows)


def resample(pcm: np.ndarray, rate: int, to: int, block: int = 4096) -> np.ndarray:
    """16-bit samples at another rate, in whole numbers (exact in doubles) and blocks; edges repeat the outermost sample.

    Outputs ``r``, ``r + up``, ... share a phase of the filter and step through the input by ``down``.
    """
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    if up == down or not len(pcm):
        return pcm.astype("<i2")
    taps = sinc_taps(up, down)
    reach = taps.shape[1] // 2
    out = np.empty(-(-len(pcm) * up // down), dtype="<i2")
    padded = np.pad(pcm, (reach, reach + 1), mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach)
    for r in range(min(up, len(out))):
        own, rows = out[r::up], windows[r * down // up + 1 :: down]
        tap = taps[r * down % up].astype(np.float64)
        for k in range(0, len(own), block):
            made = (rows[k : min(k + block, len(own))].astype(np.float64) @ tap).astype(np.int64)
            own[k : k + block] = np.clip((made + 8192) >> 14, -32768, 32767)
    return out


def halfway(x: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """What ``resample`` to twice the rate puts after every sample."""
    tap = sinc_taps(2, 1)[1].astype(np.float64)
    reach = len(tap) // 2
    out = np.empty(len(x), dtype="<i2")
    for k in range(0, len(x), block):
        first, end = max(0, k - reach + 1), k + block + reach
        near = np.pad(x[first:end], (first - k + reach - 1, max(0, min(k + block, len(x)) + reach - len(x))), mode="edge")
        made = np.correlate(near.astype(np.float64), tap, "valid").astype(np.int64)
        out[k : k + block] = np.clip((made + 8192) >> 14, -32768, 32767)
    return out


def pack_sound(pcm: np.ndarray) -> bytes:
    """Any 16-bit samples in a lossless code, short where sound has little above half its band.

    Every second sample is kept, as a place in the list of its distinct values where these are 256 or fewer. The others are
    predicted by interpolation, and what they differ by is kept unless it is zero throughout.
    """
    even = np.ascontiguousarray(pcm[::2], "<i2")
    off = halfway(even)[: len(pcm) // 2]
    np.subtract(pcm[1::2], off, out=off)
    differs = bool(off.any())
    off, code = off.tobytes() if differs else b"", even.view("<u2")
    seen = np.zeros(1 << 16, bool)
    seen[code] = True
    values = np.flatnonzero(seen)
    if len(values) <= 256:
        place = np.zeros(1 << 16, np.uint8)
        place[values] = np.arange(len(values))
        kept = (values.astype("<u2"), place[code])
    else:
        values, kept = values[:0], (even,)
    return b"".join((HEAD.pack(len(pcm), len(values), differs), *kept, off))


def unpack_sound(data: bytes) -> np.ndarray:
    """The samples that ``pack_sound`` was given."""
    n, distinct, differs = HEAD.unpack_from(data)
    evens, at = n - n // 2, HEAD.size + 2 * distinct
    if distinct:
        even = np.frombuffer(data, "<i2", distinct, HEAD.size)[np.frombuffer(data, np.uint8, evens, at)]
        at += evens
    else:
        even = np.frombuffer(data, "<i2", evens, at)
        at += 2 * evens
    out = np.empty(n, "<i2")
    out[::2] = even
    out[1::2] = halfway(even)[: n // 2]
    if differs:
        out[1::2] += np.frombuffer(data, "<i2", n // 2, at)
    return out


def decode(payloads: list[tuple[int, bytes]], block: int = IMA_BLOCKS) -> list[np.ndarray]:
    """PCM of (format tag, payload) pairs; the ADPCM blocks of all of them are decoded together, ``block`` at a time.

    Of an ADPCM payload, only whole blocks have samples; an unknown tag raises.
    """
    ima = [k for k, (tag, data) in enumerate(payloads) if tag == IMA and len(data) >= UNIT]
    out: dict[int, np.ndarray] = {}
    counts = [len(payloads[k][1]) // UNIT for k in ima]
    if ima:
        joined = np.frombuffer(b"".join(payloads[k][1][: c * UNIT] for k, c in zip(ima, counts, strict=True)), np.uint8).reshape(-1, UNIT)
        made = np.empty((len(joined), 2 * UNIT - 7), dtype=np.int16)
        for k in range(0, len(joined), block):
            made[k : k + block] = ima_blocks(joined[k : k + block])
        ends = np.cumsum(counts)
        out = {k: made[e - c : e].reshape(-1) for k, e, c in zip(ima, ends, counts, strict=True)}
    for k, (tag, data) in enumerate(payloads):
        if k not in out:
            if tag not in NAMES:
                raise ValueError(f"unknown format tag {tag}")
            out[k] = np.zeros(0, np.int16) if tag == IMA else (mulaw_table() if tag == MULAW else alaw_table())[np.frombuffer(data, np.uint8)]
    return [out[k] for k in range(len(payloads))]


def describe(pcm: np.ndarray, block: int = 1 << 16) -> tuple[int, int, int]:
    """Peak, root mean square (rounded down) and crossings of zero."""
    peak = squares = crossings = 0
    for k in range(0, len(pcm), block):
        x = pcm[k : k + block].astype(np.int64)
        peak = max(peak, int(np.abs(x).max()))
        squares += int(x @ x)
        signs = pcm[max(0, k - 1) : k + block] < 0
        crossings += int(np.count_nonzero(signs[1:] != signs[:-1]))
    return peak, math.isqrt(squares // max(1, len(pcm))), crossings


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def portions(rows: pa.RecordBatch, column: str, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of ``column``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        held += n
        if held >= most or k == len(sizes) - 1:
            yield rows.slice(first, k + 1 - first)
            first, held = k + 1, 0


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``, a WAVE file holding the text's padded UTF-8 bytes.

    The bytes themselves choose the coding (their CRC modulo 3), so equal texts have equal files. Null counts as empty
    (one unit of bytes 255); repeated rows stay; only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(batch, "text"):
                made = [payload_of(t.as_py()) for t in rows.column("text")]
                media = [wav(p, (ALAW, MULAW, IMA)[zlib.crc32(p) % 3]) for _, p in made]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, media binary")


KEPT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
SOUNDS = f"{KEPT}, coding string, samples long, rate long, "


def to_pcm(media: DataFrame, rate: int = 16_000, packed: bool = False) -> DataFrame:
    """Digests of the stored files, their coding and samples, and ``pcm``, their sound as 16-bit little-endian samples at
    ``rate``, or ``packed``, the same from ``pack_sound``.

    ``media`` has doc_id, n_bytes and media. A file that is no WAVE file of a known coding raises. Files are worked on a
    few at a time, so a task holds little beside its longest file; those of a batch come in order of their coding, as
    neighbours that are alike take less room where they are stored.
    """
    column = "packed" if packed else "pcm"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "coding", "samples", "rate", column]
        for batch in batches:
            alike = pc.sort_indices(pc.binary_slice(batch.column("media"), 20, 22))
            for rows in portions(batch.take(alike), "media"):
                files = rows.column("media").to_pylist()
                parsed = [parse_wav(f) for f in files]
                made = []
                for f, (tag, own, d), sound in zip(files, parsed, decode([(tag, data) for tag, _, data in parsed]), strict=True):
                    pcm = resample(sound, own, rate)
                    stored = pack_sound(pcm) if packed else pcm.tobytes()
                    made.append((len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-32:]), len(f), hashlib.sha256(f).hexdigest(), NAMES[tag], len(sound), rate, stored))
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), *columns], names=names)

    return map_arrow(media, run, f"{SOUNDS}{column} binary")


def described(sounds: DataFrame) -> DataFrame:
    """Packed sounds (see ``to_pcm``) unpacked: their rows without samples, but with the bytes and digest of these and
    ``feature``: coding, samples before and after resampling, peak, root mean square, crossings of zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in KEPT.split(", ")]
        for batch in batches:
            for rows in portions(batch, "packed", 2 * PORTION):
                made = []
                for coding, samples, data in zip(*(rows.column(c).to_pylist() for c in ("coding", "samples", "packed")), strict=True):
                    pcm = unpack_sound(data)
                    made.append((" ".join(map(str, (coding, samples, len(pcm), *describe(pcm)))), pcm.nbytes, hashlib.sha256(pcm).hexdigest()))
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in [*names, "rate"]), *columns], names=[*names, "rate", "feature", "pcm_bytes", "pcm_sha256"])

    return map_arrow(sounds, run, f"{KEPT}, rate long, feature string, pcm_bytes long, pcm_sha256 string")


def telephony(docs: DataFrame, rate: int = 16_000) -> DataFrame:
    """Store each text as telephony audio in the shared folder, read the files back, decode and resample them, store all
    samples beside them in a lossless code, read those back and describe them.

    One row per row of ``docs``. Null texts count as empty, repeated rows stay, doc_id may be null, and equal texts have
    equal values; only doc_id and text are read, so other columns may have any name. An empty table gives no rows.
    """
    media = stage(to_media(docs), "telephony", **PARQUET)
    return described(stage(to_pcm(media, rate, packed=True), "telephony-pcm", **PARQUET))
