"""Media columns: AVI files of motion JPEG, written and read in numpy.

Writing: a payload of bytes becomes grey frames of 32 blocks a row; each byte is the level of one 8 x 8
block, stored exactly in its DC coefficient (quantizer 8). A restart marker after every 64 blocks
makes runs of blocks independent, so that many runs are coded, and decoded, in step.

Reading: the RIFF index lists the frames; each is a baseline JPEG (its own quantizer, Huffman and
restart segments; one grey component, or three whose first is used at full sampling). Levels are compared through 32-bin
histograms; a shot begins where the difference to the frame before exceeds ``FLOOR`` and, by ``SHARP`` deviations, the
mean of the last ``MEMORY`` differences in its shot. Shots give timed clips.

Defined cases: null text counts as empty; an empty text is 64 zero bytes; equal texts give equal
results whatever the row; repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored. One document is one file, so it must fit in a task (RIFF: 4 GB).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import buffers, slices

UNIT, COLUMNS, RESTART, FRAME_BLOCKS, FPS = 64, 32, 64, 1024, 8
SHARP, MEMORY, FLOOR, BINS = 2.5, 8, 0.12, 32
#: Runs of blocks coded at once.
_RUNS = 8192

# Lengths of the usual luminance DC codes for categories 0 to 11.
_DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
_DC_SYMBOLS = tuple(range(12))
# One AC code: end of block, a single 0 bit.
_AC_COUNTS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
_AC_SYMBOLS = (0,)


def _codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol to (code, length)."""
    out, code, at = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _bit_rows() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of a block for each DC difference -255..255 (end of block included), then of 0 to 7 padding
    ones: rows of bits, which of them count, and how many do."""
    dc = _codes(_DC_COUNTS, _DC_SYMBOLS)
    words = []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        words.append(format(code, f"0{length}b") + (format(extra, f"0{size}b") if size else "") + "0")
    words += ["1" * i for i in range(8)]
    size = np.array([len(w) for w in words])
    rows = np.array([[int(c) for c in w.ljust(size.max(), "0")] for w in words], np.uint8)
    return rows, np.arange(size.max()) < size[:, None], size


_ROWS, _USED, _SIZES = _bit_rows()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(256)
def jpeg_header(width: int, height: int) -> bytes:
    quantizer = bytes([8]) + bytes([1]) * 63
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\0" + quantizer),
            _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, b"\x00" + bytes(_DC_COUNTS) + bytes(_DC_SYMBOLS)),
            _segment(0xC4, b"\x10" + bytes(_AC_COUNTS) + bytes(_AC_SYMBOLS)),
            _segment(0xDD, struct.pack(">H", RESTART)),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


def code_runs(levels: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of runs of blocks (runs x RESTART levels), each with its end marker: a restart
    marker by ``number``, or the end of the image where ``last``; and the runs' offsets."""
    n = len(levels)
    at = np.empty((n, RESTART + 1), np.int64)
    at[:, 0] = levels[:, 0].astype(np.int64) - 128
    at[:, 1:-1] = np.diff(levels.astype(np.int64), axis=1)
    at[:, :-1] += 255
    bits = _SIZES[at[:, :-1]].sum(axis=1)
    at[:, -1] = 511 + (-bits) % 8
    flat = at.ravel()
    data = np.packbits(_ROWS[flat][_USED[flat]])
    size = (bits + 7) // 8
    ends = np.cumsum(size)
    stuffed = data == 0xFF
    run = np.repeat(np.arange(n), size)
    shift = np.cumsum(stuffed) - stuffed + 2 * run
    out = np.zeros(len(data) + int(stuffed.sum()) + 2 * n, np.uint8)
    out[np.arange(len(data)) + shift] = data
    after = np.concatenate([[0], np.cumsum(stuffed)])
    offsets = np.concatenate([[0], ends + after[ends] + 2 * np.arange(1, n + 1)])
    out[offsets[1:] - 2] = 0xFF
    out[offsets[1:] - 1] = np.where(last, 0xD9, 0xD0 + number % 8)
    return out, offsets


def jpeg_frames(payloads: list[bytes]) -> list[tuple[list[bytes], int]]:
    """For each payload (a positive multiple of 64 bytes), its JPEG frames and their height in pixels."""
    blocks = [min(len(p), FRAME_BLOCKS) for p in payloads]
    padded = b"".join(p + b"\0" * (-len(p) % b) for p, b in zip(payloads, blocks, strict=True))
    runs = np.frombuffer(padded, np.uint8).reshape(-1, RESTART)
    frames = [-(-len(p) // b) for p, b in zip(payloads, blocks, strict=True)]
    per = np.repeat(np.array(blocks) // RESTART, frames)  # runs of each frame
    first = np.concatenate([[0], np.cumsum(per)])
    number = np.arange(len(runs)) - np.repeat(first[:-1], per)
    last = number == np.repeat(per, per) - 1
    coded, at = [], [np.zeros(1, np.int64)]
    for i in range(0, len(runs), _RUNS):
        data, offsets = code_runs(runs[i : i + _RUNS], last[i : i + _RUNS], number[i : i + _RUNS])
        coded.append(data.tobytes())
        at.append(offsets[1:] + at[-1][-1])
    whole, bound = b"".join(coded), np.concatenate(at)[first].tolist()
    out, f = [], 0
    for b, n in zip(blocks, frames, strict=True):
        height = b // COLUMNS * 8
        header = jpeg_header(COLUMNS * 8, height)
        out.append(([header + whole[bound[i] : bound[i + 1]] for i in range(f, f + n)], height))
        f += n
    return out


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi_files(payloads: list[bytes]) -> list[bytes]:
    """AVI files that hold the payloads (positive multiples of 64 bytes)."""
    return [_avi(frames, height, len(p)) for (frames, height), p in zip(jpeg_frames(payloads) if payloads else [], payloads, strict=True)]


def _avi(frames: list[bytes], height: int, size: int) -> bytes:
    width, most = COLUMNS * 8, max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, -1, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", f"payload={size}\0".encode()))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    body = b"AVI " + head + info + movi + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


@dataclass
class Tables:
    """What a JPEG header says."""

    width: int
    height: int
    quantizers: dict[int, np.ndarray]
    components: list[tuple[int, int, int, int]]  # id, horizontal, vertical, quantizer
    dc: dict[int, np.ndarray]
    ac: dict[int, np.ndarray]
    scan: list[tuple[int, int, int]]  # component id, DC table, AC table
    restart: int
    length: int


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits, the code's length times 256 plus its symbol; 0 for no code."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in _codes(tuple(counts), tuple(symbols)).items():
        first = code << (16 - length)
        out[first : first + (1 << (16 - length))] = length * 256 + symbol
    return out


def parse_header(frame: bytes) -> Tables:
    t, at = Tables(0, 0, {}, [], {}, {}, [], 0, 0), 2
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    while True:
        marker, (length,) = frame[at + 1], struct.unpack_from(">H", frame, at + 2)
        body, at = frame[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                t.quantizers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            _, t.height, t.width, n = struct.unpack_from(">BHHB", body)
            t.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only baseline JPEG is supported")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                (t.ac if body[0] >> 4 else t.dc)[body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (t.restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            t.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            t.length = at
            return t


def _peek(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 16 bits at bit positions ``at``."""
    byte = at >> 3
    three = (data[byte].astype(np.int32) << 16) | (data[byte + 1].astype(np.int32) << 8) | data[byte + 2]
    return (three >> (8 - (at & 7)).astype(np.int32)) & 0xFFFF


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


def decode(frames: list[bytes], headers: list[Tables]) -> tuple[np.ndarray, np.ndarray, dict]:
    """First-component DC coefficients of all frames, block by block as coded; each frame's first block
    (n + 1 offsets); and the AC coefficients: {(block, zigzag index): value}.

    The headers may differ in width and height only. Runs between restart markers go in step.
    """
    t = headers[0]
    shape = {c: (h, v) for c, h, v, _ in t.components}
    alone = len(t.scan) == 1
    mcu = [(i, d, a) for i, (c, d, a) in enumerate(t.scan) for _ in range(1 if alone else shape[c][0] * shape[c][1])]
    wide, high = (8, 8) if alone else (8 * max(h for h, _ in shape.values()), 8 * max(v for _, v in shape.values()))
    total = np.array([-(-x.width // wide) * -(-x.height // high) for x in headers])
    per_run = t.restart or int(total.max())
    runs = -(-total // per_run)
    whole = np.frombuffer(b"".join(f[x.length :] for f, x in zip(frames, headers, strict=True)) + b"\0", np.uint8)
    escape = np.flatnonzero(whole[:-1] == 0xFF)
    marks = escape[whole[escape + 1] != 0]
    keep = np.ones(len(whole), bool)
    keep[escape[whole[escape + 1] == 0] + 1] = False
    data = np.append(whole[keep], np.zeros(4, np.uint8))
    ends = marks - np.searchsorted(np.flatnonzero(~keep), marks)
    if len(ends) != runs.sum():
        raise ValueError("restart markers do not fit the header")
    at = np.concatenate([[0], ends[:-1] + 2]).astype(np.int64) * 8
    number = np.arange(len(at)) - np.repeat(np.cumsum(runs) - runs, runs)
    left = np.minimum(per_run, np.repeat(total, runs) - per_run * number)
    of_first = sum(1 for i, _, _ in mcu if i == 0)
    dc = np.zeros((len(at), per_run * of_first), np.int32)
    before = np.zeros((len(t.scan), len(at)), np.int32)
    ac: dict[tuple[int, int], int] = {}
    base = np.concatenate([[0], np.cumsum(left * of_first)])
    for m in range(per_run):
        lanes = np.flatnonzero(left > m)
        seen = 0
        for i, d, a in mcu:
            code = t.dc[d][_peek(data, at[lanes])]
            if not code.all():
                raise ValueError("no such code")
            size = code & 255
            pos = at[lanes] + (code >> 8)
            before[i, lanes] += _extend(_peek(data, pos) >> (16 - size), size)
            at[lanes] = pos + size
            if i == 0:
                dc[lanes, m * of_first + seen] = before[i, lanes]
            k, live = np.ones(len(lanes), np.int64), lanes
            while len(live):
                code = t.ac[a][_peek(data, at[live])]
                if not code.all():
                    raise ValueError("no such code")
                size, run = code & 15, (code & 255) >> 4
                pos = at[live] + (code >> 8)
                at[live] = pos + size
                go = (code & 255) != 0
                if not go.any():
                    break
                value = _extend(_peek(data, pos) >> (16 - size), size)
                k += run
                if i == 0:
                    for x in np.flatnonzero(go & (size > 0)):
                        ac[int(base[live[x]]) + m * of_first + seen, int(k[x])] = int(value[x])
                k += 1
                go &= k < 64
                live, k = live[go], k[go]
            seen += i == 0
    used = np.arange(per_run * of_first) < (left * of_first)[:, None]
    return dc[used], np.concatenate([[0], np.cumsum(total * of_first)]), ac


def _zigzag() -> np.ndarray:
    order = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 else p[0]))
    return np.array([y * 8 + x for y, x in order])


def levels(dc: np.ndarray, first: np.ndarray, ac: dict, quantizer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each block's mean level, rounded, and each frame's histogram (shares of BINS) and mean level."""
    flat = np.clip(np.rint(dc * (quantizer[0] / 8)) + 128, 0, 255).astype(np.uint8)
    busy = sorted({b for b, _ in ac})
    frame = np.repeat(np.arange(len(first) - 1), np.diff(first))
    counts = 64 * np.bincount(frame * 256 + flat, minlength=256 * (len(first) - 1)).reshape(-1, 256)
    if busy:
        u = np.arange(8)
        basis = np.sqrt(np.where(u == 0, 1 / 8, 1 / 4))[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
        zigzag = _zigzag()
        coefs = np.zeros((len(busy), 64))
        where = {b: i for i, b in enumerate(busy)}
        coefs[:, 0] = dc[busy] * quantizer[0]
        for (b, k), v in ac.items():
            coefs[where[b], zigzag[k]] = v * quantizer[k]
        pixels = np.clip(np.rint(basis.T @ coefs.reshape(-1, 8, 8) @ basis) + 128, 0, 255).astype(np.int64)
        np.add.at(counts, (frame[busy], flat[busy]), -64)
        np.add.at(counts, (np.repeat(frame[busy], 64), pixels.ravel()), 1)
    sums = np.maximum(1, counts.sum(axis=1))
    return flat, counts.reshape(len(counts), BINS, -1).sum(axis=2) / sums[:, None], counts @ np.arange(256) / sums


@dataclass
class Video:
    payload: bytes | None  # of files that hold one
    fps: float
    histograms: np.ndarray  # frames x BINS, shares
    means: np.ndarray


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        yield kind, at + 8, size
        at += 8 + size + size % 2


def _frames(data: bytes) -> tuple[list[bytes], float, int | None]:
    """Frames of an AVI file by its index, frames a second, and the size of the payload it holds."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, fps, payload = 0, [], float(FPS), None
    for kind, at, size in _chunks(data, 12, len(data)):
        if kind == b"LIST" and data[at : at + 4] == b"movi":
            movi = at
        elif kind == b"LIST" and data[at : at + 4] == b"hdrl":
            fps = 1_000_000 / max(1, struct.unpack_from("<I", data, at + 12)[0])
        elif kind == b"LIST" and data[at : at + 4] == b"INFO":
            for sub, a, n in _chunks(data, at + 4, at + size):
                if sub == b"ICMT" and data[a : a + 8] == b"payload=":
                    payload = int(data[a + 8 : a + n].rstrip(b"\0"))
        elif kind == b"idx1":
            index = [(movi + o + 4, n) for k, _, o, n in struct.iter_unpack("<4sIII", data[at : at + size]) if k[2:] == b"dc"]
    return [data[at + 4 : at + 4 + n] for at, n in index], fps, payload


def read_files(files: list[bytes]) -> list[Video]:
    """Parse AVI files and decode all their frames, those of like headers together."""
    parsed = [_frames(f) for f in files]
    frames = [f for own, _, _ in parsed for f in own]
    known: dict[bytes, tuple[Tables, bytes]] = {}
    lengths: list[int] = []
    headers, like = [], {}
    for i, f in enumerate(frames):
        hit = next((known[f[:n]] for n in lengths if f[:n] in known), None)
        if hit is None:
            t = parse_header(f)
            at = f.index(b"\xff\xc0") + 5
            hit = known[f[: t.length]] = (t, f[:at] + f[at + 4 : t.length])
            if t.length not in lengths:
                lengths.append(t.length)
        headers.append(hit[0])
        like.setdefault(hit[1], []).append(i)
    parts: list[bytes] = [b""] * len(frames)
    histograms, means = np.zeros((len(frames), BINS)), np.zeros(len(frames))
    for own in like.values():
        blocks = np.cumsum([headers[i].width * headers[i].height // 64 for i in own])
        group = blocks // (_RUNS * RESTART)
        for g in np.unique(group):
            pick = [own[j] for j in np.flatnonzero(group == g)]
            dc, first, ac = decode([frames[i] for i in pick], [headers[i] for i in pick])
            t = headers[pick[0]]
            flat, histograms[pick], means[pick] = levels(dc, first, ac, t.quantizers[t.components[0][3]])
            whole = flat.tobytes()
            for j, i in enumerate(pick):
                parts[i] = whole[first[j] : first[j + 1]]
    out, f = [], 0
    for own, fps, size in parsed:
        n = len(own)
        out.append(Video(b"".join(parts[f : f + n])[:size] if size is not None else None, fps, histograms[f : f + n], means[f : f + n]))
        f += n
    return out


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """Shots as (first, last) frames, cut where the histogram difference is outstanding."""
    n = len(histograms)
    if not n:
        return []
    d = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    begins = [0]
    for i, x in enumerate(d):
        if x > FLOOR:
            past = d[max(begins[-1], i - MEMORY) : i]
            if len(past) < 2 or x > past.mean() + SHARP * past.std():
                begins.append(i + 1)
    return [(a, b - 1) for a, b in zip(begins, [*begins[1:], n], strict=True)]


def feature(video: Video) -> str:
    """Clips as first-last@mean level, then the shares of eight level ranges in per mille."""
    clips = [f"{a / video.fps:.3f}-{(b + 1) / video.fps:.3f}@{video.means[a : b + 1].mean():.3f}" for a, b in shots(video.histograms)]
    share = video.histograms.mean(axis=0).reshape(8, -1).sum(axis=1) if len(video.histograms) else np.zeros(8)
    return "|".join(clips) + "#" + ",".join(f"{1000 * x:.1f}" for x in share)


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT or (0 if text else UNIT))


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                media = pa.array(avi_files([payload_of(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(a, b)]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], media], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def clips(files: DataFrame) -> DataFrame:
    """Timed clips of AVI files (doc_id, media): doc_id, clip, first_frame, last_frame, start_s, end_s, level.

    A null file has no clips; bytes that are no motion-JPEG AVI give one row with null frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            take = []
            for i, media in enumerate(batch.column("media")):
                if media.as_py() is None:
                    continue
                try:
                    video = read_files([media.as_py()])[0]
                except (ValueError, IndexError, KeyError, struct.error):
                    rows = [(0, None, None, None, None, None)]
                else:
                    rows = [(k, a, b, a / video.fps, (b + 1) / video.fps, float(video.means[a : b + 1].mean())) for k, (a, b) in enumerate(shots(video.histograms))]
                take += [i] * len(rows)
                for column, values in zip(out, zip(*rows, strict=True), strict=False):
                    column += values
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(take, pa.int64())), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]],
                names=["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s", "level"],
            )

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, clip int, first_frame int, last_frame int, start_s double, end_s double, level double")


def round_trip(docs: DataFrame) -> DataFrame:
    """Digest of each text's file, written and read back: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
                files = avi_files([payload_of(x) for x in texts])
                rows = [
                    (len(x), len(v.payload), hashlib.sha256(v.payload).hexdigest(), zlib.crc32(v.payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(v))
                    for x, m, v in zip(texts, files, read_files(files), strict=True)
                ]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
