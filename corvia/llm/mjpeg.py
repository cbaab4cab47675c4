"""Motion-JPEG in AVI files: frames by the RIFF index, intra decoding, shots, timed clips.

Reading. The chunk tree is walked once. The first video stream is read; of each movi list (there is one in each
RIFF part, AVIX parts included) the frames come from idx1, which knows the first part only, else from OpenDML
standard indexes, else from its chunks in order. A frame of no bytes was dropped and repeats the one before
(at the beginning: the first that has bytes). Every frame is a baseline JPEG of its own; where it brings no Huffman tables, the
standard ones hold. Restart markers, several components and any sampling are read; codes are looked up 16 bits at a time;
luma planes come out of an integer inverse transform.

Shots. Frames become luma histograms; a cut is where the difference to the frame before exceeds the
mean of the differences around it by `sigmas` of their deviations, is the largest near, and is at least
`floor`. Clips are the frames between cuts, with times from the stream's rate.

Storing bytes. store() keeps a payload without loss in a file of this kind: a frame of 32 x 24 pixels has
12 blocks, a block 48 coefficients of magnitude category 8, which has exactly 256 values, one for each
byte. The sample is thus the format's own unit, a quantised coefficient. The code of each has 9 bits, so
frames of this form are packed and read in whole arrays; read_frames() takes any other by symbol.

Defined results: a file that is no RIFF AVI, or a frame that is no baseline JPEG, raises
ValueError; clip_rows() turns that into one row with the error. A file without frames has no clips. Null and
empty texts store one frame of filling.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from corvia.llm.arrow import map_rows

WIDTH, HEIGHT, BLOCKS, USED = 32, 24, 12, 48
FRAME_BYTES = BLOCKS * USED
RATE, SCALE = 25, 1
BINS = 32
#: Frames handled at once.
MANY = 2048


def _zigzag() -> np.ndarray:
    """Row-major places of the 64 coefficients in coding order: the diagonals, up and down in turn."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Coefficient in coding order x pixel, times 4096, in integers: products add up exactly in any order."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    full = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(full * 4096)[ZIGZAG]


BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _codes(table: int, by_length: dict[int, bytes]) -> bytes:
    return bytes([table]) + bytes(len(by_length.get(i, b"")) for i in range(1, 17)) + b"".join(by_length[i] for i in sorted(by_length))


#: DC: "no difference" is 0. AC: a coefficient of 8 bits is 0, the end of the block 10.
HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([1] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, _codes(0x00, {1: b"\x00"}))
    + _segment(0xC4, _codes(0x10, {1: b"\x08", 2: b"\x00"}))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)
END = b"\xff\xd9"
BITS_IN_BLOCK = 1 + 9 * USED + 2


# --- writing


def pad_payload(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % FRAME_BYTES if data else FRAME_BYTES)


def _scan_bytes(samples: np.ndarray) -> np.ndarray:
    """frames x 576 bytes -> frames x bytes of their scans, before stuffing."""
    n = len(samples)
    bits = np.zeros((n, BLOCKS, BITS_IN_BLOCK), dtype=np.uint8)
    coded = np.zeros((n, BLOCKS, USED, 9), dtype=np.uint8)
    coded[..., 1:] = np.unpackbits(samples.reshape(n, BLOCKS, USED, 1), axis=3)
    bits[:, :, 1 : 1 + 9 * USED] = coded.reshape(n, BLOCKS, 9 * USED)
    bits[:, :, -2] = 1
    flat = bits.reshape(n, -1)
    return np.packbits(np.concatenate([flat, np.ones((n, -flat.shape[1] % 8), dtype=np.uint8)], axis=1), axis=1)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_avi(frames: list[bytes], width: int, height: int, rate: int = RATE, scale: int = SCALE) -> bytes:
    n, most = len(frames), max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 * scale // rate, most * rate // scale, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, scale, rate, 0, n, most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    index, at, chunks = [], 4, []
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        chunks.append(_chunk(b"00dc", frame))
        at += len(chunks[-1])
    return _chunk(b"RIFF", b"AVI " + header + _list(b"movi", b"".join(chunks)) + _chunk(b"idx1", b"".join(index)))


def store(payload: bytes) -> bytes:
    """An AVI file whose coefficients are the payload's bytes; its length is a multiple of FRAME_BYTES."""
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, FRAME_BYTES)
    frames = []
    for at in range(0, len(samples), MANY):
        for row in _scan_bytes(samples[at : at + MANY]):
            frames.append(HEADER + row.tobytes().replace(b"\xff", b"\xff\0") + END)
    return write_avi(frames, WIDTH, HEIGHT)


# --- RIFF


@dataclass
class Stream:
    frames: list[tuple[int, int]]  # offset and length in the file
    rate: int
    scale: int
    indexed: str


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(list kind or empty, chunk name, start, end) of all chunks, lists before what they hold."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        start, stop = at + 8, min(at + 8 + size, end)
        if name in (b"RIFF", b"LIST"):
            yield data[start : start + 4], name, start + 4, stop
            yield from _walk(data, start + 4, stop)
        else:
            yield b"", name, start, stop
        at = stop + (size & 1)


def read_riff(data: bytes) -> Stream:
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no RIFF AVI file")
    rate, scale, lists, listed, scanned, standard = RATE, SCALE, [], [], [], []
    n_streams, prefix = 0, None

    def is_video(name: bytes) -> bool:
        return name[2:] in (b"dc", b"db") and (name[:2] == prefix or prefix is None and name[:2].isdigit())

    for kind, name, start, stop in _walk(data, 0, len(data)):
        if kind == b"movi":
            lists.append((start, stop))
        elif name == b"strh":
            if data[start : start + 4] == b"vids" and prefix is None:
                prefix = b"%02d" % n_streams
                scale, rate = struct.unpack_from("<II", data, start + 20)
            n_streams += 1
        elif name == b"idx1" and lists and not listed:
            count, movi = (stop - start) // 16, lists[0][0] - 4
            entries = np.frombuffer(data, dtype="<u4", count=count * 4, offset=start).reshape(count, 4)
            names = np.frombuffer(data, dtype="S4", count=count * 4, offset=start)[::4]
            offsets = entries[:, 2].astype(np.int64)
            # Offsets count from the word movi, or in some files from the beginning.
            base = 0 if count and data[offsets[0] : offsets[0] + 4] == names[0] else movi
            listed = [(base + o + 8, n) for o, n, x in zip(offsets.tolist(), entries[:, 3].tolist(), names.tolist(), strict=True) if is_video(x)]
        elif name[:2] == b"ix":
            longs, sub, what, used, of, base = struct.unpack_from("<HBBI4sQ", data, start)
            if what == 1 and sub == 0 and longs == 2 and is_video(of):
                for i in range(used):
                    offset, size = struct.unpack_from("<II", data, start + 24 + 8 * i)
                    standard.append((base + offset, size & 0x7FFFFFFF))
        elif is_video(name):
            scanned.append((start, stop - start))
    frames, how = [], "none"
    for low, high in lists:
        for found, what in ((listed if low == lists[0][0] else [], "idx1"), (standard, "ix00"), (scanned, "movi")):
            mine = found if what == "idx1" else [f for f in found if low <= f[0] <= high]
            if mine:
                frames += mine
                how = what if how == "none" else how
                break
    if any(o + n > len(data) for o, n in frames):
        raise ValueError("a frame lies beyond the end of the file")
    shown = next((f for f in frames if f[1]), None)
    for i, frame in enumerate(frames):
        shown = frame if frame[1] else shown
        frames[i] = shown
    return Stream([f for f in frames if f], rate or RATE, scale or SCALE, how)


# --- JPEG

#: The standard Huffman tables for luma and chroma, how many codes of each length and their symbols.
STANDARD_CODES = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a34353637"
        "38393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3"
        "a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        "00020102040403040705040400010277",
        "0001020311040521310612415107617113223281081442"
        "91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465"
        "666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6"
        "c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}


def _code_table(counts: bytes, symbols: bytes) -> list[int]:
    """For each value of the next 16 bits: length << 8 | symbol of the code that they begin with, 0 for none."""
    table = np.zeros(1 << 16, dtype=np.int32)
    code, used = 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[used : used + n]:
            if code >> length:
                raise ValueError("more Huffman codes than there are")
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | s
            code += 1
        used += n
        code <<= 1
    return table.tolist()


def _windows(scan: bytes) -> memoryview:
    """At each byte of a scan, that and the next three as one number."""
    raw = np.frombuffer(scan + b"\xff" * 8, dtype=np.uint8).astype(np.uint32)
    return memoryview(raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:])


def decode_jpeg(frame: bytes, looked_up: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of the first component (blocks x 64, coding order, block rows) and its plane of pixels.

    looked_up keeps the look-up tables of Huffman codes from one frame of a stream to the next.
    """
    looked_up = {} if looked_up is None else looked_up
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, quant, tables, parts, restart, size = 2, {}, {}, [], 0, None
    while True:
        if frame[at : at + 1] != b"\xff":
            raise ValueError("no marker where one is due")
        marker = frame[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        length = struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 << wide
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                used = sum(body[1:17])
                tables[body[0]] = bytes(body[1:17]), bytes(body[17 : 17 + used])
                body = body[17 + used :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("samples of other than 8 bits")
            size = (height, width)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("a frame that is not baseline")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if size is None or set(chosen) != {p[0] for p in parts}:
        raise ValueError("a scan that does not hold all components")
    end = frame.rfind(END)
    scan, pieces, start, k = frame[at : end if end >= at else len(frame)], [], 0, 0
    while (k := scan.find(b"\xff", k)) >= 0:
        if k + 1 < len(scan) and 0xD0 <= scan[k + 1] <= 0xD7:
            pieces.append(scan[start:k])
            start = k + 2
        k += 2
    pieces.append(scan[start:])
    h_max, v_max = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, h_max, v_max = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-size[1] // (8 * h_max)), -(-size[0] // (8 * v_max))
    first = parts[0]
    grid = np.zeros((down * first[2], across * first[1], 64), dtype=np.int64)
    coded = {}
    for name, *_ in parts:
        for key in (chosen[name] >> 4, 0x10 | chosen[name] & 15):
            known = tables.get(key) or (tuple(map(bytes.fromhex, STANDARD_CODES[key])) if key in STANDARD_CODES else None)
            if known is None:
                raise ValueError("a Huffman table is missing")
            if known not in looked_up:
                looked_up[known] = _code_table(*known)
            coded[key] = looked_up[known]
    plan = [(name, h, v, coded[chosen[name] >> 4], coded[0x10 | chosen[name] & 15]) for name, h, v, _ in parts]
    places, values = [], []  # coefficients of the first component
    wide, window, at, end, before = grid.shape[1], None, 0, 0, {}
    for unit in range(across * down):
        if window is None or restart and unit % restart == 0:
            which = unit // restart if restart else 0
            if which >= len(pieces):
                raise ValueError("a scan ends too early")
            piece = pieces[which].replace(b"\xff\0", b"\xff")
            window, at, end, before = _windows(piece), 0, 8 * len(piece), dict.fromkeys(chosen, 0)
        for name, h, v, dc, ac in plan:
            mine = name == first[0]
            for y in range(v):
                for x in range(h):
                    place = ((unit // across * v + y) * wide + unit % across * h + x) * 64
                    k, table = 0, dc
                    while k < 64:
                        found = table[window[at >> 3] >> (16 - (at & 7)) & 0xFFFF]
                        if not found:
                            raise ValueError("no such Huffman code" if at < end else "a scan ends too early")
                        at += found >> 8
                        run, n = (0, found & 255) if k == 0 else (found >> 4 & 15, found & 15)
                        if n > 16:
                            raise ValueError("no such Huffman code")
                        if k and not n and run < 15:
                            break
                        k += run
                        value = 0
                        if n:
                            value = window[at >> 3] >> (32 - (at & 7) - n) & ((1 << n) - 1)
                            at += n
                            if not value >> (n - 1):
                                value -= (1 << n) - 1
                        if k > 63:
                            raise ValueError("too many coefficients")
                        if k == 0:
                            before[name] = value = before[name] + value
                            table = ac
                        if mine and value:
                            places.append(place + k)
                            values.append(value)
                        k += 1
                        if at > end:
                            raise ValueError("a scan ends too early")
    grid.reshape(-1)[places] = values
    levels = (grid * quant[first[3]]).astype(np.float64) @ BASIS
    pixels = np.clip((levels.astype(np.int64) + 2048 >> 12) + 128, 0, 255).astype(np.uint8)
    plane = pixels.reshape(*grid.shape[:2], 8, 8).swapaxes(1, 2).reshape(grid.shape[0] * 8, grid.shape[1] * 8)
    height, width = -(-size[0] * first[2] // v_max), -(-size[1] * first[1] // h_max)
    return grid.reshape(-1, 64), plane[:height, :width]


_FAST = BASIS[1 : 1 + USED].astype(np.float32)


def _own_frames(data: bytes, frames: list[tuple[int, int]]) -> np.ndarray | None:
    """Payload bytes (frames x 576) if every frame has the form that store() writes."""
    rows, head = [], len(HEADER)
    n_bytes = -(-BLOCKS * BITS_IN_BLOCK // 8)
    for at, n in frames:
        if not data.startswith(HEADER, at) or not data.startswith(END, at + n - 2):
            return None
        row = data[at + head : at + n - 2].replace(b"\xff\0", b"\xff")
        if len(row) != n_bytes:
            return None
        rows.append(row)
    bits = np.unpackbits(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, n_bytes), axis=1)
    bits = bits[:, : BLOCKS * BITS_IN_BLOCK].reshape(len(rows), BLOCKS, BITS_IN_BLOCK)
    coded = bits[:, :, 1 : 1 + 9 * USED].reshape(len(rows), BLOCKS, USED, 9)
    if bits[:, :, 0].any() or coded[..., 0].any() or not bits[:, :, -2].all() or bits[:, :, -1].any():
        return None
    return np.packbits(coded[..., 1:], axis=3).reshape(len(rows), FRAME_BYTES)


def read_frames(data: bytes, stream: Stream) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
    """For runs of frames: the stored bytes (None for other frames) and luma histograms, frames x BINS."""
    looked_up: dict = {}
    for at in range(0, len(stream.frames), MANY):
        part = stream.frames[at : at + MANY]
        samples = _own_frames(data, part)
        if samples is not None:
            value = samples.astype(np.int16).reshape(-1, USED)
            levels = np.where(value >= 128, value, value - 255).astype(np.float32) @ _FAST
            pixels = np.clip((levels.astype(np.int32) + (2048 + (128 << 12))) >> 12, 0, 255) >> 3
            frame = np.repeat(np.arange(len(part), dtype=np.int32) * BINS, BLOCKS * 64)
            yield samples, np.bincount(pixels.reshape(-1) + frame, minlength=len(part) * BINS).reshape(-1, BINS)
        else:
            yield None, np.stack([np.bincount(decode_jpeg(data[o : o + n], looked_up)[1].reshape(-1) >> 3, minlength=BINS) for o, n in part])


# --- shots


@dataclass
class Clip:
    clip: int
    first_frame: int
    n_frames: int
    start_s: float
    end_s: float
    change: float


def cuts(histograms: np.ndarray, window: int = 8, sigmas: float = 2.5, floor: float = 0.08) -> tuple[np.ndarray, np.ndarray]:
    """Frames at which a shot begins (without 0), and the differences to the frame before (from frame 1 on)."""
    total = np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    share = histograms / total
    d = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    if not len(d):
        return np.empty(0, dtype=int), d
    low, high = np.maximum(np.arange(len(d)) - window, 0), np.minimum(np.arange(len(d)) + window + 1, len(d))
    sums, squares = np.concatenate([[0.0], np.cumsum(d)]), np.concatenate([[0.0], np.cumsum(d * d)])
    n = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - d) / n
    spread = np.sqrt(np.maximum((squares[high] - squares[low] - d * d) / n - mean**2, 0))
    near = np.pad(d, 2)
    peak = d >= np.max([near[i : i + len(d)] for i in range(5)], axis=0)
    return np.flatnonzero((d >= floor) & (d > mean + sigmas * spread) & peak) + 1, d


def clips(data: bytes, **options) -> tuple[list[Clip], dict]:
    """The clips of a file, and what reading it found: stored bytes (or None), histograms, frames, rate."""
    stream = read_riff(data)
    read = list(read_frames(data, stream))
    histograms = np.concatenate([h for _, h in read]) if read else np.zeros((0, BINS), dtype=np.int64)
    own = b"".join(s.tobytes() for s, _ in read) if all(s is not None for s, _ in read) else None
    at, change = cuts(histograms, **options)
    edges = [0, *at.tolist(), len(histograms)]
    tick = stream.scale / stream.rate
    found = [
        Clip(i, a, b - a, round(a * tick, 6), round(b * tick, 6), round(float(change[a - 1]), 6) if a else 0.0)
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
        if b > a
    ]
    return found, {"stored": own, "histograms": histograms, "frames": len(histograms), "indexed": stream.indexed}


def clip_rows(files: DataFrame, key: str, media: str, **options) -> DataFrame:
    """key, media (binary) -> a row for each clip: key, clip, first_frame, n_frames, start_s, end_s, change, error."""

    def make():
        def work(keys, blobs):
            out: dict[str, list] = {k: [] for k in (key, "clip", "first_frame", "n_frames", "start_s", "end_s", "change", "error")}
            for k, blob in zip(keys, blobs, strict=True):
                try:
                    rows = [(k, c.clip, c.first_frame, c.n_frames, c.start_s, c.end_s, c.change, None) for c in clips(blob or b"", **options)[0]]
                except (ValueError, struct.error, IndexError, KeyError) as error:
                    rows = [(k, None, None, None, None, None, None, str(error))]
                for row in rows:
                    for column, x in zip(out.values(), row, strict=True):
                        column.append(x)
            yield out

        return work

    kind = files.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, clip int, first_frame long, n_frames long, start_s double, end_s double, change double, error string"
    return map_rows(files.select(key, media), schema, make)


def stored_text_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as a file, read back, and described: what op1 asks for."""

    def make():
        def work(keys, texts):
            out: dict[str, list] = {
                k: [] for k in (key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            }
            for k, x in zip(keys, texts, strict=True):
                raw = (x or "").encode("utf-8", "surrogatepass")
                media = store(pad_payload(raw))
                found, about = clips(media)
                back = about["stored"]
                h = about["histograms"]
                feature = (
                    f"frames={about['frames']};clips={len(found)};cuts={','.join(str(c.first_frame) for c in found[1:])};"
                    f"end={found[-1].end_s if found else 0:.2f};histogram={zlib.crc32(np.ascontiguousarray(h, dtype='<i8').tobytes()):08x}"
                )
                row = (
                    k, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]),
                    len(media), hashlib.sha256(media).hexdigest(), feature,
                )
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            yield out

        return work

    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    return map_rows(docs.select(key, text), schema, make)
