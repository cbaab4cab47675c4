"""Files and frames of other makers: parts, streams, dropped frames, standard tables, sizes, and long texts."""

from __future__ import annotations

import random
import struct
import time

import numpy as np
import pytest

from corvia.llm import mjpeg as m


def encoder(which):
    """symbol -> (code, length) of a standard table."""
    counts, symbols = map(bytes.fromhex, m.STANDARD_CODES[which])
    out, code, used = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[used : used + n]:
            out[s] = code, length
            code += 1
        used += n
        code <<= 1
    return out


def size_bits(value):
    n = abs(value).bit_length()
    return n, (value if value >= 0 else value + (1 << n) - 1, n)


def frame_of(blocks, width, height, tables=False, restart=0, sampling=((1, 1),)):
    """A JPEG of coefficient blocks in scan order: [unit][component][block] lists of 64."""
    segments = m._segment(0xDB, bytes([0]) + bytes([1] * 64))
    n = len(sampling)
    segments += m._segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    if tables:
        for key, (counts, symbols) in m.STANDARD_CODES.items():
            segments += m._segment(0xC4, bytes([key]) + bytes.fromhex(counts) + bytes.fromhex(symbols))
    if restart:
        segments += m._segment(0xDD, struct.pack(">H", restart))
    segments += m._segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0x11 if i else 0]) for i in range(n)) + bytes([0, 63, 0]))
    pieces, bits, before = [], [], {}

    def close():
        text = "".join(format(v, f"0{k}b") if k else "" for v, k in bits)
        text += "1" * (-len(text) % 8)
        pieces.append(int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0") if text else b"")
        bits.clear()

    for u, unit in enumerate(blocks):
        if restart and u and u % restart == 0:
            close()
            before = {}
        for c, component in enumerate(unit):
            dc, ac = encoder(1 if c else 0), encoder(0x11 if c else 0x10)
            for block in component:
                k, raw = size_bits(block[0] - before.get(c, 0))
                before[c] = block[0]
                bits += [dc[k], raw]
                run = 0
                last = max((i for i in range(64) if block[i]), default=0)
                for x in block[1 : last + 1]:
                    if x == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits.append(ac[0xF0])
                        run -= 16
                    k, raw = size_bits(x)
                    bits += [ac[run << 4 | k], raw]
                    run = 0
                if last < 63:
                    bits.append(ac[0])
    close()
    scan = b"".join(x + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(pieces) else b"") for i, x in enumerate(pieces))
    return b"\xff\xd8" + segments + scan + m.END


def random_block(rng, dense):
    block = [rng.randint(-500, 500)] + [0] * 63
    for _ in range(rng.randint(0, dense)):
        block[rng.randint(1, 63)] = rng.randint(-900, 900)
    return block


def test_standard_tables_are_whole():
    for key in (0x10, 0x11):
        assert set(encoder(key)) == {0, 0xF0} | {r << 4 | s for r in range(16) for s in range(1, 11)}
    assert set(encoder(0)) == set(encoder(1)) == set(range(12))


@pytest.mark.parametrize("tables", [False, True])
@pytest.mark.parametrize("restart", [0, 3])
def test_coefficients_come_back(tables, restart):
    rng = random.Random(restart)
    units = [[[random_block(rng, 40)]] for _ in range(12)]
    levels, plane = m.decode_jpeg(frame_of(units, 32, 24, tables, restart))
    assert levels.tolist() == [u[0][0] for u in units] and plane.shape == (24, 32)


def test_sampled_colour():
    rng = random.Random(4)
    units = [[[random_block(rng, 9) for _ in range(4)], [random_block(rng, 9)], [random_block(rng, 9)]] for _ in range(4)]
    levels, plane = m.decode_jpeg(frame_of(units, 30, 20, sampling=((2, 2), (1, 1), (1, 1))))
    grid = levels.reshape(4, 4, 64)
    for u, unit in enumerate(units):
        for b in range(4):
            assert grid[u // 2 * 2 + b // 2, u % 2 * 2 + b % 2].tolist() == unit[0][b]
    assert plane.shape == (20, 30)


def test_a_large_frame_is_read_at_once():
    rng = random.Random(5)
    frame = frame_of([[[random_block(rng, 12)]] for _ in range(80 * 60)], 640, 480)
    at = time.perf_counter()
    assert m.decode_jpeg(frame)[1].shape == (480, 640)
    assert time.perf_counter() - at < 2


def test_broken_scans_are_errors():
    rng = random.Random(6)
    frame = frame_of([[[random_block(rng, 30)]] for _ in range(12)], 32, 24)
    for cut in (frame[: len(frame) // 2], b"", b"\xff\xd8", frame[:40]):
        with pytest.raises((ValueError, struct.error, IndexError, KeyError)):
            m.decode_jpeg(cut)


def parts_of(frames, first):
    """A file whose frames from `first` on are in a second RIFF part, which idx1 does not know."""
    one = m.write_avi(frames[:first], 32, 24)
    movi = m._list(b"movi", b"".join(m._chunk(b"00dc", f) for f in frames[first:]))
    return one + m._chunk(b"RIFF", b"AVIX" + movi)


def test_later_parts_dropped_frames_and_other_streams():
    rng = random.Random(7)
    frames = [frame_of([[[random_block(rng, 5)]] for _ in range(12)], 32, 24) for _ in range(8)]
    whole = [m.decode_jpeg(f)[1] for f in frames]

    def planes(data):
        stream = m.read_riff(data)
        return [m.decode_jpeg(data[o : o + n])[1] for o, n in stream.frames]

    assert all((a == b).all() for a, b in zip(planes(parts_of(frames, 4)), whole, strict=True))
    dropped = m.write_avi([b"", frames[0], b"", frames[1], b""], 32, 24)
    got = planes(dropped)
    assert len(got) == 5 and all((got[i] == whole[j]).all() for i, j in enumerate((0, 0, 0, 1, 1)))
    assert m.read_riff(m.write_avi([b"", b""], 32, 24)).frames == []
    two = m.write_avi(frames[:2], 32, 24)
    at = two.index(b"movi") + 4
    other = m._chunk(b"01dc", frames[5])
    body = two[at : two.rindex(b"idx1")]
    header = two[12 : two.index(b"LIST", two.index(b"strf"))]
    mixed = m._chunk(b"RIFF", b"AVI " + header + m._list(b"movi", other + body + other))
    got = planes(mixed)
    assert len(got) == 2 and (got[0] == whole[0]).all() and (got[1] == whole[1]).all()


def test_the_short_way_equals_the_general_one_on_all_frames():
    payload = m.pad_payload(random.Random(9).randbytes(576 * 120))
    media = m.store(payload)
    stream = m.read_riff(media)
    own = [(s, h) for s, h in m.read_frames(media, stream)]
    samples, histograms = (np.concatenate([x[i] for x in own]) for i in (0, 1))
    for i, (at, n) in enumerate(stream.frames):
        levels, plane = m.decode_jpeg(media[at : at + n])
        used = levels[:, 1:49]
        assert np.where(used > 0, used, used + 255).astype(np.uint8).tobytes() == samples[i].tobytes()
        assert (np.bincount(plane.reshape(-1) >> 3, minlength=m.BINS) == histograms[i]).all()


def test_a_text_of_megabytes_and_repeated_rows(spark):
    rows = [(1, "é word " * 400_000), (1, "é word " * 400_000), (2, None)]
    got = m.stored_text_features(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    a, b = (r for r in got if r.doc_id == 1)
    assert a == b and a.n_bytes == 3_200_000 and a.payload_bytes % 576 == 0 and a.media_bytes > a.payload_bytes
