import hashlib
import random
import zlib

import numpy as np
import pytest

from lexmill.llm import jpeg
from lexmill.llm.media_columns import media_columns, thumbnails


def test_round_trip(spark):
    docs = [(1, "Text é" * 50), (2, None), (3, ""), (4, " " * 192), (None, "x" * 193), (5, "".join(map(chr, range(1, 2000))) * 3), (1, "Text é" * 50)]
    rows = media_columns(spark.createDataFrame([(*d, b"") for d in docs], "doc_id long, text string, media binary")).collect()
    assert len(rows) == len(docs)
    want = {}
    for i, t in docs:
        b = (t or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        want.setdefault((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])), 0)
    assert {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == set(want)
    assert all(r.media_bytes == len(r.media) and hashlib.sha256(r.media).hexdigest() == r.media_sha256 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].feature == by[3].feature == by[4].feature and by[2].media_sha256 == by[4].media_sha256
    assert media_columns(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts_take_several_images():
    rng = np.random.default_rng(1)
    payload = rng.integers(0, 256, 192 * 8200, np.uint8)
    (f,) = jpeg.written(payload, np.array([len(payload)]))
    images = jpeg.luminance([f])[0]
    assert [x.shape for x in images] == [(8191, 192), (9, 192)]
    assert b"".join(x.tobytes() for x in images) == payload.tobytes()


def colour_file(rng, restart):
    """A small 4:2:0 image with AC symbols, written bit by bit."""
    dc = {s: 4 for s in range(12)}
    ac = {0x00: 2, 0x01: 3, 0x12: 3, 0xF0: 4, 0x33: 4, 0x05: 5}
    dct, act = (jpeg.codes(jpeg.dht(0, t)[1:17], jpeg.dht(0, t)[17:]) for t in (dc, ac))
    wide, high = 3, 2
    bits, out, want, last, n = "", [], {}, [0, 0, 0], 0

    def put(code, length):
        nonlocal bits
        bits += f"{code:0{length}b}" if length else ""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        b = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""
        return b

    for my in range(high):
        for mx in range(wide):
            for comp, blocks in ((0, 4), (1, 1), (2, 1)):
                for k in range(blocks):
                    v = rng.randint(-60, 60)
                    d, last[comp] = v - last[comp], v
                    s = abs(d).bit_length()
                    put(*dct[s])
                    put(d if d >= 0 else d + (1 << s) - 1, s)
                    at = 1
                    for sym in rng.choice([[], [0x01], [0x12, 0xF0, 0x33], [0x05, 0x05], [0xF0, 0xF0, 0xF0, 0x01]]):
                        put(*act[sym])
                        put(rng.randrange(1 << (sym & 15)) if sym & 15 else 0, sym & 15)
                        at += (sym >> 4) + 1
                    put(*act[0])
                    if comp == 0:
                        want[my * 2 + k // 2, mx * 2 + k % 2] = v
            n += 1
            if restart and n % restart == 0 and n < wide * high:
                out += [flush(), bytes([0xFF, 0xD0 + (n // restart - 1) % 8])]
                last = [0, 0, 0]
    out.append(flush())
    sof = bytes([8, 0, 32, 0, 48, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8" + jpeg.segment(0xE0, b"JFIF\0") + jpeg.segment(0xDB, bytes([0, 4]) + bytes([1]) * 63) + jpeg.segment(0xC0, sof) + jpeg.segment(0xC4, jpeg.dht(0, dc) + jpeg.dht(0x10, ac))
    head += (jpeg.segment(0xDD, bytes([0, restart])) if restart else b"") + jpeg.segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    grid = np.array([[want[y, x] for x in range(6)] for y in range(4)])
    return head + b"".join(out) + b"\xff\xd9", np.clip(np.rint(grid * 4 / 8 + 128), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("restart", [0, 1, 2])
def test_other_baseline_images(restart):
    for seed in range(5):
        f, want = colour_file(random.Random(seed), restart)
        assert (jpeg.luminance([f])[0][0] == want).all()


def test_what_is_no_image(spark):
    good, _ = colour_file(random.Random(1), 0)
    rows = thumbnails(spark.createDataFrame([(1, good), (2, None), (3, b"no image"), (4, good[:-2]), (5, good.replace(b"\xff\xc0", b"\xff\xc2"))], "id long, media binary")).collect()
    assert [(r.id, r.width, r.height, r.error is None) for r in rows] == [(1, 48, 32, True)] + [(i, None, None, False) for i in (2, 3, 4, 5)]
