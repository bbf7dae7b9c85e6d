"""Baseline JPEG in numpy: writing of flat-block greyscale images, parsing of markers, and DC-only luminance of many images at once."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Blocks in a row of a written image and rows in an image at most (65535 pixels are 8191 blocks).
ROW, ROWS = 192, 8191
#: Code lengths of the written tables: a DC symbol is the number of bits of a difference (0 to 8); the only AC symbol is the end of a block.
DC_LENGTHS = {0: 4, 1: 4, 2: 4, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 8: 4}
AC_LENGTHS = {0: 1}


def dht(kind: int, lengths: dict[int, int]) -> bytes:
    """Payload of a table definition: how many codes there are of each length, and the symbols in the order of their codes."""
    ordered = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes([kind]) + bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)) + bytes(ordered)


def codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol to code and length."""
    found, code, at = {}, 0, 0
    for n, k in enumerate(counts, 1):
        for s in symbols[at : at + k]:
            found[s] = (code, n)
            code += 1
        at += k
        code <<= 1
    return found


def segment(marker: int, payload: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(payload) + 2).to_bytes(2, "big") + payload


def header(rows: int) -> bytes:
    """All up to the scan. Quantisation is by 8, so that a DC value is the mean of its block less 128."""
    sof = bytes([8]) + (rows * 8).to_bytes(2, "big") + (ROW * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([8]) + bytes([1]) * 63) + segment(0xC0, sof) + segment(0xC4, dht(0x00, DC_LENGTHS)) + segment(0xC4, dht(0x10, AC_LENGTHS)) + segment(0xDD, ROW.to_bytes(2, "big")) + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def written(samples: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A file for each run of sizes samples (positive multiples of ROW). Each sample is a flat block; a row of blocks is a restart interval.

    Files of more than ROWS rows are several images one after another.
    """
    n_rows = len(samples) // ROW
    dc = (samples.astype(np.int32) - 128).reshape(n_rows, ROW)
    diff = np.diff(dc, axis=1, prepend=0)
    size = np.zeros(512, np.int32)
    size[1:] = np.floor(np.log2(np.arange(1, 512))).astype(np.int32) + 1
    bits = size[np.abs(diff)]
    table = codes(dht(0, DC_LENGTHS)[1:17], dht(0, DC_LENGTHS)[17:])
    code, length = np.array([table[s][0] for s in range(9)]), np.array([table[s][1] for s in range(9)])
    extra = np.where(diff < 0, diff + (1 << bits) - 1, diff)
    value = ((code[bits] << bits) | extra) << 1  # the last bit ends the block
    length = length[bits] + bits + 1
    row_bits = length.sum(1)
    row_bytes = (row_bits + 7) // 8
    row_at = np.r_[0, np.cumsum(row_bytes)]
    at = (np.cumsum(length, 1) - length + row_at[:-1, None] * 8).ravel()
    value, length = value.ravel(), length.ravel()
    stream = np.ones(int(row_at[-1]) * 8, np.uint8)
    for b in range(int(length.max(initial=0))):
        m = length > b
        stream[at[m] + b] = value[m] >> (length[m] - 1 - b) & 1
    coded = np.packbits(stream)
    # a zero after each 0xFF, and a restart marker after each row
    width = 1 + (coded == 0xFF)
    first = np.r_[0, np.cumsum(sizes // ROW)]
    nth = np.arange(n_rows) - np.repeat(first[:-1], np.diff(first))
    last_row = np.zeros(n_rows, bool)
    last_row[first[1:] - 1] = True
    last_row |= nth % ROWS == ROWS - 1
    ends = row_at[1:] - 1
    place = np.cumsum(width) - width
    tail = np.zeros(len(coded), np.int64)
    tail[ends[~last_row]] = 2
    shift = np.cumsum(tail) - tail
    out = np.zeros(int(width.sum() + tail.sum()), np.uint8)
    out[place + shift] = coded
    marker = (place + shift + width)[ends[~last_row]]
    out[marker], out[marker + 1] = 0xFF, 0xD0 + (nth[~last_row] % ROWS) % 8
    stop = np.r_[0, (place + shift + width)[ends] + np.where(last_row, 0, 2)] if n_rows else np.zeros(1, np.int64)
    files = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        parts = []
        for c in range(a, b, ROWS):
            d = min(c + ROWS, b)
            parts += [header(d - c), out[stop[c] : stop[d]].tobytes(), b"\xff\xd9"]
        files.append(b"".join(parts))
    return files


@dataclass
class Component:
    number: int
    h: int
    v: int
    quant: int
    dc: bytes = b""
    ac: bytes = b""


@dataclass
class Image:
    """What the markers of a baseline image say, and where its entropy-coded data is."""

    width: int = 0
    height: int = 0
    restart: int = 0
    quant: dict[int, int] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    components: list[Component] = field(default_factory=list)
    scan: tuple[int, int] = (0, 0)

    @property
    def mcus(self) -> tuple[int, int]:
        """MCUs in a row and rows of MCUs."""
        h, v = max(c.h for c in self.components), max(c.v for c in self.components)
        if len(self.components) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def blocks(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.components) == 1:
            return [0]
        return [i for i, c in enumerate(self.components) for _ in range(c.h * c.v)]


def parsed(data: bytes) -> list[Image]:
    """The images in a file. Raises ValueError for anything but baseline images with one scan each."""
    images, at, im = [], 0, None
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1] if at + 1 < len(data) else -1
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD8:
            im, at = Image(), at + 2
            continue
        if marker == 0xD9:
            at, im = at + 2, None
            continue
        if im is None or at + 4 > len(data):
            raise ValueError("a segment stands outside an image")
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                im.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                k = sum(body[1:17])
                im.tables[body[0]] = body[1 : 17 + k]
                body = body[17 + k :]
        elif marker in (0xC0, 0xC1):
            im.height, im.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            im.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            im.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if body[0] != len(im.components) or not im.components:
                raise ValueError("more than one scan")
            for i in range(body[0]):
                c = next(c for c in im.components if c.number == body[1 + 2 * i])
                c.dc, c.ac = im.tables[body[2 + 2 * i] >> 4], im.tables[0x10 | body[2 + 2 * i] & 15]
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("the image has no end")
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            im.scan = at, end
            images.append(im)
            at = end
    return images


def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may come next: the symbol and, above it, the length of its code; zero where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for s, (code, n) in codes(table[:16], table[16:]).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
    return out


def luminance(files: list[bytes]) -> list[list[np.ndarray]]:
    """The DC-only thumbnails of each file's images: a sample (0 to 255) for each block of the first component.

    Restart intervals are independent of each other. Those of all images with the same tables are read together, one
    symbol of each at a time.
    """
    images = [parsed(f) for f in files]
    alike: dict[tuple, list[tuple[int, int]]] = {}
    for i, own in enumerate(images):
        for k, im in enumerate(own):
            alike.setdefault((tuple((c.dc, c.ac, c.h, c.v) for c in im.components),), []).append((i, k))
    out: list[list[np.ndarray]] = [[None] * len(own) for own in images]  # type: ignore[list-item]
    for group in alike.values():
        for (i, k), dc in zip(group, _decoded([(files[i], images[i][k]) for i, k in group]), strict=True):
            out[i][k] = dc
    return out


def _lanes(data: np.ndarray, im: Image) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a scan without stuffing and markers, the start of each restart interval in them, and its MCUs."""
    raw = data[im.scan[0] : im.scan[1]]
    after = np.flatnonzero(raw[:-1] == 0xFF)
    stuffed, marks = after[raw[after + 1] == 0], after[raw[after + 1] >= 0xD0]
    keep = np.ones(len(raw), bool)
    keep[stuffed + 1] = False
    keep[marks] = keep[marks + 1] = False
    kept_before = np.cumsum(keep)
    total = im.mcus[0] * im.mcus[1]
    each = im.restart or total
    n = np.full(-(-total // each), each)
    n[-1] = total - each * (len(n) - 1)
    starts = np.r_[0, kept_before[marks + 1]]
    if len(starts) != len(n):
        raise ValueError("restart intervals are missing")
    return raw[keep], starts, n


def _decoded(group: list[tuple[bytes, Image]]) -> list[np.ndarray]:
    streams, starts, mcus, at = [], [], [], 0
    for f, im in group:
        s, a, n = _lanes(np.frombuffer(f, np.uint8), im)
        streams += [s, np.full(8, 0xFF, np.uint8)]
        starts.append(a + at)
        mcus.append(n)
        at += len(s) + 8
    data = np.concatenate(streams).astype(np.uint32)
    ahead = np.zeros(len(data), np.uint32)  # the next 32 bits
    for b in range(4):
        ahead[: len(data) - b] |= data[b:] << np.uint32(24 - 8 * b)
    first = group[0][1]
    pattern = np.array(first.blocks())
    kinds: dict[bytes, int] = {}
    of = np.array([[kinds.setdefault(t, len(kinds)) for t in (c.dc, c.ac)] for c in first.components])
    tables = np.concatenate([lookup(t) for t in kinds])
    lane = np.concatenate(mcus)
    pos = np.concatenate(starts) * 8
    left = lane * len(pattern)
    n_luma = int((pattern == 0).sum())
    luma_at = np.r_[0, np.cumsum(lane * n_luma)]
    values = np.zeros(int(luma_at[-1]), np.int32)
    to = luma_at[:-1].copy()
    last = np.zeros((len(lane), len(first.components)), np.int32)
    block, k = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    live = np.flatnonzero(left > 0)
    while len(live):
        p, kk, comp = pos[live], k[live], pattern[block[live]]
        bits = ahead[p >> 3] << (p & 7).astype(np.uint32)
        got = tables[of[comp, (kk > 0).astype(np.int64)] * (1 << 16) + (bits >> np.uint32(16)).astype(np.int64)]
        n, s = got >> 8, got & 15
        if not n.all():
            raise ValueError("the data has a code that is in no table")
        p = p + n
        is_dc = kk == 0
        d = np.flatnonzero(is_dc)
        if len(d):
            size = s[d]
            more = ahead[p[d] >> 3] << (p[d] & 7).astype(np.uint32)
            v = np.where(size > 0, more >> (32 - np.maximum(size, 1)).astype(np.uint32), 0).astype(np.int32)
            v = np.where((size > 0) & (v < 1 << np.maximum(size - 1, 0)), v - (1 << size) + 1, v)
            who, c = live[d], comp[d]
            last[who, c] += v
            luma = c == 0
            values[to[who[luma]]] = last[who[luma], 0]
            to[who[luma]] += 1
        run = (got >> 4) & 15
        end = ~is_dc & ((got & 255) == 0)
        kk = np.where(is_dc, 1, np.where(end, 64, kk + run + 1))
        pos[live] = p + s
        done = kk >= 64
        k[live] = np.where(done, 0, kk)
        if done.any():
            b = live[done]
            block[b] = (block[b] + 1) % len(pattern)
            left[b] -= 1
            live = live[left[live] > 0]
    out, row = [], 0
    for (_, im), n in zip(group, mcus, strict=True):
        dc = values[luma_at[row] : luma_at[row + len(n)]]
        row += len(n)
        c, (wide, high) = im.components[0], im.mcus
        h, v = (1, 1) if len(im.components) == 1 else (c.h, c.v)
        grid = dc.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
        out.append(np.clip(np.rint(grid * im.quant[c.quant] / 8 + 128), 0, 255).astype(np.uint8))
    return out
