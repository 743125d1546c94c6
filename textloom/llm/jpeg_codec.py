"""A progressive JPEG codec in numpy: many images at once, their restart intervals decoded in step.

Scans accumulate into coefficient arrays: spectral selection gives parts of the band, successive
approximation gives bits. A restart interval is a lane; one step decodes the next symbol of all lanes that
still run, so images without restarts work too, only with one lane for each scan.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format (ITU-T T.81): the zigzag order, as row * 8 + column.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
RESTART = 4
AL = 1
#: Scans of a written image: components, first and last coefficient, high and low bit.
SCANS = [((0, 1, 2), 0, 0, 0, AL), *(((c,), 1, 5, 0, AL) for c in range(3)), *(((c,), 6, 63, 0, AL) for c in range(3)), ((0, 1, 2), 0, 0, AL, 0), *(((c,), 1, 63, AL, 0) for c in range(3))]


def _table_lengths() -> tuple[dict[int, int], dict[int, int]]:
    """Code lengths of the written tables. DC: 4 bits each. AC: 3 bits for sizes 1 to 7 without a run, 11 for all else."""
    ac = {s: 3 for s in range(1, 8)}
    ac |= {r << 4 | s: 11 for r in range(16) for s in range(11) if (r << 4 | s) not in ac}
    return {s: 4 for s in range(12)}, ac


def _canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The DHT body, and code and length by symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(1 for s in order if lengths[s] == n) for n in range(1, 17)]
    code, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    value, last = 0, 0
    for s in order:
        value = value << (lengths[s] - last) if last else 0
        last = lengths[s]
        code[s], size[s] = value, last
        value += 1
    return bytes(counts) + bytes(order), code, size


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


class _Bits:
    """Items (value, bits) of the intervals of one scan, in order."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, interval: np.ndarray, order: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        self.parts.append((interval, order, value.astype(np.uint64), bits.astype(np.int64)))

    def close(self, intervals: int, image: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Entropy-coded bytes of all images, with stuffing and restart markers, and where each begins. image: each interval's image."""
        interval, order, value, bits = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        if len(self.parts) > 1:
            at = np.argsort(order, kind="stable")  # a few ordered runs; intervals rise with the order
            interval, value, bits = interval[at], value[at], bits[at]
        total = np.bincount(interval, weights=bits, minlength=intervals).astype(np.int64)
        size = -(-total // 8)
        begin = np.cumsum(size) - size
        first = np.searchsorted(interval, np.arange(intervals))
        done = np.cumsum(bits) - bits
        p = begin[interval] * 8 + done - done[np.minimum(first, len(done) - 1)][interval]
        word, over = p >> 6, (p & 63) + bits - 64
        left = np.where(over > 0, value >> np.maximum(over, 0).astype(np.uint64), value << np.minimum(-over, 63).clip(0).astype(np.uint64))
        out = np.zeros(int(size.sum()) // 8 + 2, np.uint64)
        keep = bits > 0
        word_k, left_k = word[keep], left[keep]
        starts = np.flatnonzero(np.r_[True, word_k[1:] != word_k[:-1]]) if len(word_k) else np.zeros(0, int)
        if len(starts):
            out[word_k[starts]] = np.bitwise_or.reduceat(left_k, starts)
        spill = np.flatnonzero((over > 0) & keep)
        out[word[spill] + 1] |= value[spill] << (64 - over[spill]).astype(np.uint64)
        raw = out.byteswap().view(np.uint8)[: int(size.sum())].copy()
        pad = size * 8 - total
        last = begin + size - 1
        raw[last[size > 0]] |= ((1 << pad[size > 0]) - 1).astype(np.uint8)
        final = np.r_[image[1:] != image[:-1], True]
        number = np.arange(intervals) - np.flatnonzero(np.r_[True, image[1:] != image[:-1]])[np.cumsum(np.r_[0, image[1:] != image[:-1]])]
        marks = np.where(final, 0, 2)
        ff = raw == 255
        before = np.cumsum(ff) - ff
        shift = np.repeat(np.cumsum(marks) - marks, size)
        place = np.arange(len(raw)) + before + shift
        stuffed = np.zeros(len(raw) + int(ff.sum()) + int(marks.sum()), np.uint8)
        stuffed[place] = raw
        ends = np.cumsum(size) + np.r_[0, np.cumsum(ff)][np.cumsum(size)] + np.cumsum(marks) - marks
        mark = np.flatnonzero(~final)
        stuffed[ends[mark]] = 255
        stuffed[ends[mark] + 1] = 0xD0 + number[mark] % 8
        return stuffed.tobytes(), np.r_[0, (ends + marks)[final]]


_BITS = np.array([n.bit_length() for n in range(4096)])


def _size(x: np.ndarray) -> np.ndarray:
    """Bits of |x|, which is under 4,096."""
    return _BITS[np.abs(x)]


def _extra(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(x < 0, x + (1 << size) - 1, x)


class Writer:
    """Writes images of three components without subsampling from their coefficients in zigzag order."""

    def __init__(self) -> None:
        dc, ac = _table_lengths()
        self.dc_body, self.dc_code, self.dc_size = _canonical(dc)
        self.ac_body, self.ac_code, self.ac_size = _canonical(ac)

    def write(self, images: list[np.ndarray], wide: list[int], comments: list[bytes]) -> list[bytes]:
        """images: MCUs x 3 x 64 coefficients, each whole rows of `wide` MCUs. Coefficients are 8-bit samples' (-1023 .. 1023)."""
        n = np.array([len(x) for x in images])
        c = np.concatenate(images).astype(np.int32)
        per = -(-n // RESTART)
        image = np.repeat(np.arange(len(n)), per)
        in_image = np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)
        interval = np.repeat(np.cumsum(per) - per, n) + in_image // RESTART
        heads = [self._head(k, w, note) for k, w, note in zip(n.tolist(), wide, comments, strict=True)]
        parts: list[list[bytes]] = [[h] for h in heads]
        for comps, ss, se, ah, al in SCANS:
            bits = _Bits()
            if ss == 0 and ah == 0:
                self._dc_first(bits, c[:, :, 0] >> al, interval, in_image % RESTART == 0)
            elif ss == 0:
                bits.add(np.repeat(interval, 3), np.zeros(len(c) * 3), (c[:, :, 0] >> al).ravel() & 1, np.ones(len(c) * 3))
            elif ah == 0:
                self._ac_first(bits, c[:, comps[0], ss : se + 1], interval, al)
            else:
                self._ac_refine(bits, c[:, comps[0], ss : se + 1], interval, len(image), al)
            data, at = bits.close(len(image), image)
            head = _segment(0xDA, bytes([len(comps), *(x for k in comps for x in (k + 1, 0)), ss, se, ah << 4 | al]))
            for out, a, b in zip(parts, at[:-1].tolist(), at[1:].tolist(), strict=True):
                out += [head, data[a:b]]
        return [b"".join([*p, b"\xff\xd9"]) for p in parts]

    def _head(self, n: int, wide: int, note: bytes) -> bytes:
        frame = bytes([8]) + (8 * n // wide).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
        return b"\xff\xd8" + _segment(0xFE, note) + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC2, frame) + _segment(0xC4, bytes([0]) + self.dc_body + bytes([0x10]) + self.ac_body) + _segment(0xDD, RESTART.to_bytes(2, "big"))

    def _dc_first(self, bits: _Bits, dc: np.ndarray, interval: np.ndarray, begins: np.ndarray) -> None:
        before = np.zeros_like(dc)
        before[1:] = dc[:-1]
        before[begins] = 0
        diff = (dc - before).ravel()
        size = _size(diff)
        bits.add(np.repeat(interval, 3), np.zeros(len(diff)), self.dc_code[size] << size.astype(np.uint64) | _extra(diff, size).astype(np.uint64), self.dc_size[size] + size)

    def _ac_first(self, bits: _Bits, band: np.ndarray, interval: np.ndarray, al: int) -> None:
        v = np.sign(band) * (np.abs(band) >> al)
        block, k = np.nonzero(v)
        value = v[block, k]
        previous = np.r_[-1, k[:-1]]
        previous[np.r_[True, block[1:] != block[:-1]]] = -1 if len(block) else previous[:0]
        run = k - previous - 1 if len(block) else np.zeros(0, np.int64)
        size = _size(value)
        symbol = (run & 15) << 4 | size
        order = block * 256 + k * 4 + 3
        bits.add(interval[block], order, self.ac_code[symbol] << size.astype(np.uint64) | _extra(value, size).astype(np.uint64), self.ac_size[symbol] + size)
        for z in range(1, 4):  # runs of sixteen zeros
            far = np.flatnonzero(run >= 16 * z)
            if len(far):
                bits.add(interval[block[far]], order[far] - z, np.full(len(far), self.ac_code[0xF0]), np.full(len(far), self.ac_size[0xF0]))
        last = np.full(len(band), -1)
        last[block] = k
        open_ = np.flatnonzero(last < band.shape[1] - 1)
        if len(open_):
            bits.add(interval[open_], open_ * 256 + 255, np.full(len(open_), self.ac_code[0]), np.full(len(open_), self.ac_size[0]))

    def _ac_refine(self, bits: _Bits, band: np.ndarray, interval: np.ndarray, intervals: int, al: int) -> None:
        t = np.abs(band) >> al
        old, fresh = t > 1, t == 1
        mixed = np.bincount(interval, weights=fresh.any(1), minlength=intervals) > 0
        plain = np.flatnonzero(~mixed[interval])
        if len(plain):  # intervals in which no coefficient is new: one run of ended blocks, then their correction bits
            first = plain[np.r_[True, interval[plain][1:] != interval[plain][:-1]]]
            run = np.bincount(interval[plain], minlength=intervals)[interval[first]]
            n = _size(run) - 1
            bits.add(interval[first], first * 256, self.ac_code[n << 4] << n.astype(np.uint64) | (run - (1 << n)).astype(np.uint64), self.ac_size[n << 4] + n)
            rank = np.cumsum(old[plain], 1)
            count = rank[:, -1]
            value = np.where(old[plain], (t[plain] & 1) << np.where(old[plain], count[:, None] - rank, 0), 0).sum(1)
            bits.add(interval[plain], plain * 256 + 1, value, count)
        at = np.flatnonzero(mixed[interval])
        if not len(at):
            return
        t, old, fresh, neg = t[at], old[at], fresh[at], band[at] < 0
        width = t.shape[1]
        eob = np.where(fresh.any(1), width - 1 - fresh[:, ::-1].argmax(1), -1)
        run, held, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)

        def flush(which: np.ndarray, order: np.ndarray) -> None:
            bits.add(interval[at[which]], at[which] * 256 + order, held[which], count[which])
            held[which], count[which] = 0, 0

        for k in range(width):
            run[t[:, k] == 0] += 1
            for z in range(3):
                far = np.flatnonzero((t[:, k] > 0) & (run > 15) & (k <= eob))
                if not len(far):
                    break
                # a symbol and the bits held go in one item's place: up to 11 + 63 bits, so in two
                bits.add(interval[at[far]], at[far] * 256 + k * 4 + 0.1 * (2 * z), np.full(len(far), self.ac_code[0xF0]), np.full(len(far), self.ac_size[0xF0]))
                flush(far, k * 4 + 0.1 * (2 * z + 1))
                run[far] -= 16
            was = old[:, k]
            held[was] = held[was] << np.uint64(1) | (t[was, k] & 1).astype(np.uint64)
            count[was] += 1
            new = np.flatnonzero(fresh[:, k])
            if len(new):
                symbol = run[new] << 4 | 1
                bits.add(interval[at[new]], at[new] * 256 + k * 4 + 1, self.ac_code[symbol] << np.uint64(1) | (~neg[new, k]).astype(np.uint64), self.ac_size[symbol] + 1)
                flush(new, k * 4 + 2)
                run[new] = 0
        left = np.flatnonzero((run > 0) | (count > 0))
        if len(left):
            bits.add(interval[at[left]], at[left] * 256 + 254, np.full(len(left), self.ac_code[0]), np.full(len(left), self.ac_size[0]))
            flush(left, np.int64(255))


@dataclass
class Image:
    """A parsed file: sizes, components (id, h, v, quantisation), scans, comments, and its coefficients once read."""

    high: int = 0
    wide: int = 0
    comps: list[tuple[int, int, int, np.ndarray]] = field(default_factory=list)
    scans: list[tuple] = field(default_factory=list)  # (component indexes, ss, se, ah, al, tables, restart, begin, end)
    comments: list[bytes] = field(default_factory=list)
    base: list[int] = field(default_factory=list)  # first block of each component
    blocks: int = 0

    def grid(self, i: int) -> tuple[int, int]:
        """Rows and columns of component i's blocks, filled up to whole MCUs."""
        hm, vm = max(c[1] for c in self.comps), max(c[2] for c in self.comps)
        return -(-self.high // (8 * vm)) * self.comps[i][2], -(-self.wide // (8 * hm)) * self.comps[i][1]

    def order(self, comps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """Blocks in the order of a scan, each one's component index, and blocks in an MCU."""
        hm, vm = max(c[1] for c in self.comps), max(c[2] for c in self.comps)
        if len(comps) == 1:
            (i,) = comps
            rows, columns = -(-(-(-self.high * self.comps[i][2] // vm)) // 8), -(-(-(-self.wide * self.comps[i][1] // hm)) // 8)
            at = (np.arange(rows)[:, None] * self.grid(i)[1] + np.arange(columns)).ravel() + self.base[i]
            return at, np.full(len(at), i), 1
        parts, owner = [], []
        for i in comps:
            _, h, v, _ = self.comps[i]
            rows, columns = self.grid(i)
            g = (np.arange(rows)[:, None] * columns + np.arange(columns) + self.base[i]).reshape(rows // v, v, columns // h, h)
            parts.append(g.transpose(0, 2, 1, 3).reshape(-1, h * v))
            owner += [i] * (h * v)
        at = np.concatenate(parts, 1)
        return at.ravel(), np.tile(owner, len(at)), len(owner)


def _lookup(body: bytes) -> tuple[np.ndarray, bytes]:
    """Symbol << 8 | length for each 16 bits ahead (length 0: no code)."""
    n = sum(body[:16])
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = body[at] << 8 | length
            code, at = code + 1, at + 1
        code <<= 1
    return out, body[16 + n :]


def parse(data: bytes, markers: list[int] | None = None) -> Image:
    """Read all but the entropy-coded data. markers: places of FF and a byte that is neither 0 nor a restart's, if known."""
    out, quant, tables, restart, at = Image(), {}, {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    if markers is None:
        markers = find_markers(np.frombuffer(data, np.uint8)).tolist()
    while at < len(data) - 1:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        if kind == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xFE:
            out.comments.append(body)
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind in (0xC2, 0xC0, 0xC1):
            if kind != 0xC2 or body[0] != 8:
                raise ValueError("not progressive with 8-bit samples")
            out.high, out.wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            for i in range(len(out.comps)):
                out.base.append(out.blocks)
                rows, columns = out.grid(i)
                out.blocks += rows * columns
        elif kind == 0xDA:
            names = [c[0] for c in out.comps]
            comps = tuple(names.index(body[1 + 2 * i]) for i in range(body[0]))
            ss, se, a = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            own = tuple(tables.get(body[2 + 2 * i] >> 4 if ss == 0 else 0x10 | body[2 + 2 * i] & 15, b"") for i in range(body[0]))
            place = bisect_left(markers, at)
            end = markers[place] if place < len(markers) else len(data)
            out.scans.append((comps, ss, se, a >> 4, a & 15, own, restart, at, end))
            at = end
    out.comps = [(*c[:3], quant[c[3]]) for c in out.comps]
    return out


def find_markers(buf: np.ndarray) -> np.ndarray:
    ff = np.flatnonzero(buf[:-1] == 255)
    after = buf[ff + 1]
    return ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 255)]


class _Lanes:
    """Entropy-coded intervals without stuffing, ready to be read at any bit."""

    def __init__(self, pieces: list[bytes]):
        raw = np.frombuffer(b"".join(pieces) + bytes(16), np.uint8)
        size = np.array([len(p) for p in pieces], np.int64)
        piece = np.cumsum(size) - size
        pair = np.flatnonzero(raw[:-1] == 255)
        after = raw[pair + 1]
        inside = np.searchsorted(piece, pair, "right") == np.searchsorted(piece, pair + 1, "right")
        stuff = pair[(after == 0) & inside] + 1
        reset = pair[(after >= 0xD0) & (after <= 0xD7) & inside]
        gone = np.zeros(len(raw), bool)
        gone[stuff] = gone[reset] = gone[reset + 1] = True
        kept = np.cumsum(~gone) - ~gone
        self.begin = kept[np.sort(np.r_[piece, reset + 2])] * 8  # in bits
        self.lanes = 1 + np.bincount(np.searchsorted(piece, reset, "right") - 1, minlength=len(pieces))
        b = np.r_[raw[~gone], np.zeros(32, np.uint8)].tobytes()
        self.word = np.zeros((len(b) - 8) // 8 * 8, np.uint64)  # the eight bytes from each place on
        for i in range(8):
            self.word[i::8] = np.frombuffer(b, ">u8", len(self.word) // 8, i)

    def ahead(self, p: np.ndarray) -> np.ndarray:
        """The bits at p and after, from the top: 57 at least."""
        return self.word[np.minimum(p >> 3, len(self.word) - 1)] << (p & 7).astype(np.uint64)

    def take(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n (0 to 63) bits at p."""
        m = np.minimum(n, 32)
        high = _top(self.ahead(p), m)
        rest = n - m
        return np.where(rest > 0, high << rest | _top(self.ahead(p + m), rest), high)


def _top(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, word >> np.minimum(64 - n, 63).astype(np.uint64), 0).astype(np.int64)


def read_coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray, np.ndarray]:
    """Parsed images, their coefficients (blocks x 64, zigzag order, not dequantised), and each one's first block."""
    buf = np.frombuffer(b"".join(files), np.uint8)
    off = np.cumsum([0, *map(len, files)])
    marks = find_markers(buf) if len(buf) else np.zeros(0, np.int64)
    cut = np.searchsorted(marks, off)
    images = [parse(f, (marks[cut[i] : cut[i + 1]] - off[i]).tolist()) for i, f in enumerate(files)]
    first = np.cumsum([0, *(im.blocks for im in images)])
    coef = np.zeros((int(first[-1]), 64), np.int16)
    turn = [0] * len(images)
    while True:  # the scans that all images have next and that are alike go together
        waiting: dict[tuple, list[tuple[int, tuple]]] = {}
        for i, im in enumerate(images):
            mine, seen = None, set()
            while turn[i] < len(im.scans):
                s = im.scans[turn[i]]
                key = (s[1:5], s[5] if s[1] == 0 else s[5][0])
                if mine not in (None, key) or seen & set(s[0]):
                    break
                mine, seen = key, seen | set(s[0])
                waiting.setdefault(key, []).append((i, s))
                turn[i] += 1
        if not waiting:
            return images, coef, first
        for (band, tables), members in waiting.items():
            _scan(images, first, coef, band, tables if isinstance(tables, tuple) else (tables,), members, files)


def _scan(images: list[Image], first: np.ndarray, coef: np.ndarray, band: tuple, tables: tuple, members: list, files: list[bytes]) -> None:
    ss, se, ah, al = band
    lanes = _Lanes([files[i][s[7] : s[8]] for i, s in members])
    blocks, owners, per, known = [], [], [], {}
    for (i, s), n in zip(members, lanes.lanes.tolist(), strict=True):
        shape = (images[i].high, images[i].wide, s[0], *(c[1:3] for c in images[i].comps))
        if shape not in known:
            known[shape] = images[i].order(s[0])
        at, owner, unit = known[shape]
        blocks.append(at + first[i])
        owners.append(np.searchsorted(np.array(s[0]), owner) if len(s[0]) > 1 else np.zeros(len(at), np.int64))
        step = (s[6] or len(at)) * unit
        if n != max(1, -(-len(at) // step)):
            raise ValueError("restart markers do not fit the image")
        per += [min(step, len(at) - j * step) for j in range(n)]
    block, owner, n = np.concatenate(blocks), np.concatenate(owners), np.array(per, np.int64)
    base = np.cumsum(n) - n
    if ss == 0 and ah:
        lane = np.repeat(np.arange(len(n)), n)
        p = lanes.begin[lane] + np.arange(len(block)) - base[lane]
        coef[block, 0] |= (lanes.take(p, np.ones(len(p), np.int64)) << al).astype(np.int16)
    elif ss == 0:
        _dc_first(lanes, coef, block, owner, base, n, [_lookup(t)[0] for t in tables], al)
    elif ah == 0:
        _ac_first(lanes, coef, block, base, n, _lookup(tables[0])[0], ss, se, al)
    else:
        _ac_refine(lanes, coef, block, base, n, _lookup(tables[0])[0], ss, se, al)


def _value(word: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value of `size` bits after `skip` bits."""
    v = _top(word << skip.astype(np.uint64), size)
    return np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)


def _dc_first(lanes: _Lanes, coef: np.ndarray, block: np.ndarray, owner: np.ndarray, base: np.ndarray, n: np.ndarray, tables: list, al: int) -> None:
    look = np.stack(tables)
    p, last = lanes.begin.copy(), np.zeros((len(n), len(tables)), np.int64)
    for j in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > j)
        at = base[on] + j
        word = lanes.ahead(p[on])
        hit = look[owner[at], (word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, size = hit & 255, hit >> 8
        last[on, owner[at]] += _value(word, length, size)
        coef[block[at], 0] = last[on, owner[at]] << al
        p[on] += length + size


def _ac_first(lanes: _Lanes, coef: np.ndarray, block: np.ndarray, base: np.ndarray, n: np.ndarray, look: np.ndarray, ss: int, se: int, al: int) -> None:
    lane = np.flatnonzero(n > 0)
    p, at, end = lanes.begin[lane], base[lane].copy(), (base + n)[lane]
    k = np.full(len(lane), ss)
    flat = coef.reshape(-1)
    while len(p):
        word = lanes.ahead(p)
        hit = look[(word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, run, size = hit & 255, hit >> 12, (hit >> 8) & 15
        if not length.all():
            raise ValueError("no such code")
        ended = (size == 0) & (run < 15)
        bits = np.where(ended, run, size)
        raw = _top(word << length.astype(np.uint64), bits)
        k = k + run * ~ended
        put = size > 0
        if put.any():
            value = np.where(raw < (1 << np.maximum(size - 1, 0)), raw - (1 << size) + 1, raw)
            flat[(block[at] * 64 + k)[put]] = (np.sign(value) * (np.abs(value) << al))[put]
        k += 1
        p = p + length + bits
        over = ~ended & (k > se)
        at = at + np.where(ended, (1 << np.where(ended, run, 0)) + raw, over)
        k[ended | over] = ss
        on = at < end
        if not on.all():
            p, at, end, k = p[on], at[on], end[on], k[on]


def _ac_refine(lanes: _Lanes, coef: np.ndarray, block: np.ndarray, base: np.ndarray, n: np.ndarray, look: np.ndarray, ss: int, se: int, al: int) -> None:
    lane = np.flatnonzero(n > 0)
    p, at, end = lanes.begin[lane], base[lane].copy(), (base + n)[lane]
    k, skip = np.full(len(lane), ss), np.zeros(len(lane), np.int64)
    column = np.arange(64, dtype=np.int16)
    while len(p):
        word = lanes.ahead(p)
        hit = look[(word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        read = skip == 0
        length, run, size = np.where(read, hit & 255, 0), hit >> 12, (hit >> 8) & 15
        if not (hit[read] & 255).all():
            raise ValueError("no such code")
        ended = read & (size == 0) & (run < 15)
        bits = np.where(ended, run, np.where(read & (size > 0), 1, 0))
        raw = _top(word << length.astype(np.uint64), bits)
        skip = np.where(ended, (1 << np.where(ended, run, 0)) + raw, skip)
        p = p + length + bits
        row = coef[block[at]]
        old = row != 0
        inside = (column >= k[:, None]) & (column <= se)
        rest = skip > 0
        zeros = np.cumsum(~old & inside, 1, dtype=np.int8)
        reached = zeros == (run + 1)[:, None]
        target = np.where(rest | ~reached.any(1), se + 1, reached.argmax(1))
        fix = old & inside & (column < target[:, None])
        rank = np.cumsum(fix, 1, dtype=np.int64)
        count = rank[:, -1]
        got = lanes.take(p, count)
        add = fix & ((got[:, None] >> (count[:, None] - rank).clip(0)) & 1).astype(bool)
        row += (np.sign(row) * add.astype(np.int16)) << al
        fresh = np.flatnonzero(~rest & (size > 0) & (target <= se))
        row[fresh, target[fresh]] = np.where(raw[fresh] > 0, 1, -1) << al
        coef[block[at]] = row
        p = p + count
        k = target + 1
        done = rest | (k > se)
        skip = np.where(rest, skip - 1, skip)
        at = at + done
        k[done] = ss
        on = at < end
        if not on.all():
            p, at, end, k, skip = p[on], at[on], end[on], k[on], skip[on]


def _basis() -> np.ndarray:
    """64 coefficients (zigzag) x 64 samples of the inverse transform."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(u == 0, np.sqrt(0.5), 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG]


def samples(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Blocks x 64 samples 0 to 255. Halves round up, whatever the order in which a machine adds."""
    out = (coef.astype(np.float64) * quant) @ _basis()
    return np.clip(np.floor(out + (128.5 + 1e-6)), 0, 255).astype(np.uint8)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """... x 3 colours of full-range YCbCr."""
    y, cb, cr = y.astype(np.float64), cb.astype(np.float64) - 128, cr.astype(np.float64) - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb], -1)
    return np.clip(np.floor(rgb + (0.5 + 1e-6)), 0, 255).astype(np.uint8)


def tensor(image: Image, coef: np.ndarray) -> np.ndarray:
    """Height x width x 3 of one image; chroma is upsampled by repetition. One component gives grey."""
    hm, vm = max(c[1] for c in image.comps), max(c[2] for c in image.comps)
    planes = []
    for i, (_, h, v, quant) in enumerate(image.comps):
        rows, columns = image.grid(i)
        x = samples(coef[image.base[i] : image.base[i] + rows * columns], quant).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        planes.append(x[np.arange(image.high) * v // vm][:, np.arange(image.wide) * h // hm])
    return np.repeat(planes[0][..., None], 3, -1) if len(planes) < 3 else to_rgb(*planes[:3])
