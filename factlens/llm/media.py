"""Media columns: progressive JPEG.

`decode` is a decoder for Huffman-coded JPEG, progressive and baseline: scans of a spectral band with successive
approximation accumulate into coefficient arrays, which are dequantised, inverse-transformed in numpy, chroma is
upsampled, and the result is a full-resolution RGB tensor.

`pack` stores bytes losslessly in a progressive JPEG: a byte b is the quantised coefficient b + 256, 64 to a block and
three blocks (4:4:4) to a unit of 192 bytes. Every coefficient is sent in two steps, high bits (Al=1) and then the last
bit (Ah=1, Al=0), with DC scans (a restart interval of one unit makes each independent) and AC scans by component. All
first-scan codes then have one length, and refinement is one code and raw bits, so both sides work on whole arrays. The
decoder takes that path only where a scan's tables and length prove it, and reads bit by bit elsewhere.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.llm.store import ship

#: Fixed by the format: the zigzag order as (row, column) of each coefficient.
_ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
_RASTER = np.array([r * 8 + c for r, c in _ZIGZAG])

_K = np.arange(8)
_DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), np.sqrt(2 / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))
#: 64 coefficients in zigzag order -> 64 samples in raster order.
_INVERSE = np.kron(_DCT, _DCT)[_RASTER].astype(np.float32)

UNIT = 192
_MAX_ROWS = 8191


class JpegError(ValueError):
    """Not a JPEG that this decoder reads."""


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    blocks_w: int = 0  # padded to whole units
    blocks_h: int = 0
    own_w: int = 0  # what a scan of this component alone has
    own_h: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Picture:
    width: int
    height: int
    progressive: bool
    components: list[Component]
    quant: dict[int, np.ndarray]
    comments: list[bytes]


# ---- reading -----------------------------------------------------------------------------------------------------


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code = i = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[(length, code)] = symbols[i]
                code, i = code + 1, i + 1
            code <<= 1
        self.symbols = {1 << length | code: s for (length, code), s in self.codes.items()}
        self.only = (next(iter(self.codes.items()))) if len(self.codes) == 1 else None


#: Pictures of one source have the same few tables; they are only read.
_huffman = lru_cache(256)(_Huffman)


class _Bits:
    def __init__(self, data: np.ndarray):
        self.bits, self.at = np.unpackbits(data).tolist(), 0

    def one(self) -> int:
        if self.at >= len(self.bits):
            raise JpegError("a scan ends early")
        self.at += 1
        return self.bits[self.at - 1]

    def many(self, n: int) -> int:
        out, at = 0, self.at
        self.at = at + n
        if self.at > len(self.bits):
            raise JpegError("a scan ends early")
        for bit in self.bits[at : self.at]:
            out = out << 1 | bit
        return out

    def symbol(self, table: _Huffman) -> int:
        code, at, symbols = 1, self.at, table.symbols
        for bit in self.bits[at : at + 16]:
            code = code << 1 | bit
            if code in symbols:
                self.at = at + code.bit_length() - 1
                return symbols[code]
        raise JpegError("no such code" if at + 16 <= len(self.bits) else "a scan ends early")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        v = self.many(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _entropy(data: bytes, at: int) -> tuple[list[np.ndarray], int]:
    """The scan's data from `at`, without stuffing, cut at restart marks; and where the next marker is."""
    end, restarts = at, False
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            raise JpegError("a scan without an end")
        if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
            restarts |= data[end + 1] != 0
            end += 2
            continue
        break
    if not restarts:
        return [np.frombuffer(data[at:end].replace(b"\xff\x00", b"\xff"), np.uint8)], end
    raw = np.frombuffer(data, np.uint8, end - at, at)
    mark = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0)) if len(raw) > 1 else np.empty(0, int)
    stuffed = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] == 0)) + 1 if len(raw) > 1 else np.empty(0, int)
    keep = np.ones(len(raw), bool)
    keep[stuffed] = keep[mark] = keep[mark + 1] = False
    cuts = np.cumsum(keep)[mark]
    return np.split(raw[keep], cuts), end


def decode_coefficients(data: bytes) -> Picture:
    """All scans accumulated; coefficients in zigzag order, one row a block."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at, picture, quant, comments, restart = 2, None, {}, [], 0
    tables: dict[tuple[int, int], _Huffman] = {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError("no marker where one is due")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[name] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[(body[0] >> 4, body[0] & 15)] = _huffman(bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            comments.append(bytes(body))
        elif kind in (0xC0, 0xC1, 0xC2):
            if body[0] != 8:
                raise JpegError("only 8-bit samples")
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            hm, vm = max(c.h for c in parts), max(c.v for c in parts)
            uw, uh = -(-w // (8 * hm)), -(-h // (8 * vm))
            for c in parts:
                c.blocks_w, c.blocks_h = uw * c.h, uh * c.v
                c.own_w, c.own_h = -(-(-(-w * c.h // hm)) // 8), -(-(-(-h * c.v // vm)) // 8)
                c.coef = np.zeros((c.blocks_w * c.blocks_h, 64), np.int32)
            picture = Picture(w, h, kind == 0xC2, parts, quant, comments)
        elif kind == 0xDA:
            if picture is None:
                raise JpegError("a scan before its frame")
            n = body[0]
            by_id = {c.id: c for c in picture.components}
            scan = [(by_id[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            start, stop, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            if not picture.progressive:
                start, stop, high, low = 0, 63, 0, 0
            pieces, at = _entropy(data, at)
            _scan(picture, scan, tables, start, stop, high, low, restart, pieces)
        elif kind in (0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise JpegError("this coding isn't read")
    if picture is None:
        raise JpegError("no frame")
    return picture


def _places(scan) -> list[list[tuple[int, int]]]:
    """For each unit of the scan its blocks: which of the scan's components, row in coef."""
    if len(scan) == 1:
        c = scan[0][0]
        return [[(0, y * c.blocks_w + x)] for y in range(c.own_h) for x in range(c.own_w)]
    c0 = scan[0][0]
    uw, uh = c0.blocks_w // c0.h, c0.blocks_h // c0.v
    return [
        [(i, (uy * c.v + y) * c.blocks_w + ux * c.h + x) for i, (c, _, _) in enumerate(scan) for y in range(c.v) for x in range(c.h)]
        for uy in range(uh)
        for ux in range(uw)
    ]


_SMALL_PLACES: dict[tuple, list[list[tuple[int, int]]]] = {}


def _units(scan) -> list[list[tuple[int, int]]]:
    """_places, kept for some small shapes."""
    shape = tuple((c.h, c.v, c.blocks_w, c.blocks_h, c.own_w, c.own_h) for c, _, _ in scan)
    found = _SMALL_PLACES.get(shape)
    if found is None:
        found = _places(scan)
        if sum(w * h for _, _, w, h, _, _ in shape) <= 256 and len(_SMALL_PLACES) < 256:
            _SMALL_PLACES[shape] = found
    return found


def _scan(picture, scan, tables, start, stop, high, low, restart, pieces) -> None:
    if _scan_at_once(picture, scan, tables, start, stop, high, low, restart, pieces):
        return
    units = _units(scan)
    step = restart or len(units)
    if len(pieces) < -(-len(units) // step):
        raise JpegError("fewer restarts than due")
    for i, piece in zip(range(0, len(units), step), pieces, strict=False):
        bits, eobrun, last = _Bits(piece), 0, {c.id: 0 for c, _, _ in scan}
        for unit in units[i : i + step]:
            for part, row in unit:
                if eobrun and not high:  # nothing of a first scan's block in an end-of-band run is coded
                    eobrun -= 1
                    continue
                c, dc, ac = scan[part]
                block = c.coef[row]
                if not picture.progressive:
                    last[c.id] += bits.signed(bits.symbol(tables[(0, dc)]))
                    block[0] = last[c.id]
                    _ac_first(bits, tables[(1, ac)], block, 1, 63, 0, 0)
                elif start == 0:
                    if high:
                        block[0] |= bits.one() << low
                    else:
                        last[c.id] += bits.signed(bits.symbol(tables[(0, dc)]))
                        block[0] = last[c.id] << low
                elif high:
                    eobrun = _ac_refined(bits, tables[(1, ac)], block, start, stop, low, eobrun)
                else:
                    eobrun = _ac_first(bits, tables[(1, ac)], block, start, stop, low, eobrun)


def _ac_first(bits, table, block, start, stop, low, eobrun) -> int:
    """New coefficients of a band: runs of zeros, sizes and values; blocks of an end-of-band run have none."""
    if eobrun:
        return eobrun - 1
    k = start
    while k <= stop:
        run, size = divmod(bits.symbol(table), 16)
        if size:
            k += run
            if k > stop:
                raise JpegError("a run leaves its band")
            block[k] = bits.signed(size) << low
            k += 1
        elif run == 15:
            k += 16
        else:
            return (1 << run) - 1 + (bits.many(run) if run else 0)
    return 0


def _ac_refined(bits, table, block, start, stop, low, eobrun) -> int:
    """One bit more for known coefficients, in passing; new ones have magnitude 1 in that bit."""
    one = 1 << low

    def correct(k):
        if bits.one() and not abs(block[k]) & one:
            block[k] += one if block[k] > 0 else -one

    k = start
    if not eobrun:
        while k <= stop:
            run, size = divmod(bits.symbol(table), 16)
            new = 0
            if size:
                new = one if bits.one() else -one
            elif run < 15:
                eobrun = (1 << run) + (bits.many(run) if run else 0)
                break
            while k <= stop:
                if block[k]:
                    correct(k)
                elif run == 0:
                    if new:
                        block[k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
    if eobrun:
        while k <= stop:
            if block[k]:
                correct(k)
            k += 1
        eobrun -= 1
    return eobrun


def _scan_at_once(picture, scan, tables, start, stop, high, low, restart, pieces) -> bool:
    """Scans whose every code has one known length, on whole arrays; False where that isn't so."""
    if not picture.progressive or any(c.h != 1 or c.v != 1 for c in picture.components):
        return False
    n = scan[0][0].blocks_w * scan[0][0].blocks_h
    if start == 0 and not high:
        only = [tables[(0, dc)].only for _, dc, _ in scan]
        if restart != 1 or any(o is None or o[0][0] != 1 or o[1] == 0 for o in only) or len({o[1] for o in only}) > 1:
            return False
        width, size = only[0][1] + 1, -(-(only[0][1] + 1) * len(scan) // 8)
        if len(pieces) != n or any(len(p) != size for p in pieces):
            return False
        rows = np.unpackbits(np.concatenate(pieces).reshape(n, size), axis=1)[:, : width * len(scan)].reshape(n, len(scan), width)
        if rows[:, :, 0].any():
            return False
        values = _signed(rows[:, :, 1:])
        for i, (c, _, _) in enumerate(scan):
            c.coef[:, 0] = values[:, i] << low
        return True
    if restart or len(pieces) != 1:
        return False
    if start == 0:
        if len(pieces[0]) * 8 < n * len(scan):
            return False
        bits = np.unpackbits(pieces[0], count=n * len(scan)).reshape(n, len(scan))
        for i, (c, _, _) in enumerate(scan):
            c.coef[:, 0] |= bits[:, i].astype(np.int32) << low
        return True
    c, _, ac = scan[0]
    only, band = tables[(1, ac)].only, stop - start + 1
    if only is None or only[0][0] != 1 and not high:
        return False
    if not high:
        size = only[1]
        if not 0 < size < 16 or len(pieces[0]) != -(-n * band * (size + 1) // 8):
            return False
        rows = np.unpackbits(pieces[0], count=n * band * (size + 1)).reshape(n, band, size + 1)
        if rows[:, :, 0].any():
            return False
        c.coef[:, start : stop + 1] = _signed(rows[:, :, 1:]) << low
        return True
    # refinement of a band without zeros: one run to the end of the band in all blocks, then their bits
    run, size = divmod(only[1], 16)
    head = only[0][0] + run
    if size or run == 15 or not c.coef[:, start : stop + 1].all() or len(pieces[0]) != -(-(head + n * band) // 8):
        return False
    bits = np.unpackbits(pieces[0], count=head + n * band)
    if (1 << run) + int("0" + "".join(map(str, bits[only[0][0] : head].tolist())), 2) != n:
        return False
    step = bits[head:].reshape(n, band).astype(np.int32) << low
    known = c.coef[:, start : stop + 1]
    c.coef[:, start : stop + 1] = known + np.where(known > 0, step, -step)
    return True


def _signed(bits: np.ndarray) -> np.ndarray:
    """Values of the last axis, most significant bit first; those that begin with 0 are negative."""
    n = bits.shape[-1]
    v = np.zeros(bits.shape[:-1], np.int32)
    for i in range(n):
        v = v << 1 | bits[..., i]
    return np.where(bits[..., 0] == 1, v, v - (1 << n) + 1)


def samples(picture: Picture, c: Component) -> np.ndarray:
    """A component's plane of 8-bit samples, padded to whole blocks."""
    return _planes(picture, c, [c.coef])[0]


def _planes(picture: Picture, c: Component, coefs: list[np.ndarray]) -> np.ndarray:
    """The component's planes in pictures of one shape, from their blocks."""
    table = picture.quant.get(c.table)
    if table is None:
        raise JpegError("no quantisation table")
    coef = np.concatenate(coefs)
    out = np.empty((len(coef), 64), np.uint8)
    for i in range(0, len(coef), 4096):
        part = (coef[i : i + 4096] * table[None, :]).astype(np.float32) @ _INVERSE
        out[i : i + 4096] = np.clip(np.rint(part) + 128, 0, 255)
    return out.reshape(len(coefs), c.blocks_h, c.blocks_w, 8, 8).swapaxes(2, 3).reshape(len(coefs), c.blocks_h * 8, c.blocks_w * 8)


def _shape(picture: Picture) -> tuple:
    """What pictures must share to be brought to RGB together."""
    tables = [picture.quant.get(c.table) for c in picture.components]
    parts = [(c.h, c.v, c.blocks_w, c.blocks_h, None if t is None else t.tobytes()) for c, t in zip(picture.components, tables, strict=True)]
    return picture.width, picture.height, *parts


def to_rgb(picture: Picture) -> np.ndarray:
    """Height x width x 3; chroma is repeated up to full resolution, grey is copied to all three."""
    return _rgb_of([picture])[0]


def _rgb_of(pictures: list[Picture]) -> np.ndarray:
    """to_rgb of pictures of one shape, on whole arrays."""
    picture = pictures[0]
    hm, vm = max(c.h for c in picture.components), max(c.v for c in picture.components)
    planes = []
    for i, c in enumerate(picture.components):
        p = _planes(picture, c, [x.components[i].coef for x in pictures])
        if hm % c.h or vm % c.v:
            raise JpegError("fractional subsampling")
        p = p.repeat(vm // c.v, axis=1).repeat(hm // c.h, axis=2)
        planes.append(p[:, : picture.height, : picture.width])
    if len(planes) == 1:
        return np.stack(planes * 3, axis=-1)
    if len(planes) != 3:
        raise JpegError("one or three components")
    y, cb, cr = (p.astype(np.float32) for p in planes)
    rgb = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    return to_rgb(decode_coefficients(data))


# ---- writing -----------------------------------------------------------------------------------------------------


def segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def scan_header(parts: list[tuple[int, int, int]], start: int, stop: int, high: int, low: int) -> bytes:
    """parts: component, DC table, AC table."""
    return segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c, dc << 4 | ac]) for c, dc, ac in parts) + bytes([start, stop, high << 4 | low]))


def huffman_segment(kind: int, name: int, lengths: list[int], symbols: list[int]) -> bytes:
    return segment(0xC4, bytes([kind << 4 | name, *lengths, *symbols]))


def frame(kind: int, width: int, height: int, parts: list[tuple[int, int, int, int]]) -> bytes:
    """parts: id, horizontal and vertical sampling, quantisation table."""
    size = height.to_bytes(2, "big") + width.to_bytes(2, "big")
    return segment(kind, b"\x08" + size + bytes([len(parts)]) + b"".join(bytes([i, h << 4 | v, q]) for i, h, v, q in parts))


def stuffed(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes, padded with ones."""
    pad = -len(bits) % 8
    return np.packbits(np.r_[bits, np.ones(pad, np.uint8)] if pad else bits).tobytes().replace(b"\xff", b"\xff\x00")


_ONE_CODE = [1] + [0] * 15
_FLAT = segment(0xDB, b"\x00" + b"\x01" * 64)


def pack(payload: bytes) -> bytes:
    """A payload of whole units as a progressive JPEG; blocks beyond it (to fill the rectangle) hold spaces."""
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError(f"a payload has a positive multiple of {UNIT} bytes")
    wide = -(-units // _MAX_ROWS)
    high = -(-units // wide)
    n = wide * high
    v = np.frombuffer(payload + b" " * (UNIT * (n - units)), np.uint8).reshape(n, 3, 64)
    top, last = v >> 1 | 0x80, v & 1  # (b + 256) >> 1 has 8 bits and starts with one
    out = [b"\xff\xd8", segment(0xFE, b"units=%d" % units), _FLAT, frame(0xC2, wide * 8, high * 8, [(i, 1, 1, 0) for i in (1, 2, 3)])]
    out.append(huffman_segment(0, 0, _ONE_CODE, [8]) + huffman_segment(1, 0, _ONE_CODE, [8]))

    # DC, high bits: restart after each unit, so that every difference is the value itself
    bits = np.zeros((n, 3, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(top[:, :, 0, None], axis=2)
    rows = np.packbits(np.concatenate([bits.reshape(n, 27), np.ones((n, 5), np.uint8)], axis=1), axis=1)
    marked = np.empty((n, 10), np.uint8)
    put = np.zeros((n, 10), bool)
    marked[:, 0:8:2], marked[:, 1:8:2], put[:, 0:8:2], put[:, 1:8:2] = rows, 0, True, rows == 0xFF
    marked[:, 8], marked[:, 9] = 0xFF, 0xD0 + np.arange(n) % 8
    put[:-1, 8:] = True
    out += [segment(0xDD, b"\x00\x01"), scan_header([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0, 0, 0, 1), marked[put].tobytes(), segment(0xDD, b"\x00\x00")]
    # DC, last bit
    out += [scan_header([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0, 0, 1, 0), stuffed(np.ascontiguousarray(last[:, :, 0]).ravel())]
    # AC, high bits by component: code 0, then 8 bits
    for c in range(3):
        bits = np.zeros((n, 63, 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits(np.ascontiguousarray(top[:, c, 1:])[:, :, None], axis=2)
        out += [scan_header([(c + 1, 0, 0)], 1, 63, 0, 1), stuffed(bits.ravel())]
    # AC, last bit by component: end-of-band runs over all blocks, each with the bits of its blocks
    runs = [min(32767, n - i) for i in range(0, n, 32767)]
    kinds = sorted({r.bit_length() - 1 for r in runs})
    out.append(huffman_segment(1, 0, _ONE_CODE if len(kinds) == 1 else [0, len(kinds)] + [0] * 14, [k << 4 for k in kinds]))
    for c in range(3):
        parts, at = [], 0
        for r in runs:
            k = r.bit_length() - 1
            code = [0] if len(kinds) == 1 else [kinds.index(k) >> 1, kinds.index(k) & 1]
            extra = [int(x) for x in f"{r - (1 << k):0{k}b}"] if k else []
            parts += [np.array(code + extra, np.uint8), np.ascontiguousarray(last[at : at + r, c, 1:]).ravel()]
            at += r
        out += [scan_header([(c + 1, 0, 0)], 1, 63, 1, 0), stuffed(np.concatenate(parts))]
    return b"".join([*out, b"\xff\xd9"])


def unpack(picture: Picture) -> bytes:
    """The payload of a picture that pack() made."""
    units = next((int(c[6:]) for c in picture.comments if c.startswith(b"units=")), None)
    if units is None:
        raise JpegError("not a packed payload")
    v = np.stack([c.coef for c in picture.components], axis=1) - 256
    return v.astype(np.uint8).tobytes()[: units * UNIT]


def flat_picture(luma: list[int], blue: list[int], red: list[int]) -> bytes:
    """A progressive JPEG of flat blocks with chroma at half size both ways (4:2:0): units of 16 x 16 pixels side by side.

    luma has four values a unit (upper left, upper right, lower left, lower right), blue and red one, all less 128 and
    from -127 to 127. DC comes in two steps of successive approximation, then a spectral scan of luma without any AC.
    """
    units = len(blue)
    order = [(c, v) for u in range(units) for c, v in [*((0, v) for v in luma[4 * u : 4 * u + 4]), (1, blue[u]), (2, red[u])]]
    first, before = [], [0, 0, 0]
    for c, v in order:
        step, before[c] = (v >> 1) - before[c], v >> 1
        size = abs(step).bit_length()
        first.append(f"{size:04b}" + (f"{step if step > 0 else step + (1 << size) - 1:0{size}b}" if size else ""))
    run = 4 * units
    power = run.bit_length() - 1
    empty = "0" + (f"{run - (1 << power):0{power}b}" if power else "")
    bits = lambda text: stuffed(np.frombuffer(text.encode(), np.uint8) - ord("0"))
    every = [(c, 0, 0) for c in (1, 2, 3)]
    parts = [
        b"\xff\xd8", segment(0xDB, b"\x00" + b"\x08" * 64), frame(0xC2, 16 * units, 16, [(1, 2, 2, 0), (2, 1, 1, 0), (3, 1, 1, 0)]),
        huffman_segment(0, 0, [0, 0, 0, 9] + [0] * 12, list(range(9))), huffman_segment(1, 0, _ONE_CODE, [power << 4]),
        scan_header(every, 0, 0, 0, 1), bits("".join(first)), scan_header(every, 0, 0, 1, 0), bits("".join(str(v & 1) for _, v in order)),
        scan_header([(1, 0, 0)], 1, 63, 0, 0), bits(empty), b"\xff\xd9",
    ]
    return b"".join(parts)


def features(rgb: np.ndarray) -> str:
    """Size, channel means in 1/1000, and the share (in 1/1000) of pixels whose red, green and blue are over 127."""
    h, w, _ = rgb.shape
    flat = rgb.reshape(-1, 3)
    total, over = flat.sum(axis=0, dtype=np.int64), (flat > 127).sum(axis=0)
    n = h * w
    return f"{w}x{h};mean={','.join(str(int(x) * 1000 // n) for x in total)};over={','.join(str(int(x) * 1000 // n) for x in over)}"


# ---- Spark -------------------------------------------------------------------------------------------------------


def _batches(rows, most: int = 16 << 20):
    """Record batches of (doc_id, n_bytes, media) rows, cut at about `most` bytes of media."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= most or len(held) >= 2000:
            yield _packed_batch(held)
            held, size = [], 0
    if held:
        yield _packed_batch(held)


def _packed_batch(rows):
    ids, n, media = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _packed(batches):
    def rows():
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                yield i.as_py(), len(raw), pack(raw + b" " * ((-len(raw) % UNIT) if raw else UNIT))

    yield from _batches(rows())


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with spaces to whole units, in a progressive JPEG.

    Null counts as empty; an empty text is one unit of spaces. Equal texts give equal media, repeated rows equal rows;
    other columns are left out; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packed, "doc_id long, n_bytes long, media binary")


def _read(batches):
    for b in batches:
        rows = []
        for m in b.column(2):
            data = m.as_py()
            picture = decode_coefficients(data)
            payload = unpack(picture)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(to_rgb(picture))))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def read_texts(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media -> payloads read back as digests, digests of the media, and features of the RGB tensor."""
    return stored.mapInArrow(
        _read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def _flat(batches):
    for b in batches:
        media = [flat_picture(*row) for row in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], ["id", "media"])


def flat_pictures(rows: DataFrame) -> DataFrame:
    """rows(id, luma, blue, red) -> id, media: see flat_picture."""
    ship(rows.sparkSession)
    planes = [F.col(c).cast("array<int>").alias(c) for c in ("luma", "blue", "red")]
    return rows.select(F.col("id").cast("long").alias("id"), *planes).mapInArrow(_flat, "id long, media binary")


#: Pixels that wait for others of their picture's shape.
_AT_ONCE = 1 << 20


def _tensors(batches):
    for b in batches:
        rows, waiting, held = [(None, None, None)] * b.num_rows, defaultdict(list), 0

        def settle(rows=rows, waiting=waiting):
            for same in waiting.values():
                try:
                    found = _rgb_of([p for _, p in same])
                except JpegError:
                    continue
                for (i, _), rgb in zip(same, found, strict=True):
                    rows[i] = (rgb.shape[0], rgb.shape[1], rgb.tobytes())
            waiting.clear()

        for i, m in enumerate(b.column(1)):
            if not m.is_valid:
                continue
            try:
                picture = decode_coefficients(m.as_py())
            except (JpegError, KeyError, IndexError):
                continue
            waiting[_shape(picture)].append((i, picture))
            held += picture.width * picture.height
            if held >= _AT_ONCE:
                settle()
                held = 0
        settle()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True))], ["id", "height", "width", "rgb"]
        )


def decode_media(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """id, height, width, rgb (height * width * 3 bytes): full-resolution tensors of JPEG bytes, progressive or baseline.

    Null or unreadable media give nulls; repeated rows give equal rows; other columns are left out.
    """
    ship(media.sparkSession)
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    return rows.mapInArrow(_tensors, "id long, height int, width int, rgb binary")
