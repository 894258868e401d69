"""Media columns: progressive JPEG, read and written in numpy.

Reading accumulates the scans of a progressive stream (spectral selection and successive approximation, restart intervals, any sampling
factors) into one coefficient array per component, inverse-transforms the arrays as matrix products, upsamples chroma and gives a
full-resolution RGB tensor. Scans whose codes have one length, and refinement of coefficients that are already known, are read with array
operations; everything else by the bit-by-bit reader, and both give the same arrays.

A payload of bytes is stored losslessly in the format's own unit, the quantised coefficient: a byte becomes one coefficient of size category 8
(128 to 255 as they are, 0 to 127 as negative values), 192 bytes fill a unit of three 8x8 blocks. The scans are: DC of all components with one
bit left out and a restart after each unit, the DC bit, per component the low and the high band with one bit left out, per component that
bit. At category 7 with a one-bit code the first scans hold seven bits of each byte at a place of its own, so both directions are array
operations and a stored stream has about 1.13 bytes for each payload byte.

Defined cases: null text is the empty text, whose payload is 192 spaces; a payload that does not fill the last row of blocks is padded with
spaces and its length kept in a comment; streams that are not progressive, or end early, raise ValueError; repeated rows and extra columns are no
special case.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomdex.llm.common import blobs, map_batches, slices

UNIT = 192
COLUMNS, MOST_ROWS = 64, 8191
BANDS = ((1, 5), (6, 63))


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Natural (row-major) position of each zigzag index: along anti-diagonals, their direction alternating."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


@lru_cache(maxsize=1)
def inverse_dct() -> np.ndarray:
    """64x64 matrix from natural-order coefficients to samples of a block."""
    k, x = np.mgrid[0:8, 0:8]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), np.sqrt(2 / 8))
    return np.kron(basis, basis).astype(np.float32)


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: bytes, length: int) -> bytes:
    """A Huffman table whose codes all have one length."""
    return _segment(0xC4, bytes([kind]) + bytes(len(symbols) if n + 1 == length else 0 for n in range(16)) + symbols)


def _scan(components: list[int], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([first, last, high << 4 | low]))


def _stuff(bits: np.ndarray) -> bytes:
    """Bits as bytes, padded with ones, a zero byte after each 0xFF."""
    data = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)]))
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def store(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload``, whose length is a positive multiple of ``UNIT``."""
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError("a payload fills whole units")
    down = min(MOST_ROWS, -(-units // COLUMNS))
    across = -(-units // down)
    total = across * down
    data = np.frombuffer(payload.ljust(total * UNIT), np.uint8).reshape(total, 3, 64)
    low = data & 1
    correction = np.where(data >= 128, low, 1 - low)  # the last bit of the magnitude
    out = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, down * 8, across * 8, 3) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(3))))
    out += [_table(0x00, b"\x07", 1), _table(0x10, b"\x07", 1), _segment(0xDD, b"\0\1"), _scan([0, 1, 2], 0, 0, 0, 1)]
    dc = np.empty((total, 5), np.uint8)
    dc[:, :3] = data[:, :, 0] >> 1
    dc[:, 3], dc[:, 4] = 0xFF, 0xD0 + np.arange(total) % 8
    out += [dc.tobytes()[:-2], _segment(0xDD, b"\0\0"), _scan([0, 1, 2], 0, 0, 1, 0), _stuff(low[:, :, 0].ravel())]
    for c in range(3):
        for a, b in BANDS:
            out += [_scan([c], a, b, 0, 1), (data[:, c, a : b + 1] >> 1).tobytes()]
    out.append(_table(0x10, bytes(n << 4 for n in range(15)), 4))
    for c in range(3):
        bits = []
        for at in range(0, total, 32767):
            run = min(32767, total - at)
            n = run.bit_length() - 1
            head = np.array([int(x) for x in f"{n:04b}" + (f"{run - (1 << n):0{n}b}" if n else "")], np.uint8)
            bits += [head, correction[at : at + run, c, 1:].ravel()]
        out += [_scan([c], 1, 63, 1, 0), _stuff(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


# ---------------------------------------------------------------- reading


class _Bits:
    """Bits of one entropy-coded segment, without stuffing."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n]:
            value = value << 1 | b
        if self.at + n > len(self.bits):
            raise ValueError("the stream ends early")
        self.at += n
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := codes.get((n, code))) is not None:
                return found
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for n, k in enumerate(counts, 1):
        for s in symbols[at : at + k]:
            out[n, code] = s
            code += 1
        at += k
        code <<= 1
    return out


class Component:
    def __init__(self, ident: int, h: int, v: int, q: int):
        self.ident, self.h, self.v, self.q = ident, h, v, q


class Image:
    """A progressive stream's coefficients (zigzag order, one array per component) and what its header says."""

    def __init__(self, stream: bytes, arrays: bool = True):
        if stream[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG stream")
        self.comment, self.quantisers, self.tables, self.restart, self.arrays = b"", {}, {}, 0, arrays
        self.components: list[Component] = []
        at, ended = 2, False
        while not ended:
            if at + 2 > len(stream) or stream[at] != 0xFF:
                raise ValueError("the stream ends early")
            marker = stream[at + 1]
            if marker == 0xD9:
                ended = True
                continue
            if marker == 0xFF:
                at += 1
                continue
            size = int.from_bytes(stream[at + 2 : at + 4])
            body, at = stream[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = int.from_bytes(body)
            elif marker == 0xC2:
                self._frame(body)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a progressive stream")
            elif marker == 0xDA:
                end = at
                while True:
                    end = stream.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(stream):
                        raise ValueError("the stream ends early")
                    if stream[end + 1] == 0 or 0xD0 <= stream[end + 1] <= 0xD7:
                        end = self._next(stream, end)
                        continue
                    break
                self._scan(body, stream[at:end])
                at = end

    @staticmethod
    def _next(stream: bytes, at: int) -> int:
        """The next 0xFF that can end a scan; runs of restart markers at one stride are passed with array operations."""
        if stream[at + 1] and stream[at + 5 : at + 6] == b"\xff":
            data = np.frombuffer(stream, np.uint8, offset=at)
            rows = data[: len(data) // 5 * 5].reshape(-1, 5)
            other = np.flatnonzero((rows[:, 0] != 0xFF) | (rows[:, 1] < 0xD0) | (rows[:, 1] > 0xD7) | (rows[:, 2:] == 0xFF).any(1))
            return at + 5 * int(other[0] if len(other) else len(rows) - 1) if (len(other) == 0 or other[0] > 0) else at + 2
        return at + 2

    def _quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, k = body[at] >> 4, body[at] & 15
            self.quantisers[k] = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.int32)
            at += 129 if wide else 65

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.tables[body[at]] = _codes(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8 or not self.height or not self.width:
            raise ValueError("8-bit samples and a size are expected")
        self.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.blocks_across, c.blocks_down = self.across * c.h, self.down * c.v
            c.own_across, c.own_down = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)
            c.data = np.zeros((c.blocks_down * c.blocks_across, 64), np.int32)

    def _order(self, chosen: list[Component]) -> list[tuple[Component, np.ndarray]]:
        """For each block of a unit, its component and its place in every unit of the scan."""
        if len(chosen) == 1:
            c = chosen[0]
            r, k = np.divmod(np.arange(c.own_across * c.own_down), c.own_across)
            return [(c, r * c.blocks_across + k)]
        r, k = np.divmod(np.arange(self.across * self.down), self.across)
        return [(c, (r * c.v + y) * c.blocks_across + k * c.h + x) for c in chosen for y in range(c.v) for x in range(c.h)]

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        by_ident = {c.ident: c for c in self.components}
        chosen = [by_ident[body[1 + 2 * k]] for k in range(n)]
        select = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(n)}
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        order = self._order(chosen)
        tables = [self.tables.get((select[c.ident] >> 4) if not first else 0x10 | select[c.ident] & 15, {}) for c, _ in order]
        if self.arrays and self._whole(order, tables, data, first, last, high, low):
            return
        units = len(order[0][1])
        step = self.restart or units
        parts, at = [], 0
        while at < len(data):  # cut at restart markers
            end = data.find(b"\xff", at)
            while end >= 0 and end + 1 < len(data) and not 0xD0 <= data[end + 1] <= 0xD7:
                end = data.find(b"\xff", end + 2)
            end = len(data) if end < 0 else end
            parts.append(data[at:end].replace(b"\xff\x00", b"\xff"))
            at = end + 2
        if len(parts) < -(-units // step) and not (high and not first):
            raise ValueError("the stream ends early")
        for k, part in enumerate(parts):
            span = range(k * step, min(units, (k + 1) * step))
            bits = _Bits(part)
            if not first:
                self._dc(order, tables, bits, span, high, low)
            elif not high:
                self._ac(order[0], tables[0], bits, span, first, last, low)
            else:
                self._ac_again(order[0], tables[0], bits, span, first, last, low)

    def _whole(self, order, tables, data: bytes, first: int, last: int, high: int, low: int) -> bool:
        """Read a scan with array operations where its layout allows; False leaves it to the bit reader."""
        units = len(order[0][1])
        if high and not first:
            if self.restart:
                return False
            bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
            if len(bits) < units * len(order):
                raise ValueError("the stream ends early")
            for k, (c, at) in enumerate(order):
                c.data[at, 0] |= bits[k : units * len(order) : len(order)].astype(np.int32) << low
            return True
        if not high:
            size = next(iter(tables[0].values()), 0)
            if size != 7 or any(t != {(1, 0): 7} for t in tables):  # one code of one bit: 0 and seven bits are a byte
                return False
            raw = np.frombuffer(data, np.uint8)
            if not first:
                n = len(order)
                if self.restart != 1 or len(raw) != units * (n + 2) - 2:
                    return False
                rows = np.concatenate([raw, np.array([0xFF, 0xD0 + (units - 1) % 8], np.uint8)]).reshape(units, n + 2)
                if (rows[:, :n] > 127).any() or (rows[:, n] != 0xFF).any() or (rows[:, n + 1] != 0xD0 + np.arange(units) % 8).any():
                    return False
                groups = [(c, at, rows[:, k].astype(np.int32)) for k, (c, at) in enumerate(order)]
                if len({id(c) for c, *_ in groups}) < n:
                    return False
                for c, at, v in groups:
                    c.data[at, 0] = np.where(v >= 64, v, v - 127) << low
                return True
            wide = last - first + 1
            if self.restart or len(raw) != units * wide or (len(raw) and raw.max() > 127):
                return False
            v = raw.reshape(units, wide).astype(np.int32)
            c, at = order[0]
            c.data[at, first : last + 1] = np.where(v >= 64, v, v - 127) << low
            return True
        if self.restart:
            return False
        c, at = order[0]
        known = c.data[at, first : last + 1]
        flat = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        counts = np.concatenate([[0], np.cumsum((known != 0).sum(1))])
        place, block, fixes = 0, 0, []
        while block < units:  # only runs of blocks without a new coefficient
            code = 0
            for n in range(1, 17):
                if place >= len(flat):
                    return False
                code, place = code << 1 | int(flat[place]), place + 1
                if (n, code) in tables[0]:
                    break
            s = tables[0].get((n, code), 255)
            if s & 15 or s >> 4 == 15:
                return False
            run = (1 << (s >> 4)) + int("".join(map(str, flat[place : place + (s >> 4)])) or "0", 2)
            place += s >> 4
            stop = min(units, block + run)
            fixes.append(flat[place : place + counts[stop] - counts[block]])
            place, block = place + int(counts[stop] - counts[block]), stop
        bits = np.concatenate(fixes) if fixes else flat[:0]
        if len(bits) != counts[-1]:
            raise ValueError("the stream ends early")
        new = known.copy()
        mask = known != 0
        new[mask] += np.sign(known[mask]) * (bits.astype(np.int32) << low)
        c.data[at, first : last + 1] = new
        return True

    def _dc(self, order, tables, bits: _Bits, span: range, high: int, low: int) -> None:
        last = {c.ident: 0 for c, _ in order}
        for unit in span:
            for (c, at), table in zip(order, tables, strict=True):
                if high:
                    c.data[at[unit], 0] |= bits.take(1) << low
                else:
                    last[c.ident] += bits.signed(bits.symbol(table))
                    c.data[at[unit], 0] = last[c.ident] << low

    def _ac(self, own, table, bits: _Bits, span: range, first: int, last: int, low: int) -> None:
        c, at = own
        skip = 0
        for unit in span:
            if skip:
                skip -= 1
                continue
            k = first
            while k <= last:
                run, size = divmod(bits.symbol(table), 16)
                if size:
                    k += run
                    c.data[at[unit], k] = bits.signed(size) << low if size else 0
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    skip = (1 << run) + bits.take(run) - 1
                    break

    def _ac_again(self, own, table, bits: _Bits, span: range, first: int, last: int, low: int) -> None:
        c, at = own
        one, skip = 1 << low, 0

        def correct(row, k):
            if bits.take(1) and not abs(row[k]) & one:
                row[k] += one if row[k] > 0 else -one

        for unit in span:
            row, k = c.data[at[unit]], first
            while k <= last and not skip:
                run, size = divmod(bits.symbol(table), 16)
                value = 0
                if size:
                    value = one if bits.take(1) else -one
                elif run < 15:
                    skip = (1 << run) + bits.take(run)
                    break
                while k <= last:
                    if row[k]:
                        correct(row, k)
                    elif run:
                        run -= 1
                    else:
                        row[k] = value
                        k += 1
                        break
                    k += 1
            if skip:
                for j in range(k, last + 1):
                    if row[j]:
                        correct(row, j)
                skip -= 1

    def planes(self) -> list[np.ndarray]:
        """Each component's samples at its own resolution, float32."""
        out, natural = [], zigzag()
        for c in self.components:
            scaled = np.zeros(c.data.shape, np.float32)
            scaled[:, natural] = c.data * self.quantisers[c.q]
            blocks = (scaled @ inverse_dct()).reshape(c.blocks_down, c.blocks_across, 8, 8)
            out.append(blocks.swapaxes(1, 2).reshape(c.blocks_down * 8, c.blocks_across * 8) + np.float32(128))
        return out

    def rgb(self) -> np.ndarray:
        """height x width x 3, 8-bit; chroma is upsampled by repetition. One component is grey."""
        full = []
        for c, p in zip(self.components, self.planes(), strict=True):
            up = p.repeat(self.v // c.v, axis=0) if c.v < self.v else p
            up = up.repeat(self.h // c.h, axis=1) if c.h < self.h else up
            full.append(up[: self.height, : self.width])
        if len(full) == 1:
            colours = [full[0]] * 3
        else:
            y, cb, cr = full[0], full[1] - 128, full[2] - 128
            colours = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
        out = np.empty((self.height, self.width, 3), np.uint8)
        for k, x in enumerate(colours):
            out[:, :, k] = np.clip(np.rint(x), 0, 255)
        return out

    def payload(self) -> bytes:
        """The bytes that ``store`` was given."""
        if not self.comment.startswith(b"payload="):
            raise ValueError("the stream holds no payload")
        values = np.stack([c.data for c in self.components], axis=1)
        data = np.where(values >= 0, values, values + 255).astype(np.uint8)
        data[:, :, 0] = np.where(values[:, :, 0] >= 0, values[:, :, 0], values[:, :, 0] + 254)
        return data.tobytes()[: int(self.comment[8:])]


def features(rgb: np.ndarray) -> str:
    """Size, and each channel's mean and spread in thousandths, from exact sums."""
    n = rgb.shape[0] * rgb.shape[1]
    flat = rgb.reshape(n, 3)
    said = []
    for k in range(3):
        count = np.bincount(flat[:, k], minlength=256)
        s, q = int((count * np.arange(256)).sum()), int((count * np.arange(256) ** 2).sum())
        said.append(f"{s * 1000 // n}/{(q * n - s * s) * 1000 // (n * n)}")
    return f"{rgb.shape[1]}x{rgb.shape[0]} " + " ".join(said)


def decode(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows with height, width and the full-resolution RGB tensor (row-major bytes) of each stream; null stays null."""
    extra = [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())]
    schema = T.StructType([*media.schema.fields, *extra])

    def run(batches):
        for b in batches:
            found = [None if s is None else Image(s).rgb() for s in b.column(column).to_pylist()]
            sizes = [pa.array([None if x is None else x.shape[k] for x in found], pa.int32()) for k in (0, 1)]
            columns = [*b.columns, *sizes, pa.array([None if x is None else x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "height", "width", "rgb"])

    return map_batches(media, run, schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """Store every text as media, read it back and describe it; see the columns of the schema."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(text: bytes) -> tuple:
        media = store(text.ljust(max(1, -(-len(text) // UNIT)) * UNIT))
        image = Image(media)
        back = image.payload()
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(image.rgb())

    def run(batches):
        for b in slices(batches, "text"):
            rows = [row(t) for t in blobs(b.column("text"))]
            columns = [b.column("doc_id").cast(pa.int64())] + [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return map_batches(docs.select("doc_id", "text"), run, schema)
