import hashlib
import random
import zlib

import numpy as np
import pytest

from loomdex.llm import progressive_jpeg as pj


class Writer:
    """A plain progressive encoder with eight-bit codes: any coefficients, sampling factors and restart intervals."""

    symbols = bytes(range(255))

    def __init__(self, coefficients, factors, width, height, restart=0):
        self.c, self.f, self.w, self.h, self.restart = coefficients, factors, width, height, restart

    def stream(self, bands=((1, 10), (11, 63)), bits=2):
        n = len(self.c)
        out = [b"\xff\xd8", pj._segment(0xDB, b"\0" + bytes([3]) * 64)]
        out.append(pj._segment(0xC2, bytes([8]) + self.h.to_bytes(2) + self.w.to_bytes(2) + bytes([n]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(self.f))))
        out += [pj._table(0x00, self.symbols, 8), pj._table(0x10, self.symbols, 8), pj._segment(0xDD, self.restart.to_bytes(2))]
        dc = [(0, bits)] + [(b + 1, b) for b in reversed(range(bits))]
        for high, low in dc:
            out += [pj._scan(list(range(n)), 0, 0, high, low), self.dc(high, low)]
        for k in range(n):
            for a, b in bands:
                for high, low in dc:
                    out += [pj._scan([k], a, b, high, low), self.ac(k, a, b, high, low)]
        return b"".join(out) + b"\xff\xd9"

    def frame(self):
        image = pj.Image.__new__(pj.Image)
        image._frame(bytes([8]) + self.h.to_bytes(2) + self.w.to_bytes(2) + bytes([len(self.c)]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(self.f)))
        return image

    def parts(self, units, emit):
        out, step = [], self.restart or units
        for k, at in enumerate(range(0, units, step)):
            bits = []
            emit(range(at, min(units, at + step)), bits)
            out.append((b"" if not k else bytes([0xFF, 0xD0 + (k - 1) % 8])) + pj._stuff(np.array([int(x) for x in "".join(bits)], np.uint8)))
        return b"".join(out)

    @staticmethod
    def value(v):
        s = abs(v).bit_length()
        return s, f"{v if v > 0 else v + (1 << s) - 1:0{s}b}" if s else ""

    def dc(self, high, low):
        order = self.frame()._order(self.frame().components)
        data = {i + 1: c for i, c in enumerate(self.c)}

        def emit(span, bits):
            last = dict.fromkeys(data, 0)
            for u in span:
                for comp, at in order:
                    v = int(data[comp.ident][at[u], 0]) >> low
                    if high:
                        bits.append(str(v & 1))
                    else:
                        s, b = self.value(v - last[comp.ident])
                        bits.append(f"{s:08b}" + b)
                        last[comp.ident] = v

        return self.parts(len(order[0][1]), emit)

    def ac(self, k, a, b, high, low):
        frame = self.frame()
        ((comp, at),) = frame._order([frame.components[k]])

        def emit(span, bits):
            for u in span:
                row = self.c[k][at[u]]
                now = [int(np.sign(v)) * (abs(int(v)) >> low) for v in row]
                run, fixes = 0, []
                old = (lambda v: abs(v) >> 1) if high else (lambda v: 0)
                fresh = [j for j in range(a, b + 1) if now[j] and not old(now[j])]
                for j in range(a, b + 1):
                    v = now[j]
                    if old(v):
                        fixes.append(str(abs(v) & 1))
                    elif v:
                        s, x = (1, "1" if v > 0 else "0") if high else self.value(v)
                        bits += [f"{run << 4 | s:08b}", x, *fixes]
                        run, fixes = 0, []
                    else:
                        run += 1
                        if run == 16 and any(f > j for f in fresh):
                            bits += [f"{0xF0:08b}", *fixes]
                            run, fixes = 0, []
                if run or fixes:
                    bits += ["0" * 8, *fixes]

        return self.parts(len(at), emit)


@pytest.mark.parametrize(("factors", "restart"), [([(1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2), ([(1, 1)] * 3, 1)])
def test_any_progressive_stream(factors, restart):
    rng = np.random.default_rng(len(factors) + restart)
    width, height = 37, 21
    shell = Writer([None] * len(factors), factors, width, height).frame()
    coefficients = []
    for c in shell.components:
        x = rng.integers(-40, 41, c.data.shape) * (rng.random(c.data.shape) < 0.15)
        if c.data.shape[0] != c.own_across * c.own_down:  # blocks beyond the component's own have no scan but DC
            own = (np.arange(c.own_down)[:, None] * c.blocks_across + np.arange(c.own_across)).ravel()
            mask = np.ones(len(x), bool)
            mask[own] = False
            x[mask, 1:] = 0
        coefficients.append(x.astype(np.int32))
    stream = Writer(coefficients, factors, width, height, restart).stream()
    for arrays in (True, False):
        image = pj.Image(stream, arrays)
        assert all((a.data == b).all() for a, b in zip(image.components, coefficients, strict=True))
    rgb = image.rgb()
    assert rgb.shape == (height, width, 3)
    c, k = image.components[0], np.zeros((8, 8))
    k.flat[pj.zigzag()] = coefficients[0][0] * 3
    u, x = np.mgrid[0:8, 0:8]
    basis = np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    assert np.abs(image.planes()[0][:8, :8] - (basis.T @ k @ basis + 128)).max() < 1e-2


def test_zigzag():
    assert pj.zigzag()[:12].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25] and sorted(pj.zigzag()) == list(range(64))


@pytest.mark.parametrize("units", [1, 2, 63, 64, 65, 129, 700])
def test_payload_round_trip(units):
    payload = random.Random(units).randbytes(192 * units)
    media = pj.store(payload)
    image = pj.Image(media)
    assert image.payload() == payload
    if units < 100:
        slow = pj.Image(media, arrays=False)
        assert slow.payload() == payload and (slow.rgb() == image.rgb()).all()


def test_long_runs_of_blocks():
    payload = bytes(range(256)) * 192 * 130  # more blocks than one end-of-band run can say
    assert pj.Image(pj.store(payload)).payload() == payload


def test_bad_streams():
    media = pj.store(b"x" * 192)
    for bad in (b"", b"abc", media[:40], media[:-30], media.replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises(ValueError):
            pj.Image(bad)
    with pytest.raises(ValueError):
        pj.store(b"")


def test_frames(spark, docs_of):
    rows = [(1, "Hëllo", "en", "a"), (2, None, "en", None), (3, "", "en", "a"), (4, "Hëllo", "en", "a"), (4, "Hëllo", "en", "a"), (5, "x" * 192, "en", "a"), (6, "long 😀 " * 30000, "en", "a"), (None, "n", "en", "a")]
    got = pj.store_texts(docs_of(rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        data = text.encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = pj.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert texts.setdefault(text, r.feature) == r.feature
    assert pj.store_texts(docs_of([])).count() == 0
    media = spark.createDataFrame([(1, bytearray(pj.store(b"abc".ljust(192)))), (2, None)], "id int, media binary")
    out = {r.id: r for r in pj.decode(media).collect()}
    assert (out[1].height, out[1].width, len(out[1].rgb)) == (8, 8, 192) and out[2].rgb is None
