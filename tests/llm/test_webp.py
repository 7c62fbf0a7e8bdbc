import base64
import hashlib
import zlib

import numpy as np
import pytest

from quaverlake.llm import webp as W
from quaverlake.llm.shared import table

RNG = np.random.default_rng(0)


def test_known_file():
    """The one-pixel file that browsers are commonly probed with."""
    assert W.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).shape == (1, 1)


def test_neighbours():
    assert len(W.NEIGHBOURS) == len(set(W.NEIGHBOURS)) == 120
    near = [x * x + y * y for x, y in W.NEIGHBOURS]
    assert near == sorted(near)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200, 4096, 70001])
@pytest.mark.parametrize("values", [1, 2, 3, 60, 128, 129, 256])
def test_flat_round_trip(n, values):
    raw = bytes(RNG.integers(0, values, n, dtype=np.uint8))
    payload = raw.ljust(max(64, -(-n // 64) * 64), b"\0")
    assert W.loaded(W.stored(payload), len(payload)) == payload


def test_wide_image():
    payload = bytes(RNG.integers(0, 200, 64 * (W.SIDE + 3), dtype=np.uint8))
    assert W.to_image(payload).shape == (8194, 32) and W.loaded(W.stored(payload), len(payload)) == payload


def make_images():
    yield RNG.integers(0, 1 << 32, (7, 5), dtype=np.uint32)
    yield RNG.choice(RNG.integers(0, 1 << 32, 5, dtype=np.uint32), (20, 33))
    smooth = (np.add.outer(np.arange(19), np.arange(23)) * 3 % 256).astype(np.uint32)
    yield smooth * np.uint32(0x01010101)
    yield np.full((3, 40), 0x12345678, np.uint32)
    yield RNG.integers(0, 1 << 32, (1, 1), dtype=np.uint32)
    yield RNG.integers(0, 1 << 32, (9, 1), dtype=np.uint32)


IMAGES = list(make_images())


@pytest.mark.parametrize("image", IMAGES, ids=range(6))
@pytest.mark.parametrize("cache,back", [(0, False), (0, True), (1, False), (6, True), (11, True)])
def test_back_references_and_cache(image, cache, back):
    assert (W.decode(W.encode_rich(image, [], cache, back)) == image).all()


def own(image, block, values):
    h, w = image.shape
    return RNG.choice(np.array(values, np.uint32), ((h + (1 << block) - 1) >> block) * ((w + (1 << block) - 1) >> block))


@pytest.mark.parametrize("image", IMAGES, ids=range(6))
def test_each_predictor(image):
    for mode in range(14):
        assert (W.decode(W.encode_rich(image, [(W.PREDICTOR, 2, own(image, 2, [mode << 8 | 0xFF000000]))])) == image).all(), mode
    mixed = own(image, 2, [m << 8 | 0xFF000000 for m in range(14)])
    assert (W.decode(W.encode_rich(image, [(W.PREDICTOR, 2, mixed)])) == image).all()


@pytest.mark.parametrize("image", IMAGES, ids=range(6))
def test_transforms_together(image):
    cross = own(image, 3, RNG.integers(0, 1 << 24, 6) | 0xFF000000)
    modes = own(image, 4, [m << 8 | 0xFF000000 for m in (1, 5, 11, 13)])
    for chain in ([(W.GREEN,)], [(W.CROSS, 3, cross)], [(W.PREDICTOR, 4, modes), (W.CROSS, 3, cross), (W.GREEN,)], [(W.GREEN,), (W.PREDICTOR, 4, modes)]):
        assert (W.decode(W.encode_rich(image, chain, 4)) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    image = RNG.choice(RNG.integers(0, 1 << 32, colours, dtype=np.uint32), (11, 13))
    assert (W.decode(W.encode_rich(image, [(W.PALETTE,)], 0, True)) == image).all()


def test_predictors_by_hand():
    l, t, r, c = (np.array([[a] * 4]) for a in (10, 200, 30, 100))
    want = {1: 10, 2: 200, 3: 30, 4: 100, 5: (20 + 200) // 2, 6: 55, 7: 105, 8: 150, 9: 115, 10: (55 + 115) // 2, 11: 200 if abs(200 - 100) * 4 >= 0 and 4 * 100 >= 4 * 90 and not 4 * 100 < 4 * 90 else 10, 12: 110, 13: 107}
    for mode, value in want.items():
        assert W.PREDICTORS[mode](l, t, r, c)[0, 0] == value, mode


def test_damaged_streams_are_refused():
    good = W.stored(b"some text ".ljust(64, b"\0"))
    for bad in (good[:30], b"RIFX" + good[4:], good[:20] + b"\0" + good[21:]):
        with pytest.raises(ValueError):
            W.decode(bad)


def test_query_on_table(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in W.op6_lossless_webp(spark, d).collect()}
    rows = table(spark, d, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert g.feature == W.feature(payload) and g.media_bytes < 2 * len(payload) + 200


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, 3), (None, "", 4), (2, "é", 5)], "doc_id long, text string, media int")
    got = W.inspect_media(W.store_texts(df)).collect()
    assert [r.payload_bytes for r in got] == [64] * 3 and got[0].media == got[1].media
    assert W.inspect_media(W.store_texts(df.limit(0))).collect() == []


def plain_reader(data: bytes) -> tuple[bytes, dict]:
    """The grey samples of a stored file, read bit by bit as the format's specification tells, and what the stream made use of."""
    bits, at, seen = [b >> k & 1 for b in data[20:] for k in range(8)], 0, {"copies": 0}

    def number(n):
        nonlocal at
        at += n
        return sum(b << k for k, b in enumerate(bits[at - n : at]))

    def book(lengths):
        """{(length, code): symbol} with codes counted up from the shortest."""
        out, code = {}, 0
        for length in range(1, 16):
            for symbol, x in enumerate(lengths):
                if x == length:
                    out[length, code] = symbol
                    code += 1
            code <<= 1
        return {(0, 0): next(iter(out.values()))} if len(out) == 1 else out

    def symbol(codes):
        length = code = 0
        while (length, code) not in codes:
            length, code = length + 1, code << 1 | number(1)
        return codes[length, code]

    def read_book(alphabet):
        if number(1):
            two, wide = number(1), number(1)
            used = [number(8 if wide else 1), *([number(8)] if two else [])]
            return book([int(k in used) for k in range(256)])
        own = dict.fromkeys(range(19), 0)
        for k in [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15][: 4 + number(4)]:
            own[k] = number(3)
        assert number(1) == 0
        codes, lengths, last = book([own[k] for k in range(19)]), [], 8
        while len(lengths) < alphabet:
            x = symbol(codes)
            if x < 16:
                lengths.append(x)
                last = x or last
            else:
                lengths += [last] * (3 + number(2)) if x == 16 else [0] * (3 + number(3) if x == 17 else 11 + number(7))
        assert len(lengths) == alphabet
        return book(lengths)

    def value(prefix):
        return prefix + 1 if prefix < 4 else ((2 + prefix % 2) << (prefix - 2) // 2) + number((prefix - 2) // 2) + 1

    def image(width, height, main):
        assert number(2 if main else 1) == 0
        books, out = [read_book(a) for a in (280, 256, 256, 256, 40)], []
        while len(out) < width * height:
            s = symbol(books[0])
            if s < 256:
                red, blue, alpha = (symbol(b) for b in books[1:4])
                out.append((alpha, red, s, blue))
                continue
            seen["copies"] += 1
            n, code = value(s - 256), value(symbol(books[4]))
            x, y = W.NEIGHBOURS[code - 1] if code <= 120 else (code - 120, 0)
            for _ in range(n):
                out.append(out[-max(1, x + y * width)])
        return out

    assert number(8) == 0x2F
    width, height, _, version = number(14) + 1, number(14) + 1, number(1), number(3)
    assert version == 0 and [number(1), number(2), number(1), number(2)] == [1, 2, 1, 3]
    colours = number(8) + 1
    palette, pixel = [], (0, 0, 0, 0)
    for step in image(colours, 1, False):
        pixel = tuple((a + b) & 255 for a, b in zip(pixel, step, strict=True))
        palette.append(pixel)
    assert number(1) == 0
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    packed = (width + (1 << pack) - 1) >> pack
    index = [p[2] for p in image(packed, height, True)]
    out = []
    for row in range(height):
        for x in range(width):
            cell = index[row * packed + (x >> pack)] >> ((x & ((1 << pack) - 1)) * (8 >> pack))
            alpha, red, green, blue = palette[cell & ((1 << (8 >> pack)) - 1) if pack else cell]
            assert (alpha, (red + green) & 255, (blue + green) & 255) == (255, green, green)
            out.append(green)
    return bytes(out), seen


@pytest.mark.parametrize("segment", [1 << 20, 256])
def test_stored_files_by_a_plain_reader(monkeypatch, segment):
    monkeypatch.setattr(W, "SEGMENT", segment)
    monkeypatch.setattr(W, "WINDOW", 64 if segment == 256 else 1 << 14)
    texts = ["", "a", "ab" * 300, "the cat and the dog and the bird sat on the mat; " * 20 + "end", "Größe ça 漢字 " * 40, "".join(map(chr, range(32, 255))) * 3, bytes(RNG.integers(97, 110, 3000, dtype=np.uint8)).decode()]
    copies = 0
    for text in texts:
        raw = text.encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = W.stored(payload)
        samples, seen = plain_reader(media)
        assert samples[: len(payload)] == payload == W.loaded(media, len(payload)) and len(samples) == len(payload)
        copies += seen["copies"]
    assert copies > 5


def test_large_payloads_have_four_samples_a_pixel(monkeypatch):
    monkeypatch.setattr(W, "MOST_GREY", 128)
    payload = bytes(RNG.integers(0, 50, 64 * 9, dtype=np.uint8))
    media = W.stored(payload)
    assert W.decode(media).shape == (9, 16) and W.loaded(media, len(payload)) == payload
