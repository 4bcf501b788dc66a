import numpy as np
import pytest

from tailrace.llm import webp

GREEN, CROSS, PRED, PAL = webp.SUBTRACT_GREEN, webp.CROSS_COLOUR, webp.PREDICTOR, webp.PALETTE


def picture(width, height, colours=None, seed=0):
    r = np.random.default_rng(seed)
    x = r.integers(0, 1 << 32, width * height, dtype=np.uint64).astype(np.uint32)
    if colours:
        x = r.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)[r.integers(0, colours, width * height)]
    x[: len(x) // 3] = np.resize(x[:7], len(x) // 3)  # something to refer back to
    return x


@pytest.mark.parametrize("transforms", [(), (GREEN,), (CROSS,), (PRED,), (PRED, CROSS, GREEN), (CROSS, PRED)])
@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
@pytest.mark.parametrize("width,height", [(1, 1), (1, 9), (17, 5), (33, 12)])
def test_round_trip(transforms, cache_bits, width, height):
    for references in (False, True):
        x = picture(width, height)
        w, h, got = webp.decode(webp.encode(x, width, transforms, cache_bits, references))
        assert (w, h) == (width, height) and (got == x).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 256])
def test_palette(colours):
    x = picture(21, 13, colours)
    for transforms in ((PAL,), (PAL, PRED)):
        assert (webp.decode(webp.encode(x, 21, transforms, 3))[2] == x).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    x = picture(9, 11, seed=mode)
    assert (webp.decode(webp.encode(x, 9, (PRED,), mode=mode))[2] == x).all()


def test_meta_codes():
    w = webp.Writer()
    webp.head(w, 8, 4, False)
    w.write(0, 1)
    w.write(0, 1)
    w.write(1, 1)
    w.write(0, 3)  # blocks of 4 by 4: two of them
    webp.write_pixels(w, [0xFF000000, 0xFF000100], 2)
    for green in (10, 200):
        for symbol in (green, 1, 2, 255, 0):
            webp.write_single(w, symbol)
    _, _, x = webp.decode(webp.riff(w.bytes()))
    assert x.reshape(4, 8)[:, :4].tolist() == [[0xFF010A02] * 4] * 4 and x.reshape(4, 8)[:, 4:].tolist() == [[0xFF01C802] * 4] * 4


def test_fixed_bytes():
    """Streams written down by hand from the format's public description, not by the encoder here."""

    def image(fields):
        value = at = 0
        for x, n in fields:
            value |= x << at
            at += n
        return webp.riff(value.to_bytes((at + 7) // 8, "little"))

    size = [(0x2F, 8), (3, 14), (1, 14), (0, 1), (0, 3)]  # 4 by 2, opaque
    single = lambda s: [(1, 1), (0, 1), (1, 1), (s, 8)]
    two = lambda a, b: [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]
    # greens 5 and 9 (bits 0 and 1), red 1, blue 2: literals alone
    plain = image([*size, (0, 1), (0, 1), (0, 1), *two(5, 9), *single(1), *single(2), *single(255), *single(0), *((b, 1) for b in (0, 1, 1, 0, 1, 0, 0, 1))])
    assert [x >> 8 & 255 for x in webp.decode(plain)[2]] == [5, 9, 9, 5, 9, 5, 5, 9] and {int(x) & 0xFFFF00FF for x in webp.decode(plain)[2]} == {0xFF010002}
    # subtract green: red and blue come back as 1 + green and 2 + green
    green = image([*size, (1, 1), (2, 2), (0, 1), (0, 1), (0, 1), *two(5, 9), *single(1), *single(2), *single(255), *single(0), *((b, 1) for b in (0, 1, 1, 0, 1, 0, 0, 1))])
    assert [int(x) for x in webp.decode(green)[2][:2]] == [0xFF060507, 0xFF0A090B]
    # the predictor "left" for the one block: differences add up along the first row, the first column looks up
    left = image([*size, (1, 1), (0, 2), (0, 3), (0, 1), *single(1), *single(0), *single(0), *single(255), *single(0), (0, 1), (0, 1), (0, 1), *two(1, 3), *single(0), *single(0), *single(0), *single(0), *((b, 1) for b in (0, 1, 0, 0, 1, 0, 0, 1))])
    assert [x >> 8 & 255 for x in webp.decode(left)[2]] == [1, 4, 5, 6, 4, 5, 6, 9] and {int(x) >> 24 for x in webp.decode(left)[2]} == {255}
    # a palette of two colours, eight indices to a pixel: colours are stored as differences
    pair = image([*size, (1, 1), (3, 2), (1, 8), (0, 1), *two(7, 20), *single(0), *single(0), *two(0, 255), *single(0), (0, 1), (1, 1), (1, 1), (0, 1), (0, 1), (0, 1), (0, 1), *two(0b0110, 0b1001), *single(0), *single(0), *single(255), *single(0), (0, 1), (1, 1)])
    assert [x >> 8 & 255 for x in webp.decode(pair)[2]] == [7, 27, 27, 7, 27, 7, 7, 27]
    # green 5 and the length symbol 256 + 2 (three pixels) have one bit each; distance symbol 1 is code 2, the pixel before
    table = webp.PrefixCode(np.array([1 if i in (5, 258) else 0 for i in range(280)]))
    w = webp.Writer()
    webp.head(w, 4, 2, False)
    for x, n in ((0, 1), (0, 1), (0, 1)):
        w.write(x, n)
    assert webp.write_code(w, np.array([1 if i in (5, 258) else 0 for i in range(280)])).both.tolist() == table.both.tolist()
    for x, n in [*single(1), *single(2), *single(255), *single(1), (0, 1), (1, 1), (1, 1), (0, 1)]:
        w.write(x, n)
    assert {int(x) for x in webp.decode(webp.riff(w.bytes()))[2]} == {0xFF010502}


@pytest.mark.parametrize("zeros", [1, 2, 3, 10, 11, 137, 138, 139, 140, 141, 149, 276, 278])
def test_runs_of_zeros_in_code_lengths(zeros):
    counts = np.array([5, *[0] * zeros, 3, 2, 9, *[0] * (290 - zeros), 1])
    w = webp.Writer()
    code = webp.write_code(w, counts)
    again = webp.read_code(webp.Reader(w.bytes()), len(counts))
    assert (again.n == code.n).all() and (again.both == code.both).all()


def test_colour_cache_by_hand():
    w = webp.Writer()
    webp.head(w, 3, 1, False)
    for x, n in ((0, 1), (1, 1), (1, 4), (0, 1)):  # a cache of two places
        w.write(x, n)
    slot = (0xFF010502 * 0x1E35A7BD & 0xFFFFFFFF) >> 31
    webp.write_code(w, np.array([1 if i in (5, 280 + slot) else 0 for i in range(282)]))
    for symbol in (1, 2, 255, 0):
        webp.write_single(w, symbol)
    for bit in (0, 1, 1):
        w.write(bit, 1)
    assert [int(x) for x in webp.decode(webp.riff(w.bytes()))[2]] == [0xFF010502] * 3


@pytest.mark.parametrize("stretch", [8, 64, 1 << 18])
@pytest.mark.parametrize("cache_bits", [0, 4])
def test_arrays_equal_symbol_by_symbol(monkeypatch, cache_bits, stretch):
    """The two ways to read pixels agree, whatever the stretch of bits that is looked up at once."""
    by_arrays = webp.pixels_by_arrays
    for seed in range(6):
        x = picture(23, 17, (None, 5, 40)[seed % 3], seed)
        data = webp.encode(x, 23, (GREEN,) if seed % 2 else (), cache_bits)
        monkeypatch.setattr(webp, "MANY", 1 << 40)
        assert (webp.decode(data)[2] == x).all()
        monkeypatch.setattr(webp, "MANY", 1)
        monkeypatch.setattr(webp, "pixels_by_arrays", lambda *a: by_arrays(*a, stretch))
        assert (webp.decode(data)[2] == x).all()
        with pytest.raises(ValueError):
            webp.decode(data[: len(data) * 2 // 3])
        monkeypatch.setattr(webp, "pixels_by_arrays", by_arrays)


def test_text_gets_smaller_with_references_and_cache(monkeypatch):
    text = " ".join(f"word{i * i % 37} of the line {i % 11}" for i in range(400)).encode()
    used = []
    real = webp.best_cache
    monkeypatch.setattr(webp, "best_cache", lambda *a: used.append(real(*a)) or used[-1])
    assert len(webp.stored(text)) < len(text) / 2 and webp.opened(webp.stored(text))[3] == webp.payload(text)
    assert webp.copies(np.frombuffer(webp.payload(text), dtype=np.uint8).reshape(-1, 3).astype(np.uint32) @ np.array([1, 256, 65536], dtype=np.uint32), 192)
    smooth = np.add.outer(np.arange(400), np.arange(64) ** 2 // 3).astype(np.uint32).ravel() * np.uint32(0x010203) | np.uint32(0xFF000000)
    assert webp.PREDICTOR in webp.best_transforms(smooth, 64, 4) and (webp.decode(webp.encode(smooth, 64))[2] == smooth).all()


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000])
def test_stored_payload(n):
    text = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    data = webp.stored(text)
    width, height, channels, samples = webp.opened(data)
    assert samples == text + b"\xff" * (len(samples) - n) and len(samples) % 576 == 0 and samples and channels == 3 and width * height * 3 == len(samples)
    slow = webp.decode(webp.encode(np.frombuffer(samples, dtype=np.uint8).astype(np.uint32) * 0x10101 | np.uint32(0xFF000000), 576))[2]
    assert (slow.view(np.uint8)[1::4].tobytes()) == samples


def test_several_images(monkeypatch):
    monkeypatch.setattr(webp, "MOST_ROWS", 2)
    text = bytes(range(256)) * 20
    data = webp.stored(text)
    assert len(list(webp.images(data))) > 1 and webp.opened(data)[3] == webp.payload(text)


def test_broken_images():
    with pytest.raises(ValueError):
        webp.decode(b"RIFF1234WEBPVP8 ")
    with pytest.raises(ValueError):
        webp.decode(webp.encode(picture(9, 9), 9)[:60])


def test_columns(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (None, "ä" * 700), (1, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "2 as samples")
    got = webp.from_media(webp.to_media(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, bytes(r.samples)) for r in got) == sorted((i or 0, len((t or "").encode()), webp.payload((t or "").encode())) for i, t in rows)
    assert webp.from_media(webp.to_media(docs.limit(0))).collect() == []


def test_work_is_done_once(monkeypatch):
    """The cache is looked up once an image, and code lengths are read several at a time."""
    seen, steps = [], []
    cached, step = webp.cached, webp.length_step
    monkeypatch.setattr(webp, "cached", lambda *a: seen.append(a[2]) or cached(*a))
    text = " ".join(f"word{i * i % 37} of the line {i % 11}" for i in range(400)).encode()
    data = webp.stored(text)
    assert len(seen) == 1
    webp.opened(data)  # what the bits stand for is kept from now on
    monkeypatch.setattr(webp, "length_step", lambda *a: steps.append(a) or step(*a))
    assert webp.opened(data)[3] == webp.payload(text) and len(steps) < 30


def test_lengths_at_a_time_equal_one_by_one(monkeypatch):
    """Every symbol of code lengths, repeats of the one before included, across all lengths of the code."""
    r = np.random.default_rng(5)
    code = webp.code_of_lengths(tuple([4] * 13 + [5] * 6))
    steps = webp.length_steps
    for _ in range(40):
        w = webp.Writer()
        w.write(0, 1)
        w.write(15, 4)
        for i in webp.CODE_ORDER:
            w.write(int(code.n[i]), 3)
        w.write(0, 1)
        want, before = [], 8
        symbols = r.choice([1, 2, 3, 7, 9, 16, 16, 17, 18, 0], 60)
        for s in symbols.tolist():
            extra = {16: 2, 17: 3, 18: 7}.get(s, 0)
            more = int(r.integers(0, 1 << extra))
            w.write(int(code.written[s]) | more << int(code.n[s]), int(code.n[s]) + extra)
            want += [s] if s < 16 else [before if s == 16 else 0] * ((11 if s == 18 else 3) + more)
            before = s if 0 < s < 16 else before
        data = w.bytes()
        got = []
        monkeypatch.setattr(webp, "PrefixCode", lambda n: got.append(n.tolist()))
        for way in (steps, lambda code, window: (0, 0, b"", 0)):
            code.steps.clear()
            monkeypatch.setattr(webp, "length_steps", way)
            webp.read_code(webp.Reader(data), len(want))
        assert got == [want, want]
        monkeypatch.undo()
    code.steps.clear()


@pytest.mark.parametrize("alpha", [0xFF000000, None])
def test_fields_of_references(monkeypatch, alpha):
    """A reference's distance in one field or two, images with alpha or without: the same bits."""
    x = picture(192, 30, seed=3)
    x[3000:4500] = x[20:1520]
    x = x if alpha is None else x & np.uint32(0xFFFFFF) | np.uint32(alpha)
    data = webp.encode(x, 192, ())
    monkeypatch.setattr(webp, "MOST_BITS", 1)
    assert webp.encode(x, 192, ()) == data and (webp.decode(data)[2] == x).all()


def test_lengths_of_codes_are_least():
    """Against the plain way to join the two lightest again and again."""
    r = np.random.default_rng(1)
    for n in (2, 3, 5, 40, 300):
        for most in (1, 4, 1000):
            counts = r.integers(0, most + 1, n)
            weights, total = sorted(c for c in counts.tolist() if c), 0
            if len(weights) < 2:
                continue
            lengths = webp.code_lengths(counts, 15)
            while len(weights) > 1:
                total += weights[0] + weights[1]
                weights = sorted([weights[0] + weights[1], *weights[2:]])
            assert (lengths * counts).sum() == total and sum(2.0 ** -int(k) for k in lengths[counts > 0]) == 1
    fibonacci = [1, 1]
    while len(fibonacci) < 25:
        fibonacci.append(sum(fibonacci[-2:]))
    lengths = webp.code_lengths(np.array(fibonacci), 15)
    assert lengths.max() <= 15 and sum(2.0 ** -int(k) for k in lengths) == 1
