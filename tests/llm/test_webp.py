import hashlib
import subprocess
import sys
import zlib

import numpy as np
import pytest

from bazaarlens.llm import webp


def test_all_transforms_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(80):
        h, w = int(rng.integers(1, 30)), int(rng.integers(1, 40))
        image = rng.choice(rng.integers(0, 2**32, int(rng.choice([1, 2, 3, 9, 40, 300])), dtype=np.uint32), (h, w))
        n = len(np.unique(image))
        palette = n <= 256 and bool(rng.integers(2))
        across = -(-w >> (3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0)) if palette else w
        block = int(rng.integers(2, 5))
        shape = (-(-h >> block), -(-across >> block))
        data = webp.write_image(
            image, rng.integers(0, 14, shape) if rng.integers(2) else None, rng.integers(0, 2**32, shape, dtype=np.uint32) if rng.integers(2) else None,
            block, bool(rng.integers(2)), palette, int(rng.choice([0, 1, 5, 11])), bool(rng.integers(2)),
        )
        assert (webp.read_image(data) == image).all()


def test_predictors_by_hand():
    """A 2 x 2 image with a known residual for each mode: the last pixel from left, top and corner."""
    left, top, corner = 0xFF102030, 0xFF405060, 0xFF0A0B0C
    assert webp._predict(1, left, top, corner, 0) == left and webp._predict(2, left, top, corner, 0) == top
    assert webp._predict(7, left, top, corner, 0) == 0xFF283848
    assert webp._predict(12, left, top, corner, 0) == 0xFF466584
    assert webp._predict(11, left, top, corner, 0) == top  # far from the corner to the left, so the top is nearer
    assert webp._predict(13, left, top, corner, 0) == 0xFF374E66


def test_every_predictor_by_formula():
    """The fourteen modes of the format, written out on single channels."""
    rng = np.random.default_rng(4)
    clamp = lambda x: max(0, min(255, x))
    avg = lambda a, b: (a + b) // 2
    toward_zero = lambda x: x // 2 if x >= 0 else -(-x // 2)
    forms = {
        0: None, 1: lambda l, t, c, r: l, 2: lambda l, t, c, r: t, 3: lambda l, t, c, r: r, 4: lambda l, t, c, r: c, 5: lambda l, t, c, r: avg(avg(l, r), t), 6: lambda l, t, c, r: avg(l, c), 7: lambda l, t, c, r: avg(l, t),
        8: lambda l, t, c, r: avg(c, t), 9: lambda l, t, c, r: avg(t, r), 10: lambda l, t, c, r: avg(avg(l, c), avg(t, r)), 12: lambda l, t, c, r: clamp(l + t - c), 13: lambda l, t, c, r: clamp(avg(l, t) + toward_zero(avg(l, t) - c)),
    }
    bytes_of = lambda p: [p >> k & 255 for k in (24, 16, 8, 0)]
    for _ in range(300):
        l, t, c, r = (int(x) for x in rng.integers(0, 2**32, 4))
        for mode, form in forms.items():
            want = [255, 0, 0, 0] if form is None else [form(*x) for x in zip(*map(bytes_of, (l, t, c, r)))]
            assert bytes_of(webp._predict(mode, l, t, c, r)) == want, mode
        guess = [a + b - d for a, b, d in zip(*map(bytes_of, (l, t, c)))]
        far = lambda p: sum(abs(x - y) for x, y in zip(guess, bytes_of(p)))  # noqa: B023, E731
        assert webp._predict(11, l, t, c, r) == (l if far(l) < far(t) else t)


def test_a_predicted_image_pixel_by_pixel():
    """Borders too: the first pixel is opaque black, the first row follows from the left, the first column from above, and
    right of the last column is the row's own first pixel."""
    rng = np.random.default_rng(6)
    h, w, block = 9, 11, 2
    image = rng.integers(0, 2**32, (h, w), dtype=np.uint32)
    modes = rng.integers(0, 14, (-(-h >> block), -(-w >> block)))
    flat = image.ravel().tolist()
    for y in range(h):
        for x in range(w):
            n = y * w + x
            at = lambda k: flat[k]
            want = 0xFF000000 if n == 0 else at(n - 1) if y == 0 else at(n - w) if x == 0 else webp._predict(int(modes[y >> block, x >> block]), at(n - 1), at(n - w), at(n - w - 1), at(n - w + 1))
            assert webp._predicted(flat, n, w, modes.ravel().tolist(), modes.shape[1], block) == want
    assert (webp.read_image(webp.write_image(image, modes, None, block)) == image).all()


def test_few_values_are_a_palette_at_every_size():
    for n in (64, 1 << 10, (1 << 16) + 64):
        payload = (b"abcdabdc" * (n // 8))[:n]
        data = webp.write_samples(payload)
        assert webp.read_samples(data) == payload and webp.Bits(data[20:]).read(8) == 0x2F


@pytest.mark.parametrize("values", [b"0123456789 \n", b"acgt", b"01", bytes(range(16)), b"7"])
def test_long_texts_of_few_values(values):
    """More bytes than a distance code reaches back, with long runs and without."""
    rng = np.random.default_rng(len(values))
    payload = rng.choice(np.frombuffer(values, np.uint8), 3 << 20)
    payload[: 1 << 16] = payload[0]
    payload[1 << 20 : (1 << 20) + 40_000] = payload[5]
    payload = payload.tobytes()
    media = webp.write_media(payload)
    assert b"".join((x & 255).astype(np.uint8).tobytes() for x in webp.images(media)) == payload
    assert len(media) < len(payload) * max(0.02, np.log2(len(values)) / 8 + 0.2)


def test_16_mb_of_two_values_stay_under_a_gigabyte():
    code = """
import hashlib, resource, sys
import numpy as np
from bazaarlens.llm import webp
payload = (b"ab" * (8 << 20)) if sys.argv[1] == "ab" else np.random.default_rng(1).choice(np.frombuffer(b"ab", np.uint8), 16 << 20).tobytes()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
digest = hashlib.sha256()
for x in webp.images(webp.write_media(payload)):
    digest.update((x & 255).astype(np.uint8).tobytes())
assert digest.digest() == hashlib.sha256(payload).digest()
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    for kind in ("ab", "random"):
        assert int(subprocess.run([sys.executable, "-c", code, kind], capture_output=True, text=True, check=True).stdout) < 1_000_000


def test_copies_from_afar():
    """The general writer leaves out a match that no distance code reaches."""
    rng = np.random.default_rng(4)
    row = rng.integers(0, 2**32, 5, dtype=np.uint32)
    image = np.concatenate([row, np.full((1 << 20) + 100, 7, np.uint32), row]).reshape(-1, 1)
    image = np.concatenate([image, np.zeros((-len(image) % 16384, 1), np.uint32)]).reshape(16384, -1)
    assert (webp.read_image(webp.write_image(image)) == image).all()


def test_several_groups_of_codes():
    """A stream with an image of code groups, written bit by bit: a 4 x 8 image, upper half one value, lower half another."""
    out = webp.Out()
    webp._header(out, 4, 8, False)
    out.put(0, 1)  # no transform
    out.put(0, 1)  # no cache
    out.put(1, 1)  # groups
    out.put(0, 3)  # blocks of 4
    webp._put_pixels(out, [0 << 8, 1 << 8], 1, False)
    for green in (7, 9):
        for only, alphabet in ((green, 280), (1, 256), (2, 256), (255, 256), (0, 40)):
            webp._put_code(out, [int(s == only) for s in range(alphabet)])
    image = webp.read_image(webp._file(webp.pack(np.array(out.values, np.uint64), np.array(out.widths))))
    assert image.shape == (8, 4) and set(image[:4].ravel().tolist()) == {0xFF010702} and set(image[4:].ravel().tolist()) == {0xFF010902}


def test_near_pixels():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)


@pytest.mark.parametrize("text", ["", "a", "a" * 100_000, "ab" * 3000, "\0" * 70, "é" * 5, "x" * 64, "the cat\n" * 40, "".join(map(chr, range(1, 2000)))])
def test_payloads(text):
    payload = webp.padded(text.encode())
    assert len(payload) % 64 == 0 and payload
    data = webp.write_samples(payload)
    assert webp.read_samples(data) == payload and webp.write_samples(payload) == data


def test_wide_payload():
    assert webp.shape_of(64 * webp.MAX_SIDE) == (webp.MAX_SIDE, 64)
    h, w = webp.shape_of(64 * (webp.MAX_SIDE + 1))
    assert h * w == 64 * (webp.MAX_SIDE + 1) and h <= webp.MAX_SIDE


@pytest.mark.parametrize("n", [64, 1 << 20, 64 * 16411, 64 * 262147, webp.MAX_SIDE**2, webp.MAX_SIDE**2 + 64, webp.MAX_SIDE**2 + 64 * 16411])
def test_every_size_has_shapes(n):
    sizes = webp.cuts(n)
    assert sum(sizes) == n
    for size in sizes:
        h, w = webp.shape_of(size)
        assert h * w == size and w % 64 == 0 and max(h, w) <= webp.MAX_SIDE


def test_sizes_without_a_shape(spark, monkeypatch):
    prime = "some words " * 95_482  # 64 * 16411 bytes when padded
    assert len(webp.padded(prime.encode())) == 64 * 16411
    df = spark.createDataFrame([(1, prime), (2, "short")], "doc_id long, text string")
    rows = {r.doc_id: r for r in webp.text_media(df).collect()}
    payload = webp.padded(prime.encode())
    assert rows[1].payload_sha256 == hashlib.sha256(payload).hexdigest() and rows[1].payload_bytes == len(payload) and rows[2].n_bytes == 5
    images = [r for r in webp.decode_media(webp.encode_media(df)).orderBy("doc_id", "image").collect() if r.doc_id == 1]
    assert [r.image for r in images] == [0, 1] and b"".join(np.array(r.pixels).astype(np.uint8).tobytes() for r in images) == payload
    monkeypatch.setattr(webp, "IMAGE", 64 * webp.MAX_SIDE)
    media = webp.write_media(payload * 3)
    assert b"".join((x & 255).astype(np.uint8).tobytes() for x in webp.images(media)) == payload * 3


def test_damage_is_told():
    data = webp.write_samples(webp.padded(b"some words of a text, not a run of one letter " * 9))
    for bad in (b"", data[:40], b"RIFX" + data[4:]):
        with pytest.raises(ValueError):
            webp.read_image(bad)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (None, "x"), (-3, "y"), (-3, "y")], docs.schema)).selectExpr("*", "'m' AS media", "1 AS n_bytes", "2 AS image", "3 AS pixels", "'t' AS feature")
    rows, texts = webp.text_media(docs).collect(), [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert len(rows) == len(texts)
    want = sorted((str(i), len(b), hashlib.sha256(webp.padded(b)).hexdigest(), zlib.crc32(webp.padded(b)[-64:])) for i, b in texts)
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    by = {}
    for r in rows:
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    pixels = webp.decode_media(webp.encode_media(docs.limit(20))).collect()
    assert all(r.height * r.width == len(r.pixels) for r in pixels)
    assert webp.text_media(docs.limit(0)).count() == 0
