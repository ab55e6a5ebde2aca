"""Storyboards and crops against plain restatements, pixel by pixel."""

import struct
import zlib

import numpy as np
import pytest

from shotlake.operators import pictures as P
from shotlake.sources import documents as D


def plain_resized(image, height, width):
    """Each new pixel as the mean over the area that it covers, summed pixel by pixel."""
    h, w, c = image.shape
    out = np.zeros((height, width, c))
    for y in range(height):
        for x in range(width):
            total, area = np.zeros(c), 0.0
            for v in range(h):
                dy = min((y + 1) * h / height, v + 1) - max(y * h / height, v)
                for u in range(w):
                    dx = min((x + 1) * w / width, u + 1) - max(x * w / width, u)
                    if dy > 0 and dx > 0:
                        total, area = total + dx * dy * image[v, u], area + dx * dy
            out[y, x] = total / area
    return out


@pytest.mark.parametrize("size", [(3, 5), (7, 11), (13, 4), (1, 1), (20, 22)])
def test_resampling_takes_the_mean_of_areas(size):
    image = np.random.default_rng(1).integers(0, 256, (10, 11, 3), np.uint8)
    assert np.abs(P.resized(image, *size).astype(float) - plain_resized(image, *size)).max() <= 0.5 + 1e-6


def frames_of(spark, images):
    return spark.createDataFrame([(s, i, *x.shape, x.tobytes()) for (s, i), x in images.items()], f"stream string, frame_index long, {P.IMAGE}").repartition(3)


def unpng(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        if kind == b"IHDR":
            w, h, depth, colour = struct.unpack(">IIBB", part[:10])
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    c = 3 if colour == 2 else 1
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    assert depth == 8 and not lines[:, 0].any()
    pixels = lines[:, 1:].reshape(h, w, c)
    return pixels[:, :, ::-1] if c == 3 else pixels


def test_storyboards_equal_a_plain_pasting(spark):
    rng = np.random.default_rng(2)
    images = {("a", i): rng.integers(0, 256, (9, 16, 3), np.uint8) for i in range(12)} | {("b", 0): rng.integers(0, 256, (8, 5, 1), np.uint8), ("b", 1): rng.integers(0, 256, (6, 10, 3), np.uint8)}
    cells = [("a", 0, 3), ("a", 1, 99), ("a", 2, 3), *(("a", k, k) for k in range(3, 12)), ("b", 0, 0), ("b", 5, 1), ("c", 0, 0)]
    wanted = spark.createDataFrame([*cells, cells[0]], "stream string, cell long, frame_index long")
    frames = frames_of(spark, images)
    got = {r.stream: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels) for r in P.storyboards(wanted, frames.union(frames), 3, 3, gap=2, margin=3).collect()}
    assert set(got) == {"a", "b"}
    want = np.zeros((3 * 9 + 2 * 2 + 6, 3 * 16 + 2 * 2 + 6, 3), np.uint8)
    for i, k in enumerate([3, 3, 3, 4, 5, 6, 7, 8, 9]):  # frame 99 is not there, so the next ones move up
        y, x = 3 + i // 3 * 11, 3 + i % 3 * 18
        want[y : y + 9, x : x + 16] = images["a", k]
    assert np.array_equal(got["a"], want)
    # Cells of 10 x 8: the gray one of 5 x 8 keeps its size and lies in the middle, the other keeps its width.
    want = np.zeros((3 * 8 + 10, 3 * 10 + 10, 3), np.uint8)
    want[3:11, 3 + 2 : 3 + 7] = images["b", 0]
    want[3 + 1 : 3 + 7, 15:25] = images["b", 1]
    assert np.array_equal(got["b"], want)
    small = P.storyboards(wanted.where("stream = 'a'"), frames, 3, 3, max_side=30).first()
    cell_h, cell_w = round(9 * 30 / 48), round(16 * 30 / 48)
    assert (small.height, small.width) == (3 * cell_h, 3 * cell_w)
    ratio = min(cell_w / 16, cell_h / 9)
    h, w = int(9 * ratio), int(16 * ratio)
    part = np.frombuffer(small.data, np.uint8).reshape(small.height, small.width, 3)[(cell_h - h) // 2 :, (cell_w - w) // 2 :][:h, :w]
    assert np.abs(part - plain_resized(images["a", 3], h, w)).max() <= 0.5 + 1e-6
    assert P.storyboards(wanted.where("false"), frames).count() == 0


def test_crops_become_files_of_persons(spark, tmp_path):
    rng = np.random.default_rng(4)
    images = {("a", i): rng.integers(0, 256, (20, 30, 3 if i else 1), np.uint8) for i in range(4)}
    boxes = [("a", 0, 1, (2, 3, 10, 9)), ("a", 0, 2, (-5, -5, 4, 4)), ("a", 1, 3, (25, 15, 99, 99)), ("b", 1, 1, (40, 1, 50, 9)), ("b", 2, 2, (5, 5, 5, 9)), ("b", 3, 77, (0, 0, 5, 5)), ("b", 4, 1, None), ("b", 5, 2, (9, 9, 3, 3))]
    records = spark.createDataFrame([("a", who, k, f, b) for who, k, f, b in boxes], "stream string, person string, record int, frame_index long, crop struct<x1:long,y1:long,x2:long,y2:long>")
    got = {r.record: np.frombuffer(r.image.data, np.uint8).reshape(r.image.height, r.image.width, r.image.channels) for r in P.cropped(records.where("person = 'a'"), frames_of(spark, images)).select("record", "image").collect()}
    assert set(got) == {0, 1}
    files = P.person_files(records, frames_of(spark, images))
    D.write_files(files, str(tmp_path))
    back = {r.path: unpng(bytes(r.content)) for r in D.read_files(spark, str(tmp_path), "*.png").collect()}
    assert set(back) == {f"a/persons/a/a_f{f:07d}.png" for f in (1, 2, 3)}
    assert np.array_equal(back["a/persons/a/a_f0000001.png"], images["a", 1][3:9, 2:10]) and np.array_equal(back["a/persons/a/a_f0000002.png"], images["a", 2][:4, :4]) and np.array_equal(back["a/persons/a/a_f0000003.png"], images["a", 3][15:, 25:])
    assert np.array_equal(unpng(P.png(images["a", 0])), images["a", 0])


def test_images_are_bounded_only_where_they_do_not_fit(spark):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, shape, dtype=np.uint8) for shape in ((18, 32, 3), (40, 20, 3), (20, 50, 1), (7, 9, 3))]
    rows = [(i, *x.shape, x.tobytes()) for i, x in enumerate(images)] + [(9, 40, 20, 3, None), (10, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, " + P.IMAGE)
    got = {r.id: r for r in P.bounded(df, 32).collect()}
    assert {i: (r.height, r.width, r.resized) for i, r in got.items()} == {0: (18, 32, False), 1: (32, 16, True), 2: (12, 32, True), 3: (6, 8, True), 9: (32, 16, True), 10: (None, None, None)}
    assert bytes(got[0].data) == images[0].tobytes() and got[9].data is None
    for i in (1, 2, 3):
        r = got[i]
        out = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels).astype(int)
        assert np.abs(out - plain_resized(images[i].astype(float), r.height, r.width)).max() <= 0.5 + 1e-9
