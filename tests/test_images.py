"""Images and arrays of files into metrics: resizing, masks, and NPZ arrays of any shape."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import images
from lodestone.sources import binary


def png(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_resizing_keeps_what_it_must():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (12, 20, 3), dtype=np.uint8)
    assert (binary.resized(image, 20, 12) == image).all()
    flat = np.full((9, 7, 1), 77, np.uint8)
    for size in ((3, 3), (20, 31), (7, 2)):
        assert (binary.resized(flat, *size) == 77).all()
    for n, m in ((20, 7), (7, 20), (5, 5), (1, 4), (9, 1)):
        w = binary.resizing(n, m)
        assert w.shape == (m, n) and np.allclose(w.sum(1), 1) and np.allclose(w, w[::-1, ::-1])
    ramp = np.tile(np.arange(0, 240, 4, dtype=np.uint8)[None, :, None], (4, 1, 1))
    half = binary.resized(ramp, 30, 4)[0, 3:-3, 0].astype(int)
    assert np.abs(half - (np.arange(3, 27) * 8 + 2)).max() <= 1


def test_images_and_masks_of_files_give_an_error(spark, tmp_path):
    rng = np.random.default_rng(2)
    truth = {k: rng.integers(0, 256, (6, 8, 3), dtype=np.uint8) for k in ("a", "b", "c", "d")}
    guess = {k: np.clip(v.astype(int) + rng.integers(-9, 9, v.shape), 0, 255).astype(np.uint8) for k, v in truth.items()}
    guess["d"] = truth["d"]
    masks = {"a": (rng.random((12, 16, 1)) > 0.5).astype(np.uint8) * 255, "c": np.zeros((6, 8, 1), np.uint8), "d": np.full((6, 8, 1), 9, np.uint8)}
    for folder, held in (("truth", truth), ("guess", guess), ("mask", masks)):
        (tmp_path / folder).mkdir()
        for k, v in held.items():
            (tmp_path / folder / f"{k}.png").write_bytes(png(v))
    rows = {}
    for folder in ("truth", "guess", "mask"):
        read, bad = binary.pixel_files(spark, f"{tmp_path}/{folder}/*.png", (8, 6))
        assert bad.count() == 0
        rows[folder] = read.withColumn("image", F.regexp_extract("path", r"([^/]+)\.png$", 1))
    got = {r["image"]: r for r in images.masked_error(rows["guess"], rows["truth"], rows["mask"]).collect()}
    assert set(got) == {"a", "b", "d"}  # c has no pixel in its mask
    inside = {"a": binary.resized(masks["a"], 8, 6)[..., 0] > 0, "b": np.ones((6, 8), bool)}
    for k, held in inside.items():
        mse = (((guess[k].astype(float) - truth[k]) / 255) ** 2)[held].mean()
        assert got[k]["n_pixels"] == held.sum() and got[k]["mse"] == pytest.approx(mse) and got[k]["psnr"] == pytest.approx(-10 * np.log10(mse))
    assert got["d"]["mse"] == 0 and got["d"]["psnr"] is None


def test_arrays_of_any_shape(spark, tmp_path):
    rng = np.random.default_rng(3)
    pose = {"pose": rng.normal(size=(3, 2, 4)), "betas": np.arange(10, dtype=np.int32), "valid": np.array([True, False]), "scale": np.float32(2.5), "none": np.zeros((0, 3))}
    np.savez(tmp_path / "a.npz", **pose)
    np.savez_compressed(tmp_path / "b.npz", betas=np.ones(2), names=np.array(["x"]))
    (tmp_path / "c.npz").write_bytes(b"no archive")
    rows, bad = binary.array_files(spark, f"{tmp_path}/*.npz")
    held = {}
    for r in rows.collect():
        assert r["path"].endswith("a.npz") and tuple(r["shape"]) == pose[r["array"]].shape
        held[r["array"], tuple(r["index"])] = r["value"]
    assert held == {(k, i): float(v) for k, a in pose.items() for i, v in np.ndenumerate(a)}
    assert sorted(r["path"][-5:] for r in bad.collect()) == ["b.npz", "c.npz"]
    some, _ = binary.array_files(spark, f"{tmp_path}/*.npz", ["betas"])
    assert {(r["path"][-5:], r["value"]) for r in some.collect()} == {("a.npz", float(k)) for k in range(10)} | {("b.npz", 1.0)}
