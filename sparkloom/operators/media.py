"""Images and audio: decoded once a file, metrics as columns, verdicts as native rules over them.

Readable without further libraries: PPM and PGM images (P2, P3, P5, P6), WAV audio. Other formats keep their header facts (PNG, JPEG, GIF size) and are
flagged where pixels are needed. Files are read by Spark's binaryFile source; null or broken content gives null metrics and an issue.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions.chars import when_issues
from sparkloom.functions.vectors import bytes_vector_of

IMAGE = "struct<readable:boolean, format:string, width:int, height:int, pixel_hash:string, average_hash:bigint, sharpness:double, mean:double, std:double, low:int, high:int, dominant:double, noise:double, vector:array<double>>"
AUDIO = "struct<readable:boolean, sample_rate:int, channels:int, bit_depth:int, duration:double, pcm_hash:string, rms:double, low:int, high:int, clip_ratio:double, noise_floor:double, snr_db:double, silence_ratio:double, echo_score:double, fingerprint:string>"


def netpbm(data: bytes) -> np.ndarray | None:
    """RGB pixels of a PPM or PGM image."""
    m = re.match(rb"P([2356])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", data)
    if not m:
        return None
    kind, w, h, top = (int(x) for x in m.groups())
    n = w * h * (3 if kind in (3, 6) else 1)
    raw = data[m.end() :]
    px = np.array(raw.split()[:n], dtype=np.float64) if kind in (2, 3) else np.frombuffer(raw[:n], np.uint8).astype(np.float64)
    if px.size < n or not top or not n:
        return None
    px = (px * (255 / top)).reshape(h, w, -1)
    return np.repeat(px, 3, 2) if px.shape[2] == 1 else px


def header(data: bytes) -> tuple[str | None, int | None, int | None]:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:3] == b"GIF" and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        k = 2
        while k + 9 < len(data) and data[k] == 0xFF:
            if data[k + 1] in (0xC0, 0xC1, 0xC2):
                h, w = struct.unpack(">HH", data[k + 5 : k + 9])
                return "jpeg", w, h
            k += 2 + int.from_bytes(data[k + 2 : k + 4], "big")
        return "jpeg", None, None
    return (("ppm" if data[1:2] in b"36" else "pgm"), None, None) if re.match(rb"P[2356]\s", data) else (None, None, None)


def _resized(gray: np.ndarray, h: int, w: int) -> np.ndarray:
    return gray[np.arange(h) * gray.shape[0] // h][:, np.arange(w) * gray.shape[1] // w]


def image_facts(data: bytes | None) -> dict | None:
    if data is None:
        return None
    kind, w, h = header(data)
    px = netpbm(data)
    if px is None:
        return {"readable": False, "format": kind, "width": w, "height": h}
    gray = px @ np.array([0.299, 0.587, 0.114])
    small = _resized(gray, 8, 8)
    bits = (small > small.mean()).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    lap = gray[1:-1, 1:-1] * 4 - gray[:-2, 1:-1] - gray[2:, 1:-1] - gray[1:-1, :-2] - gray[1:-1, 2:] if min(gray.shape) > 2 else np.zeros(1)
    mid = _resized(gray, 96, 96)
    off = mid[1:-1, 1:-1] - (mid[:-2, 1:-1] + mid[2:, 1:-1] + mid[1:-1, :-2] + mid[1:-1, 2:]) / 4
    levels = np.bincount(gray.round().astype(int).ravel(), minlength=256)
    size = f"{px.shape[1]}x{px.shape[0]}".encode()
    return {
        "readable": True, "format": kind, "width": px.shape[1], "height": px.shape[0], "pixel_hash": hashlib.sha256(size + px.round().astype(np.uint8).tobytes()).hexdigest(),
        "average_hash": value - (1 << 64) if value >> 63 else value, "sharpness": float(lap.var()), "mean": float(gray.mean()), "std": float(gray.std()), "low": int(gray.min()), "high": int(gray.max()),
        "dominant": float(levels.max() / gray.size), "noise": float(off.std()), "vector": bytes_vector_of(_resized(gray, 16, 16).round().astype(np.uint8).tobytes()),
    }


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity over the whole of two gray images."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    cov = ((a - a.mean()) * (b - b.mean())).mean()
    return float((2 * a.mean() * b.mean() + c1) * (2 * cov + c2) / ((a.mean() ** 2 + b.mean() ** 2 + c1) * (a.var() + b.var() + c2)))


def compare_images(x: bytes | None, y: bytes | None) -> dict | None:
    """ssim, psnr and mean absolute error of two readable images, over 64 x 64 gray."""
    px, py = (netpbm(d) if d is not None else None for d in (x, y))
    if px is None or py is None:
        return None
    a, b = (_resized(p @ np.array([0.299, 0.587, 0.114]), 64, 64) for p in (px, py))
    mse = float(((a - b) ** 2).mean())
    return {"ssim": ssim(a, b), "psnr": 99.0 if mse == 0 else float(10 * np.log10(255**2 / mse)), "mae": float(np.abs(a - b).mean())}


def audio_facts(data: bytes | None) -> dict | None:
    if data is None:
        return None
    try:
        with wave.open(io.BytesIO(data), "rb") as w:
            rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    except (wave.Error, EOFError, ValueError):
        return {"readable": False}
    raw = raw[: len(raw) // (width * channels) * (width * channels)]
    if width == 1:
        s = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        s = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        s = np.where(s >= 1 << 23, s - (1 << 24), s)
    else:
        s = np.frombuffer(raw, f"<i{width}").astype(np.int64)
    mono = s.reshape(-1, channels).mean(1) if s.size else np.zeros(0)
    top = (1 << (8 * width - 1)) - 1
    digest = hashlib.sha256(f"{channels}{width}{rate}".encode() + raw).hexdigest()
    out = {"readable": True, "sample_rate": rate, "channels": channels, "bit_depth": 8 * width, "duration": round(len(mono) / rate, 4) if rate else 0.0, "pcm_hash": digest}
    if not mono.size:
        return out | {"rms": 0.0, "low": 0, "high": 0, "clip_ratio": 0.0, "noise_floor": 0.0, "snr_db": None, "silence_ratio": 1.0, "echo_score": 0.0, "fingerprint": "0" * 64}
    frame = max(1, int(rate * 0.02))
    frames = np.sqrt((mono[: len(mono) // frame * frame].reshape(-1, frame) ** 2).mean(1)) if len(mono) >= frame else np.array([np.sqrt((mono**2).mean())])
    order = np.sort(frames)
    tenth = max(1, len(order) // 10)
    noise, loud = float(order[:tenth].mean()), float(order[-tenth:].mean())
    env = frames - frames.mean()
    power = float((env * env).sum())
    lags = [float((env[k:] * env[:-k]).sum() / power) for k in range(2, min(25, len(env) - 1))] if power else []
    part = np.array_split(mono, 65)
    energy = np.array([float((p * p).mean()) if p.size else 0.0 for p in part])
    return out | {
        "rms": float(np.sqrt((s.astype(float) ** 2).mean())), "low": int(s.min()), "high": int(s.max()), "clip_ratio": float((np.abs(s) >= top).mean()), "noise_floor": noise,
        "snr_db": float(20 * np.log10(loud / noise)) if noise > 0 and loud > 0 else None, "silence_ratio": float((frames < 0.01 * top).mean()), "echo_score": max([0.0, *lags]),
        "fingerprint": "".join("1" if b > a else "0" for a, b in zip(energy, energy[1:])),
    }


def _facts(content: Column, schema: str, read) -> Column:
    names = [p.split(":")[0].strip() for p in re.split(r",\s*(?![^<]*>)", schema[len("struct<") : -1])]

    def run(batches):
        for s in batches:
            done = [read(x) or {} for x in s]
            yield pd.DataFrame({n: pd.Series([d.get(n) for d in done], dtype=object) for n in names})

    udf = F.pandas_udf(_typed(run), schema)
    return udf(content)


def _typed(run):
    from collections.abc import Iterator

    def facts(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run(it)

    facts.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return facts


def image_columns(content: Column) -> Column:
    return _facts(content, IMAGE, image_facts)


def audio_columns(content: Column) -> Column:
    return _facts(content, AUDIO, audio_facts)


def with_files(df: DataFrame, path_col: str, files: DataFrame) -> DataFrame:
    """df with content and file_size of the file at its path (by the last part of both); null where there is none."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    held = files.select(name(F.col("path")).alias("_name"), "content", F.col("length").alias("file_size"))
    return df.withColumn("_name", name(F.col(path_col))).join(held, "_name", "left").drop("_name")


def evaluate_images(df: DataFrame, path_col: str = "image_path", least: int = 224, ratios: tuple[float, float] = (0.2, 5.0), sharp: float = 100.0) -> DataFrame:
    """df (with content) with image facts and issues: missing, unreadable, broken, format, size, ratio, blur, blank."""
    out = df.withColumn("image", image_columns(F.col("content")))
    i = F.col("image")
    ratio = i["width"] / i["height"]
    ends = F.substring(F.col("content"), -2, 2)
    span = i["high"] - i["low"]
    white, black = (i["low"] >= 250) & (i["std"] <= 0.5), (i["high"] <= 5) & (i["std"] <= 0.5)
    solid = (span <= 18) & (i["std"] <= 6) & (i["dominant"] >= 0.12)
    blank = (i["std"] <= 12) & ((i["mean"] >= 235) | (i["mean"] <= 20)) & ((span <= 40) | (i["dominant"] >= 0.55))
    suffix = F.lower(F.regexp_extract(F.col(path_col), r"\.([A-Za-z0-9]+)$", 1))
    return out.withColumn("issues", when_issues(
        ("missing_image_path", F.col(path_col).isNull()), ("image_not_found", F.col(path_col).isNotNull() & F.col("content").isNull()), ("image_broken", (F.length("content") == 0) | ((i["format"] == "jpeg") & (ends != F.unhex(F.lit("FFD9"))))),
        ("unsupported_format", F.col(path_col).isNotNull() & ~suffix.isin("jpg", "jpeg", "png")), ("width_too_small", i["width"] < least), ("height_too_small", i["height"] < least),
        ("aspect_ratio_abnormal", (ratio < ratios[0]) | (ratio > ratios[1])), ("blurred_image", i["sharpness"] < sharp), ("pure_white_image", white), ("pure_black_image", black), ("near_solid_color_image", solid & ~white & ~black), ("blank_content_image", blank & ~white & ~black),
    ))


def evaluate_audio(df: DataFrame, path_col: str = "audio_path", rate: int = 24000, depth: int = 16) -> DataFrame:
    """df (with content) with audio facts and issues."""
    out = df.withColumn("audio", audio_columns(F.col("content")))
    a = F.col("audio")
    there = F.col("content").isNotNull()
    suffix = F.lower(F.regexp_extract(F.col(path_col), r"\.([A-Za-z0-9]+)$", 1))
    volume = (a["rms"] >= 100) & (a["high"] - a["low"] >= 500)
    noisy = (a["snr_db"] < 12) | (a["noise_floor"] > 800) | (a["silence_ratio"] > 0.8)
    clipped, echo = a["clip_ratio"] > 0.01, a["echo_score"] > 0.65
    clean = F.coalesce(a["readable"] & volume & ~clipped & ~F.coalesce(noisy, F.lit(False)) & ~echo, F.lit(False))
    return out.withColumn("issues", when_issues(
        ("missing_audio_path", F.col(path_col).isNull()), ("audio_not_found", F.col(path_col).isNotNull() & ~there), ("audio_decode_failed", there & (suffix == "wav") & ~a["readable"]), ("unsupported_audio_format", F.coalesce(suffix, F.lit("")) != "wav"),
        ("audio_sample_rate_mismatch", ~a["sample_rate"].eqNullSafe(rate)), ("audio_bit_depth_mismatch", ~a["bit_depth"].eqNullSafe(depth)), ("audio_volume_range_abnormal", ~F.coalesce(volume, F.lit(False))),
        ("audio_clipping_detected", clipped), ("audio_noise_detected", noisy), ("audio_echo_detected", echo), ("audio_cleanliness_abnormal", ~clean),
    ))


def flag_duplicates(df: DataFrame, key: Column, issue: str) -> DataFrame:
    """df with the issue added to rows whose key another row has; null keys have no copies."""
    from sparkloom.operators.evaluate import duplicate_sizes

    out = duplicate_sizes(df, F.coalesce(key, F.lit("")))
    return out.withColumn("issues", F.when(F.col("duplicate_size") > 1, F.array_union("issues", F.array(F.lit(issue)))).otherwise(F.col("issues"))).drop("duplicate_size")


def denoise_images(df: DataFrame, blur: float = 3.0, noise: float = 24.0, least: int = 128) -> DataFrame:
    """df (with content) with image facts and the denoising issues."""
    out = df.withColumn("image", image_columns(F.col("content")))
    i = F.col("image")
    ratio = i["width"] / i["height"]
    return out.withColumn("issues", when_issues(
        ("image_missing", F.col("content").isNull()), ("decode_failed", F.col("content").isNotNull() & ~i["readable"]), ("low_resolution", F.least(i["width"], i["height"]) < least), ("abnormal_aspect_ratio", (ratio < 0.2) | (ratio > 5)),
        ("blur", i["sharpness"] < blur), ("under_exposure", (i["mean"] < 25) & (i["std"] < 8)), ("over_exposure", (i["mean"] > 245) & (i["std"] < 8)), ("pure_color", i["std"] < 3), ("high_noise", i["noise"] > noise),
    ))


def bbox_check(df: DataFrame, box: str, width: str, height: str) -> DataFrame:
    """df with bbox_valid: (left, top, right, bottom) in order and inside the image; null without a box."""
    b = F.col(box)
    ok = (F.size(b) == 4) & (b[0] >= 0) & (b[1] >= 0) & (b[2] > b[0]) & (b[3] > b[1]) & (b[2] <= F.col(width)) & (b[3] <= F.col(height))
    return df.withColumn("bbox_valid", F.when(b.isNotNull(), ok))


def video_frames(frames: DataFrame, video: str = "video_id", order: str = "frame", mean: str = "mean", std: str = "std", diff: str = "diff") -> DataFrame:
    """One row a video from rows of frames (diff: mean absolute difference to the frame before): shares and issues."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    agg = frames.groupBy(video).agg(
        F.count(F.lit(1)).alias("frames"), share(F.col(mean) < 12).alias("black_share"), share(F.col(std) < 3).alias("pure_share"), share((F.col(mean) < 25) & (F.col(std) < 8)).alias("under_share"), share((F.col(mean) > 245) & (F.col(std) < 8)).alias("over_share"),
        F.avg(F.when(F.col(diff).isNotNull(), (F.col(diff) <= 1.5).cast("double"))).alias("freeze_share"),
    )
    return agg.withColumn("issues", when_issues(("black_frames", F.col("black_share") > 0.5), ("freeze_frames", F.col("freeze_share") > 0.75), ("pure_color_frames", F.col("pure_share") > 0.5), ("under_exposed_frames", F.col("under_share") > 0.5), ("over_exposed_frames", F.col("over_share") > 0.5)))


# Words that speak of generated, and of filmed, videos.
GENERATED = ("ai generated", "ai-generated", "aigc", "generated video", "synthetic", "model-generated", "synthetic video", "generated by ai", "生成视频", "ai视频", "数字人", "虚拟人", "kling", "veo", "seedance", "ltx", "mova", "ovi", "sora", "runway", "wanx", "hunyuan")
FILMED = ("handheld", "现场拍摄", "实拍", "vlog", "采访", "直播", "街拍", "camera shake", "现场收音")


def generated_video_risk(df: DataFrame, text: Column, freeze: Column, qr: Column, keywords: Column, speech: Column, threshold: float = 0.55) -> DataFrame:
    """df with video_aigc_score, added up from its signs, and whether it reaches the threshold."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    add = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    few = (F.size(keywords) > 0) & (F.size(F.array_distinct(keywords)) <= 3)
    score = add(any_of(GENERATED), 0.55) + add(freeze >= 0.9, 0.15) + add(qr, 0.1) + add(few, 0.05) - add(F.length(F.trim(speech)) > 0, 0.1) - add(any_of(FILMED), 0.15)
    return df.withColumn("video_aigc_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)).withColumn("suspected_video_aigc", F.col("video_aigc_score") >= threshold)
