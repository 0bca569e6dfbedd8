"""Audio fingerprints: shifts and noise, alignment against brute force, edge cases."""

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import audio, queries

SF = "/root/testdata/sf0.001"


def melody(rng, notes=64):
    t = np.arange(audio.FRAME) / audio.RATE
    return np.concatenate([9000 * np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * t) for _ in range(notes)])


def pcm(x):
    return x.astype("<i2").tobytes()


@pytest.fixture(scope="module")
def clips():
    rng = np.random.default_rng(5)
    songs = [melody(rng) for _ in range(12)]
    rows = [(k, pcm(s)) for k, s in enumerate(songs)]
    rows += [(20 + k, pcm(s + rng.normal(0, 300, len(s)))) for k, s in enumerate(songs[:6])]  # noisy copies
    rows += [(40 + k, pcm(s[8 * audio.HOP :])) for k, s in enumerate(songs[:4])]  # the start cut off
    rows += [(60, None), (61, b""), (62, b"\x00\x01\x02"), (None, pcm(songs[0])), (63, pcm(np.zeros(40_000)))]
    return rows


@pytest.fixture(scope="module")
def prints(spark, clips):
    df = spark.createDataFrame([(i, a, "clash") for i, a in clips], "vec_id long, audio binary, print string")
    return audio.fingerprints(df, id_column="vec_id", audio_column="audio").cache()


def test_wav_and_pcm_agree():
    samples = melody(np.random.default_rng(0), 8)
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(audio.RATE)
        w.writeframes(pcm(samples))
    assert np.array_equal(audio._pcm(f.getvalue()), audio._pcm(pcm(samples)))


def test_integral_image_filters():
    """All filters of all frames against sums taken directly."""
    found = np.random.default_rng(2).random((audio.SPAN + 9, audio.CLASSES))
    got = audio.integers(found)
    assert len(got) == 10
    for k, (kind, w, y, h) in enumerate(audio._rectangles()):
        for t in range(10):
            part = found[t : t + w, y : y + h]
            first, low = np.arange(w)[:, None] < w // 2, np.arange(h)[None, :] < h // 2
            inner = (np.arange(w)[:, None] >= w // 4) & (np.arange(w)[:, None] < w - w // 4)
            plus = [~low & (first | ~first), ~first & (low | ~low), first == low, inner & (low | ~low)][kind]
            ratio = np.log((1 + part[plus].sum()) / (1 + part[~plus].sum()))
            level = sum(ratio > x for x in (-audio.STEP, 0.0, audio.STEP))
            assert (int(got[t]) >> 2 * k) & 3 == [0, 1, 3, 2][level], (kind, t)
    assert len({kind for kind, *_ in audio._rectangles()}) == 4


def test_copies_align(prints):
    got = {r["vec_id"]: r for r in audio.align(prints, F.col("vec_id") < 12, id_column="vec_id").collect()}
    assert sorted(got) == list(range(12))
    assert all(got[k]["n_matches"] >= 2 and got[k]["best_error"] <= audio.MOST_ERROR for k in range(4))
    assert all(got[k]["best_id"] == 20 + k and got[k]["best_offset"] == 0 for k in (4, 5))
    assert all(got[k]["n_matches"] == 0 and got[k]["best_id"] is None for k in range(6, 12))


def test_cut_recordings_align_at_their_offset(prints):
    got = {r["vec_id"]: r for r in audio.align(prints, F.col("vec_id").between(40, 43), id_column="vec_id").collect()}
    assert all(r["best_id"] == k - 40 and r["best_offset"] == 8 and r["best_error"] < 0.001 for k, r in got.items() if k > 40)


def nearest(query, recording):
    """(error, offset) of the best of all offsets with enough overlap."""
    found = [(1.0, 0)]
    for shift in range(audio.LEAST_OVERLAP - len(query), len(recording) - audio.LEAST_OVERLAP + 1):
        a, b = max(0, -shift), min(len(query), len(recording) - shift)
        if b - a >= audio.LEAST_OVERLAP:
            found.append((sum(int(x).bit_count() for x in query[a:b] ^ recording[a + shift : b + shift]) / (32 * (b - a)), shift))
    return min(found)


def test_clips_are_found_again(spark):
    """Cut, quieter and noisy clips against every offset of some recordings: at least 0.9 of what aligns is found."""
    names = {"id_column": "vec_id", "audio_column": "audio"}
    recordings = audio.melodies(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), id_column="vec_id", vector_column="embedding").cache()
    asked = audio.fingerprints(audio.clips(recordings.filter("vec_id % 20 = 0"), **names), **names).cache()
    prints = audio.fingerprints(recordings, **names).cache()
    got = {r["vec_id"]: r for r in audio.search(prints, asked, id_column="vec_id").collect()}
    unsigned = lambda r: np.array(r["print"], np.int32).view(np.uint32)
    own = {r["vec_id"]: unsigned(r) for r in prints.collect()}
    clips = {r["vec_id"]: unsigned(r) for r in asked.collect()}
    due = {i: nearest(q, own[i]) for i, q in clips.items()}
    due = {i: x for i, x in due.items() if x[0] <= audio.MOST_ERROR}
    assert len(due) >= 0.9 * len(clips) and got.keys() == clips.keys()
    right = [i for i in due if got[i]["best_id"] == i and abs(got[i]["best_offset"] - due[i][1]) <= 1]
    assert len(right) >= 0.9 * len(due)
    # a clip of one recording is no clip of another
    for i in list(clips)[:5]:
        others = sum(nearest(clips[i], own[k])[0] <= audio.MOST_ERROR for k in list(own)[:40] if k != i)
        assert others == 0 and got[i]["n_matches"] <= 2


def test_every_pair_of_a_hot_bucket_is_found(spark, monkeypatch):
    """Families of near copies whose keys others share: all recordings begin with one passage."""
    monkeypatch.setattr(audio, "RECORDINGS", 100)
    monkeypatch.setattr(audio, "QUERIES", 7)
    rng = np.random.default_rng(4)
    opening, rows = rng.normal(0, 0.4, 30), []
    for family in range(60):
        own = rng.normal(0, 0.4, 40)
        for _ in range(4):
            middle = own + rng.normal(0, 0.4, 40) * (rng.random(40) < 0.12)
            rows.append((len(rows), np.concatenate([opening, middle]).tolist()))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    prints = audio.fingerprints(audio.melodies(vectors, id_column="vec_id", vector_column="embedding"), id_column="vec_id", audio_column="audio").cache()
    got = {r["vec_id"]: (r["n_matches"], r["best_id"]) for r in audio.align(prints, F.col("vec_id") % 4 == 0, id_column="vec_id").collect()}
    own = {r["vec_id"]: np.array(r["print"], np.int32).view(np.uint32) for r in prints.collect()}
    expected = {}
    for q in got:
        near = []
        for i in own:
            if i != q:
                at = [b - a for a in range(len(own[q])) for b in np.flatnonzero(own[i] == own[q][a])]
                values, hits = np.unique(at, return_counts=True) if at else ([0], np.array([0]))
                shift = int(values[hits.argmax()])
                a, b = max(0, -shift), min(len(own[q]), len(own[i]) - shift)
                if hits.max() >= audio.LEAST_HITS and b - a >= audio.LEAST_OVERLAP:
                    error = np.bitwise_count(own[q][a:b] ^ own[i][a + shift : b + shift]).sum() / (32 * (b - a))
                    if error <= audio.MOST_ERROR:
                        near.append((error, a - b, i))
        expected[q] = (len(near), min(near)[2] if near else None)
    assert len(got) == 60 and sum(n for n, _ in expected.values()) > 60
    assert got == expected


def test_best_offsets_counts_every_position():
    query = np.array([1, 2, 2, 3], np.uint32)
    flat = np.array([9, 1, 2, 2, 3, 7, 7], np.uint32)
    hits, offset = audio._Index(flat, np.array([0, 5, 7])).best_offsets(query)
    assert hits.tolist() == [4, 0] and offset.tolist() == [1, 0]


def test_empty_and_odd(spark, prints):
    assert {r["vec_id"]: len(r["print"]) for r in prints.filter("vec_id in (60, 61, 62)").collect()} == {60: 0, 61: 0, 62: 0}
    assert audio.align(prints.limit(0), F.col("vec_id") >= 0, id_column="vec_id").count() == 0
    assert audio.align(prints.filter("vec_id in (60, 63)"), F.col("vec_id") >= 0, id_column="vec_id").count() == 2
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 1.0, float("nan")])], "vec_id long, embedding array<double>")
    assert audio.melodies(odd, id_column="vec_id", vector_column="embedding").count() == 3


def test_query(spark):
    got = queries.op9_audio(spark, SF).collect()
    n = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 20 = 0").count()
    assert len(got) == n and all(r["vec_id"] % 20 == 0 for r in got)
    assert sum(r["best_id"] == r["vec_id"] for r in got) >= 0.9 * n


def wav(samples, channels=1, bits=16, rate=audio.RATE, kind=1):
    """A WAV file of samples (frames by channels, of full scale 1)."""
    x = np.asarray(samples, float).reshape(-1, channels)
    if kind == 3:
        body = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        body = (np.round(x * 127) + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        body = np.round(x * (2**23 - 1)).astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        body = np.round(x * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    form = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    chunks = b"fmt " + struct.pack("<I", 16) + form + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def tune(rate, seconds=4):
    t = np.arange(rate * seconds) / rate
    return 0.4 * np.sin(2 * np.pi * 440 * 2 ** (np.floor(4 * t) % 7 / 12) * t) + 0.1 * np.sin(2 * np.pi * 220 * t)


@pytest.mark.parametrize(("channels", "bits", "kind"), [(1, 8, 1), (2, 16, 1), (1, 24, 1), (3, 24, 1), (1, 32, 1), (2, 32, 3), (1, 64, 3)])
def test_formats_of_wav_files(channels, bits, kind):
    plain = tune(audio.RATE)
    many = np.stack([plain * (k + 1) * 2 / (channels + 1) for k in range(channels)], axis=1)  # their mean is the plain one
    got = audio._pcm(wav(many, channels, bits, kind=kind))
    assert len(got) == len(plain) and np.abs(got / 32768 - plain).max() < (0.02 if bits == 8 else 1e-3)
    errors = np.bitwise_count(audio.integers(audio.chroma(got)) ^ audio.integers(audio.chroma((plain * 32768).astype(np.float32)))).mean() / 32
    assert errors < (0.1 if bits == 8 else 0.01)


@pytest.mark.parametrize("rate", [8000, 44_100, 48_000, 2048])
def test_other_rates(rate):
    """A file of another rate is the same recording: its print agrees."""
    want, got = (audio.integers(audio.chroma(audio._pcm(wav(tune(r), rate=r)))) for r in (audio.RATE, rate))
    assert abs(len(want) - len(got)) <= 1
    n = min(len(want), len(got))
    assert np.bitwise_count(want[:n] ^ got[:n]).mean() / 32 < 0.12


def test_pieces_make_no_difference(monkeypatch):
    data = wav(tune(8000), rate=8000)
    whole = audio._pcm(data), audio.chroma(audio._pieces(data, audio.RATE))
    monkeypatch.setattr(audio, "PIECE", 777)
    monkeypatch.setattr(audio, "FRAMES", 5)
    assert np.allclose(audio._pcm(data), whole[0], atol=1e-2) and np.allclose(audio.chroma(audio._pieces(data, audio.RATE)), whole[1], atol=1e-3)


def test_files_of_other_kinds_have_no_samples():
    good = wav(tune(audio.RATE))
    for data in (None, b"", b"R", b"RIFF", good[:30], wav([0.1] * 99, kind=7), good.replace(b"fmt ", b"xxxx")):
        assert len(audio._pcm(data)) <= 1
    assert len(audio._pcm(good[:5000])) == (5000 - len(wav([]))) // 2  # a file that was cut off
