"""Audio through stand-in models, payload scalars, and the commands."""

import json

import numpy as np
import pytest

from listenlake import cli
from listenlake.operators import listening


def test_pcm_and_patches():
    raw = np.array([[0, 16384], [-32768, 32767]], "<i2").tobytes() + b"\x00"
    assert listening.samples(raw, 2).tolist() == [[0.0, 0.5], [-1.0, 32767 / 32768]]
    tone = np.sin(2 * np.pi * 440 * np.arange(44_100 * 3) / 44_100).astype(np.float32)
    p = listening.patches(tone, 44_100)
    assert p.shape == (1, 128, 96) and p[0].mean(0).argmax() < 20
    assert listening.patches(np.zeros(10, np.float32), 16_000).shape == (1, 128, 96)


@pytest.mark.parametrize("rate", [44_100, 48_000, 22_050, 8_000, 11_025])
def test_resampling_keeps_tones(rate):
    n, to = rate, 16_000
    assert len(listening.resampled(np.zeros(n, np.float32), rate)) == -(-n * to // rate)
    for f in (50, 440, 3_000, 0.42 * min(rate, to)):
        got = listening.resampled(np.sin(2 * np.pi * f * np.arange(n) / rate + 0.3), rate)
        want = np.sin(2 * np.pi * f * np.arange(len(got)) / to + 0.3)
        inner = slice(400, len(got) - 400)
        assert np.abs(got[inner] - want[inner]).max() < 1e-3, f
    if rate > to:  # what the new rate can't hold is gone instead of folded back: under -60 dB
        for f in (8_600, 9_500, 10_700):
            got = listening.resampled(np.sin(2 * np.pi * f * np.arange(n) / rate), rate)
            assert np.abs(got[400:-400]).max() < 1e-3, f
    for short in (1, 2, 7):
        assert np.isfinite(listening.resampled(np.ones(short, np.float32), rate)).all()


def test_mel_bands_are_where_the_scale_says():
    bank = listening.mel_bank()
    f = np.fft.rfftfreq(listening.FRAME, 1 / listening.RATE)
    # Slaney's scale is linear to 1 kHz at 200 / 3 Hz a mel, then 27 mels to each factor of 6.4.
    top = 15 + 27 * np.log(8) / np.log(6.4)
    centre = np.arange(1, listening.BANDS + 1) * top / (listening.BANDS + 1)
    hertz = np.where(centre < 15, centre * 200 / 3, 1000 * np.exp((centre - 15) * np.log(6.4) / 27))
    peak = f[bank.argmax(1)]
    assert np.abs(peak - hertz).max() <= f[1] and (bank >= 0).all()
    wide = np.flatnonzero(np.diff(hertz, prepend=0) > 3 * f[1])
    assert np.allclose(bank[wide].sum(1) * f[1], 1, atol=0.05)  # unit area


def test_inference_chain(spark):
    clip = (np.random.default_rng(0).normal(size=(40_000, 1)) * 3000).astype("<i2").tobytes()
    df = spark.createDataFrame([("t", clip, 16_000, 1)], "track_id string, pcm binary, rate int, channels int")
    got = listening.infer(df, lambda x: x.mean(1), lambda v: v[:, :2], ["calm", "loud"]).first()
    assert len(got["embedding"]) == 96 and set(got["tags"]) == {"calm", "loud"} and abs(got["tags"]["calm"] - got["embedding"][0]) < 1e-5


def test_scalars_and_report(spark):
    high = spark.createDataFrame([("m1", json.dumps({"highlevel": {"mood_happy": {"all": {"happy": 0.7}}}})), ("m2", "{}")], "mbid string, document string")
    low = spark.createDataFrame([("m1", json.dumps({"rhythm": {"bpm": 120}})), ("m3", json.dumps({"rhythm": {"bpm": 90}}))], "mbid string, document string")
    got = {r["mbid"]: r for r in listening.raw_scalars(high, low).collect()}
    assert set(got) == {"m1", "m2"} and got["m1"]["bpm"] == 120 and got["m1"]["happy"] == 0.7 and not got["m2"]["hit"]
    wanted, cache = spark.createDataFrame([("m1",), ("m2",), ("m9",)], "mbid string"), spark.createDataFrame([("m9",)], "mbid string")
    r = listening.build_report(wanted, cache, listening.raw_scalars(high, low)).first()
    assert (r["asked"], r["cached"], r["fetched"], r["hits"], r["misses"]) == (3, 1, 2, 1, 1)


def test_commands(spark, tmp_path):
    root, src = str(tmp_path / "data"), tmp_path / "in"
    src.mkdir()
    base = {"ts": "2024-01-01T00:00:00Z", "ms_played": 50_000, "master_metadata_track_name": "n", "master_metadata_album_artist_name": "a", "spotify_track_uri": "spotify:track:1"}
    (src / "Streaming_History_Audio_1.json").write_text(json.dumps([base, base, base | {"ts": "2024-01-02T00:00:00Z"}]))
    for _ in range(2):
        assert cli.main(["--data-dir", root, "import-spotify", str(src)]) == 0
        assert spark.read.parquet(f"{root}/history").count() == 2
    (src / "StreamingHistory_music_0.json").write_text(json.dumps([{"endTime": "2024-01-01 10:00", "artistName": "a", "trackName": "n", "msPlayed": 1}, {"endTime": "2024-01-03 10:00", "artistName": "A", "trackName": "N", "msPlayed": 1}]))
    cli.main(["--data-dir", root, "import-account-history", str(src)])
    rows = spark.read.parquet(f"{root}/history").where("source = 'spotify_account'").collect()
    assert [r["track"]["spotify_id"] for r in rows] == ["1"]
    (src / "isrc").write_text("1\t10\tI1\n2\t99\tI2\n")
    (src / "recording").write_text("10\tg1\n")
    cli.main(["build-mb-index", "--isrc", str(src / "isrc"), "--recording", str(src / "recording"), "--out", str(tmp_path / "out")])
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["# isrc, mbid", "I1\tg1"]
