"""Hand-computed cases and properties of the listening-history operators."""

import datetime as dt
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from listenlake.functions import keys, times
from listenlake.operators import audio, density, enrich, epochs, factors, identity, library, plays, scene, store, temporal, validate
from listenlake.params import AudioParams, EpochParams, SceneParams, TemporalParams, ValidationParams
from listenlake.plans import sweep
from listenlake.sources import readers, sinks
from listenlake.streaming import imports

UTC = dt.timezone.utc


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize(("ms", "skipped", "valid"), [(29_999, None, False), (30_000, None, True), (None, None, True), (None, True, False), (None, False, True)])
def test_validity(spark, ms, skipped, valid):
    df = spark.createDataFrame([(ms, skipped)], "ms bigint, s boolean")
    assert df.select(plays.is_valid(F.col("ms"), F.col("s"))).first()[0] is valid


def test_keep_first_follows_seq_and_is_idempotent(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, seq bigint, v string")
    once = plays.keep_first(df, ["k"])
    assert rows(once, "k", "v") == [("a", "y"), ("b", "z")]
    assert rows(plays.keep_first(once, ["k"]), "k", "v") == [("a", "y"), ("b", "z")]


def test_span_is_elapsed_days(spark):
    df = spark.createDataFrame([("t", "s", dt.datetime(2024, 1, 1, 23, 59, 59)), ("t", "s", dt.datetime(2024, 1, 2, 0, 0, 1))], "track_id string, source string, played_at timestamp")
    assert plays.facts(df).first()["span_days"] == 0


def test_lift(spark):
    at = [dt.datetime(2024, 1, 3, 9)] * 12 + [dt.datetime(2024, 1, 3, 20)] * 12
    track = ["a"] * 10 + ["b"] * 2 + ["b"] * 10 + ["a"] * 2
    df = temporal.with_buckets(spark.createDataFrame(list(zip(track, at)), "track_id string, played_at timestamp"))
    members = spark.createDataFrame([("r1", "a"), ("r2", "b")], "root_id string, track_id string")
    lifts = {(r["root_id"], r["day_part"]): r for r in temporal.lift_table(df, members, params=TemporalParams(event_count_floor=3)).collect()}
    best = lifts["r1", "morning"]
    assert best["n"] == 10 and best["bucket_total"] == 12 and round(best["lift"], 3) == 1.667 and best["verdict"] == "candidate"
    assert lifts["r1", "evening"]["verdict"] == "dropped:event_count_floor"


def test_wall_clock_follows_the_rules_of_the_day(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 1, 23, 30),), (dt.datetime(2024, 4, 1, 23, 30),)], "t timestamp")
    assert [r[0].hour for r in df.select(times.wall_clock(F.col("t"), F.lit("Asia/Almaty"))).collect()] == [5, 4]


def test_two_regimes_make_epochs_that_hold_all_plays(spark):
    start = dt.datetime(2024, 1, 1)
    at = [("a", start + dt.timedelta(hours=6 * i)) for i in range(200)] + [("b", start + dt.timedelta(days=70, hours=6 * i)) for i in range(200)]
    df = spark.createDataFrame(at, "track_id string, played_at timestamp")
    members = spark.createDataFrame([("r1", "a"), ("r2", "b")], "root_id string, track_id string")
    ranges, table = epochs.detect(df, members, params=EpochParams(window_days=20, step_days=10))
    found = table.orderBy("low").collect()
    assert len(found) >= 2 and found[-1]["p_value"] is None and sum(r["n_events"] for r in found) == 400
    assert all(0 <= r["presence"] <= 1 for r in epochs.presence(df, members, ranges).collect())


def test_kolmogorov_against_published_values():
    # The public example of the matrix method: P(D_10 < 0.274) = 0.62847...
    assert abs(1 - epochs.kolmogorov_sf(0.274, 10) - 0.6284796154565043) < 1e-9
    # Half of all samples of one have D over 3/4.
    assert abs(epochs.kolmogorov_sf(0.75, 1) - 0.5) < 1e-12
    assert abs(epochs.kolmogorov_sf(0.05, 3000) - epochs.kolmogorov_sf(0.0499999, 3000)) < 1e-5


@pytest.mark.parametrize(("d", "n"), [(0.03, 3990), (0.02, 5990), (0.01, 11990)])
def test_kolmogorov_series_agrees_with_the_matrix(d, n):
    assert abs(epochs.inside_series(d, n) - epochs.inside_matrix(d, n)) < 1e-8


@pytest.mark.parametrize(("d", "n"), [(0.9, 5), (0.5, 17), (0.2, 101), (0.1, 402), (0.04, 2501)])
def test_kolmogorov_tail_agrees_with_the_matrix(d, n):
    assert abs(epochs.far_tail(d, n) - (1 - epochs.inside_matrix(d, n))) < 1e-9


BASE = dict(candidate_id="c", category="audio", evidence_count=60, coverage=0.9, confidence=0.9, stability_score=0.9, n_unique=1001, span_days=181)


@pytest.mark.parametrize(
    ("change", "verdict", "failed"),
    [
        ({}, "root", []),
        ({"evidence_count": 50}, "root", []),
        ({"evidence_count": 49}, "rejected:calibration", []),
        ({"coverage": 0.29}, "rejected:coverage_floor", ["coverage_floor"]),
        ({"coverage": 0.4}, "tendency", ["coverage_floor"]),
        ({"confidence": 0.59}, "tendency", ["confidence_floor"]),
        ({"stability_score": 0.49}, "tendency", ["temporal_stability"]),
        ({"n_unique": 1000}, "tendency", ["temporal_stability_not_evaluated"]),
        ({"stability_score": None}, "tendency", ["temporal_stability_not_evaluated"]),
    ],
)
def test_classifier(spark, change, verdict, failed):
    row = BASE | change
    df = spark.createDataFrame([tuple(row.values())], "candidate_id string, category string, evidence_count bigint, coverage double, confidence double, stability_score double, n_unique bigint, span_days bigint")
    got = validate.classify(df, ValidationParams()).first()
    assert got["verdict"] == verdict and got["failed_tests"] == failed


def test_two_blobs_are_two_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.1, (6, 4)), rng.normal(3, 0.1, (6, 4))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id bigint, x array<double>")
    got = {tuple(r["x"]): r for r in density.density_clusters(df, 5, 2).collect()}
    label = [got[tuple(p)]["cluster"] for p in x]
    assert set(label[:6]) != set(label[6:]) and len(set(label)) == 2 and -1 not in label
    assert all(0 <= r["strength"] <= 1 for r in got.values())
    assert {r["cluster"] for r in density.density_clusters(df.limit(3), 5, 2).collect()} == {-1}


def test_factors_recover_two_tag_blobs():
    x = np.zeros((12, 6))
    x[:6, :3] = x[6:, 3:] = 1
    w, h = factors.nmf(x, 2, 1000)
    assert np.allclose(w @ h, x, atol=1e-3) and (w >= 0).all() and (h >= 0).all()
    assert set(w.argmax(1)[:6]) != set(w.argmax(1)[6:])


def test_coherence_counts_pairs_that_never_meet(spark):
    tags = spark.createDataFrame([(i, t, 1.0) for i in range(4) for t in ("a", "b")] + [(9, "c", 1.0)], "doc bigint, tag string, weight double")
    top = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "c"), (2, "c")], "topic bigint, tag string")
    assert [(t, round(c, 6)) for t, c in rows(scene.coherence(top, tags), "topic", "coherence")] == [(0, 1.0), (1, -1.0), (2, 0.0)]


def test_stop_tags_and_weights(spark):
    records = spark.createDataFrame([("t", [("Rock", 5.0), ("rock", 0.0), ("Seen Live", 9.0)])], "track_id string, tags array<struct<tag:string,weight:double>>")
    assert rows(scene.doc_tags(records), "doc", "tag", "weight") == [("t", "rock", 1.0)]


def test_waterfall_prefers_covered_mbids(spark):
    refs = spark.createDataFrame([("k1", "s1", None, None), ("k2", None, "i2", None), ("k3", None, None, "m9"), ("k4", None, None, None)], "input_key string, spotify_id string, isrc string, mbid string")
    index = spark.createDataFrame([("i1", "m2"), ("i1", "m1"), ("i2", "m4"), ("i2", "m3")], "isrc string, mbid string")
    spotify = spark.createDataFrame([("s1", "i1")], "spotify_id string, isrc string")
    covered = spark.createDataFrame([("m4",)], "mbid string")
    got = identity.waterfall(refs, index, spotify, covered)
    assert sorted((r["input_key"], r["mbid"]) for r in got.collect()) == [("k1", "m1"), ("k2", "m4"), ("k3", "m9"), ("k4", None)]


def test_cache_keeps_terminal_rows_only(spark):
    refs = spark.createDataFrame([("a",), ("b",)], "input_key string")
    cache = spark.createDataFrame([("a", "m", "mbid"), ("b", None, "isrc")], "input_key string, mbid string, level string")
    done, new = identity.with_cache(refs, cache, lambda r: r.withColumn("mbid", F.lit("n")).withColumn("level", F.lit("mbid")))
    assert rows(done, "input_key", "mbid") == [("a", "m"), ("b", "n")] == rows(new, "input_key", "mbid")


def test_ttl_is_strict(spark):
    now = F.lit("2024-06-01").cast("timestamp")
    df = spark.createDataFrame([(dt.datetime(2024, 3, 3),), (dt.datetime(2024, 3, 2),)], "t timestamp")
    assert [r[0] for r in df.select(store.is_stale(F.col("t"), now)).collect()] == [False, True]


def test_unchanged_import_keeps_its_stamp(spark):
    old = spark.createDataFrame([("x", 1)], "body string, imported_at bigint")
    assert library.keep_stamp(old, old.withColumn("imported_at", F.lit(2).cast("bigint"))).first()["imported_at"] == 1
    assert library.keep_stamp(old, spark.createDataFrame([("y", 2)], "body string, imported_at bigint")).first()["imported_at"] == 2


def test_drop_ledger(spark):
    df = spark.createDataFrame([({"tracks": "[1]", "shows": "[1,2]", "empty": "[]", "note": "\"x\""},)], "root map<string,string>")
    assert rows(library.drop_ledger(df, ("tracks",)), "key", "n") == [("note", 1), ("shows", 2)]


def test_audio_buckets_are_exclusive(spark):
    records = spark.createDataFrame([("a", "m1", 1.0), ("b", None, None), ("c", "m2", None), ("d", "m3", None)], "track_id string, mbid string, bpm double")
    source = spark.createDataFrame([("m2", 9.0)], "mbid string, bpm double")
    got = enrich.enrich_audio(records, source, ("bpm",))
    assert rows(got, "track_id", "bucket", "bpm")[2] == ("c", "enriched", 9.0)
    assert rows(enrich.bucket_counts(got), "bucket", "n") == [("already_present", 1), ("enriched", 1), ("missing_features", 1), ("no_mbid", 1)]


def test_sweep_guard(spark):
    good = spark.createDataFrame([(c, 1, 2, 3) for c in ("x", "y")], "config string, low bigint, high bigint, n_events bigint")
    assert sweep.same_epochs(good).count() == 2
    bad = good.withColumn("n_events", F.when(F.col("config") == "x", 4).otherwise(F.col("n_events")))
    with pytest.raises(Exception, match="epochs differ"):
        sweep.same_epochs(bad).collect()


def test_extended_history_rejects_in_order(spark, tmp_path):
    base = {"ts": "2024-01-01T00:00:00Z", "ms_played": 5, "master_metadata_track_name": "n", "master_metadata_album_artist_name": "a", "spotify_track_uri": "spotify:track:1"}
    data = [base, base | {"spotify_episode_uri": "e", "audiobook_uri": "b"}, base | {"audiobook_uri": "b"}, {"ts": "2024"}, base | {"ts": "2022"}]
    (tmp_path / "Streaming_History_Audio_1.json").write_text(json.dumps(data))
    (tmp_path / "Streaming_History_Video_1.json").write_text(json.dumps(data))
    got = readers.extended_history(spark, str(tmp_path))
    assert [r["reason"] for r in got.orderBy("seq").collect()] == [None, "episode", "audiobook", "no_identity", "unparseable_timestamp"]
    first = readers.accepted(got).first()
    assert first["track"]["spotify_id"] == "1" and first["context"]["ms_played"] == 5
    assert rows(plays.reject_ledger(got), "reason", "n")[0] == ("audiobook", 1)


def workbook(rows_):
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r) + "</row>" for r in rows_)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f"<workbook {ns}/>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["January 02, 2024 at 03:04PM", "n", "a", "id"], ["", "", "", ""], ["January 02, 2024", "n", "a"], ["January 02, 2024 at 03:04PM"]]))
    got = readers.ifttt(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["reason"] for r in got] == [None, "empty", "unparseable_timestamp", "no_identity"]
    assert got[0]["played_at"] == dt.datetime(2024, 1, 2, 15, 4)
    for k in range(2):  # a folder that fills up
        if k:
            (tmp_path / "b.xlsx").write_bytes(workbook([["January 03, 2024 at 03:04PM", "m", "a", "id"]]))
        run = readers.ifttt(spark, str(tmp_path), stream=True).writeStream.foreachBatch(lambda batch, n: batch.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
        assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, readers.ifttt(spark, str(tmp_path)).collect()))


def test_dump_tables_and_indexes(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# c\ni1\tm1\ni1\tm2\n\ni1\tm1\nshort\n")
    assert rows(readers.index(spark, str(tmp_path / "t.tsv"), "isrc"), "isrc", "mbid") == [("i1", "m1"), ("i1", "m2")]
    assert rows(readers.index(spark, str(tmp_path / "t.tsv"), "uri", last_wins=True), "uri", "mbid") == [("i1", "m1")]
    assert readers.history(spark, str(tmp_path / "none")).count() == 0


def test_library_and_playlists(spark, tmp_path):
    (tmp_path / "YourLibrary.json").write_text(json.dumps({"tracks": [{"artist": "a", "track": "t", "uri": "u"}], "albums": [], "artists": [], "bannedArtists": [], "shows": [1, 2]}))
    lists = readers.library_lists(spark, str(tmp_path / "YourLibrary.json"))
    assert lists["tracks"].count() == 1 and lists["albums"].count() == 0
    (tmp_path / "Playlist1.json").write_text(json.dumps({"playlists": [{"name": "p", "items": [{"track": {"trackName": "t", "trackUri": "spotify:track:1"}}, {"track": {"trackName": "e", "trackUri": "spotify:episode:1"}}]}]}))
    assert [r["spotify_id"] for r in readers.playlists(spark, str(tmp_path)).orderBy("seq").collect()] == ["1", None]


def test_replace_never_reads_what_it_writes(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.range(3).write.parquet(path)
    sinks.replace(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_streaming_import_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    line = json.dumps({"track": {"name": "n", "artist": "a"}, "played_at": "2024-01-01T00:00:00Z", "source": "ifttt"})
    (src / "a.json").write_text(line + "\n" + line + "\n")
    for k in range(2):
        imports.import_events(spark, str(src), out, str(tmp_path / f"c{k}"), ["played_at", "source"]).awaitTermination()
        assert spark.read.parquet(out).count() == 1


def test_percent_codes_and_casefold(spark):
    df = spark.createDataFrame([("a b*~ß",)], "s string")
    assert df.select(keys.quoted(F.col("s"))).first()[0] == "a%20b%2A~%C3%9F"
    assert df.select(keys.casefold(F.col("s"))).first()[0] == "a b*~ss"


def test_scene_stage_on_tag_blobs(spark):
    tags = spark.createDataFrame([(f"d{i:02d}", t, 1.0) for i in range(12) for t in (("a", "b", "c") if i < 6 else ("x", "y", "z"))], "doc string, tag string, weight double")
    w = scene.factor(tags, SceneParams(k_grid=(2,)))
    assigned = scene.assign(w.where("part = 'doc'").select(F.col("name").alias("doc"), "topic", "weight"))
    assert sorted(r["n"] for r in assigned.groupBy("topic").agg(F.count("*").alias("n")).collect()) == [6, 6]


def test_audio_stage_describes_two_clusters(spark):
    data = [(f"t{i:02d}", *(((90.0, 0.1, 0.1, 0.1) if i < 6 else (150.0, 0.9, 0.9, 0.9))), 0.5, 0.5 if i % 2 else None, 1) for i in range(12)]
    data = [(r[0], *(x + i * 0.001 if isinstance(x, float) else x for x in r[1:5]), *r[5:]) for i, r in enumerate(data)]
    records = spark.createDataFrame(data, "track_id string, bpm double, energy double, valence double, danceability double, acousticness double, instrumentalness double, user_id bigint")
    played = spark.createDataFrame([(r[0], dt.datetime(2024, 1, 1 + d)) for r in data for d in range(4)], "track_id string, played_at timestamp")
    params = AudioParams(min_cluster_size=5, min_samples=2)
    found = audio.describe(audio.cluster(records, params), played, params).collect()
    assert [(r["cluster_size"], r["coverage"], r["stability_score"]) for r in found] == [(6, 0.5, 1.0)] * 2
    assert sorted(r["band_bpm"] for r in found) == ["high", "low"]


def test_sweep_has_the_floors_of_the_reference():
    floors = [(ms * 1000, False) for ms in (0, 5, 10, 20, 30, 45, 60, 90)]
    assert list(sweep.CONFIGS) == [*floors, (30_000, True)]
