"""Sources, writers, commands and the whole chain from raw events to a profile."""

import base64
import datetime as dt
import io
import json
import zipfile

from pyspark.sql import functions as F

from listenlake import cli
from listenlake.functions import keys
from listenlake.operators import enrich, identity, library, temporal
from listenlake.params import AudioParams, SceneParams, ValidationParams
from listenlake.plans import analyze as plan
from listenlake.plans import sweep
from listenlake.shared import drop_since, made, stored
from listenlake.sources import readers, sinks
from listenlake.streaming import imports
from listenlake.zones import country_zones


def test_folding_is_full_case_folding(spark):
    letters = [chr(c) for c in range(0x20, 0x2FFFF) if not 0xD800 <= c < 0xE000 and chr(c).isprintable() and chr(c).isalpha()]
    words = ["".join(letters[i : i + 50]) for i in range(0, len(letters), 50)] + ["Straße ΣΑΣ İ ﬁ", "plain ASCII", "", "𐐀𝒳"]
    got = spark.createDataFrame(list(enumerate(words)), "i int, s string").select("s", keys.folded(F.col("s")).alias("f")).collect()
    wrong = [(r["s"], r["f"]) for r in got if r["f"] != r["s"].casefold() and r["s"].lower().replace("ς", "σ") == "".join(c.lower() for c in r["s"]).replace("ς", "σ")]
    # Letters that the Java runtime's Unicode tables don't have yet stay as they are.
    known = [(a, b) for s, f in wrong for a, b in zip(s.casefold(), f) if a != b and b.casefold() != a]
    assert not known
    assert [r["f"] for r in got[-4:]] == [w.casefold() for w in words[-4:]]


def test_the_active_sheet_is_the_workbooks_own(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        for n in (1, 2):
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>s{n}</t></is></c></row></sheetData></worksheet>')
    assert readers.sheet_rows(out.getvalue()) == [["s1"]]


def test_account_library_and_its_files(spark, tmp_path):
    empty, dropped = readers.account_library(spark, str(tmp_path), F.current_timestamp())
    row = empty.first()
    assert row["liked_tracks"] == [] and row["marquee"] == [] and dropped.count() == 0
    (tmp_path / "YourLibrary.json").write_text(json.dumps({"tracks": [{"artist": " a ", "track": "t", "uri": "spotify:track:9", "album": ""}], "albums": [], "artists": [{"name": "x", "uri": "u"}], "bannedArtists": [], "shows": [1, 2]}))
    (tmp_path / "Playlist1.json").write_text(json.dumps({"playlists": [{"name": "p", "items": [{"track": {"trackName": "t", "trackUri": "spotify:track:1"}}, {"track": {"trackName": "e", "trackUri": "spotify:episode:1"}}]}]}))
    (tmp_path / "Marquee.json").write_text(json.dumps([{"artistName": "m", "segment": "s"}]))
    full, dropped = readers.account_library(spark, str(tmp_path), F.current_timestamp())
    row = full.first()
    assert row["liked_tracks"][0].asDict() == {"spotify_id": "9", "name": "t", "artist": "a", "album": None}
    assert [i["spotify_id"] for i in row["playlist_items"]] == ["1"] and row["marquee"][0]["artist"] == "m"
    assert {r["key"]: r["n"] for r in dropped.collect()} == {"shows": 2, "non_track_playlist_uris": 1}


def test_small_readers(spark, tmp_path):
    (tmp_path / "ids").mkdir()
    for name, text in (("a", '{"mbid": "m2", "level": "mbid"}'), ("b", '{"mbid": "m1"}'), ("c", "{torn"), ("d", '{"mbid": ""}')):
        (tmp_path / "ids" / f"{name}.json").write_text(text)
    assert [r[0] for r in readers.identity_mbids(spark, str(tmp_path / "ids")).collect()] == ["m1", "m2"]
    assert readers.identity_mbids(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "model.json").write_text(json.dumps({"classes": ["x", "y"]}))
    assert readers.model_labels(spark, str(tmp_path / "model.onnx")) == ["x", "y"] and readers.model_labels(spark, str(tmp_path / "other.onnx")) == []
    (tmp_path / "feat").write_text('{"mbid": "m", "bpm": 1}\n{"mbid": "m", "bpm": 2}\n')
    assert readers.features(spark, str(tmp_path / "feat")).first()["bpm"] == 2.0
    (tmp_path / "rec").write_text('{"track_id": "t", "name": "old"}\n{"track_id": "t", "name": "new"}\n')
    assert readers.store_records(spark, str(tmp_path / "rec")).first()["name"] == "new"


def test_writers(spark, tmp_path):
    path = str(tmp_path / "p")
    for snapshot in ("u/1", "u/2"):
        sinks.profiles(spark.createDataFrame([(snapshot, 1)], "snapshot_id string, x int"), path)
    assert json.loads(sinks.latest_profile(spark, path).first()["value"])["snapshot_id"] == "u/2"
    assert json.loads(sinks.profile(spark, path, "u/1").first()["value"])["x"] == 1
    sinks.audio_analyses(spark.createDataFrame([("t/1", [0.5], {"a": 1.0})], "track_id string, embedding array<float>, tags map<string,double>"), str(tmp_path / "audio"))
    assert (tmp_path / "audio" / "snapshot=t_1").exists()
    scalars = spark.createDataFrame([("m1", True, 0.5, None), ("m2", False, None, None)], "mbid string, hit boolean, happy double, bpm double")
    sinks.append_raw(scalars, str(tmp_path / "raw"))
    sinks.append_raw(scalars.where("mbid = 'm1'").withColumn("happy", F.lit(0.75)), str(tmp_path / "raw"))
    cache = {r["mbid"]: r["scalars"] for r in readers.raw_cache(spark, str(tmp_path / "raw")).collect()}
    assert cache["m2"] is None and json.loads(cache["m1"])["happy"] == 0.75
    sinks.index_tsv(spark.createDataFrame([(2, "a", "x"), (1, "z", "y")], "seq bigint, k string, v string"), str(tmp_path / "i"), "k, v")
    assert [r[0] for r in spark.read.text(str(tmp_path / "i")).collect()] == ["# k, v", "z\ty", "a\tx"]


def test_a_crash_between_the_moves_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "h")
    sinks.replace(spark.range(3), path)
    (tmp_path / "h").rename(tmp_path / "h.old")
    sinks.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    sinks.replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "h.old").exists()


def test_shared_tables_are_dropped(spark):
    mark = made()
    a, b = stored(spark.range(2), "a"), stored(spark.range(3), "b")
    drop_since(spark, mark, (b,))
    assert b.count() == 3 and made() == mark + 1 and a.shared_path != b.shared_path


def test_batches_and_seams(spark):
    sizes = []
    df = spark.createDataFrame([(f"k{i % 60}",) for i in range(200)], "mbid string").coalesce(1)
    got = enrich.batched(df, lambda ks: [(k, str(len(ks))) for k in ks]).collect()
    sizes = [int(r["document"]) for r in got]
    assert len(got) == 60 and max(sizes) <= 25
    index = spark.createDataFrame([("i1", "m1")], "isrc string, mbid string")
    playing = spark.createDataFrame([("s1", "t", "a")], "spotify_id string, title string, artist string")
    found = identity.now_playing(playing, index, spark.createDataFrame([("s1", "i1")], "spotify_id string, isrc string")).first()
    assert (found["mbid"], found["level"], found["canonical_id"]) == ("m1", "mbid", "mbid:m1")
    assert identity.now_playing(playing.limit(0), index).count() == 0


def events(spark):
    rows = []
    for t in range(24):
        for k in range(6):
            rows.append((t * 10 + k, f"s{t}", None, None, f"n{t}", f"Art {t % 3}", dt.datetime(2024, 1 + k, 1 + t, 20), "spotify_extended", 60_000, False, "DE"))
    return spark.createDataFrame(rows, "seq bigint, spotify_id string, isrc string, mbid string, name string, artist string, played_at timestamp, source string, ms_played bigint, skipped boolean, conn_country string")


def test_from_raw_events_to_a_profile(spark):
    raw = events(spark)
    isrcs = spark.createDataFrame([(f"s{t}", f"i{t}") for t in range(24)], "spotify_id string, isrc string")
    index = spark.createDataFrame([(f"i{t}", f"m{t:02d}") for t in range(22)], "isrc string, mbid string")
    ddl = "mbid string, bpm double, energy double, valence double, danceability double, acousticness double, instrumentalness double"
    features = spark.createDataFrame([(f"m{t:02d}", *(x + t * 0.001 for x in ((90.0, 0.1, 0.1, 0.1) if t < 12 else (150.0, 0.9, 0.9, 0.9))), 0.5, 0.5) for t in range(20)], ddl)
    tags = spark.createDataFrame([(f"art {a}", [(t, 1.0) for t in (("x", "y") if a < 2 else ("p", "q"))]) for a in range(3)], "key string, tags array<struct<tag:string,weight:double>>")
    inputs, counts = plan.enriched(raw, country_zones(spark), index, features, (tags,), isrcs)
    assert counts["identity"].first()["n_mbid"] == 22
    assert {r["bucket"]: r["n"] for r in counts["audio"].collect()} == {"enriched": 20, "missing_features": 2, "no_mbid": 2}
    assert {r["bucket"]: r["n"] for r in counts["tags"].collect()} == {"enriched": 24}
    profile = plan.analyze(inputs, AudioParams(min_cluster_size=5, min_samples=2), SceneParams(k_grid=(2, 3)), validation=ValidationParams(evidence_count=5))
    document = json.loads(profile.document("u/1", counts).select(F.to_json(F.struct("*"))).first()[0])
    assert json.loads(document["generated_from"])[0]["n_unique"] == 24 and "k_grid" in document["method_params"]
    described = json.loads(document["descriptors"])
    assert {d["candidate_id"][:3] for d in described} <= {"r-a", "r-s", "r-t"}
    hints = {d["candidate_id"][:3]: json.loads(d["descriptor"])["hint"] for d in described}
    assert {"r-a", "r-s"} <= set(hints) and hints["r-s"].startswith("look for artists")
    log = json.loads(document["quality_log"])
    assert log == sorted(log, key=lambda e: (e["stage"], e["phase"]))
    assert set(profile.members.columns) == {"root_id", "track_id"} and sweep.surviving(profile) is profile.members
    # The sweep runs audio and scene once, and its members are those of the analysis.
    swept = sweep.sweep(inputs, sweep.CONFIGS[:2], AudioParams(min_cluster_size=5, min_samples=2), SceneParams(k_grid=(2, 3)), validation=ValidationParams(evidence_count=5)).collect()
    assert [r["rate"] for r in swept] == [1.0, 1.0] and swept[0]["n"] > 0
    alone, _ = plan.enriched(raw, country_zones(spark), index, None)
    assert plan.analyze(alone).classified.count() == 0


def test_low_coherence_is_logged(spark):
    from listenlake.operators import scene

    scored = spark.createDataFrame([(2, 0, 0.1), (2, 1, 0.15), (2, 2, 0.9)], "k bigint, topic bigint, coherence double")
    top = spark.createDataFrame([(2, 0, 2, "b"), (2, 0, 1, "a")], "k bigint, topic bigint, rank bigint, tag string")
    got = scene.coherence_log(scored, top, 0.15).collect()
    assert [(r["candidate_id"], r["failed_test"]) for r in got] == [("q-scene-0", "coherence_floor")]
    assert json.loads(got[0]["details"]) == {"coherence": 0.1, "floor": 0.15, "K": 2, "top_tags": ["a", "b"]}
    assert scene.stop_tags("v9") == ()


def test_candidate_verdicts(spark):
    bucket = ("evening", "weekday", "winter")
    # root: all floors hold; tendency: too little confidence; rejected by the classifier: too few events.
    rows = [("a", 60, 0.9, 1.5, 0.8, "candidate"), ("b", 60, 0.2, 1.4, 0.8, "candidate"), ("c", 40, 0.9, 2.0, 0.8, "candidate"), ("d", 60, 0.9, 1.1, 0.8, "rejected:lift_floor"), ("e", 3, 0.9, 9.0, 0.8, "dropped:event_count_floor")]
    lifts = spark.createDataFrame([(r, *bucket, n, 100, 200, 0.5, p, lift, b, v) for r, n, p, lift, b, v in rows], "root_id string, day_part string, weekday_kind string, season string, n bigint, events_r bigint, bucket_total bigint, p_root_overall double, p_root_given_bucket double, lift double, balance double, verdict string")
    facts = spark.createDataFrame([(2000, 400)], "n_unique bigint, span_days bigint")
    got = {r["pair"][0]: (r["verdict"], r["lift"], r["evidence_count"]) for r in sweep.candidate_verdicts(lifts, facts).collect()}
    told = {r["candidate_id"]: json.loads(r["descriptor"]) for r in temporal.descriptors(lifts).collect()}
    assert told["r-temporal-1"]["hint"] == "play more of a in the evening weekday winter: 1.5 times its usual share"
    assert told["r-temporal-1"]["time_bucket"] == dict(zip(temporal.BUCKET, bucket, strict=True)) and len(told) == 3
    assert got == {"a": ("root", 1.5, 60), "b": ("tendency", 1.4, 60), "d": ("rejected:lift_floor", 1.1, 60), "e": ("dropped:event_count_floor", None, 3)}


def test_sweep_report(spark, tmp_path):
    played = events(spark).select("seq", F.col("spotify_id").alias("track_id"), "played_at", "ms_played", "skipped")
    members = spark.createDataFrame([("r1", "s1"), ("r1", "s2")], "root_id string, track_id string")
    found = sweep.report(played, members, sweep.CONFIGS[:2])
    assert [r["rate"] for r in found.orderBy("min_ms").collect()] == [1.0, 1.0]
    sweep.write_report(found, str(tmp_path / "r"))
    assert len(json.loads(spark.read.text(str(tmp_path / "r")).first()[0])) == 2


def test_stream_appends_what_is_new(spark, tmp_path):
    out, batch = str(tmp_path / "h"), events(spark).select(F.struct("name", "artist").alias("track"), "played_at", "source", "seq")
    merge = imports.merge_into(out, ["played_at", "source"])
    merge(batch.limit(30), 0)
    files = set(p.name for p in (tmp_path / "h").glob("*.parquet"))
    merge(batch, 1)
    merge(batch, 1)
    assert spark.read.parquet(out).count() == batch.select("played_at").distinct().count()
    assert files <= set(p.name for p in (tmp_path / "h").glob("*.parquet"))  # nothing is rewritten
    imports.compact(spark, out, 1)
    assert len(list((tmp_path / "h").glob("*.parquet"))) == 1
    late = imports.before_cutoff(batch.withColumn("source", F.lit("spotify_account")), F.lit(dt.datetime(2024, 3, 1)))
    assert late.agg(F.min("played_at")).first()[0] > dt.datetime(2024, 3, 1)


def test_stream_operators(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def put(name, *rows):
        (src / name).write_text("".join(json.dumps({"stream": s, "at": a, "seconds": d, "frame": base64.b64encode(f"{s}{a}".encode()).decode()}) + "\n" for s, a, d in rows))

    put("1.json", ("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 2.0), ("b", 1.0, 9.0))
    frames = spark.readStream.schema("stream string, at double, seconds double, frame binary").json(str(src))
    try:
        for k in range(2):
            if k:
                put("2.json", ("a", 4.0, 1.0), ("b", 2.0, 1.0))
            run = imports.ring_buffer(frames, 4.0).writeStream.foreachBatch(lambda batch, n: batch.write.mode("append").parquet(str(tmp_path / "ring"))).outputMode("update")
            run = run.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
            run.awaitTermination()
            changes = spark.read.parquet(str(tmp_path / "ring"))
            held = sorted((r["stream"], r["at"], bytes(r["frame"]).decode()) for r in imports.ring_contents(changes).collect())
            assert held == [[("a", 2.0, "a2.0"), ("a", 3.0, "a3.0"), ("b", 1.0, "b1.0")], [("a", 3.0, "a3.0"), ("a", 4.0, "a4.0"), ("b", 2.0, "b2.0")]][k]
            # A batch writes its own frames and evictions, not the buffer.
            assert changes.count() == [5, 9][k]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    plays = tmp_path / "plays"
    plays.mkdir()
    (plays / "f.json").write_text("".join(json.dumps({"k": k, "played_at": f"2024-01-0{d}T00:00:00Z"}) + "\n" for k, d in ((1, 1), (1, 1), (2, 2))))
    stream = spark.readStream.schema("k bigint, played_at timestamp").json(str(plays))
    run = imports.without_repeats(stream, ["k"]).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    run.awaitTermination()
    assert spark.table("once").count() == 2
    run = imports.window_counts(stream, "2 days", "1 day").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    run.awaitTermination()
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [1, 2, 3]


def test_more_commands(spark, tmp_path):
    root, src = str(tmp_path / "data"), tmp_path / "in"
    src.mkdir()
    base = {"ms_played": 50_000, "master_metadata_track_name": "n", "master_metadata_album_artist_name": "a"}
    (src / "Streaming_History_Audio_1.json").write_text(json.dumps([base | {"ts": f"2024-01-0{d}T00:00:00Z", "spotify_track_uri": f"spotify:track:{d}"} for d in (1, 2, 3)]))
    cli.main(["--data-dir", root, "import-spotify", str(src)])
    (src / "index.tsv").write_text("# isrc, mbid\ni1\tm1\ni2\tm2\n")
    (src / "isrcs.json").write_text("".join(json.dumps({"spotify_id": str(d), "isrc": f"i{d}"}) + "\n" for d in (1, 2, 3)))
    cli.main(["--data-dir", root, "resolve", "--mb-index", str(src / "index.tsv"), "--spotify-isrcs", str(src / "isrcs.json")])
    assert sorted(r["mbid"] for r in spark.read.parquet(f"{root}/identity").collect()) == ["m1", "m2"]
    (src / "high").write_text(json.dumps({"m1": {"0": {"highlevel": {"mood_happy": {"all": {"happy": 0.7}}}}}, "mbid_mapping": {}}) + "\n")
    (src / "low").write_text(json.dumps({"m1": {"0": {"rhythm": {"bpm": 120}}}}) + "\n")
    for _ in range(2):  # the second time nothing is missing
        cli.main(["--data-dir", root, "build-ab-index", "--high", str(src / "high"), "--low", str(src / "low"), "--out", str(tmp_path / "features")])
        assert [(r["mbid"], r["bpm"], r["valence"]) for r in readers.features(spark, str(tmp_path / "features")).collect()] == [("m1", 120.0, 0.7)]
    assert spark.read.text(f"{root}/acousticbrainz_raw").count() == 2
    (src / "YourLibrary.json").write_text(json.dumps({"tracks": [{"artist": "a", "track": "t", "uri": "spotify:track:9"}], "albums": [], "artists": [], "bannedArtists": []}))
    stamps = []
    for _ in range(2):
        cli.main(["--data-dir", root, "import-account", str(src)])
        stamps.append(spark.read.json(f"{root}/library").first()["imported_at"])
    assert stamps[0] == stamps[1]
    cli.main(["--data-dir", root, "analyze", "--user", "u", "--mb-index", str(src / "index.tsv"), "--spotify-isrcs", str(src / "isrcs.json"), "--with-audio", "--features", str(tmp_path / "features")])
    assert json.loads(sinks.latest_profile(spark, f"{root}/profiles").first()["value"])["schema_version"] == "v0"
    assert library.content_hash(spark.range(1)) is not None
