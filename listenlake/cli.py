"""Commands: imports, index builds, resolution and analysis over Parquet tables in a data folder."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake import schema
from listenlake.functions.keys import track_id
from listenlake.operators import identity, library, listening, plays
from listenlake.plans.analyze import analyze, enriched
from listenlake.shared import stored
from listenlake.sources import readers, sinks
from listenlake.zones import country_zones

KEYS = ["track_key", "played_at"]


def data_root(given: str | None) -> str:
    return given or os.environ.get("LISTENLAKE_DATA") or "data"


def load(spark: SparkSession, root: str) -> DataFrame:
    ddl = f"{schema.EVENT}, track_key string, seq struct<file:string,row:bigint>"
    return readers.or_empty(spark, lambda: spark.read.schema(ddl).parquet(f"{root}/history"), ddl)


def keyed(events: DataFrame) -> DataFrame:
    t = [F.col(f"track.{c}") for c in ("spotify_id", "isrc", "mbid", "name", "artist")]
    return events.withColumn("track_key", track_id(*t)).withColumn("seq", F.struct(F.col("seq.file").alias("file"), F.col("seq.row").cast("bigint").alias("row")))


def import_rows(spark: SparkSession, root: str, found: DataFrame, replace: bool) -> None:
    """Merge accepted rows into the history and print the reject ledger; a full export replaces older sources."""
    found = found.cache()
    plays.reject_ledger(found).show(truncate=False)
    sinks.recover(spark, f"{root}/history")
    old = load(spark, root)
    kept = plays.supersede(old) if replace else old
    new = keyed(readers.accepted(found))
    if replace:
        lost = plays.lost_by_import(old, new).first()["n_older"]
        if lost:
            print(f"warning: {lost} plays of the prior export are older than all that is imported")
    sinks.replace(plays.merge_history(kept.select(*new.columns), new, KEYS), f"{root}/history")


def isrc_index(spark: SparkSession, given: str | None) -> DataFrame:
    """The index at a path or in LISTENLAKE_ISRC_INDEX; empty without either."""
    path = given or os.environ.get("LISTENLAKE_ISRC_INDEX")
    empty = spark.createDataFrame([], "isrc string, mbid string")
    return readers.index(spark, path, "isrc").select("isrc", "mbid") if path else empty


def raw_events(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root).select("seq", "track.spotify_id", "track.isrc", "track.mbid", "track.name", "track.artist", "played_at", "source", "context.ms_played", "context.skipped", "context.conn_country")


def spotify_isrcs(spark: SparkSession, given: str | None) -> DataFrame | None:
    """spotify_id, isrc as JSON lines: what a client of the live service has found."""
    return spark.read.schema("spotify_id string, isrc string").json(given) if given else None


def analyze_root(spark: SparkSession, root: str, args: argparse.Namespace) -> None:
    features = readers.features(spark, args.features) if args.features else None
    ddl = "key string, tags array<struct<tag:string,weight:double>>"
    sources = tuple(spark.read.schema(ddl).json(p) for p in args.tags or ())
    inputs, diagnostics = enriched(raw_events(spark, root), country_zones(spark), isrc_index(spark, args.mb_index), features if args.with_audio else None, sources if args.with_scene else (), spotify_isrcs(spark, args.spotify_isrcs))
    profile = analyze(inputs)
    sinks.profiles(profile.document(f"{args.user}/{spark.sql('select current_timestamp()').first()[0].isoformat()}", diagnostics), f"{root}/profiles")


def resolve_root(spark: SparkSession, root: str, args: argparse.Namespace) -> None:
    """Resolve all tracks of the history, keep those that reached an MBID in the identity cache, and print the levels."""
    refs = stored(identity.track_refs(raw_events(spark, root)), "refs")
    ddl = "input_key string, spotify_id string, isrc string, mbid string, name string, artist string, level string, canonical_id string"
    cache = readers.or_empty(spark, lambda: spark.read.schema(ddl).parquet(f"{root}/identity"), ddl)
    found = spotify_isrcs(spark, args.spotify_isrcs)
    done, kept = identity.with_cache(refs, cache, lambda r: identity.resolve(r, isrc_index(spark, args.mb_index), found))
    identity.level_report(stored(done, "resolved")).show(truncate=False)
    sinks.replace(kept, f"{root}/identity")


def import_account(spark: SparkSession, root: str, args: argparse.Namespace) -> None:
    """Write the library of an account export (with its old stamp where nothing changed), and print what was dropped and what is new."""
    document, dropped = readers.account_library(spark, args.path, F.current_timestamp())
    document = stored(document, "library")
    dropped.show(truncate=False)
    path = f"{root}/library"
    sinks.recover(spark, path)
    prior = readers.or_empty(spark, lambda: spark.read.schema(document.schema).json(path), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in document.schema))
    keys = [d.select(F.explode("liked_tracks").alias("t")).select(F.lit("liked_tracks").alias("kind"), F.coalesce("t.spotify_id", "t.name").alias("key")) for d in (prior, document)]
    library.diff_counts(*keys).show(truncate=False)
    sinks.replace(stored(library.keep_stamp(prior, document), "library"), path, "json")
    index = args.artist_index or os.environ.get("LISTENLAKE_ARTIST_INDEX")
    if index:
        followed = document.select(F.explode("followed_artists").alias("a")).select(F.coalesce("a.uri", "a.name").alias("key"), "a.uri", "a.name")
        identity.artist_waterfall(followed, readers.index(spark, index, "uri", last_wins=True)).groupBy(F.col("mbid").isNotNull().alias("resolved")).count().show()


def build_ab_index(spark: SparkSession, root: str, args: argparse.Namespace) -> None:
    """Scalars of resolved MBIDs that the raw cache does not have, from files of service answers; then the features file, whole."""
    cache_path = args.raw_cache or f"{root}/acousticbrainz_raw"
    resolved = readers.or_empty(spark, lambda: spark.read.schema("mbid string").parquet(f"{root}/identity"), "mbid string").where("mbid is not null").distinct()
    wanted = resolved.unionByName(readers.identity_mbids(spark, f"{root}/identity_cache")).distinct()
    cache = stored(readers.raw_cache(spark, cache_path), "cache")
    missing = stored(wanted.join(cache.select("mbid"), "mbid", "left_anti"), "missing")
    high, low = (readers.response_documents(spark.read.text(p).withColumnRenamed("value", "payload")).join(missing, "mbid", "left_semi") for p in (args.high, args.low))
    found = listening.raw_scalars(high, low)
    scalars = stored(missing.join(found, "mbid", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "scalars")
    listening.build_report(wanted, cache, scalars).show(truncate=False)
    sinks.append_raw(scalars, cache_path)
    names = [*listening.HIGH, *listening.LOW]
    known = readers.raw_cache(spark, cache_path).where("scalars is not null")
    sinks.write_features(known.select("mbid", *(F.get_json_object("scalars", f"$.{n}").try_cast("double").alias(n) for n in names)), args.out)


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="listenlake")
    parser.add_argument("--data-dir")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("import-ifttt", "import-spotify", "import-account-history"):
        commands.add_parser(name).add_argument("path")
    sub = commands.add_parser("analyze")
    sub.add_argument("--user", default="user")
    sub.add_argument("--with-audio", action="store_true")
    sub.add_argument("--with-scene", action="store_true")
    sub.add_argument("--features", default=os.environ.get("LISTENLAKE_FEATURES"))
    sub.add_argument("--tags", action="append")
    for command in (sub, commands.add_parser("resolve")):
        command.add_argument("--mb-index")
        command.add_argument("--spotify-isrcs")
    sub = commands.add_parser("import-account")
    sub.add_argument("path")
    sub.add_argument("--artist-index")
    sub = commands.add_parser("build-ab-index")
    for name in ("--high", "--low", "--out"):
        sub.add_argument(name, required=True)
    sub.add_argument("--raw-cache")
    for name, inputs in (("build-mb-index", ("isrc", "recording")), ("build-artist-index", ("url", "l_artist_url", "artist"))):
        sub = commands.add_parser(name)
        for i in inputs:
            sub.add_argument(f"--{i}", required=True)
        sub.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    spark, root = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), data_root(args.data_dir)
    if args.command == "import-ifttt":
        import_rows(spark, root, readers.ifttt(spark, args.path), False)
    elif args.command == "import-spotify":
        import_rows(spark, root, readers.extended_history(spark, args.path), True)
    elif args.command == "import-account-history":
        old = load(spark, root).select("source", "played_at", "track.spotify_id", "track.name", "track.artist")
        cutoff = old.where("source = 'spotify_extended'").agg(F.max("played_at").alias("cutoff"))
        import_rows(spark, root, readers.account_history(spark, args.path, identity.spotify_lookup(old).where("n_ids = 1"), cutoff), False)
    elif args.command == "analyze":
        analyze_root(spark, root, args)
    elif args.command == "resolve":
        resolve_root(spark, root, args)
    elif args.command == "import-account":
        import_account(spark, root, args)
    elif args.command == "build-ab-index":
        build_ab_index(spark, root, args)
    elif args.command == "build-mb-index":
        isrcs = readers.tsv(spark, args.isrc, {"recording_id": 1, "isrc": 2})
        sinks.index_tsv(identity.isrc_pairs(isrcs, readers.tsv(spark, args.recording, {"recording_id": 0, "gid": 1})).select("seq", "isrc", "mbid"), args.out, "isrc, mbid")
    else:
        urls = readers.tsv(spark, args.url, {"url_id": 0, "url": 1}).drop("seq")
        links = readers.tsv(spark, args.l_artist_url, {"artist_id": 2, "url_id": 3})
        sinks.index_tsv(identity.artist_pairs(urls, links, readers.tsv(spark, args.artist, {"artist_id": 0, "gid": 1}).drop("seq")), args.out, "uri, mbid")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
