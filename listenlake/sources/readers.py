"""Readers of export files. Every reader gives one frame with ``seq`` (file, then row) and a reject ``reason``; accepted rows have none."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from listenlake import schema
from listenlake.functions.keys import filled, folded, text, uri_tail
from listenlake.operators import library
from listenlake.functions.times import parse_iso, parse_long_date, parse_minutes


SEQ = "struct<time:timestamp,file:string,block:bigint,row:bigint>"


def or_empty(spark: SparkSession, read, ddl: str) -> DataFrame:
    """``read()``, or an empty frame where its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], ddl)
        raise


def history(spark: SparkSession, path: str) -> DataFrame:
    """The event log, one JSON object a line; blank lines are skipped and a missing path is empty."""
    return or_empty(spark, lambda: spark.read.schema(schema.EVENT).json(path), schema.EVENT)


def json_array(spark: SparkSession, path: str, ddl: str, glob: str) -> DataFrame:
    """Rows of JSON array files with ``seq``: the file name, then the place in it."""
    files = spark.read.option("pathGlobFilter", glob).option("wholetext", True).text(path)
    named = files.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"array<struct<{ddl}>>").alias("rows"))
    return named.select("file", F.posexplode("rows").alias("row", "r")).select(F.struct("file", "row").alias("seq"), "r.*")


def event(spotify_id: Column, name: Column, artist: Column, album: Column, context: Column) -> list[Column]:
    nothing = F.lit(None).cast("string")
    track = F.struct(spotify_id.alias("spotify_id"), nothing.alias("isrc"), nothing.alias("mbid"), name.alias("name"), artist.alias("artist"), filled(album).alias("album"))
    return [track.alias("track"), context.cast(schema.CONTEXT).alias("context")]


EXTENDED = "ts:string,ms_played:string,master_metadata_track_name:string,master_metadata_album_artist_name:string,master_metadata_album_album_name:string,spotify_track_uri:string,spotify_episode_uri:string,audiobook_uri:string,skipped:boolean,incognito_mode:boolean,conn_country:string"


def whole_number(value: Column) -> Column:
    """A JSON integer; anything else is null."""
    return F.when(value.rlike(r"^-?\d+$"), value.cast("bigint"))


def extended_history(spark: SparkSession, path: str) -> DataFrame:
    """The full export; files of videos do not match the name pattern."""
    rows = json_array(spark, path, EXTENDED, "Streaming_History_Audio_*.json")
    name, artist, uri = (text(F.col(c)) for c in ("master_metadata_track_name", "master_metadata_album_artist_name", "spotify_track_uri"))
    at = parse_iso(text(F.col("ts")))
    reason = F.when(filled(text(F.col("spotify_episode_uri"))).isNotNull(), "episode").when(filled(text(F.col("audiobook_uri"))).isNotNull(), "audiobook").when((name == "") & (artist == "") & (uri == ""), "no_identity").when(at.isNull(), "unparseable_timestamp")
    context = F.struct(whole_number(F.col("ms_played")).alias("ms_played"), "skipped", F.col("incognito_mode").alias("incognito"), filled(F.col("conn_country")).alias("conn_country"))
    return rows.select("seq", *event(uri_tail(uri), name, artist, text(F.col("master_metadata_album_album_name")), context), at.alias("played_at"), F.lit("spotify_extended").alias("source"), reason.alias("reason"), F.col("ts").alias("raw_time"))


def account_history(spark: SparkSession, path: str, lookup: DataFrame | None = None, cutoff: DataFrame | None = None) -> DataFrame:
    """The thin play log of a folder; see ``account_rows``."""
    return account_rows(json_array(spark, path, "endTime:string,artistName:string,trackName:string,msPlayed:string", "StreamingHistory_music_*.json"), lookup, cutoff)


def account_rows(rows: DataFrame, lookup: DataFrame | None = None, cutoff: DataFrame | None = None) -> DataFrame:
    """Thin play log rows as events; ids come from a lookup of unambiguous names. ``cutoff`` (one row, cutoff): plays up to then are another export's and rejected as before_cutoff."""
    name, artist, at = text(F.col("trackName")), text(F.col("artistName")), parse_minutes(text(F.col("endTime")))
    reason = F.when((name == "") & (artist == ""), "no_identity").when(at.isNull(), "unparseable_timestamp")
    nothing = F.lit(None)
    if cutoff is not None:
        rows = rows.crossJoin(F.broadcast(cutoff.select("cutoff")))
        reason = reason.when(at <= F.col("cutoff"), "before_cutoff")
    rows = rows.withColumn("name_key", folded(name)).withColumn("artist_key", folded(artist))
    rows = rows.join(lookup.select("name_key", "artist_key", "spotify_id"), ["name_key", "artist_key"], "left") if lookup is not None else rows.withColumn("spotify_id", nothing.cast("string"))
    context = F.struct(whole_number(F.col("msPlayed")).alias("ms_played"), nothing.cast("boolean").alias("skipped"), nothing.cast("boolean").alias("incognito"), nothing.cast("string").alias("conn_country"))
    return rows.select("seq", *event(F.col("spotify_id"), name, artist, F.lit(""), context), at.alias("played_at"), F.lit("spotify_account").alias("source"), reason.alias("reason"), F.col("endTime").alias("raw_time"))


_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_files(book: zipfile.ZipFile, tree: ElementTree.Element) -> list[str]:
    """The files of the sheets in the workbook's own order, or by their numbers in a file without one."""
    if "xl/_rels/workbook.xml.rels" not in book.namelist():
        return sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    places = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    targets = [places[s.get(_REL)] for s in tree.iter(f"{_MAIN}sheet")]
    return [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in targets]


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """The cells of the active sheet of an .xlsx file, as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
        view = next(tree.iter(f"{_MAIN}workbookView"), None)
        active = int(view.get("activeTab", 0)) if view is not None else 0
        out = []
        for row in ElementTree.fromstring(book.read(sheet_files(book, tree)[active])).iter(f"{_MAIN}row"):
            cells: dict[int, str | None] = {}
            for i, c in enumerate(row.iter(f"{_MAIN}c")):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else i
                value = c.find(f"{_MAIN}v")
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif value is not None:
                    cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return out


BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def ifttt(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Workbooks of a folder in the order of their names; columns time, name, artist, id. ``stream``: those that come, as they come.

    Files are read by Spark's own reader, so that any store will do, and one is the work of
    one task: a sheet has a million rows at most.
    """

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i, *(r + [None] * 4)[:4]) for p, c in zip(f["path"], f["content"], strict=True) for i, r in enumerate(sheet_rows(c))]
            yield pd.DataFrame(rows, columns=["file", "row", "time", "name", "artist", "id"])

    reader = spark.readStream.schema(BINARY) if stream else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    rows = files.mapInPandas(cells, "file string, row bigint, time string, name string, artist string, id string")
    at = parse_long_date(text(F.col("time")))
    name, artist, track = text(F.col("name")), text(F.col("artist")), text(F.col("id"))
    reason = F.when((text(F.col("time")) == "") & (name == "") & (artist == "") & (track == ""), "empty").when((name == "") & (artist == "") & (track == ""), "no_identity").when(at.isNull(), "unparseable_timestamp")
    return rows.select(F.struct("file", "row").alias("seq"), *event(filled(track), name, artist, F.lit(""), F.lit(None)), at.alias("played_at"), F.lit("ifttt").alias("source"), reason.alias("reason"), F.col("time").alias("raw_time"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason", "raw_time")


def line_order() -> Column:
    """seq of lines over several files: files by age, then the place in each. A file's splits are numbered in order, and so are the lines of a split."""
    return F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq")


def tsv(spark: SparkSession, path: str, columns: dict[str, int]) -> DataFrame:
    """Named columns of a raw dump table with ``seq``; blank and short rows are skipped, and the null mark is plain text."""
    lines = or_empty(spark, lambda: spark.read.text(path).select("value", line_order()), f"value string, seq {SEQ}")
    parts = F.split("value", "\t")
    return lines.where(F.trim("value") != "").where(F.size(parts) > max(columns.values())).select("seq", *(parts[i].alias(c) for c, i in columns.items()))


def index(spark: SparkSession, path: str, key: str, last_wins: bool = False) -> DataFrame:
    """key, mbid of a commented two-column table: distinct pairs with where they came first, or the last MBID of each key."""
    rows = tsv(spark, path, {key: 0, "mbid": 1}).where(~F.col(key).startswith("#")).select("seq", F.trim(key).alias(key), F.trim("mbid").alias("mbid")).where(f"{key} <> '' and mbid <> ''")
    if last_wins:
        return rows.groupBy(key).agg(F.max_by("mbid", "seq").alias("mbid"))
    return rows.groupBy(key, "mbid").agg(F.min("seq").alias("seq"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """Features by mbid; the last line of an mbid wins."""
    ddl = "mbid string, bpm double, energy double, valence double, danceability double, acousticness double, instrumentalness double"
    rows = or_empty(spark, lambda: spark.read.schema(ddl).json(path).select("*", line_order()), f"{ddl}, seq {SEQ}")
    return rows.where("mbid is not null").groupBy("mbid").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("mbid", "seq"))), "seq").alias("f")).select("mbid", "f.*", F.lit("acousticbrainz_dump").alias("source"))


def store_records(spark: SparkSession, path: str) -> DataFrame:
    rows = or_empty(spark, lambda: spark.read.schema(schema.RECORD).json(path).select("*", line_order()), f"{schema.RECORD}, seq {SEQ}")
    return rows.where("track_id is not null").groupBy("track_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("track_id", "seq"))), "seq").alias("r")).select("track_id", "r.*")


def raw_cache(spark: SparkSession, path: str) -> DataFrame:
    """mbid, scalars (JSON, null for a known miss); torn lines are skipped and the last line wins."""
    lines = or_empty(spark, lambda: spark.read.text(path).select("value", line_order()), f"value string, seq {SEQ}")
    rows = lines.select("seq", F.get_json_object("value", "$.mbid").alias("mbid"), F.get_json_object("value", "$.scalars").alias("scalars")).where("mbid is not null")
    return rows.groupBy("mbid").agg(F.max_by(F.struct("scalars"), "seq").alias("s")).select("mbid", "s.scalars")


def response_documents(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """mbid, document of API payloads: the first submission of each id; the id mapping and values of other shapes are skipped."""
    each = payloads.select(F.explode(F.from_json(column, "map<string,string>")).alias("mbid", "value")).where("mbid <> 'mbid_mapping'")
    return each.select("mbid", F.get_json_object("value", "$.0").alias("document")).where("document like '{%'")


LIBRARY = {"tracks": "artist:string,album:string,track:string,uri:string", "albums": "artist:string,album:string,uri:string", "artists": "name:string,uri:string", "bannedArtists": "name:string,uri:string"}


def library_lists(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The typed lists of YourLibrary.json, and under 'root' its raw keys for the drop ledger."""
    root = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,string>").alias("root"))
    out = {"root": root}
    for name, ddl in LIBRARY.items():
        out[name] = root.select(F.posexplode(F.from_json(F.col("root")[name], f"array<struct<{ddl}>>")).alias("seq", "x")).select("seq", "x.*")
    return out


def playlists(spark: SparkSession, path: str) -> DataFrame:
    """Items of all playlist files in order: playlist, place, names, spotify_id (null where the item is no track, to be dropped and counted)."""
    ddl = "playlists array<struct<name:string,lastModifiedDate:string,description:string,numberOfFollowers:bigint,items:array<struct<track:struct<trackName:string,artistName:string,albumName:string,trackUri:string>,addedDate:string>>>>"
    files = spark.read.option("pathGlobFilter", "Playlist*.json").option("wholetext", True).text(path)
    doc = files.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", ddl).alias("d"))
    each = doc.select("file", F.posexplode("d.playlists").alias("list_at", "p")).select("file", "list_at", F.col("p.name").alias("playlist"), F.posexplode("p.items").alias("item_at", "i"))
    return each.select(F.struct("file", "list_at", "item_at").alias("seq"), "playlist", F.col("i.track.trackName").alias("name"), F.col("i.track.artistName").alias("artist"), F.col("i.track.albumName").alias("album"), uri_tail(F.col("i.track.trackUri")).alias("spotify_id"), F.col("i.addedDate").alias("added_at"))


def marquee(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("artistName string, segment string").option("multiLine", True).json(path).select(F.col("artistName").alias("artist"), "segment")


def identity_mbids(spark: SparkSession, path: str) -> DataFrame:
    """mbid: the distinct MBIDs of a folder of identity cache files, sorted; files that don't parse or hold none are skipped."""
    ddl = "mbid string, level string, _corrupt_record string"
    rows = or_empty(spark, lambda: spark.read.schema(ddl).option("multiLine", True).option("pathGlobFilter", "*.json").json(path), ddl)
    return rows.where(filled(F.col("mbid")).isNotNull() & F.col("_corrupt_record").isNull()).select("mbid").distinct().orderBy("mbid")


def model_labels(spark: SparkSession, model_path: str) -> list[str]:
    """The class labels in the JSON file beside a model file; none where it is missing or has none."""
    path = re.sub(r"\.[^./]+$", "", model_path) + ".json"
    rows = or_empty(spark, lambda: spark.read.option("wholetext", True).text(path), "value string")
    found = rows.select(F.from_json("value", "classes array<string>")["classes"].alias("c")).first()
    return list(found["c"] or []) if found else []


def account_library(spark: SparkSession, path: str, now: Column, exported_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One row: the whole library of an account export, each file optional; and its drop ledger (key, n)."""
    nothing = spark.createDataFrame([], "key string, n bigint")
    playlist = "seq struct<file:string,list_at:int,item_at:int>, playlist string, name string, artist string, album string, spotify_id string, added_at string"
    lists = {n: f"seq int, {ddl.replace(':', ' ').replace(',', ', ')}" for n, ddl in LIBRARY.items()}

    def part(name: str) -> DataFrame:
        return or_empty(spark, lambda: library_lists(spark, f"{path}/YourLibrary.json")[name], lists[name])

    items = or_empty(spark, lambda: playlists(spark, f"{path}/Playlist*.json"), playlist)
    heard = or_empty(spark, lambda: marquee(spark, f"{path}/Marquee.json"), "artist string, segment string")
    parts = {
        "liked_tracks": part("tracks").select("seq", F.struct(uri_tail(F.col("uri")).alias("spotify_id"), text(F.col("track")).alias("name"), text(F.col("artist")).alias("artist"), filled(text(F.col("album"))).alias("album")).alias("x")),
        "saved_albums": part("albums").select("seq", F.struct(filled(text(F.col("uri"))).alias("uri"), text(F.col("album")).alias("name"), text(F.col("artist")).alias("artist")).alias("x")),
        "followed_artists": part("artists").select("seq", F.struct(filled(text(F.col("uri"))).alias("uri"), text(F.col("name")).alias("name")).alias("x")),
        "banned_artists": part("bannedArtists").select("seq", F.struct(filled(text(F.col("uri"))).alias("uri"), text(F.col("name")).alias("name")).alias("x")),
        "playlist_items": items.where("spotify_id is not null").select("seq", F.struct("playlist", "spotify_id", text(F.col("name")).alias("name"), text(F.col("artist")).alias("artist"), filled(text(F.col("album"))).alias("album"), filled(text(F.col("added_at"))).alias("added_at")).alias("x")),
        "marquee": heard.select(F.struct("artist", "segment").alias("seq"), F.struct(text(F.col("artist")).alias("artist"), text(F.col("segment")).alias("segment")).alias("x")),
    }
    document = spark.range(1).select(F.lit("spotify_account").alias("source"), (exported_at if exported_at is not None else F.lit(None).cast("timestamp")).alias("exported_at"), now.alias("imported_at"))
    for name, rows in parts.items():
        one = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x"))), lambda r: r["x"]).alias(name))
        document = document.crossJoin(one)
    raw = or_empty(spark, lambda: library_lists(spark, f"{path}/YourLibrary.json")["root"], "root map<string,string>")
    dropped = items.where("spotify_id is null").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("non_track_playlist_uris").alias("key"), "n")
    return document, nothing.unionByName(library.drop_ledger(raw, tuple(LIBRARY))).unionByName(dropped)
