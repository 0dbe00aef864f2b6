"""N-gram Jaccard join by a blocked sparse product of documents and n-grams (operator 5).

1. Every text becomes the set of its five-word shingles (64-bit hashes); texts
   with the same set are one class, and classes are joined from here on.
2. The n-gram columns are cut into blocks by hash. A block gathers which sets
   hold each of its columns and counts, for every set, the columns it shares
   with another. Columns shared within a task's slice are settled there, so a
   column of every document is one entry per slice. Sets that share under 80 %
   of their columns can have no partner and leave.
3. For the sets left, columns are ordered by exact frequency. A pair that
   reaches the threshold meets in the first n - ceil(0.8 n) + 1 columns of
   both, so entries of the product are opened by those columns only, and only
   where the sizes allow the threshold.
4. Open entries are filled by the blocked product: block after block of columns
   adds to every entry's overlap, and an entry whose overlap so far and columns
   to come can't reach the bound of its two sizes is discarded.
5. In each opening column all sets first meet one pivot; sets that get connected
   open no further entries in that column. What stays unconnected meets pair by
   pair, except with the column's largest component on both sides; a column of
   many such rows is split into blocks of rows. Components are found by minima
   and pointer jumps.

No link is lost: every pair in a column is either counted or already connected.
Null and empty texts have the empty set and link with nothing. A null id is
never the smallest. Rows that repeat are members of one class. An empty table
gives no rows; columns of any name stay. Sets are told apart by 128-bit digests
and shingles by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm.columns import blocks_for, shared_columns
from listenlake.llm.common import Words, batches, drop_since, fresh, gram_hashes, made, runs, stored, text_bytes

GRAM = 5
PIVOT_ROUNDS = 2
#: Blocks of columns in the product, and rows of one column that meet all others in one task.
COLUMN_BLOCKS, ROW_BLOCK = 8, 512
#: Shingles that a task of the product holds, about.
PART_ENTRIES = 1 << 21
#: Bits of the filter that is broadcast (8 MB).
FILTER_BITS = 1 << 26


def shingle_sets(texts: list[bytes], gram: int = GRAM) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, over words lower-cased from A to Z."""
    words = Words(texts, lower=True)
    full, out = gram_hashes(words.hash, gram), []
    for d in range(len(texts)):
        a, n = int(words.first[d]), int(words.count[d])
        if n >= gram:
            out.append(np.unique(full[a : a + n - gram + 1]))
        elif n:
            out.append(gram_hashes(words.hash[a : a + n], n))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def set_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, n, the digest of its set and the first half of that (set_key) for every row."""

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(rows, 1):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, sets), pa.int64()), pa.array(names := [digest(x) for x in sets], pa.binary()), pa.array([int.from_bytes(x[:8], "little", signed=True) for x in names], pa.int64())], ["doc_id", "n", "digest", "set_key"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text).alias("raw")).mapInArrow(make, "doc_id bigint, n bigint, digest binary, set_key bigint")


def columns_of(part: pa.RecordBatch, texts: list[bytes]) -> dict[int, np.ndarray]:
    """The shingles of each distinct set, under the first half of its digest."""
    out = {}
    for a in range(0, len(texts), 256):
        for x in shingle_sets(texts[a : a + 256]):
            out[int.from_bytes(digest(x)[:8], "little")] = x
    return out


def components(edges: DataFrame) -> DataFrame:
    """v and c, the smallest vertex of its component, for every vertex of ``edges`` (a, b)."""
    start = made()
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        low = labels.join(near, "v").select("v", F.least("c", "m").alias("low"), F.col("c").alias("old"))
        jump = labels.select(F.col("v").alias("low"), F.col("c").alias("further"))
        moved = stored(low.join(jump, "low", "left").select("v", F.least("low", "further").alias("c"), "old"), "labels")
        still = moved.where("c <> old").isEmpty()
        drop_since(both.sparkSession, start, (both, moved))
        labels = moved.select("v", "c")
        if still:
            return labels


def overlaps(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """Which entries (a, b) of the product of ``sets`` (distinct columns each) with itself reach the threshold; ``n`` are the full sizes of the sets.

    Column block by column block: the block of row a is marked, and the marks under each
    open b are counted and added up.
    """
    size = np.array(list(map(len, sets)), np.int64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    flat = flat[np.lexsort((flat, owner))]
    first = np.cumsum(size) - size
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    need = -(-percent * (n[a] + n[b]) // (100 + percent))
    total, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    edges = np.linspace(0, len(names), COLUMN_BLOCKS + 1).astype(np.int64)
    wide = owner * (len(names) + 1) + flat
    cut = np.searchsorted(wide, (np.arange(len(sets)) * (len(names) + 1))[:, None] + edges)
    mark = np.zeros(len(names), bool)
    for k in range(COLUMN_BLOCKS):
        for low, high in zip(*runs(a[alive]), strict=True):
            own, mine = alive[low:high], a[alive[low]]
            here = flat[cut[mine, k] : cut[mine, k + 1]]
            mark[here] = True
            start, many = cut[b[own], k], cut[b[own], k + 1] - cut[b[own], k]
            end = np.cumsum(many)
            seen = np.concatenate([[0], np.cumsum(mark[flat[np.repeat(start - end + many, many) + np.arange(int(end[-1]))]])])
            total[own] += seen[end] - seen[end - many]
            mark[here] = False
        left = np.minimum(first[a[alive]] + size[a[alive]] - cut[a[alive], k + 1], first[b[alive]] + size[b[alive]] - cut[b[alive], k + 1])
        alive = alive[total[alive] + left >= need[alive]]
        if not len(alive):
            break
    good = np.zeros(len(a), bool)
    good[by[alive]] = True
    return good


def verified(x: list[bytes], y: list[bytes], held: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Those of the entries (x, y) that reach the threshold, the smaller first; ``held`` has the sets."""
    if not len(x):
        return pd.DataFrame({"a": [], "b": []}, dtype=object)
    place = {bytes(d): i for i, d in enumerate(held["digest"])}
    a, b = (np.array([place[d] for d in v], np.int64) for v in (x, y))
    good = np.flatnonzero(overlaps(a, b, list(held["shared"]), held["n"].to_numpy(), percent)).tolist()
    return pd.DataFrame([(min(x[i], y[i]), max(x[i], y[i])) for i in good], columns=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, size) whose overlap reaches the threshold. A task has the pairs of some b, so a set of many pairs is in many tasks."""
    parts = max(16, int(pairs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // PART_ENTRIES)
    dealt = pairs.select(F.pmod(F.xxhash64("b"), F.lit(parts)).alias("part"), "a", "b")
    ends = dealt.select(F.col("part").alias("place"), F.col("a").alias("digest")).unionByName(dealt.select(F.col("part").alias("place"), F.col("b").alias("digest"))).distinct()

    def verify(pairs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return verified(list(map(bytes, pairs["a"])), list(map(bytes, pairs["b"])), held, percent)

    return dealt.groupBy("part").cogroup(ends.join(sets, "digest").groupBy("place")).applyInPandas(verify, "a binary, b binary")


def reachable(percent: int) -> Column:
    """Whether two sets that first meet in a column, with so many columns left in each from there on, can still overlap enough for their sizes."""
    return F.expr(f"least(left_a, left_b) * {100 + percent} >= {percent} * (n_a + n_b)")


def linked(sets: DataFrame, percent: int) -> DataFrame:
    """v and c for all sets (digest, n, shingles) that have a partner."""
    inside = sets.select("digest", "n", F.explode("shingles").alias("s"))
    often = inside.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    rows = inside.join(often, "s").groupBy("digest").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "s"))).alias("by"))
    rows = stored(rows.where(f"100 * size(by) >= {percent} * n").select("digest", "n", "by", F.transform("by", lambda x: x["s"]).alias("shared")), "rows")
    first = F.expr(f"slice(by, 1, int(greatest(0, size(by) - ({percent} * n + 99) div 100 + 1)))")
    heads = rows.select("digest", "n", "by", F.posexplode(F.transform(first, lambda x: x["s"])).alias("at", "s"))
    heads = stored(heads.select("digest", "n", "s", (F.size("by") - F.col("at")).alias("left")), "heads")
    counts = rows.select("digest", "n", "shared")
    edges = done = None
    labels = rows.select(F.col("digest").alias("v"), F.col("digest").alias("c")).limit(0)
    part = heads.withColumn("c", F.col("digest"))
    for salt in range(PIVOT_ROUNDS):
        pivot = part.groupBy("s").agg(F.min_by(F.struct("digest", "n", "c", "left"), F.xxhash64("digest", F.lit(salt), *(["s"] if salt else []))).alias("p"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("s", F.col("p.digest").alias("q"), F.col("p.n").alias("n_b"), F.col("p.c").alias("c_q"), F.col("p.left").alias("left_b"))
        pairs = part.join(pivot, "s").where("digest <> q and c <> c_q").withColumns({"n_a": F.col("n"), "left_a": F.col("left")}).where(reachable(percent)).select(F.least("q", "digest").alias("a"), F.greatest("q", "digest").alias("b"), (F.col("n_a") + F.col("n_b")).alias("size")).distinct()
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            break
        found = stored(confirmed(pairs, counts, percent), "links")
        edges = found if edges is None else edges.unionByName(found)
        done = pairs if done is None else done.unionByName(pairs)
        labels = components(edges)
        part = stored(heads.join(labels.withColumnRenamed("v", "digest"), "digest", "left").withColumn("c", F.coalesce("c", "digest")), "heads")
    share = part.groupBy("s", "c").agg(F.count("*").alias("k"))
    split = share.groupBy("s").agg(F.max_by("c", F.struct("k", "c")).alias("major"), F.count("*").alias("parts")).where("parts > 1")
    open_ = stored(part.join(split.select("s", "major"), "s").withColumn("minor", F.col("c") != F.col("major")), "open")
    if open_.isEmpty():
        return labels
    links = stored(open_links(open_, counts, percent), "links")
    return components(links if edges is None else edges.unionByName(links))


def open_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among rows (s, digest, n, left, c, minor) that meet in a column, are in different components and are not both of its largest one.

    Entries are opened in blocks of columns, where one is kept once however often it meets;
    the minor rows of a column are cut into blocks of ``ROW_BLOCK``, each of which meets all
    its rows in a task of its own. Entries travel packed, and only links become rows.
    """
    many = open_.where("minor").groupBy("s").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("pieces"))
    own = F.pmod(F.xxhash64("digest"), F.col("pieces"))
    rows = open_.select("s", "digest", "n", "left", "c", "minor").join(many, "s").withColumn("own", own).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = stored(rows.select("s", "piece", "digest", "n", "left", "c", "minor", (F.col("minor") & (F.col("own") == F.col("piece"))).alias("lead")), "open")
    facts = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries")).first()
    blocks, parts = max(1, facts["rows"] // 100_000), max(16, facts["rows"] // 4096, facts["entries"] // PART_ENTRIES)

    def product(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["s", "piece"], kind="stable", ignore_index=True)
        code, names = pd.factorize(block["digest"].map(bytes), sort=True)
        component, _ = pd.factorize(block["c"].map(bytes))
        n, left, minor, lead = (block[x].to_numpy() for x in ("n", "left", "minor", "lead"))
        found, held, k = [], 0, np.int64(len(names))
        column = np.cumsum(np.append(False, (block["s"].to_numpy()[1:] != block["s"].to_numpy()[:-1]) | (block["piece"].to_numpy()[1:] != block["piece"].to_numpy()[:-1])))
        for low, high in zip(*runs(column), strict=True):
            at = np.arange(low, high)
            for i in at[lead[at]]:
                good = (component[at] != component[i]) & (np.minimum(left[at], left[i]) * (100 + percent) >= percent * (n[at] + n[i])) & (~minor[at] | (code[at] > code[i]))
                other = code[at[good]]
                found.append(np.minimum(other, code[i]) * k + np.maximum(other, code[i]))
                held += len(other)
                if held > 1 << 22:
                    found = [np.unique(np.concatenate(found))]
                    held = 0
        pair = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        x, y = names[pair // k], names[pair % k]
        part = np.array([int.from_bytes(v[:8], "little") % parts for v in names], np.int64)[pair // k] if len(pair) else pair
        order = np.argsort(part, kind="stable")
        out = [(int(part[order[a]]), b"".join(x[order[a:b]]), b"".join(y[order[a:b]])) for a, b in zip(*runs(part[order]), strict=True)]
        return pd.DataFrame(out, columns=["part", "x", "y"])

    def cut(packed: bytes) -> list[bytes]:
        return [packed[i : i + 16] for i in range(0, len(packed), 16)]

    def needed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, x, y in f.itertuples(index=False):
                yield pd.DataFrame({"part": part, "digest": list({*cut(x), *cut(y)})})

    def verify(pairs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        entries = list({p for x, y in zip(pairs["x"], pairs["y"], strict=True) for p in zip(cut(x), cut(y), strict=True)})
        return verified([x for x, _ in entries], [y for _, y in entries], held, percent)

    spread = rows.withColumn("block", F.pmod(F.xxhash64("s", "piece"), F.lit(blocks)))
    packed = stored(spread.groupBy("block").applyInPandas(product, "part bigint, x binary, y binary"), "pairs")
    held = packed.mapInPandas(needed, "part bigint, digest binary").distinct().join(sets, "digest")
    return packed.groupBy("part").cogroup(held.groupBy("part")).applyInPandas(verify, "a binary, b binary")


def filter_bit(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(FILTER_BITS))


def filter_bits(ids: DataFrame) -> bytes:
    """A bitmap of fixed size with a bit for every id, whatever their number (a null id has the first); a set bit may mean another id."""
    chunk = 1 << 20

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(chunk >> 3, np.uint8)
        at = (rows["bit"].to_numpy() % chunk).astype(np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "bits": [bits.tobytes()]})

    placed = ids.select(F.coalesce(filter_bit(F.col(ids.columns[0])), F.lit(0)).alias("bit")).distinct().withColumn("chunk", F.floor(F.col("bit") / chunk))
    found = dict(tuple(r) for r in placed.groupBy("chunk").applyInPandas(pack, "chunk bigint, bits binary").collect())
    return b"".join(bytes(found.get(c, bytes(chunk >> 3))) for c in range(FILTER_BITS // chunk))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row."""
    known = stored(set_rows(docs, id_col, text), "sets")
    classes = stored(known.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("set_key").alias("set_key")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = shared_columns(docs.select(text_bytes(text).alias("raw")), columns_of, blocks_for(total)).select(F.col("key").alias("set_key"), "shared")
    alive = classes.join(counts, "set_key").where(f"100 * shared >= {percent} * n").select(F.col("rep").alias("doc_id"), F.col("digest").alias("want"))

    alive = stored(alive, "alive")
    seen = docs.sparkSession.sparkContext.broadcast(filter_bits(alive.select("doc_id")))

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(seen.value, np.uint8)
        for part, texts in batches(rows, 1):
            at = part.column(0).to_numpy()
            some = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist()
            sets = shingle_sets([texts[i] for i in some])
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["digest", "n", "shingles"])

    rows = docs.select(F.coalesce(filter_bit(F.col(id_col).cast("bigint")), F.lit(0)).alias("bit"), text_bytes(text).alias("raw")).mapInArrow(make, "digest binary, n bigint, shingles array<bigint>")
    sets = stored(rows.join(alive.select(F.col("want").alias("digest")), "digest", "left_semi").dropDuplicates(["digest"]), "shingles")
    labels = linked(sets, percent)
    named = labels.withColumnRenamed("v", "digest").join(classes.select("digest", "rep"), "digest")
    least = named.groupBy("c").agg(F.min("rep").alias("least"))
    class_of = classes.select("digest", "rep").join(named.join(least, "c").select("digest", "least"), "digest", "left").select("digest", F.least("rep", "least").alias("least"))
    return known.join(class_of, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with the same columns."""
    kept = fresh(docs, "kept_id")
    found = near_duplicates(docs, percent, id_col, text).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(found, F.col(id_col).cast("bigint").eqNullSafe(F.col(kept)), "left_semi")
