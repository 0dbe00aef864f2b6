"""Removing bytes that a smaller document has too, by sparse suffix arrays (operator 2).

A byte goes when a string of ``LENGTH`` bytes covers it that also starts in a
document with a smaller id. Texts equal to one with a smaller id go whole, or
stay whole when shorter than that; the first of each takes part in what follows.

1. Anchors: every window of ``LENGTH`` bytes names the least hashed ``SEED``-byte
   string in it. Equal windows name equal strings at equal places, so a window
   can only repeat where its anchor's string does.
2. Anchor strings that two texts have are found in blocks of hashes.
3. Around each shared anchor, the stretch of the windows that name it is a
   suffix to be sorted, to the depth of its end. Stretches that are equal within
   a slice are settled there and sent once.
4. A block sorts the suffixes of each anchor deep-shallow: by multikey quicksort
   to ``SHALLOW`` bytes, eight to a key and all segments at once; those that are
   still tied go into blind tries, which look only at branching bytes and compare
   once.
   Equal neighbours are equal stretches: all but those of the smallest document
   go. Where an anchor has different stretches, their windows are sorted in the
   same way, unless no longer string around the anchor repeats.

Hashes only propose what may be equal: stretches are compared byte by byte, and
whole texts by SHA-256. Null texts are empty. A null id is smaller than none and
keeps its text. Rows with one id remove nothing from each other, and each of their
texts is judged alone: what goes from one stays in another. An empty table gives no rows; columns of any name stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.columns import blocks_for, shared_columns, shift_for, short
from listenlake.llm.common import _BYTE, BATCH_BYTES, SLICE_BYTES, batches, fresh, mix, powers, runs, slices, span_hashes, stored, text_bytes

LENGTH, SEED, SHALLOW = 50, 25, 24
_PLACE = np.uint64((1 << 24) - 1)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every stretch of windows with one anchor: text, first window, last window, anchor (places in its text) and the anchor's hash."""
    found = []
    for a, b in slices([len(t) for t in texts]):
        if b - a == 1 and len(texts[a]) > 2 * SLICE_BYTES:
            for low in range(0, len(texts[a]), SLICE_BYTES):
                found.append(_anchors([texts[a][low : low + SLICE_BYTES + LENGTH - 1]], a, low))
        else:
            found.append(_anchors(texts[a:b], a, 0))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)


def _anchors(texts: list[bytes], first: int, low: int) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw)
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    hashes = mix((total[SEED:] - total[:-SEED]) * down[: n - SEED + 1])
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    wide, span = LENGTH - SEED + 1, 1
    while 2 * span <= wide:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - wide + span], least[wide - span :])
    end = np.cumsum([len(t) for t in texts])
    at = np.arange(len(least))
    text = np.searchsorted(end, at, side="right")
    q = np.flatnonzero(at + LENGTH <= end[text])
    anchor, text = (least[q] & _PLACE).astype(np.int64), text[q]
    new = np.ones(len(q), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(q)) - 1
    base = (end - [len(t) for t in texts])[text[start]] - low
    # The least hashes are small numbers; mixed again they spread over all blocks.
    return text[start] + first, q[start] - base, q[stop] - base, anchor[start] - base, mix(hashes[anchor[start]] + np.uint64(1))


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """The places of ``strings`` in sorted order, equal ones together."""
    root = (strings[0], [0])
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while type(node) is list:
            d = node[0]
            node = node[1].get(s[d] if d < len(s) else -1) or next(iter(node[1].values()))
        t = node[0]
        if s == t:
            node[1].append(i)
            continue
        d, most = 0, min(len(s), len(t))
        while d < most and s[d] == t[d]:
            d += 1
        above, node = None, root
        while type(node) is list and node[0] < d:
            above = node
            node = node[1][s[node[0]] if node[0] < len(s) else -1]
        c = s[d] if d < len(s) else -1
        if type(node) is list and node[0] == d:
            node[1][c] = (s, [i])
            continue
        branch = [d, {t[d] if d < len(t) else -1: node, c: (s, [i])}]
        if above is None:
            root = branch
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is list:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out.append(node[1])
    return out


def multikey_quicksort(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row order by the columns of ``keys`` (n by depth) within groups (numbers that don't descend), and the first place of every place's run of equal rows.

    All open segments are parted at once: by a pivot, the median of three, into less, equal and
    greater; what is equal goes one column deeper, the others stay in theirs.
    """
    n, depth = keys.shape
    order, first = np.arange(n), np.zeros(n, np.int64)
    start, end = runs(group)
    deep = np.zeros(len(start), np.int64)
    while len(start):
        size = end - start
        done = (size == 1) | (deep == depth)
        for a, z in ((start[done], size[done]),):
            first[np.repeat(a - np.cumsum(z) + z, z) + np.arange(int(z.sum()))] = np.repeat(a, z)
        start, size, deep = start[~done], size[~done], deep[~done]
        if not len(start):
            break
        seg = np.repeat(np.arange(len(start)), size)
        base = np.cumsum(size) - size
        at = np.arange(len(seg)) - base[seg] + start[seg]
        own = order[at]
        key = keys[own, deep[seg]]
        low, mid, high = key[base], key[base + size // 2], key[base + size - 1]
        pivot = np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high))[seg]
        less, same = key < pivot, key == pivot
        counts = []
        place = start[seg]
        before = np.zeros(len(start), np.int64)
        for side in (less, same, ~(less | same)):
            total = np.cumsum(side)
            ahead = total - side - (total[base] - side[base])[seg]
            place = np.where(side, (start + before)[seg] + ahead, place)
            counts.append(np.add.reduceat(side, base, dtype=np.int64))
            before = before + counts[-1]
        order[place] = own
        edges = start + np.cumsum([np.zeros(len(start), np.int64), counts[0], counts[1]], axis=0)
        start, size = edges.ravel(), np.concatenate(counts)
        deep = np.concatenate([deep, deep + 1, deep])
        some = size > 0
        start, deep = start[some], deep[some]
        end = start + size[some]
    return order, first


def sorted_classes(memory: bytes, at: np.ndarray, size: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """The rank of each string memory[at : at + size] in sorted order; equal strings share one. ``group``: strings are ordered by these numbers first and equal in one group only."""
    n = len(at)
    if not n:
        return np.empty(0, np.int64)
    raw = np.frombuffer(memory + bytes(8 + SHALLOW), np.uint8)
    by = np.arange(n) if group is None else np.argsort(group, kind="stable")
    keys = np.empty((n, SHALLOW // 8), np.uint64)
    for k in range(SHALLOW // 8):
        part = raw[(at[by] + 8 * k)[:, None] + np.arange(8)]
        part[np.arange(8) + 8 * k >= size[by][:, None]] = 0
        keys[:, k] = part.view(">u8")[:, 0]
    order, first = multikey_quicksort(keys, np.zeros(n, np.int64) if group is None else group[by])
    order = by[order]
    rank = np.empty(n, np.int64)
    rank[order] = first
    start, end = runs(first)
    several = end - start > 1
    if several.any():
        places, low, length = order.tolist(), at.tolist(), size.tolist()
        for a, b in zip(start[several].tolist(), end[several].tolist(), strict=True):
            own, k = places[a:b], a
            for same in blind_trie([memory[low[i] : low[i] + length[i]] for i in own]):
                for j in same:
                    rank[own[j]] = k
                k += len(same)
    return rank


def same_bytes(raw: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether raw[left : left + size] is raw[right : right + size], for rows of 8 bytes or more."""
    words = np.lib.stride_tricks.as_strided(np.append(raw, np.zeros(8, np.uint8)).view(np.uint8)[: len(raw) + 8], (len(raw) + 1, 8), (1, 1))
    good = np.ones(len(left), bool)
    for k in range(0, int(size.max()) if len(size) else 0, 8):
        off = np.minimum(k, size - 8)
        good &= (words[left + off] == words[right + off]).all(1)
    return good


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every row by equal keys, and a row order in which groups stand together."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order


def whole_groups(ordered: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about ``most`` rows that part no run of equal values."""
    start, end = runs(ordered)
    low = 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        if a > low and b - low > most:
            yield slice(low, a)
            low = a
    if len(ordered):
        yield slice(low, len(ordered))


def covered(hashes: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray, lead: np.ndarray, size: np.ndarray, memory: bytes) -> tuple[np.ndarray, ...]:
    """Documents, keys of their texts and byte spans that a smaller document covers, among stretches around anchors."""
    at = np.cumsum(size) - size
    # Stretches of one anchor are suffixes to be sorted against each other.
    kind = np.unique(sorted_classes(memory, at, size, groups(lead, hashes)[0]), return_inverse=True)[1]
    n = int(kind.max()) + 1
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc)
    gone = doc > least[kind]
    spans = [(doc[gone], key[gone], start[gone], start[gone] + size[gone])]
    first = np.full(n, -1)
    stay = np.flatnonzero(~gone)
    first[kind[stay]] = stay
    name, _ = groups(hashes[first])
    several = np.bincount(name)[name] > 1
    pick = np.sort(first[several])
    if len(pick):
        left, right = np.minimum(lead[pick], (LENGTH - SEED) // 2) == (LENGTH - SEED) // 2, size[pick] - lead[pick] >= SEED + (LENGTH - SEED) // 2 + 1
        raw, anchor = np.frombuffer(memory, np.uint8), at[pick] + lead[pick]
        good = np.zeros(len(pick), bool)
        for has, low, high in ((left, -((LENGTH - SEED) // 2), SEED), (right, 0, SEED + (LENGTH - SEED) // 2 + 1)):
            own = np.flatnonzero(has)
            if len(own):
                around, _ = groups(span_hashes(raw, anchor[own] + low, anchor[own] + high), hashes[pick[own]])
                good[own] |= np.bincount(around)[around] > 1
        pick = pick[good]
    pick = pick[np.argsort(hashes[pick], kind="stable")]
    for part in whole_groups(hashes[pick], 1 << 12):
        own = np.repeat(pick[part], size[pick[part]] - LENGTH + 1)
        windows = size[pick[part]] - LENGTH + 1
        shift = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
        rank = sorted_classes(memory, at[own] + shift, np.full(len(own), LENGTH), groups(shift - lead[own], hashes[own])[0])
        same = np.unique(rank, return_inverse=True)[1]
        least_window = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least_window, same, doc[own])
        hit = doc[own] > least_window[same]
        rows = pd.DataFrame({"kind": kind[own[hit]], "shift": shift[hit]}).merge(pd.DataFrame({"kind": kind[stay], "doc": doc[stay], "key": key[stay], "start": start[stay]}), on="kind")
        low = (rows["start"] + rows["shift"]).to_numpy()
        spans.append(merged(rows["doc"].to_numpy(), rows["key"].to_numpy(), low, low + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*spans, strict=True))


def merged(doc: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal spans of each text (document and key): those that overlap or touch become one."""
    by = np.lexsort((low, key, doc))
    doc, key, low, high = doc[by], key[by], low[by], high[by]
    if not len(doc):
        return doc, key, low, high
    own = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) - 1
    wide = int(high.max()) + 1
    reach = np.maximum.accumulate(high + own * wide)
    new = np.append(True, low[1:] + own[1:] * wide > reach[:-1])
    edge = np.flatnonzero(new)
    return doc[edge], key[edge], low[edge], reach[np.append(edge[1:], len(doc)) - 1] - own[edge] * wide


SPANS = "bucket bigint, docs binary, keys binary, lows binary, highs binary"
STRETCHES = "block bigint, hashes binary, docs binary, keys binary, starts binary, leads binary, sizes binary, memory binary"


def _rows(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    by = np.argsort(bucket, kind="stable")
    bucket = bucket[by]
    for a, b in zip(*runs(bucket), strict=True):
        yield int(bucket[a]), [c[by[a:b]] for c in columns]


def span_rows(doc: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray, buckets: int) -> dict[str, list]:
    doc, key, low, high = merged(doc, key, low, high)
    out = {"bucket": [], "docs": [], "keys": [], "lows": [], "highs": []}
    for b, parts in _rows((mix(doc.astype(np.uint64) ^ mix(key.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64), doc, key, low, high):
        for name, x in zip(out, (b, *(x.astype(np.int64).tobytes() for x in parts)), strict=True):
            out[name].append(x)
    return out


def repeated_spans(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """What goes: doc_id, sha (of its text), lows and highs of its spans; and doc_id, sha, n_bytes of every row."""
    raw = text_bytes(text)
    known = stored(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.sha2(raw, 256).alias("sha"), F.octet_length(raw).cast("bigint").alias("n_bytes")), "texts")
    classes = stored(known.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.first("n_bytes").alias("n_bytes")), "classes")
    total = classes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    blocks = blocks_for(total * 2 // (LENGTH - SEED + 2))
    key = F.conv(F.substring("sha", 1, 16), 16, -10).cast("bigint")

    def columns_of(part: pa.RecordBatch, texts: list[bytes]) -> dict[int, np.ndarray]:
        keys = np.array(part.column(0).to_pylist(), np.int64).view(np.uint64).tolist()
        text_of, _, _, _, hashes = anchors(texts)
        cut = np.searchsorted(text_of, np.arange(len(texts) + 1))
        return {k: np.unique(hashes[cut[i] : cut[i + 1]]) for i, k in enumerate(keys)}

    whole = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.sha2(raw, 256).alias("sha"), raw.alias("raw"))
    found = shared_columns(whole.where(f"octet_length(raw) >= {LENGTH}").select(key.alias("key"), "raw"), columns_of, blocks)
    first = stored(classes.where(f"n_bytes >= {LENGTH} and rep is not null").withColumn("key", key).join(found, "key").select(F.col("rep").alias("doc_id"), "sha", "key", "shared", "columns"), "shared")
    pieces = blocks_for(first.agg(F.coalesce(F.sum("shared"), F.lit(0))).first()[0], 1 << 15)

    def stretch(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = shift_for(pieces)
        for part, texts in batches(arrow, 3, BATCH_BYTES):
            ids, keys = (np.array(part.column(c).to_pylist(), np.int64) for c in (0, 1))
            text_of, low, high, anchor, hashes = anchors(texts)
            names, cut, keep = short(hashes, blocks), np.searchsorted(text_of, np.arange(len(texts) + 1)), np.zeros(len(hashes), bool)
            for i, c in enumerate(part.column(2).to_pylist()):
                keep[cut[i] : cut[i + 1]] = np.isin(names[cut[i] : cut[i + 1]], np.frombuffer(c, np.uint64))
            text_of, low, high, anchor, hashes = (x[keep] for x in (text_of, low, high, anchor, hashes))
            if not len(low):
                continue
            base = np.cumsum([0, *map(len, texts)])[:-1][text_of]
            memory = np.frombuffer(b"".join(texts), np.uint8)
            doc, key, lead, size = ids[text_of], keys[text_of], anchor - low, high - low + LENGTH
            content = span_hashes(memory, base + low, base + low + size)
            kind, _ = groups(content, lead, hashes)
            by = np.lexsort((doc, kind))
            least = by[runs(kind[by])[0]][kind]  # the row of the smallest document with this content
            gone = doc > doc[least]
            # A hash only proposes what is equal; what differs in a byte stays and is sorted.
            gone[gone] = (size[gone] == size[least[gone]]) & same_bytes(memory, (base + low)[gone], (base + low)[least[gone]], np.minimum(size[gone], size[least[gone]]))
            spans = span_rows(doc[gone], key[gone], low[gone], (low + size)[gone], pieces)
            for b, d, t, x, y in zip(*spans.values(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([-1 - b], pa.int64()), pa.array([b""]), *(pa.array([v], pa.binary()) for v in (d, t, x, y, b"", b""))], names_of)
            stay = np.flatnonzero(~gone)
            for b, (h, d, t, s, k, z, g) in _rows((hashes[stay] >> shift).astype(np.int64), hashes[stay], doc[stay], key[stay], low[stay], lead[stay], size[stay], (base + low)[stay]):
                at = np.repeat(g - np.cumsum(z) + z, z) + np.arange(int(z.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (h, d, t, s.astype(np.int64), k.astype(np.uint8), z.astype(np.uint8), memory[at]))], names_of)

    names_of = ["block", "hashes", "docs", "keys", "starts", "leads", "sizes", "memory"]

    def resolve(block: pd.DataFrame) -> pd.DataFrame:
        number = int(block["block"].iloc[0])
        if number < 0:  # spans settled in their slice
            return pd.DataFrame({"bucket": [-1 - number], "docs": [b"".join(block["docs"])], "keys": [b"".join(block["keys"])], "lows": [b"".join(block["starts"])], "highs": [b"".join(block["leads"])]})
        parts = [np.concatenate([np.frombuffer(x, t) for x in block[c]]) for c, t in (("hashes", np.uint64), ("docs", np.int64), ("keys", np.int64), ("starts", np.int64), ("leads", np.uint8), ("sizes", np.uint8))]
        return pd.DataFrame(span_rows(*covered(*parts[:4], parts[4].astype(np.int64), parts[5].astype(np.int64), b"".join(block["memory"])), pieces))

    def gather(bucket: pd.DataFrame) -> pd.DataFrame:
        doc, key, low, high = merged(*(np.concatenate([np.frombuffer(x, np.int64) for x in bucket[c]]) for c in ("docs", "keys", "lows", "highs")))
        edge = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))[: len(doc)])
        ends = np.append(edge[1:], len(doc))
        return pd.DataFrame({"doc_id": doc[edge], "key": key[edge], "lows": [low[a:b] for a, b in zip(edge, ends, strict=True)], "highs": [high[a:b] for a, b in zip(edge, ends, strict=True)]})

    texts = whole.join(first.select("doc_id", "sha", "columns"), ["doc_id", "sha"]).select("doc_id", key.alias("key"), "columns", "raw")
    inside = texts.mapInArrow(stretch, STRETCHES).groupBy("block").applyInPandas(resolve, SPANS)
    spans = inside.groupBy("bucket").applyInPandas(gather, "doc_id bigint, key bigint, lows array<bigint>, highs array<bigint>").join(first.select("doc_id", "key", "sha"), ["doc_id", "key"]).drop("key")
    copies = known.join(classes.select("sha", "rep"), "sha").where(f"doc_id > rep and n_bytes >= {LENGTH}").select("doc_id", F.array(F.lit(0).cast("bigint")).alias("lows"), F.array("n_bytes").alias("highs"), "sha").distinct()
    return stored(spans.unionByName(copies), "spans"), known


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    spans, known = repeated_spans(docs, id_col, text)
    raw = text_bytes(text)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.sha2(raw, 256).alias("sha"), raw.alias("raw"))

    def cut(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(arrow, 4):
            out = []
            for t, lows, highs in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                out.append((sum(highs) - sum(lows), len(lows), hashlib.sha256(without(t, lows, highs)).hexdigest()))
            removed, n, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    touched = rows.join(spans, ["doc_id", "sha"]).select("doc_id", "sha", "lows", "highs", "raw").mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    zero = F.lit(0).cast("bigint")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.sha") == F.col("b.sha"))
    untouched = known.alias("a").join(spans.select("doc_id", "sha").alias("b"), same, "left_anti").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return touched.unionByName(untouched)


def without(text: bytes, lows: list[int], highs: list[int]) -> bytes:
    edges = [0, *(x for pair in zip(lows, highs, strict=True) for x in pair), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def inward(text: bytes, low: int, high: int) -> tuple[int, int]:
    """A span shrunk to whole code points."""
    while low < high and text[low] & 0xC0 == 0x80:
        low += 1
    while high > low and high < len(text) and text[high] & 0xC0 == 0x80:
        high -= 1
    return low, high


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated spans cut from their texts, at whole code points; other columns stay."""
    spans, _ = repeated_spans(docs, id_col, text)
    sha, lows, highs, raw, span_doc, span_sha = (fresh(docs, x) for x in ("text_sha", "span_lows", "span_highs", "raw_text", "span_doc", "span_sha"))
    marked = docs.withColumn(sha, F.sha2(text_bytes(text), 256)).join(spans.select(F.col("doc_id").alias(span_doc), F.col("sha").alias(span_sha), F.col("lows").alias(lows), F.col("highs").alias(highs)), (F.col(id_col).cast("bigint") == F.col(span_doc)) & (F.col(sha) == F.col(span_sha)), "left")
    names, at, wide = docs.columns, docs.columns.index(text), len(docs.columns)

    def cut(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(arrow, wide + 2):
            left, right = part.column(wide).to_pylist(), part.column(wide + 1).to_pylist()
            new = []
            for t, lo, hi, old in zip(texts, left, right, part.column(at).to_pylist(), strict=True):
                pairs = [inward(t, a, b) for a, b in zip(lo, hi, strict=True)] if lo else []
                new.append(without(t, [a for a, _ in pairs], [b for _, b in pairs]).decode("utf-8", "replace") if lo else old)
            columns = part.columns[:wide]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.select(*names, lows, highs, text_bytes(text).alias(raw)).mapInArrow(cut, docs.schema)
