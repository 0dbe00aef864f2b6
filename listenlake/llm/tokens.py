"""Token ids and token counts by way of pre-tokens, which tokenizers never look across (operator 7 and what 8 and 9 use).

Two shapes of file are taken apart: byte-level BPE whose pattern puts one space
before a word, and BPE with word ends over lower-cased words. The pre-tokens of
plain texts (ASCII and two-byte Latin letters) are found by byte classes, for a
few MB of texts at once, and encoded once per worker. All other texts, those
that hold an added token, and files of any other shape go to the library whole.

Null and empty texts have no tokens. Bytes that are not UTF-8 count as the
replacement character. An empty table gives no rows. A worker tells pre-tokens
apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import os
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import BATCH_BYTES, batches, span_hashes, text_bytes

#: Pre-tokens kept by a worker; when there are more, it learns them again.
CACHE_UNITS = 1_200_000
#: Rows looked at to find frequent pre-tokens (about so many, spread over the table), and how many of those are broadcast.
SAMPLE_DOCS, HEAD_UNITS = 2000, 65_536
#: Fixed value: the pattern by which word files part words.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of a plain text: printable ASCII, the newline, and two-byte Latin letters.
_ASCII = bytes([10, *range(32, 127)])
_KEPT = {"space": _ASCII + bytes([*range(0xC3, 0xC9), *range(0x80, 0xC0)]), "word": _ASCII + bytes([0xC3, *range(0x80, 0xC0)])}
#: 0 other, 1 letter, 2 digit, 3 white space, 4 the end of a text.
_CLASS = np.array([4 if b == 0 else 3 if b in (10, 32) else 2 if 48 <= b < 58 else 1 if b >= 128 or chr(b).isalpha() else 0 for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)
_SHORT = np.frombuffer(b"stmd", np.uint8)


def spec_of(path: str) -> tuple[str, bytes]:
    """Kind and content of a tokenizer file, small enough to broadcast (a few MB)."""
    with open(path, "rb") as f:
        return ("model" if path.endswith(".model") else "json"), f.read()


class Encoder:
    """The library's encoder for a file, and how its texts may be cut into units: 'space', 'word' or None.

    Units of plain Latin text go to a rank-ordered byte-pair encoder made from the
    same file, where its ids ascend in the order of its merges; all else goes to the library.
    """

    def __init__(self, kind: str, content: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.added: list[str] = []
        self.unit = self._ranked = None
        if kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.ids = lambda text: model.encode(text, num_threads=1)
            return
        from tokenizers import Tokenizer

        text = content.decode()
        plan = json.loads(text)
        library = Tokenizer.from_str(text)
        library.no_truncation()
        library.no_padding()
        self.ids = lambda text: library.encode(text, add_special_tokens=False).ids
        self.added = [x["content"] for x in plan["added_tokens"]]
        before = plan.get("pre_tokenizer") or {}
        steps = before.get("pretokenizers", [before])
        kinds = [x["type"] for x in (plan.get("normalizer") or {}).get("normalizers", [])]
        if plan.get("normalizer") is None and len(steps) == 1 and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            self.unit = "space"
        elif kinds == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern") == {"Regex": _WORD_PATTERN} and steps[0].get("invert") and not any(c.isspace() for x in self.added for c in x):
            self.unit = "word"
        if self.unit:
            self._ranked = ranked(plan["model"])
            self._added = [x.encode() for x in self.added]
            self._end = b"\xff" if plan["model"].get("end_of_word_suffix") else b""

    def plain(self, text: bytes) -> bool:
        """Whether the pre-tokens of ``text`` are found by its bytes alone; else it goes to the library whole."""
        return self._ranked is not None and not text.translate(None, _KEPT[self.unit]) and b"\xc3\x97" not in text and b"\xc3\xb7" not in text and not any(x in text for x in self._added)

    def piece(self, token: bytes) -> list[int]:
        """The ids of a pre-token of a plain text."""
        return self._ranked._core_bpe.encode_single_piece(token + self._end)


def ranked(model: dict):
    """A rank-ordered encoder with the ids of ``model``, or None where its ids don't ascend with its merges. A word's end is the byte 255, which no UTF-8 text has."""
    import tiktoken

    end = model.get("end_of_word_suffix") or ""
    if model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {}
    for token, i in model["vocab"].items():
        ended = bool(end) and token.endswith(end)
        body = token.removesuffix(end) if ended else token
        ranks[bytes(byte_of[c] for c in body) + b"\xff" * ended] = i
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    base = set(model["vocab"].values()) - set(order)
    if order != sorted(order) or (base and order and max(base) > order[0]) or len(ranks) != len(model["vocab"]):
        return None
    return tiktoken.Encoding("units", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def pretokens(texts: list[bytes], unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of plain texts, each closed by a zero; start, end and text of every pre-token, found for all texts at once."""
    raw = np.frombuffer(b"\x00".join(texts) + b"\x00\x00\x00", np.uint8)
    if unit == "word":
        raw = _LOWER[raw]
        high = np.flatnonzero(raw[:-1] == 0xC3) + 1
        raw[high] += np.where(raw[high] <= 0x9E, 0x20, 0).astype(np.uint8)
    kind = _CLASS[raw]
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    if unit == "word":
        new |= kind == 2
    else:
        bound = np.flatnonzero(new)
        blank = np.flatnonzero(kind[bound[:-1]] == 3)
        after = bound[blank + 1]
        after = after[kind[after] != 4]
        new[after - 1] = True
        new[after[raw[after - 1] == 0x20]] = False
    quote = np.flatnonzero((raw[:-3] == 0x27) & new[:-3])
    one, two = raw[quote + 1], raw[quote + 2]
    short = np.isin(one, _SHORT)
    long_ = ((two == 0x65) & ((one == 0x72) | (one == 0x76))) | ((one == 0x6C) & (two == 0x6C))
    new[quote[short | long_] + 1] = False
    new[quote[short] + 2] = True
    new[quote[long_] + 3] = True
    bound = np.flatnonzero(new)
    start, end = bound[:-1], bound[1:]
    kept = kind[start] != 4
    if unit == "word":
        kept &= kind[start] != 3
    start, end = start[kept], end[kept]
    close = np.cumsum([len(t) + 1 for t in texts])
    return raw, start, end, np.searchsorted(close, start, side="right")


class Units:
    """What each pre-token gives, kept by the worker from task to task under its hash.

    ``head`` is the first tier: sorted hashes and values of frequent pre-tokens, made
    once and broadcast. Misses of both tiers are encoded.
    """

    def __init__(self, encoder: Encoder, head: tuple[np.ndarray, np.ndarray] | None = None):
        self.encoder, self.head, self.seen = encoder, head, {}

    def keep(self, ids: list[int]) -> int:
        return len(ids)

    def renew(self) -> None:
        self.seen = {}

    def values(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The values of all pre-tokens of ``texts``, one text after the other, and how many each text has."""
        if len(self.seen) > CACHE_UNITS:
            self.renew()
        plain = [self.encoder.plain(t) for t in texts]
        part = [t for t, p in zip(texts, plain, strict=True) if p]
        raw, start, end, doc = pretokens(part, self.encoder.unit) if part else (None, *[np.empty(0, np.int64)] * 3)
        found, first, at = np.unique(span_hashes(raw, start, end) if part else np.empty(0, np.uint64), return_index=True, return_inverse=True)
        value = np.full(len(found), -1, np.int64)
        if self.head is not None and len(self.head[0]):
            near = np.minimum(np.searchsorted(self.head[0], found), len(self.head[0]) - 1)
            value = np.where(self.head[0][near] == found, self.head[1][near], -1)
        lost = np.flatnonzero(value < 0)
        got = list(map(self.seen.get, found[lost].tolist()))
        encode = self.encoder.piece
        for k, v in enumerate(got):
            if v is None:
                i = first[lost[k]]
                got[k] = self.seen[int(found[lost[k]])] = self.keep(encode(raw[start[i] : end[i]].tobytes()))
        value[lost] = got
        out, n = value[at], np.bincount(doc, minlength=len(part))
        if len(part) == len(texts):
            return out, n
        pieces, end, k = [], np.cumsum(n), 0
        for t, p in zip(texts, plain, strict=True):
            if p:
                pieces.append(out[end[k] - n[k] : end[k]])
                k += 1
            else:
                pieces.append(np.array([self.keep(self.encoder.ids(t.decode("utf-8", "replace")))], np.int64))
        return np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))

    def counts(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text."""
        out, n = self.values(texts)
        total, end = np.concatenate([[0], np.cumsum(out)]), np.cumsum(n)
        return (total[end] - total[end - n]).tolist()


class UnitIds(Units):
    """Units whose values are places in a pool of ids."""

    def __init__(self, encoder: Encoder, head: None = None):
        super().__init__(encoder)
        self.renew()

    def renew(self) -> None:
        super().renew()
        self.pool, self.start = array("i"), array("q", [0])

    def keep(self, ids: list[int]) -> int:
        self.pool.extend(ids)
        self.start.append(len(self.pool))
        return len(self.start) - 2

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``texts``, one text after the other, and how many each has."""
        if len(self.pool) > 1 << 24:
            self.renew()
        at, n = self.values(texts)
        start = np.frombuffer(self.start, np.int64)
        low, size = start[at], start[at + 1] - start[at]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = np.frombuffer(self.pool, np.int32)[np.repeat(low - end + size, size) + np.arange(total)] if total else np.empty(0, np.int32)
        upto, last = np.concatenate([[0], end]), np.cumsum(n)
        return ids, upto[last] - upto[last - n]


_WORKER: dict[tuple, Units] = {}


def worker_units(kind: type[Units], spec: Broadcast, head: Broadcast | None = None) -> Units:
    """The units this Python worker keeps for a broadcast tokenizer file."""
    key = (kind.__name__, hash(spec.value[1]))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = kind(Encoder(*spec.value))
    if head is not None:
        _WORKER[key].head = head.value
    return _WORKER[key]


def frequent_units(docs: DataFrame, text: str, spec: Broadcast, sample_docs: int = SAMPLE_DOCS, head_units: int = HEAD_UNITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and token counts of the pre-tokens most frequent in a sample of about ``sample_docs`` rows. They only save time: any table gives the same counts."""
    every = max(1, docs.count() // sample_docs)
    picked = docs.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0).select(text_bytes(text).alias("raw"))

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, seen = worker_units(Units, spec), Counter()
        for _, texts in batches(rows, 0):
            units.values(texts)
            part = [t for t in texts if units.encoder.plain(t)]
            if part:
                raw, start, end, _ = pretokens(part, units.encoder.unit)
                seen.update(dict(zip(*(x.tolist() for x in np.unique(span_hashes(raw, start, end), return_counts=True)), strict=True)))
        top = [(h, units.seen[h], n) for h, n in seen.most_common(head_units) if h in units.seen]
        h, size, n = zip(*top, strict=True) if top else ((), (), ())
        yield pa.RecordBatch.from_pydict({"unit": pa.array(np.array(h, np.uint64).view(np.int64)), "size": pa.array(size, pa.int64()), "n": pa.array(n, pa.int64())})

    top = picked.mapInArrow(count, "unit bigint, size bigint, n bigint").groupBy("unit", "size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(head_units)
    # As one row, so that executors merge the partitions' lists and the driver gets the result alone.
    listed = top.agg(F.collect_list("unit").alias("units"), F.collect_list("size").alias("sizes")).first()
    units, size = np.array(listed["units"], np.int64).view(np.uint64), np.array(listed["sizes"], np.int64)
    by = np.argsort(units)
    return units[by], size[by]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, UTF-8 bytes and tokens of every row, by the file at ``tokenizer``.

    One narrow pass: a broadcast table answers for frequent pre-tokens, and misses are
    encoded once per worker; no pre-token is shuffled, but for the counts of the sample
    that the table is made of. Rows that repeat give rows that repeat.
    """
    context = docs.sparkSession.sparkContext
    spec = context.broadcast(spec_of(tokenizer))
    head = context.broadcast(frequent_units(docs, text, spec))

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = worker_units(Units, spec, head)
        for part, texts in batches(rows, 1, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(units.counts(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_bytes(text).alias("raw")).mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
