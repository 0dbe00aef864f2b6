"""The training-data operators against plain versions, on small tables and odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_plain import plain_components, plain_sets, plain_spans, plain_verdicts, texts_of

from listenlake.llm import ann, chat, columns, idfiles, mixing, packing, queries, repetition, shingles, suffixes, tokens, urls
from listenlake.llm.common import stored

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " ", "\n\n a\n b", "a  b", "it's 'say we'll're ''s 5's ab12", "<|endoftext|> a  <|endoftext|>b", "　 z é̀ ﬁ ſ İI ΣΑΣ", "x" * 3000, "a b " * 2000, "ÀÉ ª º ² ¼×"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "the"] + [f"w{i}" for i in range(60)]
    long = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 160))) for _ in range(12)]
    near = [long[0], long[0] + " tail", long[1].replace("of", "off", 1), long[2][:300] + long[3][:300], long[3], long[2] + "\n" + long[2]]
    texts = ODD + long + near
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[12]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_join(spark, odd, empty):
    sets = plain_sets(texts_of(odd))
    want = plain_components(sets)
    got = shingles.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert shingles.near_duplicates(empty).count() == 0
    assert {r["doc_id"] for r in shingles.keep_first(odd).collect()} == {i for i in sets if want[i] == i}


def test_jaccard_join_of_a_loose_group(spark):
    # Many texts that are close to some of the others only, so that pivots cannot settle them.
    rng = random.Random(1)
    base = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(80), 2):
            w[k] = f"u{rng.randint(0, 30)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_components(plain_sets(texts_of(df)))
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(df).collect()} == want
    assert len(set(want.values())) > 1


def test_jaccard_join_when_no_pivot_pair_can_link(spark):
    # Sets 1 and 2 overlap by 9 of 11; every column they share is also in set 3, which is too large for either.
    sets = [[*range(9), 100], [*range(9), 101], [*range(9), *range(200, 260)]]
    sets += [[*range(200, 260), *range(k, k + 1000)] for k in (1000, 2000, 3000)]
    # Digests by the first round's hash, so that set 3 is the pivot of all its columns.
    tries = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 16).cast("binary").alias("d")).select("d", F.xxhash64("d", F.lit(0)).alias("h")).orderBy("h").collect()
    names = [bytes(r["d"]) for r in tries]
    order = [names[900], names[901], names[0], *names[1:4]]
    df = spark.createDataFrame([(d, len(x), x) for d, x in zip(order, sets, strict=True)], "digest binary, n bigint, shingles array<bigint>")
    got = {bytes(r["v"]): bytes(r["c"]) for r in shingles.linked(df, 80).collect()}
    both = order[:2]
    assert got[both[0]] == got[both[1]] == min(both)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=2, max_size=12), st.integers(0, 5))
def test_blocked_product(sets, hidden):
    n = np.array([len(x) + hidden for x in sets])
    a, b = (x.ravel() for x in np.triu_indices(len(sets), 1))
    got = shingles.overlaps(a, b, [np.array(sorted(x, key=str), np.int64) for x in sets], n, 80)
    assert got.tolist() == [100 * len(sets[i] & sets[j]) >= 80 * (n[i] + n[j] - len(sets[i] & sets[j])) for i, j in zip(a, b, strict=True)]


def test_jaccard_join_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(shingles, "ROW_BLOCK", 8)  # so that columns are cut into blocks of rows
    rng = random.Random(4)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(60), 1 + i % 3):
            w[k] = f"u{rng.randint(0, 12)}"
        rows.append((i if i % 40 else None, " ".join(w), 7, "x"))
    rows += [(500, "z " * 60_000, 7, "x"), (501, "z " * 60_001, 7, "x"), (502, " ".join(f"q{i}" for i in range(20_000)), 7, "x"), (503, " ".join(f"q{i}" for i in range(19_900)), 7, "x"), (None, None, 7, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept_id int, digest string")
    named = {i if d is not None else 10_000 + i: (t or "").encode() for i, (d, t, _, _) in enumerate(rows)}
    label = plain_components({k: v for k, v in plain_sets(named).items()})
    got = {}
    for r in shingles.near_duplicates(df).where("doc_id is not null").collect():
        got[r["doc_id"]] = r["component_id"]
    place = {i: d for i, (d, _, _, _) in enumerate(rows) if d is not None}
    groups = collections.defaultdict(set)
    for k, c in label.items():
        groups[c].add(k)
    want = {place[k]: min(place[m] for m in members if m in place) for members in groups.values() for k in members if k in place}
    assert got == want
    assert shingles.keep_first(df).columns == df.columns


def test_suffix_dedup(spark, odd, empty):
    texts = texts_of(odd)
    want = plain_spans(texts)
    got = suffixes.digests(odd).collect()
    assert len(got) == odd.count() and sum(r["n_removed"] for r in got) > 0
    for r in got:
        t, spans = texts[r["doc_id"]], want[r["doc_id"]]
        kept = suffixes.without(t, [a for a, _ in spans], [b for _, b in spans])
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
    assert suffixes.digests(empty).count() == 0
    kept = suffixes.remove_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_suffix_dedup_of_repeated_ids(spark):
    # Rows of one id remove nothing from each other, and what goes from one text stays in another of the same id.
    rng = random.Random(8)
    passage = ["".join(rng.choice("abcdefgh ") for _ in range(120)) for _ in range(4)]
    rows = [(1, passage[0]), (2, "xx " + passage[0] + " yy"), (2, "zz" + "q".join(passage[3]) + passage[1]), (2, "zz" + "q".join(passage[3]) + passage[1]), (2, passage[1] + " tail"), (3, passage[1] + passage[2]), (3, None), (None, passage[0] + passage[2]), (None, None), (1, None), (4, passage[2] + passage[2]), (4, passage[2] + passage[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = []
    for i, t in rows:
        raw, spans = (t or "").encode(), []
        seen = {u[k : k + 50] for j, u in ((j, (u or "").encode()) for j, u in rows) if j is not None and i is not None and j < i for k in range(len(u) - 49)}
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in seen:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + 50
                else:
                    spans.append([k, k + 50])
        kept = suffixes.without(raw, [a for a, _ in spans], [b for _, b in spans])
        want.append((str(i), len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    for parts in (1, 5):
        got = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.digests(df.repartition(parts)).collect()]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("held", [1, 50, 1 << 20])
def test_shared_columns_do_not_depend_on_what_a_task_holds(spark, monkeypatch, held):
    monkeypatch.setattr(columns, "TASK_ENTRIES", held)
    monkeypatch.setattr(columns, "BATCH_BYTES", 200)
    rng = random.Random(4)
    sets = {i: np.unique(np.array([rng.getrandbits(64) if rng.random() < 0.5 else (k << 58) + 7 * k for k in rng.sample(range(60), 20)], np.uint64)) for i in range(40)}

    def columns_of(part, texts):
        return {int(t): sets[int(t)] for t in texts}

    df = spark.createDataFrame([(bytearray(str(i % 40).encode()),) for i in range(60)], "raw binary").repartition(3)
    got = {r["key"]: sorted(np.frombuffer(r["columns"], np.uint64).tolist()) for r in columns.shared_columns(df, columns_of, 16).collect()}
    count = collections.Counter(c for x in sets.values() for c in x.tolist())
    want = {i: sorted(columns.short(np.array([c for c in x.tolist() if count[c] > 1], np.uint64), 16).tolist()) for i, x in sets.items()}
    assert got == {i: x for i, x in want.items() if x}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=40))
def test_sorted_classes(strings):
    strings = [bytes(24) + s for s in strings]  # so that the blind tries have work
    memory = b"".join(strings)
    size = np.array(list(map(len, strings)))
    rank = suffixes.sorted_classes(memory, np.cumsum(size) - size, size)
    by = sorted(range(len(strings)), key=lambda i: strings[i])
    assert [strings[i] for i in np.argsort(rank, kind="stable")] == [strings[i] for i in by]
    assert all((rank[i] == rank[j]) == (strings[i] == strings[j]) for i in range(len(strings)) for j in range(len(strings)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_the_librarys(spark, odd, name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    texts = texts_of(odd)
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(odd, public_tokenizers.path(name)).collect()}
    assert got == {i: len(library.encode(t.decode(), add_special_tokens=False).ids) for i, t in texts.items()}
    units = tokens.UnitIds(tokens.Encoder(*tokens.spec_of(public_tokenizers.path(name))))
    ids, n = units.ids(list(texts.values()))
    parts = np.split(ids, np.cumsum(n)[:-1])
    assert [p.tolist() for p in parts] == [library.encode(t.decode(), add_special_tokens=False).ids for t in texts.values()]


def test_sentencepiece_counts(spark, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(odd, path).collect()}
    assert got == {i: len(model.encode(t.decode())) for i, t in texts_of(odd).items()}


def test_packing(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    once = odd.dropDuplicates(["doc_id"])
    got = packing.pack_documents(once, path, capacity=64).collect()
    whole = {i: library.encode(t.decode(), add_special_tokens=False).ids + [0] for i, t in texts_of(once).items()}
    seen, rooms = collections.defaultdict(dict), collections.defaultdict(list)
    for r in got:
        ids = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"] and len(ids) == r["length"]
        assert r["length"] == 64 or r["piece"] == 0
        seen[r["doc_id"]][r["piece"]] = r["length"]
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: sum(p.values()) for d, p in seen.items()} == {d: len(x) for d, x in whole.items()}
    for parts in rooms.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert len(rooms) <= 1.1 * sum(map(len, whole.values())) / 64 + 2
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_spreads_rows_without_ids(spark):
    # Rows that are all alike, ids and texts, still go to many groups, and none is lost.
    same = spark.range(400).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = stored(packing.pieces(same, path, capacity=64), "pieces")
    groups = packing.pack(cut, 64, group_size=40).groupBy(F.shiftright("sequence_id", 40).alias("g")).count().collect()
    assert len(groups) > 5 and max(r["count"] for r in groups) < 100 and sum(r["count"] for r in groups) == 400


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=2500))
def test_words_round_trip(ids):
    words, offsets = idfiles.encode(np.array(ids, np.uint64))
    assert idfiles.decode(words, offsets, len(ids)).tolist() == ids


def test_id_files(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    once = odd.dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in idfiles.ids_by_file(once, path).collect()}
    at = 0
    for d, t in sorted(texts_of(once).items()):
        ids = library.encode(t.decode(), add_special_tokens=False).ids + [1]
        assert (got[d]["start"], got[d]["n_tokens"], bytes(got[d]["ids"])) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert idfiles.ids_by_file(empty, path).count() == 0


def plain_repeats(words, least):
    cover, longest = set(), 0
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            k = 0
            while j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                cover.update(range(i, i + k))
                cover.update(range(j, j + k))
    return len(cover), longest


def test_quality_rules(spark, odd, empty):
    rng = random.Random(5)
    small = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    for t, m in zip(small, repetition.measure([s.encode() for s in small], repetition.RepetitionRules()), strict=True):
        w = t.split()
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert (m["n_words"], m["n_repeat_words"]) == (len(w), len(inside))
        assert (m["covered_words"], m["longest_repeat"]) == plain_repeats(w, 8)
        for least in (1, 2, 3):
            few = repetition.measure([t.encode()], repetition.RepetitionRules(min_repeat=least))[0]
            assert (few["covered_words"], few["longest_repeat"]) == plain_repeats(w, least)
    judged, name = repetition.quality_measures(odd.withColumn("quality", F.lit(1)))
    assert judged.count() == odd.count() and name != "quality"
    assert repetition.quality_measures(empty)[0].count() == 0
    one = repetition.measure(["# a\n\n# a\n é b|".encode()], repetition.RepetitionRules())[0]
    assert (one["word_chars"], one["n_symbols"], one["n_dup_lines"]) == (7, 3, 1)


def test_mixing(spark, odd, empty):
    slim = stored(mixing.sized(odd), "sized")
    got = mixing.mix(slim).collect()
    assert len(got) == odd.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mix(slim).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(stored(mixing.sized(empty), "sized")).count() == 0
    rows = mixing.mix_documents(odd)
    assert rows.columns == odd.columns


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, "w " * rng.randint(1, 40), f"s{i % 4}") for i in range(2000)], "doc_id bigint, text string, source string")
    got = mixing.mix(stored(mixing.sized(df), "sized")).groupBy("target", "source_size").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 4 and r["target"] <= 3 * r["source_size"] for r in got)
    assert abs(sum(r["target"] for r in got) - sum(r["source_size"] for r in got)) < 1e-6


def test_mixing_is_within_two_percent(spark):
    got = queries.op4_mixing(spark, "/root/testdata/sf0.01").groupBy("target", "source_size").agg(F.sum("taken").alias("taken")).collect()
    assert got and all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] for r in got)


def test_longer_documents_are_likelier_and_ties_stay_together(spark):
    rows = [(i, "w " * (100 if i % 2 else 1), "a" if i < 1000 else "b") for i in range(2000)] + [(5000, "w w", "c")] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(stored(mixing.sized(df), "sized"))
    missed = {r["size"]: r["count"] for r in got.where("copies = 0 and target < source_size and size in (1, 100)").groupBy("size").count().collect()}
    assert missed[1] > 2 * missed.get(100, 0)
    assert got.where("mix_id = 5000").select("taken").distinct().count() == 1


def test_targets_of_equal_sources(spark):
    # Sources of one size tie in the order of their caps; the words shared are all words.
    df = spark.createDataFrame([(i, "w " * 10, None if i % 8 == 7 else f"s{i % 8}") for i in range(80)], "doc_id bigint, text string, source string")
    slim = stored(mixing.sized(df), "sized")
    for weights, cap, want in (((5, 2, 1), 3, [800 * w / 23 for w in (5, 2, 1, 5, 2, 1, 5, 2)]), ((1, 3), 1.2, [80, 120] * 4), ((1,), 3, [100] * 8)):
        got = mixing.targets(slim, weights, cap).orderBy(F.col("mix_source").asc_nulls_last()).collect()
        assert [r["target"] for r in got] == pytest.approx(want)


def test_inclusion_follows_its_probability(spark):
    # 200 sources of the same documents, of which half of the words are sampled: the share that takes a document is its pi.
    sizes = [1, 2, 3, 5, 8, 400] + [10 + i for i in range(54)]
    df = spark.createDataFrame([(1000 * k + i, "w " * n, f"s{k:03d}") for k in range(200) for i, n in enumerate(sizes)], "doc_id bigint, text string, source string")
    slim = stored(mixing.sized(df), "sized")
    got = mixing.mix(slim, weights=(1, 3)).groupBy((F.col("mix_id") % 1000).alias("i"), "size").agg(F.avg(F.when(F.col("target") < F.col("source_size"), F.col("copies")).otherwise(F.col("copies") - 1)).alias("share")).collect()
    rest, certain = sum(sizes) / 2, []
    while True:
        factor = (rest - sum(certain)) / sum(n**1.5 for n in sizes if n not in certain)
        more = [n for n in sizes if factor * n**0.5 >= 1]
        if more == certain:
            break
        certain = more
    pi = {n: min(1.0, factor * n**0.5) for n in sizes}
    assert certain and abs(sum(pi[n] * n for n in sizes) - rest) < 1e-6
    assert all(r["share"] == 1 for r in got if r["size"] in certain)
    # Four standard errors of one document, and the rounds that fill the gap with short ones.
    assert all(abs(r["share"] - pi[r["size"]]) < 4 * (0.25 / 200) ** 0.5 + 0.02 for r in got if r["size"] > 8)
    assert abs(np.mean([r["share"] - pi[r["size"]] for r in got if r["size"] > 8])) < 0.02


def test_lean_changes_inclusion(spark):
    df = spark.createDataFrame([(i, "w", "a" if i < 1000 else "b", 9.0 if i % 2 else 1.0) for i in range(2000)], "doc_id bigint, text string, source string, lean double")
    got = mixing.mix(stored(mixing.sized(df, lean="lean"), "sized")).where("copies = 0 and target < source_size").groupBy((F.col("mix_id") % 2).alias("odd")).count().collect()
    missed = {r["odd"]: r["count"] for r in got}
    assert missed[0] > missed.get(1, 0)


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "a\\b<|\n", None, "", "x<", "\\"]
    rows = [(1, i, "assistant" if i % 2 else "us%er\n<", t) for i, t in enumerate(said)] + [(2, 0, "user", "only"), (None, 0, None, "t"), (3, 0, "assistant", "r"), (3, 1, "user", "after"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "user", "é" * 300_000), (5, 1, "assistant", "<|" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("example", F.lit(1)).withColumn("formatted", F.lit(2))
    done = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(chat.expand(done)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, t or "") for _, _, r, t in rows[:6]]
    assert got[1]["replies"] == [t or "" for t in said[1::2]] and got[2]["replies"] == [] and got[None]["turns"][0]["role"] == ""
    assert got[3]["replies"] == ["r"] and [t["text"] for t in got[3]["turns"]] == ["r", "after"] and got[4]["replies"] == ["same", "same"]
    assert got[5]["replies"] == [rows[-1][3]] and got[5]["turns"][0]["text"] == rows[-2][3]
    examples = chat.expand(done).where("conv_id = 1").orderBy("example").collect()
    whole = {r["conv_id"]: r["formatted"] for r in done.collect()}
    assert len(examples) == 3 and all(whole[1].startswith(e["text"]) and e["text"].endswith(chat.END) for e in examples)
    assert {c: r["formatted"] for c, r in got.items()} == whole
    tail = chat.expand(done).where("conv_id = 3").orderBy("example").collect()
    assert [(e["loss_start"] is None, e["last"]) for e in tail] == [(False, False), (True, True)]
    assert chat.read_back(chat.expand(chat.format_conversations(df.limit(0)))).count() == 0


def test_urls(spark):
    rules = queries.URL_RULES
    cases = [
        ("http://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("http://b.com/en/8", "b.com", "/en/8", "com/en/", "block"),
        ("http://notcom/en/", "notcom", "/en/", None, "allow"),
        ("http://x.example.net/de/81", "x.example.net", "/de/81", "example.net/de/8", "block"),
        ("http://h?x/y", "h", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id bigint, url string")
    got = urls.judge_urls(df, rules).orderBy("page_id").collect()
    assert [(r["url_host"], r["url_path"], r["url_rule"], r["url_verdict"]) for r in got] == [c[1:] for c in cases]


def test_impure_templates_are_rejected(spark):
    rows = [(i, f"http://h.io/bad/{i}", True) for i in range(8)] + [(20 + i, f"http://h.io/good/{i}", False) for i in range(8)] + [(40, "http://h.io/bad/99", None), (41, "http://h.io/good/99", None), (42, "http://h.io/new/1", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")
    got = {r["page_id"]: r["url_verdict"] for r in urls.judge_urls(df, [], labels=F.col("bad")).collect()}
    assert (got[40], got[41], got[42]) == ("block", "allow", "allow")


def test_path_tree_is_the_plain_one(spark):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        host = f"h{int(rng.random() ** 3 * 6)}.io"
        kind = rng.randint(0, 4)
        path = [f"/item/{rng.randint(0, 9)}/{rng.choice('abcdef')}", f"/user/u{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x/{rng.choice(['posts', 'pics'])}", f"/{rng.choice('abc')}/{rng.choice('de')}/{rng.choice('fghi')}/{rng.choice('jk')}/z", "/", "/one" + "/deep" * rng.randint(0, 8)][kind]
        share = {0: 0.9, 1: 0.1, 2: 0.5 if "b" in path else 0.95, 3: 0.3, 4: 0.8}[kind]
        rows.append((i, f"http://{host}{path}", rng.random() < share if rng.random() < 0.5 else None))
    rows += rows[:200]
    df = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean").withColumn("url_host", F.lit("old")).withColumn("host", F.lit("mine")).withColumn("salt", F.lit(0))
    found = urls.judge_urls(df, [], labels=F.col("bad"), template_rules=urls.TemplateRules(max_children=12))
    assert found.columns[: len(df.columns)] == df.columns and "url_host_" in found.columns
    assert urls.judge_urls(df.limit(0), []).count() == 0
    wide = [(u.split("://")[1].split("/", 1)[0], "/" + u.split("://")[1].split("/", 1)[1], bad) for _, u, bad in rows]
    want = sorted((i, v) for (i, _, _), v in zip(rows, plain_verdicts(wide, max_children=12), strict=True))
    got = sorted((r["page_id"], r["url_verdict"]) for r in found.collect())
    assert got == want and {v for _, v in want} == {"allow", "block"}
    assert found.where("url_template like '%/*/%'").count() > 0


def test_very_long_paths(spark):
    long = "http://h.io" + "/a" * 20_000
    df = spark.createDataFrame([(1, long, True), (2, long, None), (None, None, None), (3, "http://h.io/b", None)], "page_id bigint, url string, bad boolean")
    got = {r["page_id"]: r["url_verdict"] for r in urls.judge_urls(df, [], labels=F.col("bad")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", None: "allow"}


def test_a_few_labels_reject_no_other_folder(spark):
    rows = [("one.org", "/en/a", True), ("one.org", "/contact", None), ("one.org", "/fr/about", None), ("one.org", "/en/b", None), ("one.org", "/en/a", None)]
    rows += [("few.org", f"/en/{i}", True) for i in range(10)] + [("few.org", "/fr/1", None), ("few.org", "/en/99", None)]
    rows += [("many.org", f"/en/{i}", True) for i in range(11)] + [("many.org", "/fr/1", None)]
    rows += [("wide.org", f"/{x}/{i}", True) for x in "abcd" for i in range(3)] + [("wide.org", "/e/1", None)]
    rows += [("mixed.org", f"/{x}/{i}", x in "abc") for x in "abcd" for i in range(30)] + [("mixed.org", "/a/new", None), ("mixed.org", "/d/new", None), ("mixed.org", "/e/1", None)]
    df = spark.createDataFrame([(i, f"http://{h}{p}", bad) for i, (h, p, bad) in enumerate(rows)], "page_id bigint, url string, bad boolean")
    got = {r["page_id"]: r["url_verdict"] for r in urls.judge_urls(df, [], labels=F.col("bad")).collect()}
    assert [got[i] for i in sorted(got)] == plain_verdicts(rows)
    seen = {(h, p): got[i] for i, (h, p, bad) in enumerate(rows) if bad is None}
    assert [p for (h, p), v in seen.items() if h == "one.org" and v == "block"] == ["/en/a"]
    assert [seen["few.org", "/fr/1"], seen["few.org", "/en/99"], seen["many.org", "/fr/1"], seen["wide.org", "/e/1"]] == ["allow", "block", "block", "block"]
    assert [seen["mixed.org", p] for p in ("/a/new", "/d/new", "/e/1")] == ["block", "allow", "allow"]


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24))
    x[700:] = x[:800] + 0.1 * rng.normal(size=(800, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0]), (2004, [None] * 24), (2020, x[0].tolist()), (2040, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, F.col("id") % 20 == 0, 10, params=ann.CodeParams(base_block=400)).collect()
    ids = np.array([i for i, v in rows if i < 2000 or i >= 2020])
    full = np.array([v for i, v in rows if i < 2000 or i >= 2020])
    hit = total = 0
    by = collections.defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {int(i) for i in ids if i % 20 == 0}
    for q, found in by.items():
        v = full[ids == q][0]
        score = (full * v).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:10]
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 11))
        hit += len({i for _, i, _ in found} & set(ids[order].tolist()))
        total += 10
    assert hit / total >= 0.9
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    other = rng.normal(size=8).tolist()
    df = spark.createDataFrame(rows + rows[:30] + [(20, other), (None, other)], "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0, 10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    points = [(i, np.array(v)) for i, v in [*rows, (20, other)]]
    for i, q in points:
        if i % 20 == 0:
            want = sorted((-float((v * q).sum()), j) for j, v in points if j != i)[:10]
            assert all(any(r[0] == k + 1 and r[1] == j and abs(r[2] + s) < 1e-12 for r in got[i]) for k, (s, j) in enumerate(want))
    assert {i: len(v) for i, v in got.items()} == {0: 10, 20: 20, 40: 10}


def test_codes_within_a_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) & rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for bits in (64, 20):
        own = codes & np.uint64((1 << bits) - 1)
        index = ann.SubstringIndex(own, bits)
        for radius in (0, 1, 2, 5, 11, 30, 64):
            for c in own[:20]:
                assert index.within(c, radius).tolist() == np.flatnonzero(np.bitwise_count(own ^ c) <= radius).tolist()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_default_radius_keeps_the_neighbours(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    asked = ids[ids % 20 == 0][:100].tolist()
    found = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("id").isin(asked)).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in asked:
        score = (x * x[ids == q][0]).sum(1)
        hit += len({i for i, _ in found[q]} & set([i for i in ids[np.lexsort((ids, -score))].tolist() if i != q][:20]))
        assert all(abs(s - score[ids == i][0]) < 1e-12 for i, s in found[q]) and found[q] == sorted(found[q], key=lambda r: (-r[1], r[0]))
    assert set(found) == set(asked) and hit >= 0.95 * 20 * len(asked)


def test_queries_are_right_on_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = texts_of(docs)
    sets, spans = plain_sets(texts), plain_spans(texts)
    label = plain_components(sets)
    got = {r["doc_id"]: r for r in queries.op5_jaccard_join(spark, SF).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == {d: (len(sets[d]), label[d]) for d in texts}
    for r in queries.op2_suffix_dedup(spark, SF).collect():
        t, own = texts[r["doc_id"]], spans[r["doc_id"]]
        kept = suffixes.without(t, [a for a, _ in own], [b for _, b in own])
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), len(t) - len(kept), len(own), hashlib.sha256(kept).hexdigest())
    byte, word = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    ids = {d: byte.encode(t.decode(), add_special_tokens=False).ids for d, t in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op7_token_counts(spark, SF).collect()} == {d: (len(texts[d]), len(x), len(x) > 1024) for d, x in ids.items()}
    packed, rooms = queries.op8_best_fit_packing(spark, SF).collect(), collections.defaultdict(list)
    for r in packed:
        part = [*ids[r["doc_id"]], 0][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    total = sum(len(x) + 1 for x in ids.values())
    assert sum(r["length"] for r in packed) == total and len(rooms) <= 1.05 * total / 2048 + 1
    assert all(sorted(v) == [(sum(n for _, n in sorted(v)[:k]), sorted(v)[k][1]) for k in range(len(v))] for v in rooms.values())
    at, found = 0, {r["doc_id"]: r for r in queries.op9_token_id_output(spark, SF).collect()}
    for d in sorted(texts):
        x = [*word.encode(texts[d].decode(), add_special_tokens=False).ids, 1]
        assert (found[d]["start"], found[d]["n_tokens"], found[d]["ids_crc32"]) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    for r in queries.op10_quality_rules(spark, SF).collect():
        w = texts[r["doc_id"]].translate(None, b"").split()
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        lines = [x for x in texts[r["doc_id"]].split(b"\n") if x.split()]
        symbols = sum(texts[r["doc_id"]].count(c) for c in b"#*$%&|<>")
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(len(x.decode()) for x in w), symbols, len(lines) - len(set(lines)), len(inside), failed)
        if len(w) <= 400:
            covered, longest = plain_repeats(w, 8)
            assert r["kept"] == (not failed and 100 * covered <= 30 * len(w) and longest <= 120 and 100 * symbols <= 5 * r["word_chars"])
    for name in ("op1_nearest_neighbours", "op3_chat_formatting", "op4_mixing", "op6_url_filters"):
        assert queries.queries()[name](spark, SF).count() > 0


def test_texts_of_a_megabyte_and_odd_tables(spark, empty):
    rng = random.Random(11)
    words = [f"word{i}" for i in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(150_000))
    rows = [(3, long, 1), (7, long[:600_000] + " cut " + long[650_000:], 1), (9, long[700_000:700_400], 1), (None, long[:100], 1), (9, long[700_000:700_400], 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, raw int").withColumn("block", F.lit(1)).withColumn("span_doc", F.lit(2)).withColumn("text_sha", F.lit(3)).withColumn("mix_id", F.lit(4)).withColumn("size", F.lit(5)).withColumn("source", F.lit("s"))
    texts = {r[0]: r[1].encode() for r in rows if r[0] is not None}
    want = plain_spans(texts)
    for r in suffixes.digests(df).where("doc_id is not null").collect():
        own = want[r["doc_id"]]
        assert (r["n_spans"], r["n_removed"]) == (len(own), sum(b - a for a, b in own))
    cut = suffixes.remove_repeats(df)
    assert cut.columns == df.columns and cut.count() == 5
    label = plain_components(plain_sets(texts))
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(df).where("doc_id is not null").collect()} == label
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    n = {d: len(library.encode(t.decode(), add_special_tokens=False).ids) for d, t in texts.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, path).where("doc_id is not null").collect()} == n
    packed = packing.pack_documents(df, path).where("doc_id in (3, 7)").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {3: n[3] + 1, 7: n[7] + 1}
    read = idfiles.ids_by_file(df, path).collect()
    assert len(read) == 5 and sorted(r["n_tokens"] for r in read)[-2:] == sorted([n[3] + 1, n[7] + 1])
    assert repetition.keep_good(df).columns == df.columns
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and mixed.where("doc_id = 3").count() <= 3
    for found in (mixing.mix_documents(empty), suffixes.remove_repeats(empty), shingles.keep_first(empty), repetition.keep_good(empty)):
        assert found.columns == empty.columns and found.count() == 0
    assert tokens.count_tokens(empty, path).count() == 0
