"""The stages of the pipeline, each judged on its own input by a plain version."""

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from llm_plain import plain_components, plain_sets, plain_spans, texts_of

from listenlake.llm import repetition, suffixes
from listenlake.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "jaccard_join", "suffix_dedup", "source_mix", "best_fit_packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        kept.append(docs)
    start = table(spark, SF, "documents")
    good, first, cut, mixed, packed = kept
    texts = texts_of(start)
    rules = repetition.RepetitionRules()
    assert {r["doc_id"] for r in good.collect()} == {i for i, t in texts.items() if repetition.measure([t], rules)[0]["kept"]}
    label = plain_components(plain_sets(texts_of(good)))
    assert {r["doc_id"] for r in first.collect()} == {i for i in label if label[i] == i}
    before, spans = texts_of(first), plain_spans(texts_of(first))
    for i, t in texts_of(cut).items():
        pairs = [suffixes.inward(before[i], a, b) for a, b in spans[i]]
        assert t == suffixes.without(before[i], [a for a, _ in pairs], [b for _, b in pairs])
    assert all(df.columns == start.columns for df in kept[:4])
    size = lambda df: sum(len(t.split()) for t in [(r["text"] or "").encode() for r in df.collect()])
    assert abs(size(mixed) - size(cut)) < 0.05 * size(cut) + 5000
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in packed.collect()) == sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
