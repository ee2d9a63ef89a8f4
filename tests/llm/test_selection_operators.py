"""Mixing, packing, toxicity, languages and the pipeline."""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewater.llm import language_id, mixing, packing, queries, toxicity
from tidewater.llm.textkernel import chunks

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_targets_by_rounds():
    assert mixing.capped_targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.capped_targets([10, 1000], [3, 1]) == [30, 980]
    assert mixing.capped_targets([0, 7], [1, 1]) == [0, 7] and mixing.capped_targets([], []) == []


@given(st.lists(st.integers(0, 500), min_size=1, max_size=12))
def test_targets_share_everything(sizes):
    t = mixing.capped_targets(sizes, [float(i % 3 + 1) for i in range(len(sizes))])
    assert sum(t) == pytest.approx(sum(sizes)) and all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes, strict=True))


def test_flow_routes_overlapping_sources():
    given_ = mixing.route({("a",): 100, ("b",): 10, ("a", "b"): 50}, {"a": 100, "b": 60})
    assert given_ == {("a",): 100, ("b",): 10, ("a", "b"): 50}
    again = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 20, "b": 25})
    assert again == {("a",): 20, ("a", "b"): 25}


def test_mix_comes_near_targets(docs):
    taken, sources = mixing.mix(docs, "source")
    rows = taken.collect()
    for r in sources.collect():
        own = [x for x in rows if x["source"] == r["source"]]
        assert sum(len(WORD.findall(x["text"])) for x in own) == r["source_size"] == sum(x["size"] for x in own)
        assert all(x["taken"] == x["size"] * x["copies"] and x["copies"] <= 3 for x in own)
        assert abs(sum(x["taken"] for x in own) - r["target"]) <= 0.01 * r["target"] + max(x["size"] for x in own) / 2
    again = mixing.mix(docs.repartition(5), "source")[0]
    assert {(r["doc_id"], r["copies"]) for r in again.collect()} == {(r["doc_id"], r["copies"]) for r in rows}


def test_mix_refines_histograms(docs, monkeypatch):
    """The cut is found in many small steps as well."""
    monkeypatch.setattr(mixing, "STEP_BITS", 2)
    monkeypatch.setattr(mixing, "NEAR_DOCS", 4)
    taken, sources = mixing.mix(docs, "source")
    rows = taken.collect()
    for r in sources.collect():
        own = [x for x in rows if x["source"] == r["source"]]
        assert abs(sum(x["taken"] for x in own) - r["target"]) <= 0.02 * r["target"] + max(x["size"] for x in own) / 2


def test_mix_edge_cases(odd_docs, no_docs):
    taken, sources = mixing.mix(odd_docs, "source")
    assert taken.count() == odd_docs.count() and {r["source"] for r in sources.collect()} == {"a", "b", "c", None}
    repeated = mixing.mixed_documents(odd_docs)
    assert repeated.columns == odd_docs.columns and all(r["size"] == "x" for r in repeated.collect())
    assert mixing.mix(no_docs, "source")[0].count() == 0 and mixing.mixed_documents(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=40), st.sampled_from([0.0, 0.05, 1.0]))
def test_pack_group(lengths, waste):
    sequences = packing.pack_group(lengths, 32, waste)
    got = defaultdict(list)
    for s in sequences:
        assert 0 < sum(n for _, _, n in s) <= 32
        for i, start, n in s:
            got[i].append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(got[i]):
            assert start == at and k > 0
            at += k
        assert at == n
    if lengths and waste == 0.0:
        assert sum(32 - sum(n for _, _, n in s) for s in sequences) < 32


@given(st.lists(st.integers(1, 32), max_size=40))
def test_first_fit_decreasing(lengths):
    order, bins, room = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)), [], []
    for i in order:
        for b, left in enumerate(room):
            if left >= lengths[i]:
                bins[b].append(i)
                room[b] -= lengths[i]
                break
        else:
            bins.append([i])
            room.append(32 - lengths[i])
    assert packing.first_fit_decreasing(lengths, 32) == bins


@pytest.fixture(scope="module")
def reference_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@functools.cache
def rank_tokens():
    return packing.Tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


ODD = ["", " ", "  a", "a  b", " a", "a ", "a\n b", "a \nb", "é ö", "x  y", "x  y", "  q", "q  ", "don't 12 3.4", "<|endoftext|> x", "a\u0085 b", "日本 語 x", "\x1c a \x1f b", "a b\n", "tab\t x", "é e"]


@pytest.mark.parametrize("kind", ["json", "tiktoken"])
def test_tokens_are_the_vocabularys(reference_tokenizer, docs, kind):
    texts = [*ODD, *(r["text"] for r in docs.limit(40).collect()), *ODD]
    tokens = packing.Tokens(public_tokenizers.path(f"byte_bpe_50k.{kind}"), public_tokenizers.PATTERN)
    got = [ids.tolist() for c in chunks(pa.array(texts), 3000) for ids in tokens(c)]
    assert got == [e.ids for e in reference_tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é \n\t.'1 ", max_size=12), min_size=1, max_size=5))
def test_tokens_of_any_text(reference_tokenizer, texts):
    tokens = rank_tokens()
    got = [ids.tolist() for c in chunks(pa.array(texts)) for ids in tokens(c)]
    assert got == [e.ids for e in reference_tokenizer.encode_batch(texts, add_special_tokens=False)]


SPACES = " \t\n\r\x0b\x0c\x1c\x1f\x85\u00a0\u1680\u2000\u2009\u2028\u2029\u202f\u205f\u3000\u200b\ufeff"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(SPACES), st.sampled_from("abé漢字かな한🙂👩‍👩‍👧\u0301\u093f1٣½'s.-_<|>"), st.characters(exclude_categories=["Cs"])), max_size=25), min_size=1, max_size=4))
def test_tokens_of_any_unicode(reference_tokenizer, texts):
    tokens = rank_tokens()
    assert packing.LOOK_AHEAD in public_tokenizers.PATTERN
    got = [ids.tolist() for c in chunks(pa.array(texts)) for ids in tokens(c)]
    assert got == [e.ids for e in reference_tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_pieces(pieces, texts, tokenizer, width=2048):
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i]) and p["ids_crc32"] == zlib.crc32(ids[i][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= width and all(p["sequence_length"] == at for p in own)
    return sum(packing.padding(s[0]["sequence_length"]) for s in by_sequence.values()) / sum(map(len, ids.values()))


def test_packing_query(spark, sf, docs, reference_tokenizer):
    pieces = queries.op5_packing(spark, sf).collect()
    assert check_pieces(pieces, [(r["doc_id"], r["text"]) for r in docs.collect()], reference_tokenizer) < 0.02


def test_packing_edge_cases(odd_docs, no_docs):
    pieces = packing.pack(odd_docs, *queries.vocabulary()).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 2) == 2 * sum(p["length"] for p in pieces if p["doc_id"] == 1)
    assert [p["doc_tokens"] for p in pieces if p["doc_id"] == 3] == [1] and len(pieces[0]["ids"]) == 4 * pieces[0]["length"]
    assert packing.pack(no_docs, *queries.vocabulary()).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["abcde", "aabab", "babab", "stupid"]), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 8), st.sampled_from("abcst")), max_size=2))
def test_automaton(word, changes):
    entries = ["abcde", "aabab", "babab", "stupid"]
    letters = list(word)
    for kind, at, c in changes:
        at = min(at, len(letters))
        letters[at : at + (kind > 0)] = [] if kind == 2 else [c]
    word = "".join(letters)
    near = [i for i, e in enumerate(entries) if edits(e, word) <= 1]
    assert toxicity.Lexicon([(e, False, 1.0 + i) for i, e in enumerate(entries)]).fuzzy(word) == (max(near) if near else None)


def test_quotation_lowers_the_score():
    assert toxicity.is_quoted('he said "you ', "stupid", ' man" today') and toxicity.is_quoted("they called him ", "stupid", "")
    assert not toxicity.is_quoted("you are ", "stupid", " and bad") and not toxicity.is_quoted('a "b" ', "stupid", ' "c"')


def test_toxicity_learns(spark, odd_docs, no_docs):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{v}" for v in rng.integers(0, 300, 40)]
        toxic = i % 5 == 0
        if toxic:
            words[7], words[20] = ["grumple", "grumpel", "grumplle"][i // 5 % 3], f"zorq{rng.integers(99)}"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, marks).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(i for i in out if out[i]["held_out"]) == held
    assert np.mean([out[i]["predicted"] == labels[i][1] for i in held]) > 0.95
    odd = toxicity.score_toxicity(odd_docs, marks.withColumn("toxic", F.when(F.col("doc_id") % 7 > 0, F.col("toxic")))).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score_toxicity(no_docs, marks).count() == 0
    assert {r["predicted"] for r in toxicity.score_toxicity(odd_docs, marks.filter("false")).collect()} == {0}


def test_language_query(spark, sf, docs):
    out = queries.op10_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == docs.count() and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_language_edge_cases(odd_docs, no_docs, docs):
    out = language_id.identify(odd_docs.select("doc_id", "text").join(docs.limit(0).select("doc_id", "lang"), "doc_id", "left")).collect()
    assert {r["lang_pred"] for r in out} == {"und"} and {r["score"] for r in out} == {0.0}
    both = language_id.identify(docs.select("doc_id", "text", "lang").union(odd_docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit(None).cast("string")))).collect()
    no_letter = [r for r in both if r["doc_id"] in (10**6 + 3, 10**6 + 4, 10**6 + 6)]
    assert [r["lang_pred"] for r in no_letter] == ["und"] * 3 and all(r["rejected"] for r in no_letter)
    assert language_id.identify(no_docs).count() == 0


def test_pipeline_stages(spark, sf, docs, reference_tokenizer):
    """Each stage on its predecessor's rows, by brute-force versions where the other tests don't have them."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "mixing", "packing"]
    from test_dedup_operators import brute
    from test_text_operators import counts, drop_lines

    from tidewater.sources.work import materialize

    frame, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = materialize(stage(spark, frame, sf), name)
        assert frame.columns == docs.columns
        seen.append([(r["doc_id"], r["text"]) for r in frame.collect()])
    start = [(r["doc_id"], r["text"]) for r in docs.collect()]
    good = [(i, t) for i, t in start for c in [counts(t)] if c[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    assert sorted(seen[0]) == sorted(good)
    assert Counter(seen[1]) == Counter((i, t) for i, _, _, t in drop_lines(seen[0], 10))
    want, _ = brute(seen[1], 5)
    assert sorted(i for i, _ in seen[2]) == sorted({want[i] for i, _ in seen[1]})
    assert set(seen[3]) <= set(seen[2]) and max(Counter(seen[3]).values()) <= 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, sf).collect()
    lengths = {i: len(reference_tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in seen[3]}
    assert sum(p["length"] for p in pieces) == sum(lengths[i] for i, _ in seen[3])
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)
