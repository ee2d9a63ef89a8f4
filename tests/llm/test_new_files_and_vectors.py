"""Token files, importance resampling and whitening against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import importance, quickselect, token_files, whitening
from tidewater.sources.work import materialize

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def token_rows(docs, tokenizer):
    """(doc_id, start, n_tokens, crc) of rows (doc_id, text) in order."""
    out, start = [], 0
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_brute_force(spark, docs, tokenizer):
    found = token_files.read_documents(token_files.write_token_files(docs, VOCABULARY, rows_per_batch=3, width=128)).orderBy("doc_id").collect()
    wanted = token_rows([(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()], tokenizer)
    assert [tuple(r) for r in found] == wanted


def test_token_files_of_odd_documents(spark, odd_docs, no_docs, tokenizer):
    manifest = token_files.write_token_files(odd_docs, VOCABULARY, width=64)
    found = token_files.read_documents(manifest).orderBy("start").collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    wanted = token_rows(sorted(rows, key=lambda r: (r[0] is None, r[0])), tokenizer)
    assert [tuple(r) for r in found] == wanted
    assert token_files.read_documents(token_files.write_token_files(no_docs, VOCABULARY)).count() == 0


def test_sequences_are_views_of_the_file(spark, docs, tmp_path):
    manifest = token_files.write_token_files(docs.limit(60), VOCABULARY, folder=str(tmp_path / "out"), rows_per_batch=4, width=256).collect()
    for row in manifest:
        file, plain = token_files.TokenFile(row.ids_file), pa.ipc.open_stream(row.ids_file).read_all()
        assert len(file) == row.n_sequences == plain.num_rows
        ids, mask = plain.column("ids").to_pylist(), plain.column("mask").to_pylist()
        assert sum(map(sum, mask)) == row.n_tokens and all(all(m) for m in mask[:-1])
        for i in {0, len(file) // 2, len(file) - 1}:
            one, flags = file.sequence(i)
            assert not one.flags.owndata and one.tolist() == ids[i] and flags.to_pylist() == mask[i]
    assert sorted(Path(tmp_path / "out" / "files").iterdir()) == sorted(Path(p) for r in manifest for p in (r.ids_file, r.docs_file))
    sequences = token_files.read_sequences(token_files.token_manifest(spark, str(tmp_path / "out")))
    assert sequences.count() == sum(r.n_sequences for r in manifest)
    assert sequences.agg(F.sum(F.size(F.filter("mask", lambda x: x)))).first()[0] == sum(r.n_tokens for r in manifest)


def test_files_of_lost_attempts_are_not_read(spark, docs, tmp_path, tokenizer):
    folder = str(tmp_path / "out")
    before = token_files.write_token_files(docs.limit(20), VOCABULARY, folder=folder)
    for p in list(Path(folder, "files").iterdir()):
        (p.parent / p.name.replace("part-", "part-9")).write_bytes(p.read_bytes()[:100])  # what a lost executor leaves
    assert token_files.read_documents(before).count() == 20


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aB'sStdlvemr09.,|<> é“\u0301٣", max_size=60)))
def test_words_give_the_ids_of_whole_texts(text):
    whole, words = test_words_give_the_ids_of_whole_texts.encoders
    raw = text.encode("utf-8", "ignore")
    assert words([raw]) == whole([raw])


test_words_give_the_ids_of_whole_texts.encoders = (token_files.TextIds(VOCABULARY, "<u2", by_pieces=False), token_files.TextIds(VOCABULARY, "<u2"))


def test_special_strings_and_long_words():
    whole, words = test_words_give_the_ids_of_whole_texts.encoders
    for text in ("a<|endoftext|>b c", "<|startoftext|> it's I'LL", "x" * 5000 + " y", "É ́e İ ΣΣ   \x1c\x85\xa0 z", "가 ᆨ"):
        assert words([text.encode()]) == whole([text.encode()])


def test_long_texts_are_cut_at_white_space():
    whole, words = test_words_give_the_ids_of_whole_texts.encoders
    texts = [("word é'tis 12 " * 150_000).encode(), b"z" * 3_000_00, b"", b" \n ", ("a b" * 9).encode()]
    assert words(texts) == whole(texts) and sum(map(len, words.words.now)) + sum(map(len, words.pieces.now)) < 100_000


def brute_importance(docs, targets, max_words, buckets, min_words, percent, seed):
    def runs(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, max_words + 1) for i in range(len(words) - k + 1)]

    mine, theirs = [runs(t) for _, t in docs], [runs(t) for t in targets]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for found, total in ((mine, s), (theirs, t)):
        for _, f in found:
            np.add.at(total, f, 1)
    gains = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    rows = []
    for (doc_id, _), (n, f) in zip(docs, mine):
        weight = sum(gains[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    fit = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = [(*r[:4], i + 1) for i, r in enumerate(fit[: percent * len(fit) // 100])]
    return drawn, rows


@pytest.mark.parametrize("max_words", [1, 3])
def test_importance_equals_brute_force(spark, sf, docs, max_words):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = importance.resample(docs, target, max_words=max_words, buckets=997, percent=30).collect()
    drawn, rows = brute_importance([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], max_words, 997, 20, 30, 2024)
    assert sorted(tuple(r)[:4] for r in found) == sorted(tuple(r[:4]) for r in rows)
    assert sorted((tuple(r) for r in found if r["rank"]), key=lambda r: r[4]) == drawn


def test_importance_of_odd_documents(spark, odd_docs, no_docs):
    found = importance.resample(odd_docs, no_docs, percent=60).collect()
    drawn, rows = brute_importance([(r.doc_id, r.text) for r in odd_docs.collect()], [], 1, 10_000, 20, 60, 2024)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted((tuple(r)[:4] for r in found), key=key) == sorted((tuple(r[:4]) for r in rows), key=key)
    assert sorted((tuple(r) for r in found if r["rank"]), key=lambda r: r[4]) == drawn
    assert importance.resample(no_docs, odd_docs).count() == 0


def test_long_words_and_crc():
    texts = [b"abc", b"", b"x" * 500, "héllo".encode(), b"y" * 48, b"z" * 49]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    assert importance.crc32_spans(data, end - [len(t) for t in texts], end).tolist() == [zlib.crc32(t) for t in texts]


def test_quickselect_finds_each_place(spark):
    rows = materialize(spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 5 else cast(id * 7919 % 101 as int) end as a", "case when id % 11 > 0 then cast(id % 5 as string) end as b"), "selected")
    order = sorted(([r.a, r.b, r.id] for r in rows.collect()), key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    for k in (1, 2, 700, 1999, 3000):
        assert quickselect.kth_key(rows, ["a", "b", "id"], k) == tuple(order[k - 1])
    assert quickselect.kth_key(rows, ["a", "b", "id"], 0) is None and quickselect.kth_key(rows, ["a", "b", "id"], 3001) is None
    low, high = quickselect.split_at(rows, ["a", "b", "id"], 1234)
    assert [[r.a, r.b, r.id] for r in quickselect.ranked(low, ["a", "b", "id"]).orderBy("rank").collect()] == order[:1234] and high.count() == 1766


def random_symmetric(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.asarray(values, float)) @ q.T


SPECTRA = {
    "falling": 0.8 ** np.arange(64), "flat": np.ones(40), "pairs": np.repeat(np.arange(1, 21), 2)[::-1], "one": np.array([3.0]), "two": np.array([2.0, 1.0]),
    "low rank": np.concatenate([np.linspace(5, 1, 7), np.zeros(30)]), "close": 1 + 1e-7 * np.arange(50), "wide": 10.0 ** -np.linspace(0, 9, 60), "cluster": np.concatenate([[100.0], np.full(33, 2.0), np.full(20, 1.0)]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_feast_finds_all_leading_pairs(name):
    v = random_symmetric(SPECTRA[name])
    values, vectors = whitening.leading_eigenpairs(v, 32)
    wanted = np.sort(SPECTRA[name])[::-1]
    wanted = wanted[wanted > 1e-11 * wanted[0]][:32]
    assert len(values) == len(wanted) and np.abs(values - wanted).max() < 1e-13 * wanted[0] * 50
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * wanted[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_inertia_counts():
    v = random_symmetric(SPECTRA["wide"])
    shifts = np.array([-1.0, 1e-9, 1e-5, 0.5, 2.0])
    assert whitening.count_below(*whitening.tridiagonal(v), shifts).tolist() == [int((np.linalg.eigvalsh(v) < s).sum()) for s in shifts]


def test_an_interval_is_whole_whatever_the_first_block():
    values = np.concatenate([np.linspace(1.0, 1.001, 12), np.linspace(0.2, 0.99, 30)])
    found, _ = whitening.eigenpairs_between(random_symmetric(values), 0.995, 1.1, 12)
    assert np.abs(np.sort(found) - np.linspace(1.0, 1.001, 12)).max() < 1e-13


def brute_whitening(rows, k=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s).astype(float) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), centred @ vectors / np.sqrt(values), values / np.trace(v)


def test_whitening_equals_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = {(r.vec_id, r.component): r for r in whitening.whiten(table).collect()}
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    deviation, whitened, explained = brute_whitening(rows)
    assert len(found) == len(rows) * 32
    for c in range(32):
        ours = np.array([found[i, c + 1].whitened for i, _ in rows])
        sign = np.sign(ours @ whitened[:, c])
        assert np.abs(ours - sign * whitened[:, c]).max() < 1e-8
    assert [found[i, 1].deviation for i, _ in rows] == deviation.tolist()
    assert max(abs(r.explained / explained[r.component - 1] - 1) for r in found.values()) < 1e-9
    assert len({r.identity_error for r in found.values()}) == 1 and found[rows[0][0], 1].identity_error < 1e-9 and found[rows[0][0], 1].n == len(rows)


def test_whitening_of_odd_vectors(spark):
    rng, schema = np.random.default_rng(3), "vec_id long, embedding array<float>, label int, component string, n int, vector string"
    good = [(i, rng.normal(size=5).astype(np.float32).tolist(), 1) for i in range(60)]
    short = [(100 + i, rng.normal(size=3).astype(np.float32).tolist(), None) for i in range(20)]
    odd = [(None, [0.5] * 5, 1), (None, [0.5] * 5, 1), (200, None, 1), (201, [], 1), (202, [1.0, None, 1.0, 1.0, 1.0], 1), (203, [float("nan")] * 5, 1), (204, [float("inf")] * 5, 1), (205, [3e38] * 5, 1)]
    table = spark.createDataFrame([(*r, "c", 1, "v") for r in good + short + odd], schema)
    found = whitening.whiten(table).collect()
    assert len(found) == 62 * 5 + 20 * 3 and {r.n for r in found} == {62, 20}
    assert {r.vec_id for r in found} == {*range(60), *range(100, 120), None}
    assert all(r.identity_error < 1e-9 for r in found)
    assert whitening.whiten(table.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "c", 1, "v") for i in range(5)], schema)
    assert whitening.whiten(same).count() == 0


def test_large_deviations():
    x = np.array([[0, 0], [1 << 40, 5], [3, 1 << 33]], np.int64)
    n, s = len(x), x.astype(object).sum(axis=0)
    known = whitening.Fit(n, (s // n).astype(np.int64), (s % n).astype(np.int64))
    wanted = [int(v) for v in ((n * x.astype(object) - s) ** 2).sum(axis=1)]
    assert known.deviation(x).to_pylist() == [v if v < 1 << 63 else None for v in wanted]
