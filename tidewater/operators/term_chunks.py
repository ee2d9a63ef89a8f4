"""Terms (word n-grams) of a chunk of texts as arrays: what the tasks of textstats.tfidf_terms do.

A term is known by a 64-bit hash: that of its word, or a mix of its words' hashes. The different terms of a chunk are
counted once for all its documents, so that they leave it and not the (document, term) pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SENT = "chunk int, bucket int, hashes array<bigint>, dfs array<int>"
BACK = "chunk int, bucket int, dfs array<bigint>"
SUMS = "word string, s double"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array of arrays that end at `ends`."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values))


def _split(texts: pa.ChunkedArray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Words as codes of a vocabulary, and of each word the number of its sentence and of its text."""
    text = texts.cast(pa.large_string()).combine_chunks()
    _, bounds, data = text.buffers()
    bounds = np.frombuffer(bounds, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    in_word = data > ord(" ")
    edges = np.flatnonzero(np.diff(in_word, prepend=False, append=False))
    starts, bytes_of = edges[::2].copy(), edges[1::2] - edges[::2]
    del edges
    sentence = np.searchsorted(np.flatnonzero(data == 1), starts).astype(np.int32)
    of_text = np.repeat(np.arange(len(text), dtype=np.int32), np.diff(np.searchsorted(starts, bounds - bounds[0])))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(bytes_of))), pa.py_buffer(data[in_word]))
    return words.dictionary_encode(), sentence, of_text


class Terms:
    """The different terms of a chunk, numbered as they are first met, and its (document, term) pairs.

    `texts` are those of functions.text.sentence_words. Texts of one key are one document; so are those without a key, the last.
    """

    def __init__(self, keys: pa.ChunkedArray, texts: pa.ChunkedArray, lengths: Sequence[int]) -> None:
        coded = keys.combine_chunks().dictionary_encode()
        self.n_keys, self.lengths = len(coded.dictionary), lengths
        words, sentence, of_text = _split(texts)
        doc = coded.indices.fill_null(self.n_keys).to_numpy()[of_text]
        self.codes, self.vocabulary = words.indices.to_numpy(), words.dictionary
        single = pd.util.hash_array(self.vocabulary.to_numpy(zero_copy_only=False), categorize=False)[self.codes]
        hashes, docs, self.places = [], [], []
        for n in lengths:
            most = max(len(single) - n + 1, 0)
            h = single[:most]
            for j in range(1, n):
                h = _mixed(h, single[j : j + most])
            place = np.flatnonzero(sentence[:most] == sentence[n - 1 : n - 1 + most]).astype(np.int32)
            hashes.append(h[place])
            docs.append(doc[place])
            self.places.append(place)
        # What isn't needed any more goes at once: a worker's memory is that of these arrays.
        del words, sentence, of_text, doc, single, h, place
        hashes = np.concatenate(hashes)
        terms = pa.array(hashes).dictionary_encode()
        del hashes
        self.ids, self.hashes = terms.indices.to_numpy(), terms.dictionary.to_numpy()
        pairs = self.ids.astype(np.int64)
        pairs *= self.n_keys + 1
        for part, end in zip(docs, np.cumsum([len(d) for d in docs]), strict=True):
            pairs[end - len(part) : end] += part
        del docs, part
        pairs.sort()
        heads = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
        self.tf = np.diff(heads, append=len(pairs)).astype(np.int32)
        pairs = pairs[heads]
        del heads
        self.term = (pairs // (self.n_keys + 1)).astype(np.int32)
        self.doc = (pairs - self.term.astype(np.int64) * (self.n_keys + 1)).astype(np.int32)

    def words(self, chosen: np.ndarray) -> pa.Array:
        """The words of terms, given by their numbers in ascending order."""
        first = np.flatnonzero(np.diff(np.maximum.accumulate(self.ids), prepend=np.int32(-1)))[chosen]
        out, before = [], 0
        for n, place in zip(self.lengths, self.places, strict=True):
            at = place[first[(first >= before) & (first < before + len(place))] - before]
            before += len(place)
            out.append(pc.binary_join_element_wise(*[self.vocabulary.take(pa.array(self.codes[at + j])) for j in range(n)], pa.scalar(" ", pa.large_string())))
        return pa.concat_arrays(out).cast(pa.string())


def sent(lengths: Sequence[int], buckets: int) -> Callable[[pa.Table], pa.Table]:
    """(chunk, key, text) of a chunk to its terms' hashes, in ascending order, and numbers of documents, a row for each bucket of hashes."""

    def run(rows: pa.Table) -> pa.Table:
        terms = Terms(rows["key"], rows["text"], lengths)
        order = np.argsort(terms.hashes)
        hashes, dfs = terms.hashes[order], np.bincount(terms.term, minlength=len(order))[order]
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        heads = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
        ends = np.append(heads[1:], len(bucket)) if len(heads) else heads
        chunk = np.full(len(heads), rows["chunk"][0].as_py(), np.int32)
        return pa.table({"chunk": chunk, "bucket": bucket[heads].astype(np.int32), "hashes": _lists(hashes.view(np.int64), ends), "dfs": _lists(dfs.astype(np.int32), ends)})

    return run


def added(rows: pa.Table) -> pa.Table:
    """A bucket's rows with the numbers of documents of all chunks."""
    ends = np.cumsum(pc.list_value_length(rows["hashes"]).to_numpy())
    hashes, dfs = (pc.list_flatten(rows[c]).to_numpy() for c in ("hashes", "dfs"))
    order = np.argsort(hashes)
    hashes = hashes[order]
    heads = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    whole = np.empty(len(order), np.int64)
    whole[order] = np.repeat(np.add.reduceat(dfs[order].astype(np.int64), heads), np.diff(heads, append=len(order)))
    return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"], "dfs": _lists(whole, ends)})


def weighed(lengths: Sequence[int], n: int, least: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(chunk, key, text) of a chunk and what came back for it to its terms of at least `least` documents and the sums of their weights."""

    def run(rows: pa.Table, back: pa.Table) -> pa.Table:
        terms = Terms(rows["key"], rows["text"], lengths)
        df = np.empty(len(terms.hashes), np.int64)
        df[np.argsort(terms.hashes)] = pc.list_flatten(back.sort_by("bucket")["dfs"]).to_numpy()
        w = terms.tf * (np.log((1 + n) / (1 + df)) + 1)[terms.term]
        norms = np.sqrt(np.bincount(terms.doc, w * w, minlength=terms.n_keys + 1))
        # Documents without a key count, but have no weights.
        norms[terms.n_keys] = np.inf
        w /= norms[terms.doc]
        s = np.bincount(terms.term, w, minlength=len(df)).astype(np.float64)
        chosen = np.flatnonzero((df >= least) & (s > 0))
        return pa.table({"word": terms.words(chosen), "s": s[chosen]})

    return run
