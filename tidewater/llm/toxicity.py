"""Toxicity by a lexicon that is matched with misspellings and read in context.

The lexicon holds words and word beginnings that mark documents labelled toxic; it is learned from labelled documents by
a log-likelihood ratio test. It is kept as a trie. A Levenshtein automaton of a text's word runs along the trie's edges
and gives the entries within one edit (entries of fewer than FUZZY_LENGTH letters, and beginnings, match exactly only; the
learned words that a beginning stands for are matched with misspellings).
Each hit is weighed by its context: a hit within quotation marks, or close after a word of reporting, counts as quoted.
A logistic model over a document's hits (plain, misspelled, quoted, their weights and density) gives the score.

The lexicon and the model are fitted on a sample of at most about SAMPLE labelled rows, drawn by a hash of the id;
scores cover every whole text.

Defined cases: a null or empty text has no hits and gets the model's score for that. Without labels to learn from, or
with labels of one kind only, every score is the share of toxic labels (0 without labels). Repeated rows get a row each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.held_out import held_out
from tidewater.llm.textkernel import Chunk, chunks

SAMPLE = 20_000
MAX_ENTRIES, LEAST_RATIO, LEAST_PRECISION = 500, 15.0, 0.6
#: An entry is found in so many toxic documents at least, however many there are.
LEAST_TOXIC_DOCS = 4
PREFIX_LENGTHS, FUZZY_LENGTH, EDITS = (4, 5, 6, 7), 5, 1
#: A beginning is no entry where one word makes up this share of its documents.
ONE_WORD = 0.8
THRESHOLD = 0.3
CONTEXT_BYTES, REPORT_BYTES = 120, 40
MEMO_WORDS = 500_000
#: Pairs of quotation marks, and words by which an insult is reported rather than made.
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
REPORTING = ("said", "says", "called", "calls", "calling", "wrote", "quote", "quoted", "word", "term", "slur", "insult", "phrase", "reported", "nannte", "sagte", "dit", "appelé", "dijo", "llamó")
FEATURES = ("plain", "misspelled", "quoted", "weight", "best", "density")


class Lexicon:
    """A trie of entries (words, and beginnings of words, with weights), and two tries for misspellings.

    One edit leaves the left or the right half of an entry as it is. A word that runs exactly to the end of an entry's
    left half in the trie of entries, or to the end of its right half in the trie of reversed entries, is handed to the
    automaton there, which goes on through the part of the trie below. Words that a beginning covers (None in place of
    "is a beginning") match by their beginning as they are, and are in the tries for misspellings only.
    """

    def __init__(self, entries: list[tuple[str, bool | None, float]]):
        self.entries = entries  # (text, is a beginning, weight)
        self.root, self.ahead, self.back = {}, {}, {}
        for number, (text, beginning, _) in enumerate(entries):
            if beginning is not None:
                self._insert(self.root, text, 0)["beginning" if beginning else "word"] = number
            if not beginning and len(text) >= FUZZY_LENGTH:
                self._insert(self.ahead, text, len(text) // 2)["word"] = number
                self._insert(self.back, text[::-1], len(text) - len(text) // 2)["word"] = number

    @staticmethod
    def _insert(node: dict, text: str, half: int) -> dict:
        for depth, c in enumerate(text, 1):
            node = node.setdefault(c, {})
            if depth == half:
                node["half"] = True
        return node

    def exact(self, word: str) -> int | None:
        """The entry that is the word, or else the longest beginning of it."""
        node, found = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                return found
            found = node.get("beginning", found)
        return node.get("word", found)

    def fuzzy(self, word: str) -> int | None:
        """An entry within EDITS edits of the word; the one of the greatest weight."""
        found: list[int] = []
        for node, letters in ((self.ahead, word), (self.back, word[::-1])):
            for place, c in enumerate(letters, 1):
                node = node.get(c)
                if node is None:
                    break
                if "half" in node:
                    self._automaton(node, _closed({place: 0}, len(letters)), letters, found)
        return max(found, key=lambda i: (self.entries[i][2], -i), default=None)

    def _automaton(self, node: dict, states: dict[int, int], word: str, found: list[int]) -> None:
        """Run from a trie node on; states: fewest edits for each place of the word that may be reached."""
        if "word" in node and states.get(len(word), EDITS + 1) <= EDITS:
            found.append(node["word"])
        for c, child in node.items():
            if len(c) > 1:
                continue
            after: dict[int, int] = {}
            for place, edits in states.items():
                for there, cost in ((place + 1, edits + (place >= len(word) or word[place] != c)), (place, edits + 1)):
                    if there <= len(word) and cost <= EDITS and cost < after.get(there, EDITS + 1):
                        after[there] = cost
            if after:
                self._automaton(child, _closed(after, len(word)), word, found)


def _closed(states: dict[int, int], length: int) -> dict[int, int]:
    """The states with those that leave out letters of the word, an edit each."""
    for place in range(min(states), length):
        if states.get(place, EDITS) < EDITS and states[place] + 1 < states.get(place + 1, EDITS + 1):
            states[place + 1] = states[place] + 1
    return states


_NOT_ALNUM = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def core(word: str) -> str:
    """The word in lower case without other characters than letters and digits at its ends."""
    word = word.lower().strip(_NOT_ALNUM)
    while word and not word[0].isalnum():
        word = word[1:]
    while word and not word[-1].isalnum():
        word = word[:-1]
    return word


class Matcher:
    """Finds the lexicon's entries in chunks; remembers the outcome for each different word."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.memo: dict[int, int] = {}

    def _match(self, word: bytes) -> int:
        """0, or the entry's number + 1, negative for a misspelling."""
        text = core(word.decode(errors="replace"))
        found = self.lexicon.exact(text)
        if found is not None:
            return found + 1
        found = self.lexicon.fuzzy(text) if len(text) >= FUZZY_LENGTH - EDITS else None
        return 0 if found is None else -(found + 1)

    def features(self, chunk: Chunk) -> np.ndarray:
        start, end, row = chunk.words()
        out = np.zeros((chunk.rows, len(FEATURES)))
        n_words = np.bincount(row, minlength=chunk.rows)
        if not len(start):
            return out
        keys, at, which = np.unique(chunk.hash_spans(chunk.prefix_hash(lower=True), start, end), return_index=True, return_inverse=True)
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        raw = chunk.data.tobytes()
        names = keys.tolist()
        for i, k in enumerate(names):
            if k not in self.memo:
                self.memo[k] = self._match(raw[start[at[i]] : end[at[i]]])
        hit = np.fromiter(map(self.memo.__getitem__, names), np.int64, len(names))[which]
        for i in np.flatnonzero(hit):
            r, entry = row[i], abs(hit[i]) - 1
            weight = self.lexicon.entries[entry][2]
            lo, hi = max(chunk.offsets[r], start[i] - CONTEXT_BYTES), min(chunk.offsets[r + 1], end[i] + CONTEXT_BYTES)
            quoted = is_quoted(raw[lo : start[i]].decode(errors="ignore"), raw[start[i] : end[i]].decode(errors="ignore"), raw[end[i] : hi].decode(errors="ignore"))
            out[r, 2 if quoted else 0 if hit[i] > 0 else 1] += 1
            if not quoted:
                out[r, 3] += weight
                out[r, 4] = max(out[r, 4], weight)
        out[:, 5] = np.sqrt((out[:, 0] + out[:, 1]) / np.maximum(n_words, 1))
        out[:, :4] = np.log1p(out[:, :4])
        return out


def is_quoted(before: str, word: str, after: str) -> bool:
    """Whether a word is inside quotation marks on its line, or close after a word of reporting."""
    before, after = before.rpartition("\n")[2] + word[: len(word) - len(word.lstrip("".join(QUOTES)))], word[len(word.rstrip("".join(QUOTES.values()))) :] + after.partition("\n")[0]
    for opening, closing in QUOTES.items():
        inside = before.count(opening) % 2 == 1 if opening == closing else before.rfind(opening) > before.rfind(closing)
        if inside and closing in after:
            return True
    return any(core(w) in REPORTING for w in before[-REPORT_BYTES:].split())


def _entries(sample: DataFrame) -> list[tuple[str, bool | None, float]]:
    """The lexicon learned from rows of (text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, bad = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {core(w) for w in (text or "").split()} - {""}
                terms = {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in PREFIX_LENGTHS if len(w) > n}
                seen.update(terms)
                if toxic:
                    bad.update(terms)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([bad[t] for t in seen], pa.int64())], ["term", "n", "k"])

    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("k")).first()
    total, toxic = totals["n"], totals["k"] or 0
    if not total or not 0 < toxic < total:
        return []
    share = toxic / total
    counted = sample.mapInArrow(count, "term string, n long, k long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    ratio = 2 * (k * F.log(k / (n * share)) + F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(0.0))
    good = counted.filter((F.col("k") >= LEAST_TOXIC_DOCS) & (k / n >= max(LEAST_PRECISION, share))).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
    rows = good.orderBy(F.col("ratio").desc(), F.length("term").desc(), "term").limit(MAX_ENTRIES).collect()
    words = {r["term"][1:]: r["k"] for r in rows if r["term"][0] == "="}
    taken: dict[str, tuple[str, bool | None, float]] = {}
    for r in rows:
        text, beginning = r["term"][1:], r["term"][0] == "^"
        if beginning and any(w.startswith(text) and k >= ONE_WORD * r["k"] for w, k in words.items()):
            continue  # nearly always the same word, which is an entry itself
        covered = any(text.startswith(old) and is_beginning for old, is_beginning, _ in taken.values())
        if covered and beginning:
            continue  # a shorter beginning with a greater ratio has it
        weight = math.log((r["k"] + 0.5) / (r["n"] - r["k"] + 0.5)) - math.log(share / (1 - share))
        taken.setdefault(r["term"] if covered else text, (text, None if covered else beginning, max(weight, 0.1)))
    return list(taken.values())


def logistic_fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients, the constant last, by Newton's method with an L2 penalty on all but the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _with_features(rows: DataFrame, lexicon: Lexicon, columns: list[str]) -> DataFrame:
    plain = rows.select(*columns, "text")
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns), *(f"{f} double" for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            parts = [matcher.features(c) for c in chunks(batch.column(len(columns)))]
            found = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *(pa.array(found[:, i].copy()) for i in range(len(FEATURES)))], [*columns, *FEATURES])

    return plain.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """For each document: doc_id, held_out, score, predicted and its features."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = plain.join(F.broadcast(drawn), "doc_id").select("text", "toxic")  # about `sample` ids at most
    entries = _entries(rows)
    lexicon = Lexicon(entries)
    if entries:
        seen = _with_features(rows, lexicon, ["toxic"]).toPandas()  # about `sample` rows of numbers
        w = logistic_fit(seen[list(FEATURES)].to_numpy(), seen["toxic"].to_numpy(float))
    else:
        level = drawn.agg(F.avg("toxic")).first()[0] or 0.0
        w = np.append(np.zeros(len(FEATURES)), math.log(max(level, 1e-9) / max(1 - level, 1e-9)))
    logit = F.lit(float(w[-1]))
    for value, name in zip(w, FEATURES, strict=False):
        logit = logit + F.lit(float(value)) * F.col(name)
    out = _with_features(plain, lexicon, ["doc_id", "held_out"]).withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *FEATURES)
