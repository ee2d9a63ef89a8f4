"""Packing documents into sequences of a fixed number of tokens.

Documents are dealt at random to partitions (by a hash of id, text and input partition, so that a row that is repeated
very often isn't dealt to one task) and there, in the order of that hash, to groups of bounded size.
In a group every document gives full sequences first; the remainders are packed first-fit in decreasing size. A
tournament tree over the bins' free room finds the first bin that fits in logarithmic time. What padding is then left
is filled by dissolving the emptiest bins: their pieces are cut to fit the room in the others, until the group has at
most `max_waste` padding or one bin that isn't full.

A sequence is padded to `width`, unless its length is a power of two (a sequence of 1, 2, 4, ... tokens stands as it is).

Defined cases: a null text is an empty one; an empty document is its closing token. Rows that repeat an id are packed
each on their own. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.textkernel import Chunk, chunks

WIDTH, END_ID = 2048, 1
#: Tokens of a group at which it is closed, and the padding that cutting may leave.
GROUP_TOKENS, MAX_WASTE = 2_000_000, 0.002
SEED = 23


class Tokens:
    """Ids of texts under a byte-level BPE vocabulary: a tokenizers .json file, or the same as .tiktoken ranks.

    `pattern` cuts texts into the pieces of ranks. Its part for runs of white space looks ahead, which makes matching
    slow; in a text without two white-space characters in a row that part matches nothing that the last part would not
    match as well, so such texts are cut without it. `added` names tokens that stand for their literal text, with their
    ids; without it such texts are tokenized as any other.
    """

    def __init__(self, path: str, pattern: str | None = None, added: dict[str, int] | None = None):
        added = added or {}
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            ranks = {token: i for token, i in ranks.items() if i not in added.values()}
            whole, plain = (tiktoken.Encoding("own", pat_str=cut, mergeable_ranks=ranks, special_tokens=added) for cut in (pattern, pattern.replace(LOOK_AHEAD, "")))
            self.encode = lambda text: (whole if TWO_SPACES.search(text) else plain).encode_to_numpy(text, allowed_special="all", disallowed_special=())
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = not added
            self.encode = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, chunk: Chunk) -> list[np.ndarray]:
        """The ids of each row of a chunk."""
        raw, bounds = chunk.data.tobytes(), chunk.offsets.tolist()
        return [self.encode(raw[a:b].decode()) for a, b in zip(bounds, bounds[1:], strict=False)]


LOOK_AHEAD = r"\s+(?!\S)|"
TWO_SPACES = re.compile(r"\s\s")


class BinTree:
    """A tournament tree over bins in the order they were opened; each node knows the most room below it."""

    def __init__(self, bins: int, width: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [width] * (2 * self.size)
        for i in range(self.size + bins, 2 * self.size):
            self.room[i] = 0
        for i in range(self.size - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def place(self, length: int) -> int:
        """Put a piece into the first bin with room for it; the bin's number."""
        at = 1
        while at < self.size:
            at = 2 * at if self.room[2 * at] >= length else 2 * at + 1
        self.room[at] -= length
        i = at >> 1
        while i:
            most = max(self.room[2 * i], self.room[2 * i + 1])
            if self.room[i] == most:
                break
            self.room[i] = most
            i >>= 1
        return at - self.size


def first_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Bins of item numbers; every length is between 1 and width."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    tree, bins = BinTree(len(lengths), width), [[] for _ in lengths]
    for i in order:
        bins[tree.place(lengths[i])].append(i)
    return [b for b in bins if b]


def pack_group(lengths: list[int], width: int = WIDTH, max_waste: float = MAX_WASTE) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) for documents of the given lengths."""
    sequences, tails = [], []
    for i, n in enumerate(lengths):
        sequences += [[(i, s, width)] for s in range(0, n - n % width, width)]
        if n % width:
            tails.append((i, n - n % width, n % width))
    bins = [[tails[t] for t in b] for b in first_fit_decreasing([t[2] for t in tails], width)]
    room = [width - sum(p[2] for p in b) for b in bins]
    order = sorted((b for b in range(len(bins)) if room[b]), key=lambda b: (room[b], b))  # fullest first
    waste, allowed = sum(room), int(max_waste * sum(lengths))
    lo, hi = 0, len(order) - 1
    while lo < hi and waste > allowed:
        last, target = order[hi], order[lo]
        doc, start, n = bins[last].pop()
        part = min(n, room[target])
        bins[target].append((doc, start, part))
        room[target] -= part
        room[last] += part
        if part < n:
            bins[last].append((doc, start + part, n - part))
        if not bins[last]:
            waste -= width
            hi -= 1
        if not room[target]:
            lo += 1
    return sequences + [b for b in bins if b]


def padding(length: int, width: int = WIDTH) -> int:
    return 0 if length & (length - 1) == 0 else width - length


def pack(docs: DataFrame, vocabulary: str, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
         end_id: int = END_ID, seed: int = SEED, group_tokens: int = GROUP_TOKENS, max_waste: float = MAX_WASTE, with_ids: bool = True,
         added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length and,
    with_ids, the ids themselves as little-endian 32-bit numbers.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]) + (", ids binary" if with_ids else "")
    names += ["ids"] * with_ids
    deal = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), F.spark_partition_id())
    dealt = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), deal.alias("deal"))
    dealt = dealt.repartition("deal").sortWithinPartitions("deal", "doc_id").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary, pattern, added)
        next_id = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        owners: list = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, ids, owners, held
            rows: list[list] = [[] for _ in names]
            for sequence in pack_group([len(x) for x in ids], width, max_waste):
                whole, offset = sum(n for _, _, n in sequence), 0
                for i, start, n in sequence:
                    part = ids[i][start : start + n].astype("<u4").tobytes()
                    for column, value in zip(rows, (owners[i], start, n, zlib.crc32(part), len(ids[i]), next_id, offset, whole, part), strict=False):
                        column.append(value)
                    offset += n
                next_id += 1
            ids, owners, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], owner_type), *(pa.array(r, pa.int64()) for r in rows[1:8]), *(pa.array(r, pa.binary()) for r in rows[8:])], names)

        for batch in batches:
            owner_type = batch.schema.field(0).type
            for c in chunks(batch.column(1)):
                for owner, found in zip(batch.column(0).slice(c.lo, c.rows).to_pylist(), tokens(c), strict=True):
                    ids.append(np.append(found, np.uint32(end_id)))
                    owners.append(owner)
                    held += len(ids[-1])
                    if held >= group_tokens:
                        yield from packed()
        if ids:
            yield from packed()

    return dealt.mapInArrow(run, schema)
