"""Token counts with the whole-token shortcut.

For a byte-level BPE it is proved once, on the driver, which vocabulary strings encode alone as
one token.  Every pre-token that is such a string counts 1 without any merging; only the rest is
merged, and remembered in a bounded cache per task.

Cases: null or empty text has 0 tokens; the special strings of the file that occur inside a text
count one token each, as in the library's default; a pre-token of any length is merged with a
heap in n log n steps; ids, ties and repeated rows do not matter, as each row is counted alone.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces, texts

#: The pre-token pattern of byte-level BPE files, white space spelt as Unicode's property.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Merged pre-tokens remembered in a task.
CACHE = 400_000


def byte_letters() -> list[str]:
    """The letter that byte-level files write for each byte: printable Latin-1 stands for itself,
    the other bytes take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left when the lowest-ranked adjacent pair is merged until none is left."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:  # one of them has been merged meanwhile
            continue
        symbols[i], symbols[j], after[i] = a + b, "", after[j]
        left -= 1
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get((symbols[i], symbols[after[j]]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[after[j]]))
        if before[i] >= 0 and (r := ranks.get((symbols[before[i]], symbols[i]))) is not None:
            heapq.heappush(heap, (r, before[i], symbols[before[i]], symbols[i]))
    return left


def load_vocabulary(path: str) -> dict:
    """Merge ranks, proved whole tokens (as text) and special strings of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
    ranks = {pair: i for i, pair in enumerate(pairs)}
    value = {letter: b for b, letter in enumerate(byte_letters())}
    whole = set()
    for string in spec["model"]["vocab"]:
        if merged_length(list(string), ranks) == 1:
            try:
                whole.add(bytes(value[c] for c in string).decode())
            except UnicodeDecodeError:  # part of a character: never a pre-token
                pass
    return {"ranks": ranks, "whole": whole, "special": [t["content"] for t in spec.get("added_tokens", [])]}


class Counts(dict):
    """Pre-token -> number of tokens."""

    def __init__(self, vocabulary: dict):
        super().__init__()
        self.ranks, self.whole, self.letters = vocabulary["ranks"], vocabulary["whole"], byte_letters()
        self.update(dict.fromkeys(self.whole, 1))

    def __missing__(self, token: str) -> int:
        n = merged_length([self.letters[b] for b in token.encode()], self.ranks)
        if len(self) > CACHE:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        if len(token) < 64:
            self[token] = n
        return n


def counter(vocabulary: dict):
    """text -> number of tokens."""
    counts, pre_tokens = Counts(vocabulary), regex.compile(PRE_TOKEN).findall
    special = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary["special"], key=len, reverse=True))) if vocabulary["special"] else None

    def of(text: str) -> int:
        parts = special.split(text) if special and special.search(text) else [text]
        return len(parts) - 1 + sum(sum(map(counts.__getitem__, pre_tokens(p))) for p in parts)

    return of


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document, for the tokenizer file ``path``
    (read on the driver; its 50,000 strings are broadcast)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(vocabulary.value)
        for batch in pieces(batches):
            column = batch.column(1).to_pylist()
            n = [of(t) for t in column]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in column], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
