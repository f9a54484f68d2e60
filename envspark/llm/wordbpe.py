"""BPE encoding and decoding by speculation and verification.

For a word-end BPE file (lower case, white space dropped).  A greedy longest match over the
vocabulary proposes the tokens of every new word of a chunk of texts.  A sequence of tokens is what
the merges give exactly if each token is what the merges make of its own letters and every two
neighbours, encoded together, stay those two; so all distinct adjacent pairs of the chunk are tested
at once in numpy, by undoing the merges that made the two tokens from the last one back.  Words with
a pair that fails are merged exactly, rank by rank.  Words and verified pairs are remembered in
bounded caches of the task; nothing is shuffled.

Cases: null and empty texts, and texts of white space, have no tokens and decode to the empty text;
special strings of the file that occur inside a text are their own token, as in the library's
default; words of any length are merged in n log n steps; ids, ties and repeated rows do not matter,
as each row is encoded alone; a null list of ids decodes to the empty text, an id outside the
vocabulary is left out of it.  Decoding joins the token strings with a space, as the library does
for a file without a decoder.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces, texts

#: The file's pre-token pattern, white space spelt as Unicode's property, and its mark
#: for the end of a word (one letter here, which no byte stands for).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
WORD_END, END = "</w>", " "
#: Beyond these code points, letter classes and cases depend on the Unicode version of a library, so
#: such texts are normalised and cut by the file's own rules in ``tokenizers``.
SETTLED = "՗"
#: Words, and pairs of tokens, remembered in a task; longer words are not remembered.
CACHE, LONGEST = 300_000, 64
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that byte-level files write for each byte: printable Latin-1 stands for itself,
    the other bytes take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def symbols(letters: str) -> list[str]:
    """The letters of a marked word; the mark belongs to the last of them."""
    return [*letters[:-2], letters[-2:]] if letters[-1:] == END else list(letters)


def merge(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """What is left when the adjacent pair of the lowest rank (leftmost if equal) is merged until none is."""
    parts, n = list(parts), len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:  # one of them has been merged meanwhile
            continue
        parts[i], parts[j], after[i] = a + b, "", after[j]
        if after[j] < n:
            before[after[j]] = i
        for p, q in ((before[i], i), (i, after[i])):
            if p >= 0 and q < n and (r := ranks.get((parts[p], parts[q]))) is not None:
                heapq.heappush(heap, (r, p, parts[p], parts[q]))
    return [p for p in parts if p]


def load_vocabulary(path: str) -> dict:
    """Token ids, merges as arrays over ids, and the special strings of a word-end BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own = lambda t: t.removesuffix(WORD_END) + END if t.endswith(WORD_END) else t
    ids = {own(t): i for t, i in spec["model"]["vocab"].items()}
    size = max(ids.values()) + 1
    rank, left, right = np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    ranks: dict[tuple[str, str], int] = {}
    for r, pair in enumerate(spec["model"]["merges"]):
        a, b = map(own, pair.split(" ") if isinstance(pair, str) else pair)
        ranks[a, b] = r
        k = ids[a + b]
        if rank[k] < 0:
            rank[k], left[k], right[k] = r, ids[a], ids[b]
    # a token may be proposed only if the merges make it of its own letters, by the merge noted above
    sure = {t: i for t, i in ids.items() if merge(symbols(t), ranks) == [t]}
    pairs = np.array([ids[a] * size + ids[b] for a, b in ranks], np.int64)
    order = np.argsort(pairs)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    strings = [""] * (max(size, *special.values()) + 1 if special else size)
    for t, i in [*spec["model"]["vocab"].items(), *special.items()]:
        strings[i] = t
    return {
        "ids": ids, "ranks": ranks, "sure": sure, "rank": rank, "left": left, "right": right, "size": size, "special": special,
        "pairs": pairs[order], "pair_rank": np.array(list(ranks.values()), np.int32)[order], "strings": strings, "path": path,
    }


def compatible(a: np.ndarray, b: np.ndarray, v: dict) -> np.ndarray:
    """For each pair of token ids whether the two, encoded together, stay the two.  The merges that
    made them are undone from the last one on; if the tokens that then meet at the border would have
    merged before the merge just undone (the left one first among equals), the border would not be there."""
    ok, open_ = np.ones(len(a), bool), np.arange(len(a))
    x, y, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), NONE, np.int64)
    while len(open_):
        at = np.minimum(np.searchsorted(v["pairs"], x * v["size"] + y), len(v["pairs"]) - 1)
        met = np.where(v["pairs"][at] == x * v["size"] + y, v["pair_rank"][at], NONE)
        made_x, made_y = v["rank"][x], v["rank"][y]
        broken = met < limit
        ok[open_[broken]] = False
        go_x, go_y = made_x > made_y, (made_x <= made_y) & (made_y >= 0)
        limit = np.where(go_x, made_x, made_y + 1)
        x, y = np.where(go_x, v["right"][x], x), np.where(go_y, v["left"][y], y)
        stay = ~broken & (go_x | go_y)
        open_, x, y, limit = open_[stay], x[stay], y[stay], limit[stay]
    return ok


class Codec:
    """Words and texts -> token ids and back, for one task."""

    def __init__(self, vocabulary: dict):
        self.v, self.sure, self.ids = vocabulary, vocabulary["sure"], vocabulary["ids"]
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.value = {c: b for b, c in self.letters.items()}
        # the longest token that starts with two given letters bounds the search for a match
        self.reach: dict[str, int] = {}
        for t in self.sure:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.known: dict[str, bytes] = {}
        self.verified: dict[int, bool] = {}
        self.exact = 0  # words that had to be merged
        self.find = regex.compile(PRE_TOKEN).findall
        self.unsettled = regex.compile(f"[^\\x00-{SETTLED}]").search
        special = vocabulary["special"]
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.rules = None

    def _cut(self, text: str) -> list[str]:
        """Normalised words of a text without special strings."""
        if not self.unsettled(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            return self.find(text.lower())
        if self.rules is None:
            from tokenizers import Tokenizer

            self.rules = Tokenizer.from_file(self.v["path"])
        found = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))
        return [bytes(map(self.value.__getitem__, w)).decode() for w, _ in found]

    def units(self, text: str) -> list[str]:
        """Words and special strings of a text, in order."""
        if self.special is None or "<" not in text:
            return self._cut(text)
        parts = self.special.split(text)
        return list(chain.from_iterable([p] if k % 2 else self._cut(p) for k, p in enumerate(parts)))

    def propose(self, word: str) -> list[int]:
        """Greedy longest match of the marked letters; the end mark never stands alone."""
        out, start, n, sure, reach = [], 0, len(word), self.sure, self.reach
        while start < n:
            end = min(n, start + reach.get(word[start : start + 2], 1))
            while True:
                found = sure.get(word[start:end]) if end != n - 1 else None
                if found is not None:
                    break
                end -= 1
            out.append(found)
            start = end
        return out

    def _check(self, pairs: np.ndarray) -> np.ndarray:
        """``compatible`` for distinct packed pairs, remembered."""
        known = self.verified
        new = np.array([p for p in pairs.tolist() if p not in known], np.int64)
        if len(new):
            if len(known) > CACHE:
                known.clear()
                new = pairs
            known.update(zip(new.tolist(), compatible(new // self.v["size"], new % self.v["size"], self.v).tolist()))
        return np.array([known[p] for p in pairs.tolist()], bool)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of the words (little-endian 32-bit), all of them through speculation and verification."""
        if len(self.known) > CACHE:
            self.known.clear()
        out, new = {}, []
        for w in words:
            if w in self.known:
                out[w] = self.known[w]
            elif self.special is not None and w in self.v["special"]:
                out[w] = self.v["special"][w].to_bytes(4, "little")
            else:
                new.append(w)
        marked = [w.encode().decode("latin-1").translate(self.letters) + END for w in new]
        proposed = [self.propose(m) for m in marked]
        if new:
            size = np.array([len(p) for p in proposed])
            flat, word = np.fromiter(chain.from_iterable(proposed), np.int64, int(size.sum())), np.repeat(np.arange(len(new)), size)
            inside = word[1:] == word[:-1]
            pair, owner = (flat[:-1] * self.v["size"] + flat[1:])[inside], word[1:][inside]
            distinct, back = np.unique(pair, return_inverse=True)
            for k in np.unique(owner[~self._check(distinct)[back]]).tolist():
                proposed[k] = [self.ids[t] for t in merge(symbols(marked[k]), self.v["ranks"])]
                self.exact += 1
        for w, p in zip(new, proposed):
            out[w] = np.array(p, "<u4").tobytes()
            if len(w) <= LONGEST:
                self.known[w] = out[w]
        return out

    def encode(self, column: list[str]) -> list[bytes]:
        cut = [self.units(t) for t in column]
        known = self.learn(set(chain.from_iterable(cut)))
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        strings = self.v["strings"]
        return " ".join(filter(None, map(strings.__getitem__, ids[(ids >= 0) & (ids < len(strings))].tolist())))


def _shared(docs: DataFrame, path: str):
    """The vocabulary (a file of fixed size), broadcast."""
    return docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) of every whole text."""
    vocabulary = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        for batch in pieces(batches):
            packed = codec.encode(batch.column(1).to_pylist())
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), ids], names=["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with ``ids``."""
    vocabulary = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        for batch in batches:
            out = [codec.decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode_documents`` and then
    ``decode_documents`` give for every whole text, digested (ids as little-endian unsigned 32-bit
    integers, the decoded text as UTF-8) in the task that encoded it."""
    vocabulary = _shared(docs, path)
    digest = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        for batch in pieces(batches):
            packed = codec.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([digest(p) for p in packed]),
                    pa.array([digest(codec.decode(np.frombuffer(p, "<u4").astype(np.int64)).encode()) for p in packed]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
