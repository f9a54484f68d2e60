"""SentencePiece encoding and decoding by a shared-prefix dynamic programme.

The distinct marked words of a chunk of texts are sorted, which lays out their trie in depth-first
order; walking it, the forward values of the prefix that a word shares with the word before it are
kept and only the new letters are computed.  For a BPE model the forward value of a prefix is the
last piece of the prefix's encoding: exactly one piece that ends there and whose left neighbour it
may follow (the two encode together as themselves) is admissible, so the maximisation of the
Viterbi step has one candidate left, and the result equals the merges of the library.

Cases: null and empty texts have no pieces and decode to the empty text; characters that are no
piece become byte pieces; a text with the mark U+2581 itself decodes with a space in its place;
words of any length take time in proportion to it; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import pieces, texts

MARK = "▁"
#: Words and pairs of pieces remembered in a task.
CACHE = 500_000


def load_model(path: str) -> dict:
    """Scores of the ordinary pieces, the text or byte of every id and the ids of the 256 bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, out = {}, {}, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            out.append(b"")
        else:
            ids[piece], scores[piece] = i, model.get_score(i)
            out.append(piece.replace(MARK, " ").encode())
    order = {p: k for k, p in enumerate(sorted((p for p in scores if len(p) > 1 and p.strip(MARK)), key=scores.get, reverse=True))}
    split = {}  # piece -> the two pieces that its last merge joins; a piece that merges never reach has none
    for p in order:
        parts = merge(p, scores, without=p)
        if len(parts) == 2:
            split[p] = tuple(parts)
    return {"ids": ids, "scores": scores, "order": order, "split": split, "bytes": out, "byte_id": [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]}


def merge(symbols: str, scores: dict[str, float], without: str = "") -> list[str]:
    """Pieces left when the best-scored adjacent pair (leftmost if equal) is merged until none is;
    ``without``: a piece that must not be made."""
    parts, n = list(symbols), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-s, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (s := scores.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j >= n or parts[i] + parts[j] != joined or joined == without:
            continue
        parts[i], parts[j], after[i] = joined, "", after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (s := scores.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, parts[a] + parts[b]))
    return [p for p in parts if p]


class Codes(dict):
    """Piece -> its ids as little-endian int32; a letter without a piece has those of its bytes."""

    def __init__(self, model: dict):
        super().__init__((p, i.to_bytes(4, "little")) for p, i in model["ids"].items())
        self.byte_id = model["byte_id"]

    def __missing__(self, letter: str) -> bytes:
        return b"".join(self.byte_id[b].to_bytes(4, "little") for b in letter.encode())


class Encoder:
    """Marked words -> ids, for one task."""

    def __init__(self, model: dict):
        self.scores, self.order, self.split, self.codes = model["scores"], model["order"], model["split"], Codes(model)
        # ends of pieces -> whether the end is itself a piece that merges reach
        reached = dict.fromkeys((p for p in model["ids"] if len(p) == 1 or p in self.split), True)
        self.ends = dict.fromkeys((p[i:] for p in self.split for i in range(1, len(p))), False) | reached
        self.follows: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.runs: dict[int, list[str]] = {}

    def may_follow(self, a: str, b: str) -> bool:
        """``a`` and ``b`` together encode as a, b.  The merges that made them are undone from the
        last on; if a pair that meets at the border would have merged before the merge just undone
        (the left one first among equals), the border would not be there."""
        order, split, before = self.order, self.split, len(self.order)
        x, y = a, b
        while True:
            if order.get(x + y, before) < before:
                ok = False
                break
            made_x, made_y = order.get(x, -1), order.get(y, -1)
            if made_x > made_y:
                before, x = made_x, split[x][1]
            elif made_y >= 0:
                before, y = made_y + 1, split[y][0]
            else:
                ok = True
                break
        if len(self.follows) > CACHE:
            self.follows.clear()
        self.follows[a, b] = ok
        return ok

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) for sorted distinct words: a depth-first walk of their trie."""
        last: list[str] = [""]  # last[i]: the last piece of the encoding of the first i letters
        ends, follows, may_follow, old = self.ends, self.follows, self.may_follow, ""
        for word in words:
            same = 0
            for a, b in zip(old, word):
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                found = word[end - 1]
                for start in range(end - 1, -1, -1):
                    piece = word[start:end]
                    is_piece = ends.get(piece)
                    if is_piece is None:  # no piece ends so
                        break
                    if is_piece:
                        ok = not start or follows.get((last[start], piece))
                        if ok or ok is None and may_follow(last[start], piece):
                            found = piece
                            break
                last.append(found)
            got, end = [], len(word)
            while end:
                got.append(last[end])
                end -= len(last[end])
            yield word, got[::-1]
            old = word

    def run(self, n: int) -> list[str]:
        """Pieces of a run of ``n`` marks."""
        if n not in self.runs:
            if len(self.runs) > 1000:
                self.runs.clear()
            self.runs[n] = merge(MARK * n, self.scores)
        return self.runs[n]

    def learn(self, units: set[str]) -> None:
        """Encode new units: a run of marks and what follows up to the next mark.  Marks before the
        last one of a run meet the rest only after all better merges are done, so the last mark with
        the letters is encoded first and the others join what stays a bare mark."""
        if len(self.known) > CACHE:
            self.known.clear()
        new = [u for u in units if u not in self.known]
        cut = {u: max(0, len(u) - len(u.lstrip(MARK)) - 1) for u in new}
        encoded = dict(self.walk(sorted({u[cut[u] :] for u in new})))
        for u in new:
            found, n = encoded[u[cut[u] :]], cut[u]
            if n:
                found = self.run(n + 1) + found[1:] if found[0] == MARK else self.run(n) + found
            self.known[u] = b"".join(map(self.codes.__getitem__, found))


def marked_units(text: str) -> list[str]:
    return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)) if text else []


def decode(ids: np.ndarray, out: list[bytes]) -> str:
    """Text of the ids; byte sequences that are no UTF-8 become U+FFFD."""
    return b"".join(map(out.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace") if len(ids) else ""


def encode_column(column: list[str], encoder: Encoder) -> list[bytes]:
    split = [marked_units(t) for t in column]
    encoder.learn(set(chain.from_iterable(split)))
    known = encoder.known
    return [b"".join(map(known.__getitem__, s)) for s in split]


def _model(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(load_model(path))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) of every whole text."""
    model = _model(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in pieces(batches):
            packed = encode_column(batch.column(1).to_pylist(), encoder)
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), ids], names=["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with ``ids``."""
    model = _model(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = model.value["bytes"]
        for batch in batches:
            text = [decode(np.asarray(x or [], np.int64), out) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_check(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip): the ids of every whole text, digested as
    little-endian int32, and whether decoding them gives the text again."""
    model = _model(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = Encoder(model.value), model.value["bytes"]
        for batch in pieces(batches):
            column = batch.column(1).to_pylist()
            packed = encode_column(column, encoder)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([decode(np.frombuffer(p, "<i4"), out) == t for p, t in zip(packed, column)], pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "round_trip"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")
