"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of one document; each word is removed that a window covers
whose word sequence also starts in a document with a smaller id.

1. Documents are packed, in id order, into blocks of bounded size.
2. Candidates: every block sends the short hashes of its distinct windows, sorted, delta-coded and
   cut by hash range; each range answers every block with one bit per hash: seen in another block or not.
3. Confirmation: runs of candidate windows, cut where the least hash of their short word runs changes,
   are sent as text to the shard of that hash, so that equal windows meet in one shard.  The shard
   compiles an automaton of the passages that several documents hold, and streams all runs
   through it; each occurrence found carries the first document that has it.  Where only a part
   of a passage recurs, its windows are looked up.
4. Blocks remove the words that occurrences cover.

Only hashes of all windows travel, and text of candidate windows, once for each block: a passage in
a third of all documents reaches its shard once per block, not once per document.

Cases: null and empty texts have no words and stay empty; texts shorter than a window lose nothing;
rows that share a doc_id are one document and take nothing from each other (a null doc_id is
one id, the smallest); an empty table gives no rows; texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, give_back, pieces, raw, store, texts, total_bytes, trimmed, word_hashes
from .neardup import NO_ID, run_hashes

WINDOW = 13
#: Text bytes of a block, hashes of a range and windows of an automaton, about.
BLOCK_BYTES = 4 << 20
RANGE_HASHES = 1 << 20
SHARD_WINDOWS = 60_000
#: Words of the runs whose least hash chooses the shard of a window.
ANCHOR = 4
#: Stands for "no document has this window before".
NEVER = np.iinfo(np.int64).max


def _pack(a: np.ndarray) -> bytes:
    """Bytes of an integer array, equal places of the numbers together, compressed."""
    flat = np.ascontiguousarray(a)
    return zstandard.compress(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes(), 1)


def _unpack(blob: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    flat = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).ravel()


def blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, sizes, body): documents in id order, packed; block numbers rise with the ids.
    Rows of one id, however many, are cut into blocks like others: ids are compared, not blocks."""
    rows = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    parts = max(1, -(-total_bytes(rows) // BLOCK_BYTES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bodies, held, number = [], [], 0, TaskContext.get().partitionId() << 32

        def row():
            body = zstandard.compress(b"\n".join(bodies), 3)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([_pack(np.array(ids, np.int64))], pa.binary()), pa.array([_pack(np.array([len(b) for b in bodies], np.int64))], pa.binary()), pa.array([body], pa.binary())],
                names=["block", "ids", "sizes", "body"])

        for batch in pieces(batches):
            for i, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                if held >= BLOCK_BYTES:
                    yield row()
                    ids, bodies, held, number = [], [], 0, number + 1
                ids.append(i)
                bodies.append(text)
                held += len(text) + 16
        if ids:
            yield row()

    packed = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id").mapInArrow(trimmed(pack), "block long, ids binary, sizes binary, body binary")
    return store(packed, "blocks")


class Block:
    """One block, unpacked: texts, words (a list made when first asked for) and the places where windows start."""

    def __init__(self, ids: bytes, sizes: bytes, body: bytes):
        self.ids = _unpack(ids, np.int64)
        ends = np.cumsum(_unpack(sizes, np.int64) + 1) - 1
        whole = zstandard.decompress(body)
        self.texts = [whole[a:b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist())]

    @cached_property
    def words(self) -> list[bytes]:
        return [w for t in self.texts for w in t.split()]

    def hashes(self) -> np.ndarray:
        """Hashes of all words; also sets ``first``, the number of each text's first word."""
        found = word_hashes(self.texts)
        size = [len(h) for h in found]
        self.first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return np.concatenate(found)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes; starts of windows, their documents (by number) and their hashes."""
        hashes = self.hashes()
        length = np.diff(self.first) - WINDOW + 1
        length = np.maximum(length, 0)
        doc = np.repeat(np.arange(len(length)), length)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(self.first[:-1], length)
        found = run_hashes(hashes, WINDOW)[start] if len(doc) else np.zeros(0, np.uint64)
        return hashes, start, doc, found


def _ranges(found: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted short hashes (32 bits below the range number)."""
    part = (found >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(part, prepend=-1))
    return [(int(part[a]), int(a), int(b)) for a, b in zip(at, [*at[1:], len(part)])]


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(32 - bits)


def window_hashes(packed: DataFrame, bits: int) -> DataFrame:
    """(range, block, hashes): the distinct window hashes of each block, cut into 2^bits ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = distinct(_short(Block(r.pop("ids"), r.pop("sizes"), r.pop("body")).windows()[3], bits))
                low, cuts = found.astype(np.uint32), _ranges(found, bits)
                blobs = [_pack(np.diff(low[a:b], prepend=np.uint32(0))) for _, a, b in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.int64()), pa.array([r["block"]] * len(cuts), pa.int64()), pa.array(blobs, pa.binary())], names=["range", "block", "hashes"])

    return packed.mapInArrow(trimmed(run), "range long, block long, hashes binary")


def seen_elsewhere(table: pa.Table) -> pa.Table:
    """For one range: (block, range, bits) with a bit for each hash of the block: in another block too?"""
    own = [np.cumsum(_unpack(h, np.uint32), dtype=np.uint32) for h in table.column("hashes").to_pylist()]
    every = np.concatenate(own)
    order = np.argsort(every, kind="stable")
    same = np.diff(every[order]) == 0
    again = np.zeros(len(every), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cuts = np.cumsum([len(o) for o in own])[:-1]
    bits = [zlib.compress(np.packbits(a).tobytes(), 1) for a in np.split(again, cuts)]
    return pa.table({"block": table.column("block"), "range": table.column("range"), "bits": pa.array(bits, pa.binary())})


def candidate_runs(block: Block, seen: dict[int, bytes], bits: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, bool, bytes]]]:
    """Runs of candidate windows of a block: starts and run numbers of all occurrences, and the
    distinct runs (number, anchor hash, first document, in another document of the block too, text)."""
    hashes, start, doc, found = block.windows()
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    short = _short(found, bits)
    order = np.argsort(short, kind="stable")
    ranked, ids = short[order], block.ids[doc]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    begin = np.flatnonzero(fresh)
    mask = np.zeros(len(begin), bool)
    for part, a, b in _ranges(ranked[begin], bits):
        mask[a:b] = np.unpackbits(np.frombuffer(zlib.decompress(seen[part]), np.uint8), count=b - a).astype(bool)
    # or in several documents of this block, which lie in id order (ids compared, as rows may share one)
    inner = ids[order]
    mask |= inner[begin] != inner[np.concatenate([begin[1:], [len(inner)]]) - 1]
    keep = np.empty(len(order), bool)
    keep[order] = mask[np.cumsum(fresh) - 1]
    start, doc = start[keep], doc[keep]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    anchors = run_hashes(hashes, ANCHOR)
    least = np.empty(len(start), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(anchors, WINDOW - ANCHOR + 1)
    for i in range(0, len(start), 1 << 16):
        least[i : i + (1 << 16)] = view[start[i : i + (1 << 16)]].argmin(axis=1)
    least += start
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(least) != 0) | (np.diff(doc) != 0)]))
    windows = np.diff([*begin, len(start)])
    number: dict[bytes, int] = {}
    runs: list[list] = []
    which = np.empty(len(begin), np.int64)
    words = block.words
    for k, (s, n, a, d) in enumerate(zip(start[begin].tolist(), windows.tolist(), anchors[least[begin]].astype(np.int64).tolist(), ids[keep][begin].tolist())):
        text = b" ".join(words[s : s + n + WINDOW - 1])
        i = number.setdefault(text, len(runs))
        if i == len(runs):
            runs.append([i, a, d, False, text])
        elif d != runs[i][2]:
            runs[i][3] = True
        which[k] = i
    return start[begin], which, [tuple(r) for r in runs]


def _letter(i: int) -> str:
    """The i-th code point that is no surrogate."""
    return chr(i + 1 if i < 0xD7FF else i + 0x801)


def confirm(table: pa.Table) -> pa.Table:
    """For one shard: (block, run, firsts) with the first document of each window of the run, for
    runs with a window that several documents hold."""
    letter: dict[bytes, str] = {}  # a letter for each word, so that a run of words is a short string
    held: dict[bytes, list] = {}  # text -> first document, whether another has it too, as letters
    rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "run", "doc_id", "again", "text"))))
    for _, _, doc, again, text in rows:
        known = held.get(text)
        if known is None:
            held[text] = [doc, again, "".join([letter.get(w) or letter.setdefault(w, _letter(len(letter))) for w in text.split(b" ")])]
        else:
            known[1] = known[1] or again or doc != known[0]
            known[0] = min(doc, known[0])
    texts_ = sorted(held.values())
    owner: dict[str, int] = {}  # window -> the first run that has it, in the order of documents
    recurring: set[str] = set()
    for k, (doc, again, words) in enumerate(texts_):
        for i in range(len(words) - WINDOW + 1):
            w = words[i : i + WINDOW]
            o = owner.setdefault(w, k)
            if again or texts_[o][0] != doc:
                recurring.add(w)
    # passages: stretches of recurring windows in the run that owns them
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for k, (doc, _, words) in enumerate(texts_):
        begin = None
        for i in range(len(words) - WINDOW + 2):
            w = words[i : i + WINDOW]
            if len(w) == WINDOW and w in recurring and owner[w] == k:
                begin = i if begin is None else begin
            elif begin is not None:
                passage = words[begin : i + WINDOW - 1]
                automaton.add_word(passage, (len(passage), doc))
                begin = None
    block, run, firsts = [], [], []
    if recurring:
        automaton.make_automaton()
        located: dict[bytes, bytes] = {}
        for text, (_, _, words) in held.items():
            found = [NEVER] * (len(words) - WINDOW + 1)
            for end, (size, doc) in automaton.iter(words):
                for i in range(end - size + 1, end - WINDOW + 2):
                    found[i] = doc
            # a passage that is not here whole: its windows one by one
            for i, doc in enumerate(found):
                if doc == NEVER and (w := words[i : i + WINDOW]) in recurring:
                    found[i] = texts_[owner[w]][0]
            if min(found) < NEVER:
                located[text] = np.array(found, np.int64).tobytes()
        for b, k, _, _, text in rows:
            if text in located:
                block.append(b)
                run.append(k)
                firsts.append(located[text])
    return pa.table({"block": pa.array(block, pa.int64()), "run": pa.array(run, pa.int64()), "firsts": pa.array(firsts, pa.binary())})


def removed_words(block: Block, start: np.ndarray, run: np.ndarray, answer: dict[int, bytes]) -> np.ndarray:
    """Mask over the words of the block."""
    change = np.zeros(len(block.words) + 1, np.int64)
    if not answer or not len(start):
        return change[:-1] > 0
    keys = np.fromiter(answer, np.int64, len(answer))
    order = np.argsort(keys)
    blobs = list(answer.values())
    firsts = np.frombuffer(b"".join([blobs[i] for i in order]), np.int64)
    windows = np.array([len(blobs[i]) // 8 for i in order], np.int64)
    begin, keys = np.cumsum(windows) - windows, keys[order]
    at = np.minimum(np.searchsorted(keys, run), len(keys) - 1)
    hit = keys[at] == run
    at, start = at[hit], start[hit]
    document = block.ids[np.searchsorted(block.first, start, side="right") - 1]
    n = windows[at]
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    gone = firsts[np.repeat(begin[at], n) + offset] < np.repeat(document, n)
    place = (np.repeat(start, n) + offset)[gone]
    size = len(change)
    change = np.bincount(place, minlength=size) - np.bincount(place + WINDOW, minlength=size)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_removed, kept, kept_sha256) for every row of ``docs``: the words
    that stay, joined by one space; ``text_hash`` is xxhash64 of the text, to tell rows of one id apart."""
    packed = blocks(docs)
    n_bytes = packed.select(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = max(0, int(n_bytes) // 2 // RANGE_HASHES).bit_length()  # about two compressed bytes a word
    answers = window_hashes(packed, bits).groupBy("range").applyInArrow(seen_elsewhere, "block long, range long, bits binary")
    answers = store(answers, "seen")

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        seen = dict(zip(right.column("range").to_pylist(), right.column("bits").to_pylist()))
        start, which, runs = candidate_runs(Block(r["ids"], r["sizes"], r["body"]), seen, bits)
        n = len(runs)
        give_back()
        column = lambda k, kind: pa.array([None, *[x[k] for x in runs]], kind)
        return pa.table({
            "block": pa.array([r["block"]] * (n + 1), pa.int64()), "run": column(0, pa.int64()), "anchor": column(1, pa.int64()),
            "doc_id": column(2, pa.int64()), "again": column(3, pa.bool_()), "text": column(4, pa.binary()),
            "starts": pa.array([_pack(start)] + [None] * n, pa.binary()), "runs": pa.array([_pack(which)] + [None] * n, pa.binary())})

    found = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        candidates, "block long, run long, anchor long, doc_id long, again boolean, text binary, starts binary, runs binary")
    found = store(found, "candidates")
    runs = found.where("run is not null").select("block", "run", "anchor", "doc_id", "again", "text")
    n_text = runs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, int(n_text) // 20 // SHARD_WINDOWS)  # about 20 bytes of run for each window
    confirmed = runs.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInArrow(confirm, "block long, run long, firsts binary")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        part = left.to_pylist()
        body = next(r for r in part if r["body"] is not None)
        places = next(r for r in part if r["starts"] is not None)
        block = Block(body["ids"], body["sizes"], body["body"])
        block.first = np.concatenate([[0], np.cumsum([len(t.split()) for t in block.texts])]).astype(np.int64)
        answer = dict(zip(right.column("run").to_pylist(), right.column("firsts").to_pylist()))
        gone = removed_words(block, _unpack(places["starts"], np.int64), _unpack(places["runs"], np.int64), answer)
        n, removed, kept, digest = [], [], [], []
        for a, b in zip(block.first[:-1].tolist(), block.first[1:].tolist()):
            words, mask = block.words[a:b], gone[a:b]
            if mask.any():
                words = [w for w, g in zip(words, mask.tolist()) if not g]
            text = b" ".join(words)
            n.append(b - a)
            removed.append(b - a - len(words))
            kept.append(text)
            digest.append(hashlib.sha256(text).hexdigest())
        return pa.table({
            "doc_id": pa.array([i if i != NO_ID else None for i in block.ids.tolist()], pa.int64()),
            "text_hash": pa.array([xxhash.xxh64_intdigest(t, seed=42) - ((xxhash.xxh64_intdigest(t, seed=42) >> 63) << 64) for t in block.texts], pa.int64()),
            "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()), "kept_sha256": pa.array(digest)})

    none = F.lit(None).cast("binary")
    left = packed.select("block", "ids", "sizes", "body", none.alias("starts"), none.alias("runs")).union(
        found.where("run is null").select("block", none.alias("ids"), none.alias("sizes"), none.alias("body"), "starts", "runs"))
    return left.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(
        finish, "doc_id long, text_hash long, n_words long, n_removed long, kept string, kept_sha256 string")
