"""Sparse text features for the classifiers (toxicity, domains).

Features of a text are its words (ASCII letters lower-cased, ASCII punctuation as space) and the
first letters of its words, each with the value sqrt(share of the text's words).  A vocabulary of
features is fitted on a bounded sample of labelled rows; scoring covers whole texts of all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, raw, texts

PREFIX = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def prefix(word: bytes) -> bytes:
    """The first letters of a longer word, marked so that it equals no word."""
    return b" " + word.decode()[:PREFIX].encode() if len(word) > PREFIX else b""


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: str, per_grade: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and grades of at most ``per_grade`` labelled rows of each grade (a documented bound):
    those with the smallest hashes of their ids, so the choice does not depend on file order.
    ``labels``: (doc_id, grade); rows with a null id, text or grade teach nothing."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).alias("y")).where("doc_id is not null and y is not null")
    grades = sorted(r[0] for r in known.select("y").distinct().limit(64).collect())
    chosen = None
    for g in grades:
        part = known.where(F.col("y") == F.lit(g)).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return [], np.zeros(0, int)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", F.encode("text", "UTF-8").alias("b"))
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["y"], bytes(r["b"])))
    return [bytes(r["b"]) for r in rows], np.array([r["y"] for r in rows])


class Vocabulary:
    """Features seen in at least ``least`` sample texts."""

    def __init__(self, sample: list[bytes], least: int = 4):
        seen: Counter[bytes] = Counter()
        for t in sample:
            own = set(words(t))
            seen.update(own | {prefix(w) for w in own} - {b""})
        self.index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}

    def __len__(self) -> int:
        return len(self.index)

    def encoder(self):
        """text -> (feature numbers, values); remembers words within bounds."""
        index, own, of = self.index, {}, []

        class Words(dict):
            def __missing__(self, w: bytes) -> int:
                pair = (index.get(w, -1), index.get(prefix(w), -1))
                k = own.setdefault(pair, len(of))
                if k == len(of):
                    of.append(pair)
                if len(self) < 300_000:
                    self[w] = k
                return k

        known = Words()

        def encode(text: bytes) -> tuple[np.ndarray, np.ndarray]:
            ws = words(text)
            n = np.bincount(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)), minlength=0)
            hit = np.flatnonzero(n)
            pairs = np.array(of, np.int64).reshape(-1, 2)[hit] if len(of) < 4096 or len(hit) * 8 > len(of) else np.array([of[i] for i in hit], np.int64).reshape(-1, 2)
            at, count = pairs.ravel(), np.repeat(n[hit], 2)
            at, count = at[at >= 0], count[at >= 0]
            feature, place = np.unique(at, return_inverse=True)
            return feature, np.sqrt(np.bincount(place, count, len(feature)) / max(1, len(ws)))

        return encode


def matrix(sample: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) triples of the sample."""
    encode = vocabulary.encoder()
    parts = [encode(t) for t in sample]
    rows = np.repeat(np.arange(len(parts)), [len(f) for f, _ in parts])
    return rows, np.concatenate([f for f, _ in parts] or [np.zeros(0, np.int64)]), np.concatenate([v for _, v in parts] or [np.zeros(0)])


def score_texts(docs: DataFrame, vocabulary: Vocabulary, score, schema: str) -> DataFrame:
    """Rows (doc_id, text_hash, *score(features, values, text bytes)) of every document, whole texts;
    ``text_hash`` is xxhash64 of the text, to tell rows of one id apart.
    ``schema`` names the score's columns; the vocabulary is bounded by the sample and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, score))
    names = ["doc_id", "text_hash", *(c.split()[0] for c in schema.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, score = shared.value
        encode = vocabulary.encoder()
        for batch in pieces(batches):
            found = [score(*encode(t), t) for t in raw(batch.column(1))]
            columns = [pa.array(list(c)) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=names)

    return texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, f"doc_id long, text_hash long, {schema}")
