"""Every operator against brute force, the libraries, round trips or held-out rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as E

pytest.importorskip("envspark.llm")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def run(spark, name):
    return E.queries()[name](spark, SMALL).collect()


# --- 1 quality rules ---------------------------------------------------------
def base(text):
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = collections.defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    again = {i + k for s in seen.values() if len(s) > 1 for i in s for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_quality_base_measures(spark, rows):
    for r in run(spark, "op1_quality_rules"):
        n, chars, symbols, dup, rep = base(rows[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        assert not (r["kept"] and r["base_failed"])


def test_quality_agrees_with_labels(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    j = E.queries()["op1_quality_rules"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("quality", "q"), "doc_id")
    good, kept_good, bad, kept_bad = j.agg(*[F.sum(x.cast("int")) for x in ((j.q == 1) & ~j.base_failed, (j.q == 1) & j.kept, j.q == 0, (j.q == 0) & j.kept)]).first()
    assert kept_good >= 0.98 * good and kept_bad <= 0.1 * bad


def test_quality_em_matches_numpy(spark):
    from envspark.llm import quality as Q

    names = ["a", "b", "c"]
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    votes = [np.where(rng.random(4000) < 0.3, 0, np.where(truth, np.where(rng.random(4000) < 0.99, 1, -1), np.where(rng.random(4000) < h, -1, 1))) for h in (0.5, 0.6, 0.7)]
    count = collections.Counter(zip(*[v.tolist() for v in votes]))
    df = spark.createDataFrame([(*k, n) for k, n in count.items()], "a int, b int, c int, n long")
    got, good = Q.accuracies(df, names, 5)
    p, w = Q.PRIOR, Q.PRIOR["weight"]
    hit, ok, share = np.full(3, 0.25), np.full(3, 0.99), p["good"]
    v, n = np.array(list(count)), np.array(list(count.values()))
    for _ in range(5):
        lo = math.log(share / (1 - share)) + np.where(v == 1, np.log(ok / (1 - hit)), np.where(v == -1, np.log((1 - ok) / hit), 0)).sum(1)
        q = 1 / (1 + np.exp(-lo))
        share = min(max((n @ q + w * p["good"]) / (n.sum() + w), 0.05), 0.999)
        cast = v != 0
        hit = np.clip(((n * (1 - q)) @ (v == -1) + w * 0.25) / ((n * (1 - q)) @ cast + w), Q.LEAST_HIT, 0.999)
        ok = np.clip(((n * q) @ (v == 1) + w * 0.99) / ((n * q) @ cast + w), Q.LEAST_PASS, 0.999)
    assert np.allclose([got[r] for r in names], np.stack([hit, ok], 1)) and abs(good - share) < 1e-9


# --- 2 mixing ------------------------------------------------------------------
def test_mixing_meets_targets(spark, rows):
    from envspark.llm.mixing import WEIGHTS

    got = run(spark, "op2_mixing")
    total = {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got) for d in WEIGHTS}
    share = {d: t / sum(total.values()) for d, t in total.items()}
    assert all(abs(share[d] - WEIGHTS[d]) < 0.002 for d in WEIGHTS)
    assert len(got) == len(rows) and min(r["rate"] for r in got) >= 1 and all(r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in got)
    assert all(r["n_tokens"] == len(rows[r["doc_id"]].encode().split()) for r in got)


# --- 3 toxicity ------------------------------------------------------------------
def test_toxicity_held_out():
    import duckdb

    from envspark.llm import sparse as S
    from envspark.llm import toxicity as T

    d = "/root/testdata/sf0.1"
    data = duckdb.sql(f"select text, toxic from '{d}/documents.parquet' join '{d}/labels.parquet' using (doc_id) order by hash(doc_id)").fetchall()
    half = len(data) // 2
    sample, y = [t.encode() for t, _ in data[:half]], np.array([t for _, t in data[:half]])
    v = S.Vocabulary(sample)
    triples = S.matrix(sample, v)
    w, b = T.fit_ordinal(triples, T.severity_grades(triples, y, len(v)), len(v))
    assert (np.diff(b) > 0).all()
    score, encode = T.Severity(w, b), v.encoder()
    out = np.array([score(*encode(t.encode()), None)[0] for t, _ in data[half:]]) >= T.REJECT
    truth = np.array([t for _, t in data[half:]]) == 1
    assert out[truth].mean() > 0.85 and out[~truth].mean() < 0.02


# --- 4 substring dedup ------------------------------------------------------------
def brute_removed(rows):
    first = {}
    split = {i: (t or "").encode().split() for i, t in sorted(rows.items())}
    for i, w in split.items():
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def test_substrings_match_brute_force(spark, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run(spark, "op4_substring_dedup")}
    assert got == brute_removed(rows)


def test_substrings_over_many_blocks_and_shards(table, monkeypatch):
    from envspark.llm import phrases as P

    monkeypatch.setattr(P, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(P, "RANGE_HASHES", 64)
    monkeypatch.setattr(P, "SHARD_WINDOWS", 50)
    rnd = random.Random(3)
    passage = [[f"p{k}_{i}" for i in range(40)] for k in range(5)]
    rows = {}
    for i in range(120):
        w = [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(40))]
        p = rnd.choice(passage)
        a = rnd.randrange(20)
        w[rnd.randrange(len(w) + 1) : 0] = p[a : a + rnd.randrange(5, 30)]
        rows[i] = " ".join(w * rnd.choice((1, 1, 2)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in P.remove_repeats(table(list(rows.items()))).collect()}
    assert got == brute_removed(rows)


# --- 5 sharding -----------------------------------------------------------------
def test_shards(spark, rows):
    got = run(spark, "op5_sharding")
    by, size = collections.defaultdict(list), collections.Counter()
    for r in got:
        t = rows[r["doc_id"]].encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(24))
    assert max(size.values()) - min(size.values()) <= max(r["size"] for r in got)


def test_shard_map_edits():
    from envspark.llm.shards import edited_map, first_map

    rnd = random.Random(5)
    load = [rnd.randrange(1000) for _ in range(4096)]
    owner = first_map(load, 24)
    grown = edited_map(load, owner, 25)
    assert all(b == 24 for a, b in zip(owner, grown) if a != b)
    held = collections.Counter()
    for s, x in zip(grown, load):
        held[s] += x
    assert max(held.values()) - min(held.values()) < 0.05 * sum(load) / 25
    assert edited_map(load, owner, 24) == owner or sum(a != b for a, b in zip(edited_map(load, owner, 24), owner)) < 48


def test_shard_map_versions(spark, tmp_path):
    from envspark.llm.shards import load_map, save_map

    path = str(tmp_path / "map")
    save_map(spark, path, 1, [5, 6], [0, 1])
    save_map(spark, path, 2, [5, 6], [1, 1])
    assert [r["shard"] for r in load_map(spark, path, 1).orderBy("virtual_slot").collect()] == [0, 1]
    assert [r["shard"] for r in load_map(spark, path).orderBy("virtual_slot").collect()] == [1, 1]


# --- 6 language model -------------------------------------------------------------
def test_language_model(spark, rows):
    got = run(spark, "op6_lm_scoring")
    split = {i: t.encode().lower().split() + [None] for i, t in rows.items()}
    c = collections.Counter(w for i, s in split.items() if zlib.crc32(str(i).encode()) % 10 for w in s)
    total, distinct = sum(c.values()), len(c)
    for r in got:
        s = split[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(s), sum(c[w] > 0 for w in s), total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in s), rel_tol=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_class_model_is_normalised():
    from envspark.llm.neural_lm import Classes, Model

    m = Model(Classes([b"a", b"b"], [b"c"], np.array([5.0, 3, 2, 1, 4])))
    z = np.full(25, np.nan, np.float32)
    p = np.exp(m.log_p(np.full(5, 1), np.full(5, 3), np.arange(5), z))
    assert math.isclose(p.sum(), 1, rel_tol=1e-5)


def test_vocabulary_grows_with_the_corpus(table):
    from envspark.llm import neural_lm as N

    rnd = random.Random(9)
    for n in (1000, 3000):  # more words than any fixed table of some hundreds holds
        counts = table([(f"w{i}".encode(), rnd.randrange(N.MIN_COUNT, 99)) for i in range(n)] + [(b"rare%d" % i, 1) for i in range(50)], "word binary, c long")
        classes, words = N.word_classes(counts, 5)
        own = {bytes(r["word"]): r["class"] for r in words.collect()}
        assert len({own[f"w{i}".encode()] for i in range(n)}) == n == len(classes.words)
        m = N.Model(classes)
        assert m.context.shape[0] == m.target[-1].shape[0] == classes.size > n
        # every unit has a probability that depends on the units before it
        rng = np.random.default_rng(1)
        for t in m.target:
            t[...] = rng.standard_normal(t.shape)
        p, q = (np.exp(m.log_p(np.full(classes.size, k), np.full(classes.size, 7), np.arange(classes.size))) for k in (1, 2))
        assert math.isclose(p.sum(), 1, rel_tol=1e-4) and math.isclose(q.sum(), 1, rel_tol=1e-4)
        assert (np.abs(np.log(p / q)) > 1e-6).mean() > 0.99


def test_training_shuffles_one_model_a_core(spark):
    """However many files the texts have, no more copies of the model are trained and shuffled than tasks run at once."""
    from envspark.llm import neural_lm as N

    rows = [(i, " ".join(f"w{(7 * i + j) % 60}" for j in range(200))) for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    cores, name = spark.sparkContext.defaultParallelism, "copies of the model"
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.sparkContext.setJobGroup(name, name)
    try:
        for k in before:
            spark.conf.set(k, "2k")  # a task for each file
        got = {r["doc_id"]: r for r in N.score_documents(docs).collect()}
        status = spark.sparkContext.statusTracker()
        stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(name) for s in status.getJobInfo(j).stageIds]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    trained = [s for s in stages if s and s.name.startswith("toLocalIterator")]
    assert len(trained) >= N.ROUNDS and max(s.numTasks for s in trained) <= cores < 24
    held = [r for r in got.values() if r["held_out"]]
    assert len(got) == 480 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rare_words_of_several_blocks(spark):
    """Counts of rare words come from all blocks, also for texts and words that no training text has."""
    from envspark.llm import neural_lm as N

    texts = {i: " ".join(f"{'rare' if (i + j) % 7 else 'often'}{(i * 31 + j) % 90}" for j in range(40)) for i in range(60)} | {60: "", 61: None, 62: "nowhere else"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in N.score_documents(docs).collect()}
    split = {i: (t or "").split() + [None] for i, t in texts.items()}
    c = collections.Counter(w for i, s in split.items() if N.fold_of(i) for w in s)
    total, distinct = sum(c.values()), len(c)
    for i, s in split.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(s), sum(c[w] > 0 for w in s), total)
        assert math.isclose(got[i]["base_score"], sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in s), rel_tol=1e-9)


def test_dictionary_numbers_follow_split():
    from envspark.llm.neural_lm import coded_words

    rnd = random.Random(4)
    for n in range(300):
        texts = [bytes(rnd.choice(b"aAbZ \t\n\x0b\x0c\r\x1c\x85\x00\xc3\xa9") for _ in range(rnd.randrange(12))) for _ in range(n % 5 + 1)]
        split = [t.lower().split() for t in texts]
        known = {w: i for i, w in enumerate(dict.fromkeys(w for s in split for w in s))}
        sizes, ids, words = coded_words(texts)
        assert (sizes.tolist(), ids.tolist(), words.to_pylist()) == ([len(s) for s in split], [known[w] for s in split for w in s], list(known))


@pytest.mark.parametrize("units", [2, 9, 700])
def test_graphs_train_and_score_as_numpy(monkeypatch, units):
    """The graphs do the whole step: all levels, all tokens and their noise, as numpy does."""
    from envspark.llm import graphs
    from envspark.llm import neural_lm as N

    if not graphs.usable():
        pytest.skip("no ONNX Runtime")
    rng, found = np.random.default_rng(3), []
    one, two, word = (np.minimum(rng.pareto(0.7, (3, 6000)), units - 1).astype(np.int64)).reshape(3, -1)
    for graph in (True, False):
        monkeypatch.setattr(graphs, "usable", lambda graph=graph: graph)
        m = N.Model(N.Classes([b"w%d" % i for i in range(units - 2)], [], np.append(np.full(units - 1, 5.0), 3)))
        before, start = [x.copy() for x in m.tables()], m.log_p(one, two, word).sum()
        trainer = N.Trainer(m, 1)
        for a in range(0, 6000, 1500):
            trainer.step(one[a : a + 1500], two[a : a + 1500], word[a : a + 1500])
        p = m.log_p(one, two, word)
        assert p.sum() > start + 100
        m.target = [np.ascontiguousarray(t) * 1000 for t in m.target]  # scores beyond the range of exp
        far = m.log_p(one, two, word)
        m.keep()
        assert np.array_equal(far, m.log_p(one, two, word))
        found.append([*trainer.tables, *trainer.seen, p, far, *[x - y for x, y in zip(trainer.tables, before)]])
    for x, y in zip(*found):
        assert np.allclose(x, y, rtol=1e-3, atol=1e-4)


def test_units_of_several_dictionaries():
    import pyarrow as pa
    import zstandard

    from envspark.llm import neural_lm as N

    classes = N.Classes([b"one", b"two"], [b"ree"], np.ones(5))
    blocks = [[b"two", b"three"], [], [b"x", b"one", b"free"], [b"two"], [b"three", b"x"], [b"one"]]
    got = list(N.units_of([zstandard.compress(b" ".join(b)) for b in blocks], classes))
    assert [(i, w.to_pylist()) for i, w, _ in got] == list(enumerate(blocks))
    assert all(np.array_equal(u, classes.numbers(pa.array(b, pa.binary()))) for (_, _, u), b in zip(got, blocks))


# --- 7 and 9 tokenizers --------------------------------------------------------------
def odd_texts():
    rnd = random.Random(7)
    letters = "ab e\n▁ é 'tsl中🎉1. ,  "
    return ["", " ", "   a ", "<|endoftext|>a<|endoftext|>", "a\x1cb\x85c　d", " " * 300, "x" * 3000, "don't we'LL", *["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(800)]]


def test_sentencepiece_matches_library(spark, rows):
    import sentencepiece

    from envspark.llm import spm
    from envspark.llm.queries import PIECE_FILE, tokenizer

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE_FILE))
    texts = odd_texts() + list(rows.values())
    model = spm.load_model(tokenizer(PIECE_FILE))
    packed = spm.encode_column(texts, spm.Encoder(model))
    for t, p in zip(texts, packed):
        ids = np.frombuffer(p, "<i4")
        assert ids.tolist() == library.encode(t)
        assert spm.decode(ids, model["bytes"]) == t.replace("▁", " ")
    for r in run(spark, "op7_sentencepiece"):
        ids = library.encode(rows[r["doc_id"]])
        assert r["round_trip"] and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()


def test_token_counts_match_library(spark, rows):
    from tokenizers import Tokenizer

    from envspark.llm.queries import BPE_FILE, tokenizer
    from envspark.llm.tokens import counter, load_vocabulary

    library = Tokenizer.from_file(tokenizer(BPE_FILE))
    of = counter(load_vocabulary(tokenizer(BPE_FILE)))
    for t in odd_texts():
        assert of(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)
    for r in run(spark, "op9_token_counts"):
        t = rows[r["doc_id"]]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)


# --- 8 fingerprints -------------------------------------------------------------------
def test_fingerprints(spark, rows):
    order = sorted(rows, reverse=True)
    follow = dict(zip(order, order[1:] + order[:1]))
    got = {r["doc_id"]: r for r in run(spark, "op8_fingerprints")}
    assert set(got) == set(rows)
    by_text = collections.defaultdict(set)
    for i, r in got.items():
        t, u = rows[i], rows[follow[i]]
        n = len(t) // 3
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest()
        by_text[t].add(r["fingerprint"])
        assert 0 <= r["near_next"] <= 1 and (t != u or r["near_next"] == 1)
    assert all(len(f) == 1 for f in by_text.values())
    long_ = [r for r in got.values() if r["n_chars"] > 500]
    assert np.median([r["near_edited"] for r in long_]) > 0.5 > np.median([r["near_next"] for r in long_])


def test_window_entropy_is_exact():
    from envspark.llm import digest as D

    x = np.random.default_rng(2).integers(0, 20, 3000).astype(np.uint8)
    for i, got in enumerate(D.window_entropy(x)):
        c = np.bincount(x[i : i + D.WIDTH])
        c = c[c > 0] / D.WIDTH
        assert abs(-(c * np.log2(c)).sum() / math.log2(D.WIDTH) * 255 - got) <= 0.51


# --- 10 near-duplicates ------------------------------------------------------------------
def brute_components(rows, percent):
    sets = {}
    for i, t in rows.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                n = len(sets[a] & sets[b])
                if n and comp[a] != comp[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in rows}


def test_near_duplicates_match_brute_force(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op10_minhash")}
    assert got == brute_components(rows, 85)


@pytest.mark.parametrize("stars", [0, 2])
def test_near_duplicate_group_with_chains(table, monkeypatch, stars):
    from envspark.llm import neardup as N

    monkeypatch.setattr(N, "STARS", stars)
    rnd = random.Random(11)
    text = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(60):
        w = list(text)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        rows[i] = " ".join(w)
        if i % 7 == 0:
            text[rnd.randrange(len(text))] = f"d{i}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(table(list(rows.items())), 85).collect()}
    assert got == brute_components(rows, 85)


def test_components(spark):
    from envspark.llm.common import components

    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(100 + rnd.randrange(60), 100 + rnd.randrange(60)) for _ in range(50)]
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: p for x, p in parent.items() if x != p}


# --- odd and empty tables -------------------------------------------------------------
def applied(name, spark, docs):
    from envspark.llm import digest, mixing, neardup, neural_lm, phrases, quality, shards, spm, tokens, toxicity
    from envspark.llm.common import scratch_path
    from envspark.llm.queries import BPE_FILE, PIECE_FILE, tokenizer

    labels = spark.createDataFrame([(3, 1, "en"), (4, 0, "de"), (None, 1, "en"), (7, None, None)], "doc_id long, toxic int, lang string")
    return {
        "quality": lambda: quality.judge(docs), "mixing": lambda: mixing.mix(docs, labels), "toxicity": lambda: toxicity.score_toxicity(docs, labels),
        "phrases": lambda: phrases.remove_repeats(docs), "shards": lambda: shards.shard_documents(docs, 24, scratch_path(spark, "map")),
        "lm": lambda: neural_lm.score_documents(docs), "spm": lambda: spm.encode_documents(docs, tokenizer(PIECE_FILE)),
        "digest": lambda: digest.compare_neighbours(docs), "tokens": lambda: tokens.count_tokens(docs, tokenizer(BPE_FILE)), "neardup": lambda: neardup.near_duplicates(docs),
    }[name]().collect()


NAMES = ["quality", "mixing", "toxicity", "phrases", "shards", "lm", "spm", "digest", "tokens", "neardup"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    got = applied(name, spark, odd)
    want = collections.Counter(r["doc_id"] for r in odd.collect())
    assert collections.Counter(r["doc_id"] for r in got) == want
    if name == "phrases":
        by = {r["doc_id"]: r for r in got}
        assert by[10]["n_removed"] == 0 and by[11]["kept"] == "" and by[1]["n_words"] == 0
    if name == "neardup":
        by = {(r["doc_id"], r["component_id"]) for r in got}
        assert {(4, 4), (5, 4), (10, 10), (11, 10), (1, 1), (2, 2), (6, 6)} <= by


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert applied(name, spark, empty) == []


# --- pipeline -------------------------------------------------------------------------------
def test_pipeline(spark, docs, rows):
    import corpus_pipeline as P

    from envspark.llm.common import store

    got, kept = docs, []
    for name, stage in P.STAGES:
        got = store(stage(spark, got, SMALL), name)
        kept.append({r["doc_id"] for r in got.select("doc_id").collect()})
        if name != "sentencepiece":
            assert got.columns == P.COLUMNS
        if name == "near_dedup":
            left = {i: rows[i] for i in kept[0]}
            assert kept[1] == {i for i, (_, c) in brute_components(left, P.SIMILAR).items() if i == c}
        if name == "substring_dedup":
            removed = brute_removed({i: rows[i] for i in kept[1]})
            for r in got.collect():
                n, gone, digest = removed[r["doc_id"]]
                assert r["text"] == rows[r["doc_id"]] if not gone else hashlib.sha256(r["text"].encode()).hexdigest() == digest
                assert r["n_chars"] == len(r["text"])
    assert kept[1] == kept[2] == kept[3] == kept[4]
    assert set(got.columns) == {"doc_id", "n_tokens", "ids"}


def test_pipeline_rows_of_one_id(spark, docs, rows):
    import corpus_pipeline as P

    toxic = next(rows[r["doc_id"]] for r in run(spark, "op3_toxicity") if r["rejected"])
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")
    extra = [(None, toxic), (None, a), (None, b), (-5, c), (-5, d), (-4, c), (-5, d), (-3, None), (None, "")]
    table = docs.select(*P.COLUMNS).union(spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in extra], "doc_id long, text string, lang string, source string, n_chars long"))
    got = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect() if r["doc_id"] is None or r["doc_id"] < 0)
    clean = sorted((str(i), t or "") for i, t in extra if t != toxic)
    assert got(P.toxicity(spark, table, SMALL)) == clean
    few = table.where("doc_id is null or doc_id < 0").where(table["text"].isNull() | (table["text"] != toxic))
    once = sorted({x for x in clean if x != ("-4", c)})  # -4 holds the text of a smaller id, one row stands twice
    kept = P.near_dedup(spark, few, SMALL)
    assert got(kept) == once
    assert got(P.substring_dedup(spark, kept, SMALL)) == once
    assert set(got(P.mixing(spark, kept, SMALL))) == set(once)
    assert P.sentencepiece(spark, kept, SMALL).count() == len(once)


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty, kind):
    from pyspark.sql import functions as F

    import corpus_pipeline as P

    table = (odd if kind == "odd" else empty).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("x").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for name, stage in P.STAGES:
        got = stage(spark, table, SMALL)
        ids = {r["doc_id"] for r in got.collect()}
        want = {r["doc_id"] for r in table.collect()} - ({5, 11} if name == "near_dedup" else set())
        assert ids == want, name
