"""Word BPE, fill-in-middle and Merkle manifest against the library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import regex

import __spark_entry__ as E

pytest.importorskip("envspark.llm")
from envspark.llm.queries import WORD_FILE, tokenizer  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(WORD_FILE))


@pytest.fixture(scope="module")
def codec():
    from envspark.llm import wordbpe

    return wordbpe.Codec(wordbpe.load_vocabulary(tokenizer(WORD_FILE)))


# --- 11 word BPE ---------------------------------------------------------------
def digests(ids, text):
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), H(text)


def test_word_bpe_equals_the_library(spark, rows, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in E.queries()["op11_word_bpe"](spark, SMALL).collect()}
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == digests(ids, library.decode(ids, skip_special_tokens=False))
    assert len(got) == len(rows)


def test_word_bpe_speculates_and_merges_exactly(codec, library):
    rnd = random.Random(1)
    alphabet = "abcdeinotrsh'é ÀßΣσİǅ中文🎉<|endoftext|>0½²́ Ᲊ\U00033000\n#$!?.,"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 60))) for _ in range(2000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b <|endoftext|", "ΟΔΟΣ ΑΣ", "x</w> </w>", "", " \t\n", "x" * 40_000, "!" * 9_999, "it's we'll I'M"]
    packed = codec.encode(texts)
    for t, p, want in zip(texts, packed, library.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(p, "<u4").astype(np.int64)
        assert ids.tolist() == want.ids
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)
    words = len({w for t in texts for w in codec.units(t)})
    assert 0 < codec.exact < words  # some proposals fail and are merged, the others stand


def test_compatible_pairs_match_merging(codec):
    from envspark.llm import wordbpe as W

    rnd, v = random.Random(2), codec.v
    names = {i: t for t, i in v["ids"].items()}
    first = [i for i, t in names.items() if not t.endswith(W.END)]
    pairs = [(rnd.choice(first), rnd.randrange(v["size"])) for _ in range(4000)]
    pairs += [(v["ids"][a], v["ids"][b]) for a, b in rnd.sample(list(v["ranks"]), 500)]
    got = W.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), v)
    for (a, b), ok in zip(pairs, got.tolist()):
        assert ok == (W.merge(W.symbols(names[a] + names[b]), v["ranks"]) == [names[a], names[b]])


def test_word_bpe_tables(spark, odd, empty, library):
    from envspark.llm import wordbpe as W

    path = tokenizer(WORD_FILE)
    encoded = W.encode_documents(odd, path)
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in encoded.collect())
    want = sorted((str(r["doc_id"]), library.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect())
    assert got == want
    back = sorted((str(r["doc_id"]), r["text"]) for r in W.decode_documents(encoded, path).collect())
    assert back == sorted((str(r["doc_id"]), library.decode(library.encode(r["text"] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in odd.collect())
    digest = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in W.encode_and_decode(odd, path).collect())
    assert digest == sorted((i, *digests(ids, library.decode(ids, skip_special_tokens=False))) for i, ids in want)
    strange = spark.createDataFrame([(1, None), (2, [0, None, 10**6, 1])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, W.decode_documents(strange, path).collect())) == [(1, ""), (2, '! "')]
    assert W.encode_documents(empty, path).collect() == W.encode_and_decode(empty, path).collect() == []


# --- 12 fill in middle -----------------------------------------------------------
def infilled(doc_id, text, rate=100, spm=50, unit=r"[^\n]*\n|[^\n]+"):
    units = regex.findall(unit, text)
    n = len(units)
    d = H(f"7:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or h[2] % 100 >= rate or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_query(spark, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in E.queries()["op12_fill_in_middle"](spark, SMALL).collect()}
    for r in rows:
        *counts, output = infilled(r["doc_id"], r["text"] or "")
        assert got[r["doc_id"]] == (*counts, H(output), H(r["text"] or ""))
    assert {g[1] for g in got.values()} >= {"psm", "spm"}


@pytest.mark.parametrize("rate, spm, unit", [(100, 50, r"[^\n]*\n|[^\n]+"), (60, 0, r"\S+\s*|\s+"), (100, 100, r"(?s:.)")])
def test_fill_in_middle_tables(spark, odd, empty, rate, spm, unit):
    from pyspark.sql import functions as F

    from envspark.llm.infill import fill_in_middle, restored

    marked = spark.createDataFrame([(20, "a\nb <M> c\nd"), (21, "<\nP>\n<S\n>"), (22, "\n\n\n"), (23, "<<\n<\nM>")], "doc_id long, text string")
    for table in (odd.select("doc_id", "text"), marked):
        made = fill_in_middle(table, 7, rate, spm, unit).withColumn("back", restored(F.col("output"), F.col("form")))
        got = sorted((str(r["doc_id"]), tuple(r)[1:-1], r["back"]) for r in made.collect())
        assert got == sorted((str(r["doc_id"]), infilled(r["doc_id"], r["text"] or "", rate, spm, unit), r["text"] or "") for r in table.collect())
    assert fill_in_middle(odd, 7).count() == odd.count() and fill_in_middle(empty, 7).collect() == []


def test_cut_offsets_and_uncovered_texts():
    from envspark.llm.infill import LINES, cutter

    ends = cutter(LINES)
    long = "x" * 200_000 + "\n" + "ab\n" * 100_000 + "tail"
    assert ends("") == [] and ends("a") == [1] and ends("\n\na") == [1, 2, 3]
    assert ends(long) == [m.end() for m in regex.finditer(LINES, long)]
    with pytest.raises(ValueError):
        cutter("[a-z]")("abC")


# --- 13 Merkle manifest -------------------------------------------------------------
def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = None if r["n_chars"] is None else r["n_chars"] + more
    return H("".join(map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"]))))


def tree(level, arity):
    """Root, and for each leaf the runs of (left, right) siblings on its way up."""
    place, paths = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        for path, p in zip(paths, place):
            a = p // arity * arity
            path.append((level[a:p], level[p + 1 : a + arity]))
        place = [p // arity for p in place]
        level = [H("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return level[0], paths


def brute(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        held = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append((held, *tree([leaf(r) for r in held], arity)))
    out = []
    if trees:
        root, above = tree([t[1] for t in trees], arity)
        for (held, subroot, paths), up in zip(trees, above):
            for r, path in zip(held, paths):
                tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
                node = leaf(r, int(tampered))
                for a, b in path + up:
                    node = H("".join(a) + node + "".join(b))
                out.append((r["doc_id"], leaf(r), subroot, root, H("".join("".join(a) + "".join(b) for a, b in path + up)), node, node == root))
    return sorted(map(str, out))


def test_merkle_query_matches_brute_force(spark, rows):
    got = E.queries()["op13_merkle_manifest"](spark, SMALL).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    assert 0 < sum(r["verified"] for r in got) < len(got)


DOC = "doc_id long, source string, lang string, n_chars long, text string, g string, h int, idx int, level int"


@pytest.mark.parametrize("arity", [2, 3])
def test_merkle_odd_tables(spark, monkeypatch, arity):
    from pyspark.sql import functions as F

    from envspark.llm import merkle as M

    monkeypatch.setattr(M, "ROWS_PER_RANGE", 4)
    monkeypatch.setattr(M, "HOP", 1)
    rows = [(None, None, None, None, None)] * 5 + [(None, "s", "en", 3, "abc"), (1, "s", "en", 3, "abc"), (1, "s", "en", 3, "abc"), (1, "t", "en", None, ""), (2, "é", "", 1, "中" * 500)]
    rows += [(i, "hot", "de", i, f"text {i}") for i in range(20)] + [(70, "x", "é", 1, None), (None, None, "de", None, "x")]
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], DOC)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = M.manifest(df, tampered=tampered, arity=arity).withColumn("folded", M.fold(F.coalesce("forged", "leaf"), F.col("proof")))
    hexed = [M.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    got = made.select("doc_id", *hexed, F.sha2(M.proof_text(F.col("proof")), 256), "folded", (F.col("folded") == M.hexed(F.col("root"))).alias("ok")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(df.collect(), arity)


def test_merkle_empty_and_single(spark):
    from envspark.llm.merkle import manifest

    empty = spark.createDataFrame([], DOC)
    assert manifest(empty).collect() == []
    one = spark.createDataFrame([(1, "s", "en", 3, "abc", "", 0, 0, 0)], DOC)
    r = manifest(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof"] == [] and r["leaf"].hex() == leaf(one.first())
