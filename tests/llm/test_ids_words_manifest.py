"""Piece ids, spelling variants and the manifest against the library, brute force and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from plotspark.llm import merkle, piece_ids, spelling
from plotspark.llm.queries import QUERIES
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [
        (1, "one two three four", "en", "a", 18), (1, "one two three four", "en", "a", 18), (None, "one two three four", None, None, None), (2, None, "en", None, None),
        (3, "", "de", "b", 0), (4, " \t\n\r ", None, "b", 5), (5, "1234 -- 5678", "fr", "c", 12), (6, "long words here " * 20_000, "en", "c", 320_000), (None, None, None, None, None),
        (7, "x" * 50_000, "", "d", 50_000), (8, "日本\U0001f642\x00 ▁<s></s>", "fr", "e", 8),
    ]
    clash = {n: F.lit(7) for n in ("ids", "decoded", "word", "n", "grp", "idx", "digest", "path", "leaf", "root", "subroot", "used", "id", "run", "h", "__place", "near")}
    return spark.createDataFrame(rows, DOC).withColumns(clash)


# piece ids

@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    return piece_ids.PieceModel(PIECES)


def ids_of(model, text):
    return np.frombuffer(model.encode(text), dtype="<i4").tolist()


@pytest.mark.parametrize("text", ["", " ", "   ", "a", " a ", "▁▁ a", "<s>", "</s> <0x0A><unk>", "\x00a\x00 b", "a\tb\r\nc", "\U0001f642 x\U0001f642", "日本語", "é é", "�", "12345 678"])
def test_piece_ids_equal_the_library(model, library, text):
    assert ids_of(model, text) == library.encode(text, add_eos=True)


def test_piece_ids_of_blanks_and_long_runs(model, library):
    for k in (*range(2, 40), 63, 64, 65, 1000):
        for text in (" " * k, " " * k + "a", "a" + " " * k + "b", "a" * k, "ab" * k, "7" * k):
            assert ids_of(model, text) == library.encode(text, add_eos=True), text[:20]


def test_piece_ids_of_random_texts(model, library):
    rng = random.Random(3)
    letters, pieces = "ab et his\n\t 0123 ▁.,'éü日\U0001f642\x00́", sorted(model.scores)
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
        assert ids_of(model, text) == library.encode(text, add_eos=True)
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30)))
        assert ids_of(model, text) == library.encode(text, add_eos=True)


def test_last_tokens_are_those_of_every_prefix(model, library):
    text = "▁unbelievably▁▁internationalisation"
    table = model.last_tokens(text)
    for end in range(2, len(text) + 1):
        assert table[end][0] == library.encode(text[:end].replace("▁", " ")[1:])[-1]


def test_small_tables_change_nothing(library, monkeypatch, documents):
    monkeypatch.setattr(piece_ids, "CUTS_KEPT", 3)
    monkeypatch.setattr(piece_ids, "PAIRS_KEPT", 5)
    small = piece_ids.PieceModel(PIECES)
    for r in documents.limit(5).collect():
        assert ids_of(small, r.text) == library.encode(r.text, add_eos=True)


def test_piece_ids_of_all_documents(spark, documents, library):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    got = QUERIES["op11_piece_ids"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        want = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *want)


def test_piece_ids_of_odd_rows(spark, odd_docs, library):
    got = piece_ids.encode(odd_docs, PIECES, decode=True)
    assert got.columns == [c for c in odd_docs.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_eos=True) and r.decoded == library.decode(r.ids)
    assert piece_ids.encode(odd_docs.where("false"), PIECES).count() == 0
    assert "decoded" in piece_ids.encode(odd_docs, PIECES).columns


# spelling variants

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_variants(counts, ratio=5):
    forms, result = {}, {}
    for w, n in counts.items():
        around = [v for v in counts if near(w, v)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        result[w] = (forms[w], n, len(around), counts[best] if forms[w] is not None else None)
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        form, *rest = result[w]
        result[w] = (form, root, *rest)
    return result


def brute_counts(rows, drop_every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def as_rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("filter_bytes", [1 << 20, 64, 200])
def test_variants_equal_brute_force(spark, filter_bytes):
    rng = random.Random(filter_bytes)
    words = {"".join(rng.choice("aabéßz") for _ in range(rng.randint(2, 7))) for _ in range(220)} | {"q", "", "colour", "color", "colours"}
    counts = {w: rng.choice([5, 6, 25, 25, 30, 126, 700, 4000]) for w in words}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert as_rows(spelling.group_variants(vocabulary, filter_bytes=filter_bytes)) == brute_variants(counts)


def test_chains_end_at_the_last_form(spark):
    counts = {"a" * 10 + "b" * k: 6 ** (k + 1) for k in range(12)}
    got = as_rows(spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")))
    assert {r[1] for r in got.values()} == {"a" * 10 + "b" * 11}
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([("a", 1)], "word string, n bigint"), ratio=1)


def test_variants_of_all_documents(spark, documents):
    counts = brute_counts([(r.doc_id, r.text) for r in documents.collect()])
    assert as_rows(QUERIES["op12_spelling_variants"](spark, SF)) == brute_variants(counts)


def test_words_of_odd_rows(spark, odd_docs):
    got = spelling.count_words(odd_docs, min_length=3, min_count=1, drop_every=3)
    want = Counter()
    for r in odd_docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 and len(run) >= 3 else run
            want[run] += len(run) >= 3
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if n}
    assert len(as_rows(spelling.spelling_variants(odd_docs))) == 0 + len(brute_counts([(r.doc_id, r.text) for r in odd_docs.collect()], 10**12))
    assert spelling.spelling_variants(odd_docs.where("false")).count() == 0


def test_filters_take_every_word_and_few_strangers(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(4000)]
    vocabulary = spark.createDataFrame([(w,) for w in sorted(set(words[:2000]))], "word string")
    filters = spelling._filters(vocabulary, {8: len(set(words[:2000]))}, 0, 1)
    digests = spelling._term(np.arange(8), spelling._letters(words, 8)).sum(axis=1, dtype=np.uint64)
    taken = set(spelling._taken(filters, 8, digests, 0, 1).tolist())
    assert taken >= set(range(2000)) and len(taken) < 2040


# manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves, fanout):
    """Root, and the proof (slot, siblings) of every leaf."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for k, i in enumerate(at):
            run, slot = runs[i // fanout], i % fanout
            proofs[k].append((slot, [d for j, d in enumerate(run) if j != slot]))
            at[k] = i // fanout
        level = [sha("".join(run)) for run in runs]
    return level[0], proofs


def brute_manifest(rows, fanout=2):
    """(doc_id, leaf) -> subroot, root, proof text; equal leaves of a group share the sorted list of their proofs."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        groups[lang].append(((doc_id is not None, doc_id or 0), brute_leaf(doc_id, source, lang, n_chars, text), doc_id))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda r: r[:2])
        trees.append(brute_tree([r[1] for r in groups[g]], fanout))
    root, above = brute_tree([t[0] for t in trees], fanout)
    found = []
    for g, (subroot, proofs), upper in zip(order, trees, above, strict=True):
        for (_, leaf, doc_id), proof in zip(groups[g], proofs, strict=True):
            found.append((doc_id, leaf, subroot, root, sha("".join(d for _, others in [*proof, *upper] for d in others))))
    return found


def leaf_of(chars="n_chars"):
    return merkle.digest(*[F.expr(c) for c in ("doc_id", "source", "lang", chars, "text")])


def checked(docs, fanout=2):
    found = merkle.manifest(docs, leaf_of(), "lang", "doc_id", fanout=fanout)
    return merkle.verify(found, F.col("leaf")).withColumn("proof", F.sha2(merkle.proof(F.col("path")), 256))


@pytest.mark.parametrize("fanout", [2, 5])
def test_manifest_equals_brute_force(spark, documents, odd_docs, fanout):
    for docs in (documents.select("doc_id", "text", "lang", "source", "n_chars"), odd_docs):
        rows = [tuple(r)[:5] for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        got = checked(docs, fanout).collect()
        key = lambda r: tuple(str(v) for v in r)
        assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got], key=key) == sorted(brute_manifest(rows, fanout), key=key)
        assert all(r.verified and r.folded_root == r.root for r in got)


def test_manifest_of_all_documents(spark, documents):
    rows = {r.doc_id: r for r in documents.collect()}
    got = QUERIES["op13_merkle_manifest"](spark, SF).collect()
    want = {r[0]: r for r in brute_manifest([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows.values()])}
    assert len(got) == len(rows)
    for r in got:
        assert (r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) == want[r.doc_id]
        changed = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and rows[r.doc_id].n_chars is not None
        assert r.verified == (not changed) and (r.folded_root == r.root) == (not changed)


@pytest.mark.parametrize("sizes", [(1,), (3,), (17, 1, 1, 4, 5)])
def test_trees_of_few_leaves(spark, sizes):
    rows = [(i * 10 + k, f"t{k}", f"g{i}", None, k) for i, n in enumerate(sizes) for k in range(n)]
    got = checked(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got) == sorted(brute_manifest(rows))


def test_manifest_of_no_rows(spark, odd_docs):
    assert checked(odd_docs.where("false")).count() == 0
