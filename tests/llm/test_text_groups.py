"""Near duplicates, decontamination, secrets, token files, packing and the pipeline against brute force and odd inputs."""

import random
import re
import sys
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF
from plotspark.llm import decontaminate, near_copies, packing, secret_scan, simhash, token_files, tokens, window_plan, workers
from plotspark.llm.components import components
from plotspark.llm.tokens import Encoder, encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [
        (1, "one two three four", "en", "a", 18), (1, "one two three four", "en", "a", 18), (None, "one two three four", None, None, None), (2, None, "en", None, None),
        (3, "", "de", "b", 0), (4, " \t\n\r ", None, "b", 5), (5, "1234 -- 5678", "fr", "c", 12), (6, "long words here " * 20_000, "en", "c", 320_000), (None, None, None, None, None),
        (2**62 + 1, "big", None, None, 3),
    ]
    return spark.createDataFrame(rows, DOC).withColumns({n: F.lit(7) for n in ("fp", "rid", "bin", "words", "found", "length", "start", "ids", "root", "at", "label", "tie")})


# near duplicates

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_near_duplicates_equal_brute_force(documents):
    rows = documents.select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    groups = brute_components(sorted(set(prints.values())), 2)
    lowest = defaultdict(lambda: 1 << 62)
    for d, p in prints.items():
        lowest[groups[p]] = min(lowest[groups[p]], d)
    got = simhash.near_duplicates(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        assert int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == lowest[groups[prints[r.doc_id]]]


@pytest.mark.parametrize(("bits", "key_rows"), [(1, 256), (2, 256), (2, 1), (3, 2)])
def test_no_link_is_lost(spark, bits, key_rows):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        for _ in range(40):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    got = {frozenset((r.a, r.b)) for r in simhash.links(df, bits, key_rows).collect()}
    want = {frozenset((signed(a), signed(b))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= bits}
    assert got == want


def test_the_index_is_never_broadcast(spark):
    found = simhash.links(spark.range(300).select(F.xxhash64("id").alias("fp")))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin[^\n]*piece", plan) and not re.search(r"BroadcastHashJoin[^\n]*piece", plan)


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{k: 100 for k in range(101, 160)}, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_of_odd_rows(odd_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == 10
    by = defaultdict(list)
    for r in got:
        by[r.fingerprint].append(r)
    assert {(r.doc_id, r.component_id) for r in by["0" * 16]} == {(2, 2), (3, 2), (4, 2), (None, 2)}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 5, 6, 2**62 + 1])
    assert simhash.keep_one(odd_docs.limit(0)).count() == 0 and simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_at_every_edit_level(spark, documents):
    rng = random.Random(3)
    bases = [r.text.split() for r in documents.where("n_chars between 1500 and 4500").orderBy("doc_id").collect()]
    rows, texts = [], []
    for k, words in enumerate(bases):
        for edits in (0, 1, 2, 3, 5, 8, 12, 20):
            copy = list(words)
            for at in rng.sample(range(len(words)), edits):
                copy[at] = f"new{rng.randrange(10**6)}"
            texts.append((k, " ".join(copy)))
    rows = [(i, text, "en", "x", len(text)) for i, (_, text) in enumerate(texts)]
    sets = [shingle_set(text) for _, text in texts]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    want = {i for i in range(len(rows)) if find(i) == i}
    got = {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, DOC)).collect()}
    assert len(want) < len(rows) / 2 and want <= got and len(got - want) <= 0.01 * (len(rows) - len(want))
    staged = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOC), SF)
    assert {r.doc_id for r in staged.collect()} == got


def test_near_copies_ask_the_fingerprints(spark):
    """Contents whose SimHash fingerprints are equal or two bits apart are candidates, whatever their bands."""
    contents = spark.createDataFrame([(1, 5), (2, 5), (3, 5 ^ 1 << 40 ^ 1 << 3), (4, 5 ^ 0b111 << 20)], "fp bigint, print bigint")
    assert {(r.a, r.b) for r in near_copies.print_pairs(contents).collect()} == {(1, 2), (1, 3)}
    text = " ".join(f"w{i % 97}" for i in range(300))
    digest, fingerprint, bands = near_copies.sketch_of(text)
    assert fingerprint == simhash.fingerprint_of(text, near_copies.SHINGLE_WORDS) and len(bands) == near_copies.BANDS


def test_near_copies_of_odd_rows_and_crowds(spark, odd_docs):
    kept = near_copies.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and near_copies.keep_one(odd_docs.limit(0)).count() == 0
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 5, 6, 2**62 + 1])
    # A chain in one large group: each text is near the next one only.
    words = [f"w{i}" for i in range(700)]
    chain = [(i, " ".join(words[4 * i : 4 * i + 100]), "en", "x", 0) for i in range(150)]
    crowd = [(1000 + i, " ".join([*words[:100], f"end{i}"]).upper(), "en", "x", 0) for i in range(200)]
    assert [r.doc_id for r in near_copies.keep_one(spark.createDataFrame([*chain, *crowd], DOC)).collect()] == [0]


def test_no_link_of_a_crowded_key_is_lost(spark, monkeypatch):
    """Texts under one key, each with its own nearest text somewhere in the crowd, in groups of two and one large group; several blocks of several sizes."""
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 40)
    rng = random.Random(5)
    texts = []
    for k in range(150):
        words = [f"k{k}w{i}" for i in range(60 + k)]
        texts += [" ".join(words), " ".join([*words[:-3], f"end{k}"])]
    texts += [" ".join([*(f"base{i}" for i in range(80)), f"last{k}"]) for k in range(90)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, __words string")
    contents = spark.createDataFrame([(i, 1000 + i * 2654435761, [7], (i,)) for i in range(len(texts))], "fp bigint, print bigint, bands array<bigint>, first struct<id: bigint>")
    got = {r.fp: r.root for r in near_copies.groups(contents, docs, ["id"], 0.8, 5).collect()}
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert got == dict(enumerate(root)) and len(set(root)) == 151


def test_no_link_of_equal_or_linked_fingerprints_is_lost(spark):
    """The second and third contents of fingerprints are near each other, and the smallest ones are near none."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(f"x{i}" for i in range(100)), " ".join(words), " ".join([*words, "end"]), " ".join(f"y{i}" for i in range(100)), " ".join(["begin", *words])]
    prints = [5, 5, 5, 4, 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, __words string")
    contents = spark.createDataFrame([(i, p, [i], (i,)) for i, p in enumerate(prints)], "fp bigint, print bigint, bands array<bigint>, first struct<id: bigint>")
    got = {r.fp: r.root for r in near_copies.groups(contents, docs, ["id"], 0.8, 5).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 1}


# decontamination

def least_edits(item, words):
    last = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(words, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return min(last)


def test_decontamination_equals_brute_force(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    cut = {r.item_id: decontaminate.words_of(r.text) for r in items.collect()}
    docs = [(r.doc_id, r.text) for r in documents.where("n_chars < 2500").collect()]
    rng, vocabulary = random.Random(8), [w.decode() for w in decontaminate.words_of(docs[0][1])]
    for k, (item, words) in enumerate(sorted(cut.items())):  # items with edits up to just beyond the limit
        words = [w.decode() for w in words]
        for _ in range(k % (decontaminate.most_edits(len(words)) + 3)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
        docs.append((10_000 + item, " ".join([*vocabulary[:20], *words, *vocabulary[20:40]])))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    want = {}
    for d, text in docs:
        words = decontaminate.words_of(text)
        for i, item in cut.items():
            if len(set(item) & set(words)) >= 0.5 * len(set(item)) and (n := least_edits(item, words)) <= decontaminate.most_edits(len(item)):
                want[(d, i)] = n
    assert got.keys() <= want.keys() and len(got) >= 0.95 * len(want)
    assert all(got[k] == 0 for k, n in want.items() if n == 0) and sum(got[k] == want[k] for k in got) >= 0.95 * len(got)


def test_decontamination_of_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "Two, THREE four"), (2, None), (3, ""), (4, "two three four"), (5, "big"), (None, "five six seven eight nine ten")], "item_id bigint, text string")
    got = Counter((r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(odd_docs, items).collect())
    assert got == Counter({(1, 1, 0): 2, (1, 4, 0): 2, (None, 1, 0): 1, (None, 4, 0): 1, (2**62 + 1, 5, 0): 1})
    left = decontaminate.without_benchmark(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == 6
    assert decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0 and decontaminate.without_benchmark(odd_docs.limit(0), items).count() == 0


def test_items_in_blocks_and_neighbouring_documents(spark):
    items = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} delta{k} eps{k}") for k in range(30)], "item_id bigint, text string")
    blocks = list(decontaminate.item_blocks(items, block_bytes=200))
    assert len(blocks) > 1 and sorted(i for ids, _ in blocks for i in ids) == list(range(30))
    matcher = decontaminate.Matcher(*next(iter(decontaminate.item_blocks(items))))
    found = matcher.find(["nothing here", "alpha3 beta3 gamma3 delta3 eps3", "x", None, "alpha4 beta4 gamma4 delta4"])
    assert [[x["item_id"] for x in f] for f in found] == [[], [3], [], [], [4]]


def test_items_are_found_in_other_typography_and_scripts(spark):
    item = "don't say it's the end - we'll see what they've got, and that's all there is"
    han = "\u6211\u5011\u5728\u5c71\u4e0a\u770b\u898b\u4e86\u4e00\u500b\u5f88\u5927\u7684\u6e56"
    items = spark.createDataFrame([(1, item), (2, han), (3, "\u00e9t\u00e9 \u00e0 la plage")], "item_id bigint, text string")
    curly = item.replace("'", "\u2019").replace(" - ", "\u2009\u2014\u2009").replace(", ", "\u2026\u00a0").replace("what", "wh\u00adat")
    docs = [(1, f"\u201c{curly}\u201d"), (2, "\u4eca\u5929" + han + "\u3002\u660e\u5929"), (3, "\u4eca\u5929" + han[:5] + "\u6c34" + han[6:] + "\u660e"), (4, "l\u2019\u00c9T\u00c9\u00a0\u00e0 la\u202fplage!"), (5, "\u660e\u5929\u898b"),
            (6, item.replace("'", ""))]
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert got == {(1, 1): 0, (2, 2): 0, (3, 2): 1, (4, 3): 0}
    assert decontaminate.words_of("a\u0301b \u0928\u092e\u0938\u094d\u0924\u0947 x_y 3\u00d74") == ["a\u0301b".encode(), "\u0928\u092e\u0938\u094d\u0924\u0947".encode(), b"x", b"y", b"3", b"4"]


def test_items_are_found_at_low_similarity_and_without_repetitions(monkeypatch):
    rng = random.Random(21)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("qrstuvwxyz")
    items = [[word() for _ in range(n)] for n in (2, 5, 9, 9, 16, 16, 24)]
    for most, similarities in ((decontaminate.MOST_REPETITIONS, (0.5,)), (4, (0.8, 0.6, 0.5, 0.4, 0.3))):
        monkeypatch.setattr(decontaminate, "MOST_REPETITIONS", most)
        for similarity in similarities:
            texts = []
            for k in range(28):
                planted = list(items[k % 7])
                for _ in range(rng.randrange(decontaminate.most_edits(len(planted), similarity) + 2)):
                    planted[rng.randrange(len(planted))] = "changed"
                texts.append([*(word() for _ in range(rng.randrange(4))), *planted, *(word() for _ in range(rng.randrange(20)))])
            matcher = decontaminate.Matcher(list(range(7)), [" ".join(i) for i in items], similarity=similarity)
            found = matcher.find([" ".join(t) for t in texts])
            got = {(k, f["item_id"]): f["distance"] for k, own in enumerate(found) for f in own}
            want = {(k, i): n for k, t in enumerate(texts) for i, item in enumerate(items) if (n := least_edits(item, t)) <= decontaminate.most_edits(len(item), similarity)}
            assert all(want.get(k) is not None for k in got) and len(want) > 10
            exact = {i for n in matcher.lengths if n.walks is None or not n.edits for i in n.rows.tolist()}
            assert {k: n for k, n in want.items() if k[1] in exact} == {k: n for k, n in got.items() if k[1] in exact}
            assert len(got) >= 0.9 * len(want) and (most > 4 or similarity > 0.6 or len(exact) >= 5)
    with pytest.raises(ValueError):
        decontaminate.Matcher([1], ["a b"], similarity=0.0)


# secrets

def test_secrets_are_found_and_cut(spark):
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, planted = [], {}
    for i in range(120):
        secret = hexes(rng.choice([18, 32, 40]))
        lead = ['token = "', "password=", "api_key: '"][i % 3]
        rows.append((i, f"word here {lead}{secret}\" and mail a.b{i}@mail{i}.example.com or 4{rng.randrange(10**14):015d} or 10.20.30.{i} end", "en", None, 0))
        planted[i] = secret
    df = spark.createDataFrame([*rows, rows[0], (None, None, None, None, None), (900, "", None, None, 0)], DOC)
    found = secret_scan.scan_and_classify(df, carry=("doc_id",)).collect()
    right = {(r.doc_id, r.candidate) for r in found if r.is_secret}
    assert right == set(planted.items()) and sum(r.is_secret for r in found) == 121
    cut = {r.doc_id: r for r in secret_scan.redact(df).collect()}
    assert all(planted[i] not in cut[i].text and "[SECRET]" in cut[i].text and f"b{i}@mail" in cut[i].text and cut[i].n_chars == len(cut[i].text) for i in planted)
    assert secret_scan.redact(df).count() == df.count()


def test_secrets_of_odd_rows(odd_docs):
    assert secret_scan.redact(odd_docs).columns == odd_docs.columns
    assert Counter(map(str, secret_scan.redact(odd_docs).collect())) == Counter(map(str, odd_docs.collect()))
    assert secret_scan.scan_and_classify(odd_docs.limit(0)).count() == 0


def test_neighbours_alone_do_not_decide(spark):
    found = secret_scan.describe('x token = "0123abcd9876ef54" y', 11, 27)
    assert found["hinted"] == found["named"] == found["quoted"] == 1.0 and found["kind"] == "token"
    assert secret_scan.describe("mail a.b1@mail.example.com", 5, 26)["kind"] == "mail"


def test_secrets_of_every_kind(spark):
    rng = random.Random(11)
    letters, base = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    draw = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    rows, planted = [], []
    for i in range(60):
        plain = f"mail me at a{i}.b@mail{i}.example.com or read /usr/share/documentation{i}/pages and see 10.20.30.{i}, author: John Smith, plain words here"
        short, signs, free, keyed = draw(letters[:26], 6) + draw("0123456789", 2), draw(letters, 4) + "&%" + draw(base, 5), draw(letters, 26), draw(base, 18) + "/" + draw(base, 21)
        bare = draw(base, 15) + "/" + draw(base, 24)
        free_bare = draw(letters, 40)
        for text, secret in ((f"password: {short}", short), (f'password = "{signs}"', signs), (f'token = "{free}"', free), (f'{{"aws_secret_access_key": "{keyed}"}}', keyed),
                             (f"the key {bare} was sent", bare), (f"the key {free_bare} was sent", free_bare)):
            planted.append((len(rows), secret))
            rows.append((len(rows), f"{plain} {text} {plain}", "en", None, 0))
    df = spark.createDataFrame(rows, DOC)
    scanned = secret_scan.scan(df, carry=("doc_id",))
    labels = {(r.doc_id, r.candidate): r.label for r in secret_scan.rule_labels(scanned).collect()}
    assert set(planted) <= set(labels) and not any(labels[p] == 0 for p in planted)
    assert {labels[p] for k, p in enumerate(planted) if k % 6 < 4} == {1.0} and {labels[p] for k, p in enumerate(planted) if k % 6 == 4} == {None}
    cut = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    missed = Counter(k % 6 for k, (d, secret) in enumerate(planted) if secret in cut[d])
    assert not any(missed[kind] for kind in range(4)) and missed[4] <= 3 and missed[5] <= 3
    assert all("@mail" in t and "/usr/share/documentation" in t and "author: John Smith" in t for t in cut.values())
    spans = lambda t: [t[a:b] for a, b in secret_scan.spans(t)]
    assert spans("Authorization: Bearer ab.cd, then api-key => 'x y'; pwd=\"a\\\"b\"") == ["ab.cd", "x y", 'a\\"b']
    assert spans("author = Smith, Geschichtsschreibungen and some_snake_case_identifier") == []


def test_rare_words_after_telling_names_stay(spark):
    rng = random.Random(12)
    draw = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    names = ["Winterberg", "marguerite", "Esperanza", "Oberammergau", "quixotic", "chrysalide", "Guadalajara", "elderberry"]
    rows = [(i, f"The secret: {name} was a token: {name[::-1]} of love", "en", None, 0) for i, name in enumerate(names)]
    rows += [(100 + i, f'password = "{draw(20)}" and 10.1.2.{i} or a{i}@mail{i}.example.com', "en", None, 0) for i in range(60)]
    cut = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame(rows, DOC)).collect()}
    assert all(f"secret: {name} " in cut[i] for i, name in enumerate(names)) and all("[SECRET]" in cut[100 + i] for i in range(60))
    assert secret_scan.describe("at 10.20.30.40 now", 3, 14)["kind"] == "address"


def test_dictionary_counts_words_once(spark):
    docs = spark.createDataFrame([("the cat the dog",), ("the cat, the cat!",), (None,)], "text string")
    found = spark.createDataFrame([(["the", "cat"],), (["the", "dog"],)], "runs array<string>")
    assert sorted(r.word for r in secret_scan.dictionary(docs, found).collect()) == ["cat", "the"]


# token files

def test_ids_equal_the_whole_texts_ids():
    odd = ["", "  a  b", "a\tb c", "x\n\ny", " lead", "trail ", "trail\n", "\nlead", "don't. it's, we'll", "1,234.5 foo. bar,", "É é. Été, ça", "a\u0301b c", "𝔘𝔫𝔦 ǅ. é", "!!. ,, .a ,b", "<|endoftext|> x", "a \n b", "ΣΑΣ. σ",
           "x\x1cy \x1f. z", "İstanbul. I", "½ ⅓. ٣, x٣.", "a\x00b c", "tab\there. ok", "0 1 a0b", "a.\nb,\nc. d", "THAT!! de%%% x_y _a a_. l'été it's' 's'", "ŉa Ǆ ẞ ﬁ", "a’b “x” …"]
    for path in (BYTES, WORDS):
        own, tokenizer = Encoder(path), Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for text, ids in zip([*odd, *odd], own.encode([*odd, *odd]), strict=True):
            assert np.frombuffer(ids, own.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
        assert own.direct


def test_ids_of_words_that_end_in_combining_marks():
    texts = ["cafe\u0301 noir", "cafe\u0301", "cafe\u0301, noir", "un cafe\u0301. e\u0301te\u0301", "q\u0303 n\u0303 a\u0327\u0301!", "a\u0338 o\u0308\u0304 x"]
    for path in (BYTES, WORDS):
        own, tokenizer = Encoder(path), Tokenizer.from_file(path)
        for text, ids in zip([*texts, *texts], own.encode([*texts, *texts]), strict=True):
            assert np.frombuffer(ids, own.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_token_tables_are_let_go():
    own = encoder(WORDS)
    assert encoder(WORDS) is own
    want, gone = own.encode(["a word or two"]), weakref.ref(own)
    workers.kept("other", "x", str)
    del own
    tokens.forget()
    assert gone() is None and "other x" in sys.modules["plotspark_worker"].__dict__
    assert encoder(WORDS).encode(["a word or two"]) == want


def test_a_full_generation_takes_no_double_room():
    table = {}
    for i in range(tokens.PIECES_KEPT + 1):
        table[f" {i}"] = b""
    assert sys.getsizeof(table) < 12_000_000


def test_no_worker_holds_token_tables_after_packing(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of"), F.col("id")).alias("text")).repartition(64)
    assert packing.pack(docs, WORDS, 2).agg(F.sum("length")).first()[0] > 0
    docs.select(near_copies.sketch(F.col("text")).alias("sketch")).write.format("noop").mode("overwrite").save()

    def held(batches):
        for _ in batches:
            names = vars(sys.modules["plotspark_worker"]) if "plotspark_worker" in sys.modules else {}
            yield pa.RecordBatch.from_pydict({"n": [sum(k.startswith("tokens ") for k in names)]})

    assert [r.n for r in docs.select("doc_id").mapInArrow(held, "n bigint").distinct().collect()] == [0]


def test_ids_of_texts_with_special_tokens(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y <|endoftext|>\n\nz", "a <|ENDOFTEXT|> b <| endoftext |>", "caf\u00e9 <|endoftext|>.", "plain words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for path in (BYTES, WORDS):
        own, tokenizer = encoder(path), Tokenizer.from_file(path)
        for text, ids in zip([*texts, *texts], own.encode([*texts, *texts]), strict=True):
            assert np.frombuffer(ids, own.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    sizes = lambda path: {i: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in token_files.token_file_rows(docs, BYTES).collect()} == sizes(BYTES)
    assert {r.doc_id: r.doc_tokens for r in packing.pack(docs, WORDS, 2).collect()} == sizes(WORDS)


@pytest.mark.parametrize("count", [0, 1, 63, 64, 65, 1000])
def test_elias_fano_selects_every_document(count):
    rng = np.random.default_rng(count)
    docs = [rng.integers(0, 60_000, size=int(rng.integers(0, 300)) * (k % 5 > 0)).astype("<u2").tobytes() for k in range(count)]
    content = token_files.write_file(docs, 2)
    file = token_files.TokenFile(content)
    assert [file.document(i).tobytes() for i in range(count)] == docs
    assert file.ends.all().tolist() == np.cumsum([len(d) // 2 for d in docs]).tolist()
    index = len(content) - sum(map(len, docs)) - 40
    assert index <= count * (2 + max(0, np.log2(max(1, file.n_ids) / max(1, count))) + 1) / 8 + 4 * (count / 64 + 1) + 2


def test_token_files_round_trip(documents, odd_docs):
    tokenizer = Tokenizer.from_file(BYTES)
    for docs in (documents, odd_docs):
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        want = Counter()
        for r in rows:
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
            want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        got = sorted(token_files.token_file_rows(docs, BYTES).collect(), key=lambda r: r.start)
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        assert [r.doc_id for r in got] == [r.doc_id for r in rows]
        assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert token_files.token_file_rows(odd_docs.limit(0), BYTES).count() == 0


# packing

def check_pieces(rows, ids, window=4096):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0 and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        docs[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for group, total in ((docs, lambda k: len(ids[k])), (sequences, lambda k: None)):
        for key, parts in group.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == total(key) if total(key) is not None else at <= window
    return 1 - sum(map(len, ids.values())) / (window * len(sequences))


def test_packing_of_documents(spark, documents):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in documents.collect()}
    assert check_pieces(packing.pack(documents, WORDS, 2).collect(), ids) < 0.02


def test_packing_of_odd_rows(spark, odd_docs):
    rows = packing.pack(odd_docs, WORDS, 2).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in odd_docs.select("doc_id", "text").collect())
    got = Counter()
    for r in rows:
        got[(r.doc_id, r.doc_tokens)] += r.length
    assert got == Counter({k: k[1] * n for k, n in want.items()})
    assert packing.pack(odd_docs.limit(0), WORDS, 2).count() == 0


def test_sequences_hold_their_pieces_ids(spark, tmp_path, documents):
    path = str(tmp_path / "tokens")
    packing.write_tokens(documents.limit(60), path, WORDS, 2, window=256)
    tokens = spark.read.parquet(path)
    pieces = packing.pieces_of(tokens, window=256, unit=8)
    whole = {r.rid: np.frombuffer(r.ids, "<u2") for r in tokens.collect()}
    got = {r.sequence_id: np.frombuffer(r.ids, "<u2") for r in packing.sequences_of(pieces, tokens).collect()}
    for r in pieces.collect():
        assert (got[r.sequence_id][r.offset : r.offset + r.length] == whole[r.rid][r.start : r.start + r.length]).all()


def test_plan_uses_no_more_than_there_is():
    rng = np.random.default_rng(2)
    every = packing.combinations(64, 3)
    solvable = Counter()  # a histogram that combinations use up whole
    for k in rng.choice(len(every), size=60, replace=False):
        count = int(rng.integers(100, 2000))
        for x in every[k]:
            solvable[x] += count
    uneven = {k: int(n) for k, n in enumerate(50_000 / np.arange(1, 65) + rng.integers(0, 300, 64), 1)}
    for histogram in ({}, {64: 3}, {40: 100_000}, {40: 100_000, 24: 30_000, 12: 90_000}, uneven, dict(solvable)):
        plan = packing.plan(histogram, 64)
        used = Counter()
        for part, count in zip(plan.parts, plan.counts, strict=True):
            assert sum(part) == 64 and len(part) <= 3 and count > 0
            for x in part:
                used[x] += count
        assert all(used[k] <= histogram.get(k, 0) for k in used)
        left = Counter(histogram) - used
        assert not any(all(left[x] >= part.count(x) for x in part) for part in every)  # nothing that fits is left
    assert sum(k * n for k, n in used.items()) >= 0.95 * sum(k * n for k, n in solvable.items())
    assert set(packing.combinations(6, 3)) == {(6,), (5, 1), (4, 2), (3, 3), (4, 1, 1), (3, 2, 1), (2, 2, 2)}


def test_one_length_holds_most_rows(spark):
    docs = spark.createDataFrame([(i, "word " * (2499 if i % 3 else i)) for i in range(90)], "doc_id bigint, text string")
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    assert check_pieces(packing.pack(docs, WORDS, 2).collect(), ids) < 0.05


def _checked_layout(histogram, window=4096, units=512):
    """The layout, after a look at every rank and every sequence of it."""
    found = window_plan.layout(histogram, window, units)
    filled, last = Counter(), {}
    for length, first, end, sequence, place in found.rows.tolist():
        assert last.get(length, 0) <= first < end <= histogram[length]
        last[length] = end
        for k in range(sequence, sequence + end - first):
            filled[k] += length
    assert sorted(filled) == list(range(found.sequences)) and all(n <= window for n in filled.values())
    taken = sum(r[2] - r[1] for r in found.rows.tolist())
    assert found.by_squares + found.by_best_fit == taken == sum(histogram.values()) - found.left_over
    return found, (1 - sum(filled.values()) / (window * found.sequences) if filled else 0.0)


def test_layouts_of_odd_histograms():
    rng = np.random.default_rng(4)
    for histogram in ({}, {1: 1}, {4095: 7}, {1: 100_000}, {2048: 5}, {3000: 10, 1096: 4}, {2500: 900, 3: 1}, {int(k): int(n) for k, n in zip(rng.integers(1, 4096, 300), rng.integers(1, 40, 300), strict=True)}):
        found, padding = _checked_layout(histogram)
        assert padding <= 0.01
    assert _checked_layout({4095: 7})[0].left_over == 0 and _checked_layout({2500: 900})[0].left_over == 900
    assert _checked_layout({7: 40, 9: 3, 40: 11}, 64, 16)[0].sequences > 0


def test_least_squares_take_nearly_all_documents(documents):
    tokenizer = Tokenizer.from_file(WORDS)
    sizes = Counter((len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) % 4096 for r in documents.collect())
    del sizes[0]
    shares = []
    for times in (1, 30):
        found, padding = _checked_layout({k: n * times for k, n in sizes.items()})
        shares.append(found.by_squares / (times * sum(sizes.values())))
        assert padding < 0.005
    assert min(shares) > 0.9


def test_left_over_rests_are_cut(spark):
    docs = spark.createDataFrame([(i, "word " * 2499) for i in range(40)], "doc_id bigint, text string")
    rows = packing.pack(docs, WORDS, 2).collect()
    assert sum(r.length for r in rows) == 40 * rows[0].doc_tokens and len(rows) > 40
    assert len({r.sequence_id for r in rows}) == -(-40 * rows[0].doc_tokens // 4096)


# pipeline

def test_pipeline_stages(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()
    clean = documents.where("n_chars between 1500 and 4000").orderBy("doc_id").collect()
    long = " ".join(r.text for r in clean[:2])
    planted = [(50_000, long, "en"), (50_001, long, "en"), (50_002, long + " again", "en"), (50_003, clean[3].text + " " + items[0].text + " " + clean[4].text, "en"), (50_004, "spam spam spam " * 200, "en"),
               (50_005, clean[5].text + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + clean[6].text, "en"), (None, None, None)]
    docs = documents.unionAll(spark.createDataFrame([(d, t, lang, "x", len(t or "")) for d, t, lang in planted], DOC)).withColumn("extra", F.lit("e"))
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = []
    for stage in stages[:4]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == [*documents.columns, "extra"]
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert 50_004 not in kept[0] and None not in kept[0] and {50_000, 50_001, 50_002, 50_003, 50_005} <= set(kept[0])
    assert 50_000 in kept[1] and 50_001 not in kept[1] and len(kept[1]) < len(kept[0])
    assert 50_003 in kept[1] and 50_003 not in kept[2] and 50_005 in kept[2]
    assert set(kept[3]) == set(kept[2]) and "[SECRET]" in kept[3][50_005] and "04dbebab" not in kept[3][50_005]
    pieces = stages[4](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(kept[3])
    assert all(stage(spark, docs.limit(0), SF).count() == 0 for stage in stages)
