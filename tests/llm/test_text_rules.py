"""Language, quality, sharding, preferences and URL operators against brute force, their SQL and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from plotspark.llm import language_id, link_trust, preferences, quality, sharding

TABLES = "documents embeddings pages benchmark labels conversations".split()
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and extra columns with names the operators use."""
    rows = [
        (1, "one two three four", "en", "a", 18), (1, "one two three four", "en", "a", 18), (None, "one two three four", None, None, None), (2, None, "en", None, None),
        (3, "", "de", "b", 0), (4, " \t\n\r ", None, "b", 5), (5, "1234 -- 5678", "fr", "c", 12), (6, "long words here " * 20_000, "en", "c", 320_000), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({n: F.lit(7) for n in ("fp", "rid", "bin", "words", "kept", "shard", "slot", "score", "place", "root", "at", "label")})


def same_as_sql(spark, name, sf=SF):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = entry.queries()[name](spark, sf)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    got = Counter(tuple(tidy(r[c]) for c in names) for r in df.collect())
    assert got == Counter(tuple(map(tidy, r)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", ["op2_distribution_divergence", "op3_jump_shards", "op4_preference_pairs", "op6_link_trust", "op12_spelling_variants", "op13_merkle_manifest"])
def test_query_equals_its_sql(spark, name):
    same_as_sql(spark, name)


def test_all_queries_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


# language

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.train(docs.where("not held_out"))
    found = language_id.identify(docs.where("held_out"), model).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    right = [r.lang == r.lang_pred for r in found]
    assert sum(right) / len(right) >= 0.95
    sure = [r.lang == r.lang_pred for r in found if not r.rejected]
    assert sum(sure) / len(sure) >= sum(right) / len(right)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_texts(spark, odd_docs):
    model = language_id.LanguageModel(["aa", "bb"], [b"the one and the other of them", b"le un et un autre de la"])
    found = {(r.doc_id, r.text): r for r in language_id.identify(odd_docs, model).collect()}
    assert found[(2, None)].lang_pred == found[(3, "")].lang_pred == found[(5, "1234 -- 5678")].lang_pred == "und"
    assert found[(2, None)].score == 0 and found[(6, "long words here " * 20_000)].lang_pred in ("aa", "bb")
    tie = language_id.identify(odd_docs, language_id.LanguageModel(["aa", "bb"], [b"same", b"same"])).where("doc_id = 1").first()
    assert (tie.lang_pred, tie.score, tie.rejected) == ("aa", 0.0, True)
    alone = language_id.identify(odd_docs, language_id.LanguageModel(["aa"], [b"same"])).where("doc_id = 1").first()
    assert (alone.lang_pred, alone.score, alone.rejected) == ("aa", 1.0, False)
    nothing = language_id.train(odd_docs.limit(0))
    assert nothing.languages == [] and {r.lang_pred for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}
    assert language_id.identify(odd_docs.limit(0), model).count() == 0


def test_copies_fill_one_sample(spark):
    rows = [(i, "the very same text", "en", None, None) for i in range(500)] + [(1000 + i, f"text number {i}", "en", None, None) for i in range(20)]
    model = language_id.train(spark.createDataFrame(rows, DOC))
    assert model.dictionaries[0].count(b"the very same text") == 1


# quality

def brute_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)})


def test_repeat_words_by_both_ways(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    half = [str(i) for i in range(400)]
    texts += [" ".join(half + half), " ".join(half)]  # more repeated windows than the short way takes
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", quality._let(quality.words_of(F.col("text")), quality.repeat_words).alias("n"))
    for r in df.collect():
        assert r.n == brute_repeats(r.text.split()), r.text[:80]


def test_quality_of_odd_rows(spark, odd_docs):
    judged = quality.judge(odd_docs)
    assert judged.count() == odd_docs.count() and set(odd_docs.columns) <= set(judged.columns)
    for r in judged.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_repeat_words == brute_repeats(words) and r.n_dup_lines == 0
        assert r.base_failed and r.kept is False
    kept = quality.keep(odd_docs, quality.QualityRules(min_words=4, max_repeat_percent=100))
    assert kept.columns == odd_docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, None, 6])
    assert all(r.kept == 7 and r.words == 7 for r in kept.collect())
    assert quality.judge(odd_docs.limit(0)).count() == 0


def test_quality_follows_the_labels(spark):
    sf = SF.replace("0.001", "0.01")
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    good = judged.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = judged.where("quality = 0 and n_words >= 100").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good == 1 and bad <= 0.1


def test_rows_without_a_language_are_judged_by_the_nearest(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id", "left")
    chosen = (F.col("quality") == 1) & (F.length("text") > 700)
    judged = quality.judge(docs.withColumns({"true_lang": F.col("lang"), "lang": F.when(~F.coalesce(chosen, F.lit(False)), F.col("lang"))}))
    kept = {r.true_lang: (r.n, r.k) for r in judged.where("lang is null and not base_failed").groupBy("true_lang").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()}
    assert len(kept) == 4 and all(n == k > 0 for n, k in kept.values())
    alone = quality.judge(docs.where("doc_id < 40").withColumn("lang", F.lit(None).cast("string")))
    assert alone.where("word_distance is not null or class_distance is not null").count() == 0


def test_copies_do_not_bend_the_reference(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    copied = docs.where("lang = 'en'").orderBy(F.desc(F.length("text"))).limit(1).select(F.explode(F.sequence(F.lit(10_000).cast("bigint"), F.lit(10_400).cast("bigint"))).alias("doc_id"), "text", "lang")
    before = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    after = {r.doc_id: r.kept for r in quality.judge(docs.unionAll(copied)).collect()}
    assert sum(before[k] != after[k] for k in before) <= 2


def test_js_distance(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.9, 0.1], [0.4, 0.6])]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<double>, q array<double>").select(quality.js_distance(F.col("p"), F.col("q"))).collect()]
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0
    assert got == pytest.approx([math.sqrt(sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True)) / 2) for p, q in rows])


# sharding

def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 24, 1000])
def test_jump_hash_equals_the_published_loop(spark, shards):
    rows = spark.range(200).select("id", sharding.jump_hash(F.col("id"), shards).alias("s")).collect()
    assert all(r.s == jump(int(hashlib.md5(str(r.id).encode()).hexdigest()[:16], 16), shards) for r in rows)


def test_shards_of_documents(spark, odd_docs):
    many = odd_docs.select("doc_id", "text").unionAll(odd_docs.where("doc_id = 2").select("doc_id", "text").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9000)))).drop("k"))
    rows = sharding.shard_documents(many, 24, buckets=16).collect()
    assert len(rows) == many.count()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.shard == jump(int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16), 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in many.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert sharding.shard_documents(many.limit(0)).count() == 0


# preferences

TURN = "pair_id bigint, turn bigint, role string, text string"


def test_prompt_is_the_longest_common_start(spark):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"), (2, 0, "user", "same"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    rejected = [(1, 5, "user", "hi"), (1, 6, "assistant", "hello"), (1, 9, "user", "more"), (1, 10, "assistant", "no"), (1, 11, "user", "why"), (2, 0, "user", "same"), (3, 0, "user", "a"), (None, 0, "user", "lost")]
    rows = preferences.segments(spark.createDataFrame(chosen, TURN), spark.createDataFrame(rejected, TURN), places_per_block=2).collect()
    parts = {}
    for r in sorted(rows, key=lambda r: (r.pair_id, r.part, r.place)):
        parts.setdefault((r.pair_id, r.part), []).append(r)
    text = lambda k: "".join(r.rendered for r in parts.get(k, []))
    assert text((1, "prompt")) == "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nmore\n"
    assert text((1, "chosen")) == "<|assistant|>\nyes\n" and text((1, "rejected")) == "<|assistant|>\nno\n<|user|>\nwhy\n"
    assert [r.loss for r in parts[(1, "rejected")]] == [True, False] and not any(r.loss for r in parts[(1, "prompt")])
    assert (2, "chosen") not in parts and text((2, "prompt")) == "<|user|>\nsame\n"
    assert text((3, "prompt")) == "<|user|>\na\n" and text((3, "chosen")) == "<|user|>\na\n" and (3, "rejected") not in parts
    for rows_of in parts.values():
        at = 0
        for r in rows_of:
            assert r.offset == at
            at += len(r.rendered)


def test_preferences_of_odd_conversations(spark):
    rows = [(None, 0, "user", "x"), (4, None, None, None), (4, 1, "assistant", None), (5, 1, "assistant", "other"), (6, 0, "user", "no reply"), (4, 1, "assistant", None)]
    conversations = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"part": F.lit(1), "place": F.lit(2), "side": F.lit(3)})
    got = Counter((r.pair_id, r.part, r.rendered) for r in preferences.segments(*preferences.reply_pairs(conversations)).collect())
    assert got[(4, "prompt", "<||>\n\n")] == 1 and got[(4, "chosen", "<|assistant|>\n\n")] == 2 and got[(4, "rejected", "<|assistant|>\nother\n")] == 2
    assert got[(5, "rejected", "<|assistant|>\n\n")] == 1 and got[(6, "prompt", "<|user|>\nno reply\n")] == 1
    assert preferences.segments(*preferences.reply_pairs(conversations.limit(0))).count() == 0


# links

RULES = [link_trust.Rule("allow", "org"), link_trust.Rule("block", "example.org", "/es/"), link_trust.Rule("block", "example.org", "/en/1"), link_trust.Rule("allow", "good.com", "/")]


def test_hosts_paths_and_rules(spark):
    urls = ["https://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://badexample.org/es/2", "http://x.net?q=/a", "no scheme", None, "a://b://c/d", "http://ORG", "http://Ä.org/#/es/", ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    text, verdict = link_trust.rule_of(F.col("host"), F.col("path"), RULES)
    rows = df.withColumns({"host": link_trust.host_of(F.col("url")), "path": link_trust.path_of(F.col("url"))}).select("page_id", "host", "path", text, verdict).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("badexample.org", "/es/2", "org/", "allow"), ("x.net", "", None, None),
        ("", "", None, None), ("", "", None, None), ("b:", "//c/d", None, None), ("org", "", None, None), ("Ä.org", "/", "org/", "allow"), ("", "", None, None),
    ]


def test_trust_reaches_hosts_at_any_distance(spark):
    far = 60
    link = lambda host: f'<a href="http://{host}/">x</a>'
    rows = [(0, "http://bad.com/x", None), *[(k, f"http://h{k}.net/", link("bad.com" if k == 1 else f"h{k - 1}.net")) for k in range(1, far + 1)], (100, "http://nobody.net/", "")]
    rules = [link_trust.Rule("block", "bad.com")]
    got = {r.page_id: (r.verdict, r.trust_share) for r in link_trust.judge_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"), rules).collect()}
    assert all(got[k] == ("block", 0.0) for k in range(1, far + 1)) and got[100] == ("allow", None)


def test_trust_spreads_as_in_the_plain_iteration(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/p">x</a>' for h in hosts) + '<a HREF=/own>y</a>'
    pages = [
        (1, "http://good.com/", link("a.net", "b.net")), (2, "http://a.net/", link("b.net", "b.net")), (3, "http://b.net/", None), (4, "http://c.net/", link("example.org")),
        (5, "http://example.org/es/", link("a.net")), (6, "http://d.net/", link("c.net")), (7, None, None), (8, "http://lone.net/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("rank", F.lit(1))
    settings = link_trust.TrustSettings(rest=1e-6)
    got = {r.page_id: r for r in link_trust.judge_pages(df, RULES, settings).collect()}
    edges = Counter()
    for _, url, html in pages:
        src = url.split("/")[2] if url else ""
        for dst in re.findall(r'href="?(?:http://([^/]*))?', html or "", re.I):
            edges[(src, dst or src)] += 1

    def ranks(arcs, seeds):
        rank = {h: 0.15 * s for h, s in seeds.items()}
        total = Counter()
        for (a, _), n in arcs.items():
            total[a] += n
        for _ in range(settings.rounds):
            new = Counter({h: 0.15 * s for h, s in seeds.items()})
            for (a, b), n in arcs.items():
                new[b] += 0.85 * rank.get(a, 0) * n / total[a]
            rank = new
        return rank

    trust, distrust = ranks(edges, {"good.com": 1.0}), ranks(Counter({(b, a): n for (a, b), n in edges.items()}), {"example.org": 1.0})
    for page, host in ((2, "a.net"), (3, "b.net"), (4, "c.net"), (6, "d.net")):
        share = trust.get(host, 0) / (trust.get(host, 0) + distrust.get(host, 0))
        assert got[page].trust_share == pytest.approx(share, abs=1e-9) and got[page].verdict == ("allow" if share >= 0.5 else "block")
    assert got[4].verdict == got[6].verdict == "block" and got[3].verdict == "allow"
    assert got[8].trust_share is None and got[8].verdict == got[7].verdict == "allow" and got[5].rule == "example.org/es/"
    assert link_trust.judge_pages(df.limit(0), RULES).count() == 0
