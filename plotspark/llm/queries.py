"""Registered queries of the text operators: name -> plan, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plotspark.llm import (
    decontaminate, language_id, link_trust, merkle, packing, piece_ids, preferences, quality, secret_scan, sharding, simhash, spelling, token_files,
)

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _walk_sql(name: str, shards: int) -> str:
    """The jumps of every key below ``shards``, and the last of them."""
    return f"""{name} AS (
  SELECT rid, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT) AS state, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM texts
  UNION ALL
  SELECT rid, next, j, CAST(floor((j + 1) * (2147483648e0 / CAST((next >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT rid, j, CAST((CAST(state AS UHUGEINT) * {sharding.MULTIPLIER} + 1) % 18446744073709551616 AS UBIGINT) AS next FROM {name} WHERE j < {shards})),
{name}_end AS (SELECT rid, CAST(max(b) AS INT) AS shard FROM {name} GROUP BY rid)"""


SHARD_SQL = f"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
entries AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS entry),
sums AS (SELECT rid, doc_id, octet_length(raw) + 8 AS size,
                xor(4294967295, list_reduce(list_transform(string_split(regexp_replace(hex(raw), '(..)', '\\1 ', 'g'), ' ')[:octet_length(raw)], lambda x: CAST('0x' || x AS BIGINT)),
                                            lambda c, x: xor(c >> 8, entry[(xor(c, x) & 255) + 1]), 4294967295)) AS text_crc32
         FROM texts, entries),
{_walk_sql('jumps', 24)},
{_walk_sql('grown', 25)},
placed AS (SELECT s.*, a.shard, b.shard AS grown_shard,
                  CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR), CAST(text_crc32 AS VARCHAR))), 1, 8) AS BIGINT) % 4096 AS bucket
           FROM sums s JOIN jumps_end a USING (rid) JOIN grown_end b USING (rid))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard
FROM placed"""


@query("op3_jump_shards", SHARD_SQL)
def jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by jump consistent hashing of doc_id."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op7_simhash_variants")
def simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id", "component_rows")


_CLASS_SQL = {  # RE2 classes, as the operator's; each count leaves out what an earlier class took
    "lower": r"[^\p{Ll}]", "space": r"[^\x20\x09-\x0D]", "upper": r"[^\p{Lu}]", "digit": r"[^\p{Nd}]", "symbol": r"[^#*$%&|<>]", "punct": r"[^\p{P}]|[#*%&]",
}
_RULES = quality.QualityRules()
_COUNTS = ", ".join(f"length(regexp_replace(t, '{pattern}', '', 'g')) AS {name}" for name, pattern in _CLASS_SQL.items())
_NAMES = [*_CLASS_SQL, "other"]
_JS = "CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END"
_CHARS = " + ".join(_NAMES)
_CLASS_DISTANCE = " + ".join(_JS.format(p=f"(s.{name} / s.chars)", q=f"c.{name}") for name in _NAMES)
QUALITY_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
counted AS (SELECT *, length(t) AS chars, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, {_COUNTS} FROM texts),
sized AS (SELECT *, len(w) AS n, chars - lower - space - upper - digit - symbol - punct AS other, CAST(floor(strlen(t) / {quality.STRATUM_BYTES}) AS INT) % {_RULES.strata} AS stratum FROM counted),
sums AS (SELECT lang, stratum, sum(strlen(t)) AS bytes, {", ".join(f"sum({x}) / sum({_CHARS}) AS {x}" for x in _NAMES)} FROM sized WHERE strlen(t) >= {_RULES.min_reference_bytes} GROUP BY lang, stratum),
classes AS (SELECT lang, {", ".join(f"avg({x}) AS {x}" for x in _NAMES)} FROM sums GROUP BY lang),
tokens AS (SELECT rid, lang, stratum, strlen(t) AS size, unnest(w) AS word, unnest(range(len(w))) AS pos FROM sized),
word_counts AS (SELECT lang, stratum, word, count(*) AS k FROM tokens WHERE size >= {_RULES.min_reference_bytes} GROUP BY ALL),
weights AS (SELECT lang, word, sum(k / bytes) AS weight FROM word_counts JOIN sums USING (lang, stratum) GROUP BY lang, word),
shares AS (SELECT lang, word, round(weight / sum(weight) OVER (PARTITION BY lang), 12) AS share FROM weights),
top AS (SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY lang ORDER BY share DESC, word) <= {_RULES.common_words}),
rests AS (SELECT lang, greatest(1 - sum(share), 0) AS q FROM top GROUP BY lang),
seen AS (SELECT s.rid, s.n, s.lang, top.word, share AS q, coalesce(k, 0) / s.n AS p
         FROM sized s JOIN top USING (lang) LEFT JOIN (SELECT rid, word, count(*) AS k FROM tokens GROUP BY ALL) x ON x.rid = s.rid AND x.word = top.word WHERE s.n >= {_RULES.min_common_words}),
parts AS (SELECT rid, lang, sum({_JS.format(p="p", q="q")}) AS part, greatest(1 - sum(p), 0) AS p FROM seen GROUP BY rid, lang),
word_far AS (SELECT rid, sqrt(greatest((part + {_JS.format(p="p", q="q")}) / 2, 0)) AS word_distance FROM parts JOIN rests USING (lang)),
grams AS (SELECT rid, pos, word || ' ' || lead(word, 1) OVER (PARTITION BY rid ORDER BY pos) || ' ' || lead(word, 2) OVER (PARTITION BY rid ORDER BY pos) AS gram FROM tokens),
again AS (SELECT rid, pos FROM grams WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
repeats AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM texts)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
judged AS (
  SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(s.chars - s.space AS BIGINT) AS word_chars, CAST(s.symbol AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         n < {_RULES.min_words} OR 100 * coalesce(n_repeat_words, 0) > {_RULES.max_repeat_percent} * n AS base_failed,
         CASE WHEN s.chars >= {_RULES.min_class_chars} THEN sqrt(greatest(({_CLASS_DISTANCE}) / 2, 0)) END AS class_distance, word_distance
  FROM sized s LEFT JOIN classes c USING (lang) LEFT JOIN word_far USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN lines USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
       NOT base_failed AND coalesce(class_distance <= {_RULES.max_class_distance}, true) AND coalesce(word_distance <= {_RULES.max_word_distance}, true) AS kept
FROM judged"""


@query("op2_distribution_divergence", QUALITY_SQL)
def distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting rules and distance from the language's distributions for every document."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    distances = [F.round(c, 6).alias(c) for c in ("class_distance", "word_distance")]
    return judged.select("doc_id", *quality.BASE, "base_failed", *distances, "kept")


@query("op8_cgk_decontamination")
def cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_elias_fano_files")
def elias_fano_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token-id files in doc_id order, read back."""
    return token_files.token_file_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query("op10_least_squares_packing")
def least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op1_compression_language")
def compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by per-language dictionaries learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.train(docs.where(~F.col("held_out")))
    found = language_id.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


RULES = [
    link_trust.Rule("allow", "org"), link_trust.Rule("block", "example.org", "/es/"), link_trust.Rule("block", "example.org", "/en/1"),
    link_trust.Rule("allow", "com", "/fr/"), link_trust.Rule("block", "com", "/de/"),
]
_TRUST = link_trust.TrustSettings()
_FITS = [
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{'rule': '{r.text}', 'verdict': '{r.verdict}'}}"
    for r in sorted(RULES, key=lambda r: -len(r.text))
]
_ROUNDS = "".join(
    f"""r{k} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT kind, host, share * {1 - _TRUST.damping!r} AS rank FROM seeds
  UNION ALL SELECT kind, dst, rank * (share * {_TRUST.damping!r}) FROM r{k - 1} JOIN edges USING (kind, host)) GROUP BY kind, host),
""" for k in range(1, _TRUST.rounds + 1)
)
TRUST_SQL = f"""
WITH cut AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {" ".join(_FITS)} END AS fit FROM parts),
seeds AS (SELECT kind, host, count(*) / sum(count(*)) OVER (PARTITION BY kind) AS share
          FROM (SELECT host, CASE fit.verdict WHEN 'allow' THEN 'trust' WHEN 'block' THEN 'distrust' END AS kind FROM ruled) WHERE kind IS NOT NULL GROUP BY kind, host),
hrefs AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\\shref\\s*=\\s*["'']?([^"''\\s>]*)', 1)) AS href FROM ruled WHERE host <> ''),
ends AS (SELECT src, lower(regexp_extract(href, '^(?:(?i)https?:)?//([^/?#]*)', 1)) AS dst FROM hrefs),
counted AS (SELECT src, CASE WHEN dst <> '' THEN dst ELSE src END AS dst, count(*) AS n FROM ends GROUP BY ALL),
edges AS (SELECT 'trust' AS kind, src AS host, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM counted
          UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM counted),
r0 AS (SELECT kind, host, share * {1 - _TRUST.damping!r} AS rank FROM seeds),
{_ROUNDS}hosts AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, sum(rank) AS total FROM r{_TRUST.rounds} GROUP BY host HAVING sum(rank) > 0)
SELECT page_id, host, path, fit.rule AS rule,
       coalesce(fit.verdict, CASE WHEN total IS NULL THEN '{_TRUST.default}' WHEN round(trust / total, 9) >= {_TRUST.min_trust_share} THEN 'allow' ELSE 'block' END) AS verdict,
       round(trust / total, 6) AS trust_share
FROM ruled LEFT JOIN hosts USING (host)"""


@query("op6_link_trust", TRUST_SQL)
def link_trust_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by rules and by trust spread over the host graph."""
    return link_trust.judge_pages(table(spark, sf_dir, "pages"), RULES).withColumn("trust_share", F.round("trust_share", 6))


PREFERENCE_SQL = f"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
replies AS (SELECT conv_id, turn AS at_turn, text AS reply FROM turns WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1),
rejected AS (SELECT t.conv_id, t.turn, t.role, CASE WHEN t.role = 'assistant' AND t.turn = a.at_turn AND t.text = a.reply AND b.reply IS NOT NULL THEN b.reply ELSE t.text END AS text
             FROM turns t LEFT JOIN replies a USING (conv_id) LEFT JOIN replies b ON b.conv_id = xor(t.conv_id, 1)),
sides AS (SELECT 'chosen' AS side, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM turns
          UNION ALL SELECT 'rejected', *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 FROM rejected),
met AS (SELECT conv_id, place, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same FROM sides GROUP BY conv_id, place),
prompts AS (SELECT conv_id, coalesce(min(place) FILTER (NOT same), max(place) + 1) AS prompt_turns FROM met GROUP BY conv_id),
parts AS (SELECT conv_id, place, role, '{preferences.OPEN}' || role || '|>' || chr(10) || text || chr(10) AS rendered, CASE WHEN place < prompt_turns THEN 'prompt' ELSE side END AS part
          FROM sides JOIN prompts USING (conv_id) WHERE place >= prompt_turns OR side = 'chosen')
SELECT conv_id AS pair_id, part, CAST(place AS BIGINT) AS place, role, rendered, part <> 'prompt' AND role = 'assistant' AS loss,
       CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM parts"""


@query("op4_preference_pairs", PREFERENCE_SQL)
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its neighbour's last reply, as prompt and completions."""
    return preferences.segments(*preferences.reply_pairs(table(spark, sf_dir, "conversations")))


@query("op5_forest_secrets")
def forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, and whether the forest takes it for a secret."""
    found = secret_scan.scan_and_classify(table(spark, sf_dir, "documents"), carry=("doc_id",))
    return found.select("doc_id", "at", F.md5("candidate").alias("candidate_md5"), F.col("length").cast("int").alias("length"), "name", "kind", "coverage", "score", "is_secret")


@query("op11_piece_ids")
def piece_ids_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document's text and of the text they stand for."""
    found = piece_ids.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: crc32 of a short ASCII or UTF-8 text, its 256 entries worked out in the query.
CRC_ENTRIES = "entries AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS entry)"


def crc_sql(text: str) -> str:
    """SQL of the unsigned crc32 of a non-empty text, where ``entry`` is in scope."""
    octets = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), ' ')[:octet_length(encode({text}))], lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce({octets}, lambda c, x: xor(c >> 8, entry[(xor(c, x) & 255) + 1]), 4294967295))"


SPELLING_SQL = f"""
WITH RECURSIVE {CRC_ENTRIES},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{spelling.RUNS}')), '{spelling._UPPER}', '{spelling._LOWER}') AS run FROM documents),
seen AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= {spelling.MIN_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, k, {crc_sql("id || ':' || run")} AS h FROM seen, entries),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed),
vocabulary AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(k) >= {spelling.MIN_COUNT}),
places AS (SELECT word, n, unnest(range(length(word))) AS p FROM vocabulary),
cut AS (SELECT word, n, p, substr(word, 1, p) AS a, substr(word, p + 2) AS z FROM places),
pairs AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.p = y.p AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT x.word, x.n, v.word, v.n FROM cut x JOIN vocabulary v ON v.word = x.a || x.z
  UNION SELECT v.word, v.n, x.word, x.n FROM cut x JOIN vocabulary v ON v.word = x.a || x.z),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
judged AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.RATIO} * v.n THEN near END AS form, CASE WHEN near_n >= {spelling.RATIO} * v.n THEN near_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS root, 0 AS steps FROM judged UNION ALL SELECT w.word, j.form, steps + 1 FROM ways w JOIN judged j ON j.word = w.root WHERE j.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM judged JOIN ends USING (word)"""


@query("op12_spelling_variants", SPELLING_SQL)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its frequent form."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_every=199)


def _leaf_sql(chars: str) -> str:
    part = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
    return "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"


_CLIMB = """SELECT level + 1, grp, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + 1) // 2 FROM {0} WHERE n > 1 GROUP BY level, grp, idx // 2"""
_PATH = """{0}_path AS (SELECT grp, idx AS leaf, level, idx, CAST(NULL AS VARCHAR) AS other, false AS odd, n FROM {0} WHERE level = 0
  UNION ALL SELECT p.grp, p.leaf, p.level + 1, p.idx // 2, coalesce(s.digest, ''), p.idx % 2 = 1, (p.n + 1) // 2
  FROM {0}_path p LEFT JOIN {0}_nodes s ON s.grp = p.grp AND s.level = p.level AND s.idx = xor(p.idx, 1) WHERE p.n > 1)"""
MERKLE_SQL = f"""
WITH RECURSIVE {CRC_ENTRIES},
marked AS (SELECT doc_id, coalesce(':' || lang, '') AS grp, {_leaf_sql("n_chars")} AS digest, {_leaf_sql("n_chars + 1")} AS other,
                  coalesce({crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0, false) AS tampered FROM documents, entries),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM marked),
low(level, grp, idx, digest, n) AS (SELECT 0, grp, idx, digest, n FROM leaves UNION ALL {_CLIMB.format("low")}),
low_nodes AS MATERIALIZED (SELECT * FROM low),
subroots AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS groups FROM low_nodes WHERE n = 1),
high(level, grp, idx, digest, n) AS (SELECT 0, '', place, subroot, groups FROM subroots UNION ALL {_CLIMB.format("high")}),
high_nodes AS MATERIALIZED (SELECT * FROM high),
{_PATH.format("low")},
{_PATH.format("high")},
steps AS (SELECT l.grp, l.idx, list({{'other': p.other, 'odd': p.odd}} ORDER BY p.level) FILTER (p.level > 0) AS low FROM leaves l JOIN low_path p ON p.grp = l.grp AND p.leaf = l.idx GROUP BY l.grp, l.idx),
high_steps AS (SELECT s.grp, list({{'other': p.other, 'odd': p.odd}} ORDER BY p.level) FILTER (p.level > 0) AS high FROM subroots s JOIN high_path p ON p.leaf = s.place GROUP BY s.grp),
joined AS (SELECT doc_id, digest, CASE WHEN tampered THEN other ELSE digest END AS used, l.grp, coalesce(low, []) || coalesce(high, []) AS path
           FROM leaves l JOIN steps USING (grp, idx) JOIN high_steps h ON h.grp = l.grp),
folded AS (SELECT *, list_reduce(path, lambda own, s: {{'other': CASE WHEN s.odd THEN sha256(s.other || own.other) ELSE sha256(own.other || s.other) END, 'odd': false}}, {{'other': used, 'odd': false}}).other AS folded_root FROM joined)
SELECT doc_id, digest AS leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.other), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN subroots USING (grp), (SELECT digest AS root FROM high_nodes WHERE n = 1)"""


@query("op13_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, checked against the root with every seventh document changed."""
    leaf = lambda chars: merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang")], chars, F.col("text"))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("used", F.when(tampered, leaf(F.col("n_chars") + 1)).otherwise(leaf(F.col("n_chars"))))
    found = merkle.manifest(docs, leaf(F.col("n_chars")), "lang", "doc_id", carry=("used",))
    checked = merkle.verify(found, F.col("used"))
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    return corpus_pipeline.run(spark, sf_dir)
