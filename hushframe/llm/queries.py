"""The operators' queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.rng import uniform_sql

from . import chat, divergence, exact_dedup, hpylm, mixing, near_dedup, packing, pii, quality_rules, sentencepiece_lattice, spelling, wavelet, wordpiece
from .common import documents
from .tokens import default_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_hpylm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(documents(spark, sf_dir))


@query
def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(documents(spark, sf_dir), default_path("word_bpe_49k.json"), end_id=1)
    return wavelet.read_shards(shards)


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


ORACLES["op3_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


@query
def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(documents(spark, sf_dir)))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_lattice.round_trip(documents(spark, sf_dir), default_path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.crc32(F.array_join("ids", ",")).alias("ids_crc32"), "ids", "text")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), default_path("byte_bpe_50k.json"), window=1024, end_id=0)


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), least=0.75, words=5)


#: What conversation -1 says, beside the table's own.
EXTRA_TURN = "</s>[INST] ok [/INST]"


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{EXTRA_TURN}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_chats(rows)
    turns = F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "")
    return made.select(
        "conv_id",
        F.size(chat.read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op8_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same,
  length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '<\||</?s>|<</?SYS>>|\[/?INST\]')) AS size,
  length(role) + length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '<\||</?s>|<</?SYS>>|\[/?INST\]')) AS role_size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size + CASE WHEN same THEN 8 ELSE role_size + 23 END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.judged(docs, quality_rules.fit(docs, documents(spark, sf_dir, "labels")))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(documents(spark, sf_dir), default_path("piece_bpe_32k.model"))


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(documents(spark, sf_dir))


_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
ORACLES["op13_source_mix"] = f"""
WITH d AS (SELECT doc_id, source, {_SIZE} AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM d GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS others FROM s WINDOW w AS (ORDER BY source_size / weight::DOUBLE, source)),
f AS (SELECT *, cap * others < rest * weight AS over FROM o),
l AS (SELECT 1.5::DOUBLE * sum(source_size) - coalesce(sum(cap) FILTER (over), 0) AS rest, sum(weight) FILTER (NOT over) AS others FROM f),
t AS (SELECT source, source_size, CASE WHEN over THEN cap ELSE l.rest::DOUBLE * weight / l.others::DOUBLE END AS target FROM f, l),
p AS (SELECT doc_id, d.source, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY {uniform_sql(13, "mix", "coalesce(doc_id::VARCHAR, 'null')")}, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source, source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size * size + greatest(0, least(size, floor(target)::BIGINT % source_size - start)) END)::BIGINT AS taken FROM p
"""


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


ORACLES["op12_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(lang_total), 0) AS lang_total, coalesce(any_value(total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + v)::HUGEINT AS q FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 200
"""


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


ORACLES["op11_spelling_variants"] = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS MATERIALIZED (SELECT id, run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(range(1, length(id) + length(run) + 2), lambda i: CASE WHEN ord(substr(id || ':' || run, i, 1)) < 128 THEN [ord(substr(id || ':' || run, i, 1))::BIGINT] ELSE [192 + (ord(substr(id || ':' || run, i, 1)) >> 6)::BIGINT, 128 + (ord(substr(id || ':' || run, i, 1)) & 63)::BIGINT] END)) AS bytes FROM r),
h AS MATERIALIZED (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, tab),
o AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM x a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN v b ON a.rest = b.word),
q AS (SELECT word, count(*) AS n_near FROM p GROUP BY word),
f AS MATERIALIZED (SELECT word, other AS form, other_n AS form_n FROM (SELECT p.*, v.n, row_number() OVER (PARTITION BY p.word ORDER BY other_n DESC, other) AS k FROM p JOIN v USING (word)) WHERE k = 1 AND other_n >= 2 * n),
c(word, root, steps) AS (SELECT word, form, 1 FROM f UNION ALL SELECT c.word, f.form, steps + 1 FROM c JOIN f ON f.word = c.root)
SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, form, form_n, coalesce(root, v.word) AS root FROM v LEFT JOIN q USING (word) LEFT JOIN f USING (word) LEFT JOIN (SELECT word, arg_max(root, steps) AS root FROM c GROUP BY word) USING (word)
"""
