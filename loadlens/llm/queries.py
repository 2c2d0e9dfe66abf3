"""The registered ``opN_`` queries: each operator over its whole table, and SQL where SQL can."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loadlens.llm import (ann, bpe, decontaminate, langid, minhash, runs, secrets, simhash, suffix,
                          toxicity, trie, urls, warc)
from loadlens.llm.workers import is_training_row
from loadlens.session import work_dir

# Vocabulary files of public tokenizers.
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"

URL_RULES: list[urls.Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secrets.dictionary_words(spark, public_tokenizers.path(WORDS))
    found = secrets.scan(table(spark, sf_dir, "documents"), words)
    return found.select("doc_id", "start", F.length("value").cast("bigint").alias("n_chars"),
                        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
                        "kind", "label", "held_out", "score", "is_secret")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(is_training_row(F.col("doc_id")))
    model = toxicity.fit(docs, labels, "toxic")
    return toxicity.score(docs, model).select(
        "doc_id", (~is_training_row(F.col("doc_id"))).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE),
                             public_tokenizers.PATTERN)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_passages(table(spark, sf_dir, "documents"), passage=50)
    return found.select("doc_id", "n_words", "n_repeated",
                        F.size("spans").cast("bigint").alias("n_spans"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), work_dir(spark, "warc"))
    return warc.read_archives(manifest).select(
        F.col("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(is_training_row(F.col("doc_id"))),
                       public_tokenizers.path(BYTE_BPE))
    return langid.predict(docs, model).select(
        "doc_id", (~is_training_row(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def repeated_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one id in ten: from word a on, the p words after it again and again."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + np.arange(n - a) % p
    return order


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), reorder=repeated_order)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumns({"best": best, "lines": lines}).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"),
        F.expr("1000 * best.length div -best.short").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    rows, convs = trie.grafted(
        trie.numbered(table(spark, sf_dir, "conversations")), base=conv - conv % 100,
        take=F.crc32(conv.cast("string").cast("binary")) % 6, most=5)
    nodes, ends = trie.trie(rows, convs)
    return nodes.join(trie.ends_digests(ends), ["conv", "d"], "left").select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"),
        F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_nearest_neighbours, op2_secret_scan, op3_toxicity, op4_simhash, op5_byte_bpe,
    op6_decontamination, op7_suffix_repeats, op8_url_filter, op9_warc, op10_language,
    op11_minhash, op12_periodic_runs, op13_prefix_trie)}

_OP6 = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS p
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS x(s) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM patterns),
windows AS (
  SELECT r, l.n, x.s, array_to_string(w[x.s:x.s + l.n - 1], ' ') AS p
  FROM words, lengths l, unnest(range(1, len(w) - l.n + 2)) AS x(s)),
hits AS (SELECT r, s, n, item_id FROM windows JOIN patterns USING (n, p)),
hit_words AS (
  SELECT r, count(DISTINCT u.pos) AS n_hit
  FROM (SELECT DISTINCT r, s, n FROM hits) h, unnest(range(h.s, h.s + h.n)) AS u(pos) GROUP BY r),
named AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (r) LEFT JOIN named USING (r)
"""

_OP7 = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+') AS w FROM documents),
windows AS (
  SELECT r, x.s, sha256(array_to_string(w[x.s:x.s + 49], ' ')) AS p
  FROM words, unnest(range(1, len(w) - 48)) AS x(s)),
twice AS (SELECT p FROM windows GROUP BY p HAVING count(*) > 1),
starts AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before
           FROM windows JOIN twice USING (p)),
counted AS (
  SELECT r, sum(CASE WHEN before IS NULL OR s - before > 50 THEN 50 ELSE s - before END) AS n_repeated,
         sum(CASE WHEN before IS NULL OR s - before > 50 THEN 1 ELSE 0 END) AS n_spans
  FROM starts GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM words LEFT JOIN counted USING (r)
"""

_OP9 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM p),
chunks AS (
  SELECT page_id, payload_bytes, translate(
    lpad(to_base(CAST('0x' || substr(h, 1, 10) AS BIGINT), 32), 8, '0')
    || lpad(to_base(CAST('0x' || substr(h, 11, 10) AS BIGINT), 32), 8, '0')
    || lpad(to_base(CAST('0x' || substr(h, 21, 10) AS BIGINT), 32), 8, '0')
    || lpad(to_base(CAST('0x' || substr(h, 31, 10) AS BIGINT), 32), 8, '0'),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM chunks
"""

# CRC-32 of the decimal digits of {id}, bit by bit.
_CRC = """xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(
      string_split(CAST({id} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda s, b: list_reduce([xor(s, b), 0, 1, 2, 3, 4, 5, 6, 7],
      lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

_OP11 = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x09-\x0D\x20]+') AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.r AS a, b.r AS b FROM items a JOIN items b ON a.x = b.x AND a.r <> b.r
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT r AS a, r AS b FROM sets
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_id AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN sets ON reach.b = sets.r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least_id USING (r)
"""

_OP12 = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    coalesce(text, ''), '[^\x09-\x0D\x20]+') AS w, """ + _CRC.format(id="doc_id") + r""" AS h
  FROM documents),
sized AS (
  SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n, h % 10 = 0 AND len(w) > 0 AS turned,
         (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS m FROM base),
cut AS (SELECT *, 1 + (n - a) // (3 + m) AS p FROM sized),
docs AS (
  SELECT r, doc_id, n, CASE WHEN turned THEN list_transform(range(0, n), lambda i:
    w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM cut),
words AS (SELECT r, n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM docs),
same AS (
  SELECT a.r, b.i - a.i AS q, a.i FROM words a JOIN words b
  ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
marked AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM same),
stretches AS (
  SELECT r, q, min(i) AS s, count(*) + q AS l FROM marked GROUP BY r, q, part
  HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, l, min(q) AS q FROM stretches GROUP BY r, s, l),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         max({'l': l, 's': -s, 'q': -q}) AS best FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, u.i FROM runs, unnest(range(s + q, s + l)) AS u(i)),
left_over AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS line FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-best.s AS BIGINT) AS start,
       CAST(best.l AS BIGINT) AS length, CAST(-best.q AS BIGINT) AS period,
       CAST(1000 * best.l // -best.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (r) LEFT JOIN left_over USING (r)
"""

_OP13 = r"""
WITH own AS (
  SELECT conv_id AS c, md5(coalesce(role, '') || chr(10) || coalesce(text, '')) AS k,
         length(coalesce(text, '')) AS points, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, n, c - c % 100 AS base, """ + _CRC.format(id="c") + r""" % 6 AS h
  FROM (SELECT c, count(*) AS n FROM own GROUP BY c)),
planned AS (
  SELECT x.c, x.base, x.h, least(x.h, coalesce(b.n, 0)) AS got FROM convs x LEFT JOIN convs b ON b.c = x.base),
rebuilt AS (
  SELECT p.c, i AS d, k, points FROM planned p JOIN own ON own.c = p.base AND i <= got
  UNION ALL SELECT c, i - h + got, k, points FROM planned JOIN own USING (c) WHERE i > h),
paths AS (
  SELECT c, d, array_to_string(list(k) OVER (PARTITION BY c ORDER BY d), ',') AS k, points FROM rebuilt
  UNION ALL SELECT c, 0, '', 0 FROM convs),
nodes AS (SELECT d, k, min(c) AS v, count(*) AS n_convs, max(points) AS points FROM paths GROUP BY d, k),
named AS (SELECT c, d, v FROM paths JOIN nodes USING (d, k)),
lengths AS (SELECT c, max(d) AS d FROM named GROUP BY c),
ends AS (
  SELECT v, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
  FROM lengths JOIN named USING (c, d) GROUP BY v, d),
linked AS (
  SELECT n.v, n.d, n_convs, points, p.v AS parent
  FROM nodes n LEFT JOIN named p ON p.c = n.v AND p.d = n.d - 1),
kids AS (SELECT parent AS v, d - 1 AS d, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY 1, 2),
full_nodes AS (
  SELECT v, d, parent, n_convs, points, coalesce(n_children, 0) AS n_children
  FROM linked LEFT JOIN kids USING (v, d)),
sums AS (
  SELECT t.v, t.d, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
         sum((u.n_convs - 1) * u.points) AS saved
  FROM full_nodes u JOIN named t ON t.c = u.v AND t.d <= u.d GROUP BY t.v, t.d)
SELECT v AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id,
       CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes JOIN sums USING (v, d) LEFT JOIN ends USING (v, d)
"""

ORACLE_SQL: dict[str, str] = {
    "op6_decontamination": _OP6,
    "op7_suffix_repeats": _OP7,
    "op9_warc": _OP9,
    "op11_minhash": _OP11,
    "op12_periodic_runs": _OP12,
    "op13_prefix_trie": _OP13,
}
