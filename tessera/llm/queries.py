"""The driver's queries of this subpackage: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .common import new_path
from .decontam import find_leaks
from .htmltext import extract
from .katz import score_texts
from .langid import identify
from .lloyd import lloyd
from .mixing import mix_sources
from .quality import score_quality
from .simhash import simhash_components
from .spelling import count_words, spelling_variants
from .substrings import remove_repeats
from .tokenfiles import read_tokens, write_tokens
from .toxicity import score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"), shingle_words=4, radius=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), folds=7, held_out=2)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), k=10)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), limit=3)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle_words=5, similarity=0.8)
    return out.select("doc_id", "item_id", F.col("start").cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), "similarity")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lloyd(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dims=64, scale=1024)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=1, by_word=True)
    return read_tokens(spark, path).select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(table(spark, sf_dir, "documents"), shortest=7, least=2, damage=31), ratio=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_katz": op2_katz,
    "op3_html": op3_html,
    "op4_langid": op4_langid,
    "op5_substrings": op5_substrings,
    "op6_ann": op6_ann,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_decontam": op9_decontam,
    "op10_quality": op10_quality,
    "op11_lloyd": op11_lloyd,
    "op12_tokens": op12_tokens,
    "op13_spelling": op13_spelling,
}


def _lloyd_sql(rounds: int) -> str:
    """Lloyd's rounds one after another, every vector against every centroid."""
    vectors = """k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(CAST(1024 AS DOUBLE) * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF isfinite(x)]) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM (
    SELECT * FROM k ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v LIMIT 8))"""
    parts = [vectors]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(d * 8 + c) AS m FROM (
    SELECT r, c, CAST(list_sum([(k.v[j] - c{i}.v[j]) * (k.v[j] - c{i}.v[j]) FOR j IN range(1, 65)]) AS BIGINT) AS d FROM k, c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
      SELECT m % 8 AS c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT r, unnest(v) AS x, unnest(range(64)) AS j FROM k) JOIN a{i} USING (r) GROUP BY ALL) GROUP BY c) n ON o.c = n.c)""")
    return f"""WITH {", ".join(parts)},
e AS (SELECT vec_id, CAST(m % 8 AS INTEGER) AS cluster, m // 8 AS distance FROM k JOIN a{rounds} USING (r))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(v, ',')) AS centroid_sha256 FROM e JOIN c{rounds} ON cluster = c"""


#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_substrings": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
k AS (SELECT r, doc_id, unnest(range(len(w) - 49)) AS pos, unnest([array_to_string(w[i:i + 49], ' ') FOR i IN range(1, len(w) - 48)]) AS seq FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL),
m AS (SELECT r, pos FROM (SELECT r, pos, doc_id, min(doc_id) OVER (PARTITION BY seq) AS least FROM k) WHERE least < doc_id),
g AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(pos, pos + 50)) AS p FROM m) GROUP BY r),
v AS (SELECT r, list(x ORDER BY p) AS kept FROM (
    SELECT d.r, unnest(w) AS x, unnest(range(len(w))) AS p FROM d JOIN g USING (r)) u
  LEFT JOIN (SELECT r, unnest(gone) AS p, true AS cut FROM g) c USING (r, p) WHERE cut IS NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE coalesce(kept, []) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN v USING (r)
""",
    "op7_mixing": """
WITH d AS (
  SELECT doc_id, source, CAST(len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> '']) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
f AS (SELECT *, source_size * 3 / CAST(w AS DOUBLE) AS full_at FROM s),
c AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
    CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open FROM f WINDOW o AS (ORDER BY full_at, encode(source) NULLS LAST)),
l AS (SELECT arg_min((total - capped) / open, full_at) FILTER ((total - capped) / open <= full_at) AS level FROM c),
t AS (SELECT source, source_size, coalesce(least(CAST(w AS DOUBLE) * level, CAST(source_size * 3 AS DOUBLE)), CAST(0 AS DOUBLE)) AS target FROM c, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
b AS (SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
e AS (SELECT b.source, min(CASE WHEN target - times * source_size - (upto - size) > size / CAST(2 AS DOUBLE) THEN b.h ELSE b.h - 1 END) AS last_h
  FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source WHERE target - times * source_size > 0 AND upto >= target - times * source_size AND upto - size < target - times * source_size AND size > 0 GROUP BY b.source)
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN h <= coalesce(last_h, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken, d.source
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
""",
    "op9_decontam": """
WITH dw AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
iw AS (
  SELECT item_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
ds AS (
  SELECT doc_id, len(w) - 4 AS nd, unnest(range(len(w) - 4)) AS pos, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS sh FROM dw WHERE len(w) > 4),
ic AS (
  SELECT item_id, sz, sh, count(*) AS n_item
  FROM (SELECT item_id, len(w) - 4 AS sz, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS sh FROM iw WHERE len(w) > 4) GROUP BY ALL),
an AS (
  SELECT doc_id, item_id, pos, nd, sz, least(sz, nd) AS span, CAST(ceil((sz + least(sz, nd)) * (CAST(0.8 AS DOUBLE) / CAST(1.8 AS DOUBLE)) - CAST(1e-9 AS DOUBLE)) AS BIGINT) AS need,
    row_number() OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS rn
  FROM (SELECT DISTINCT doc_id, item_id, pos, nd, sz FROM ds JOIN ic USING (sh))),
st AS (
  SELECT DISTINCT a.doc_id, a.item_id, a.sz, a.span, least(a.pos, a.nd - a.span) AS start
  FROM an a JOIN an b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.rn = a.rn + a.need - 1 WHERE b.pos - a.pos < a.span),
wc AS (
  SELECT st.doc_id, st.item_id, st.sz, st.span, st.start, ds.sh, count(*) AS n_window
  FROM st JOIN ds ON st.doc_id = ds.doc_id AND ds.pos >= st.start AND ds.pos < st.start + st.span GROUP BY ALL),
ov AS (
  SELECT wc.doc_id, wc.item_id, wc.sz, wc.span, wc.start, CAST(sum(least(n_window, n_item)) AS BIGINT) AS o
  FROM wc JOIN ic ON wc.item_id = ic.item_id AND wc.sh = ic.sh GROUP BY ALL),
best AS (
  SELECT *, o / (sz + span - o) AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY o / (sz + span - o) DESC, start, span) AS b
  FROM ov WHERE o / (sz + span - o) >= CAST(0.8 AS DOUBLE))
SELECT doc_id, item_id, start AS start_word, span + 4 AS n_words, similarity FROM best WHERE b = 1
UNION ALL
SELECT doc_id, item_id, min(pos) AS start_word, n AS n_words, CAST(1 AS DOUBLE) AS similarity
FROM (SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS sh FROM iw WHERE len(w) BETWEEN 1 AND 4) i
JOIN (SELECT doc_id, n, unnest(range(len(w) - n + 1)) AS pos, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS sh
      FROM dw, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n) r USING (n, sh)
GROUP BY doc_id, item_id, n
""",
    "op11_lloyd": _lloyd_sql(10),
    "op13_spelling": """
WITH RECURSIVE t AS (
  SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) g(i)),
d AS (SELECT row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), '') AS id, regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+') AS runs FROM documents),
u AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT id, translate(unnest(runs), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM d) WHERE length(run) >= 7 GROUP BY id, run),
h AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], [CAST('0x' || substr(hex(id || ':' || run), 2 * i + 1, 2) AS BIGINT) FOR i IN range(strlen(id || ':' || run))]),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM u, t),
w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
v AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT a.word, b.word AS other, b.n AS m FROM v a JOIN v b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT v.word, w.word, w.n FROM v JOIN w ON v.cut = w.word
    UNION ALL SELECT w.word, v.word, v.n FROM v JOIN w ON v.cut = w.word)),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS form, max(m) AS form_n FROM near GROUP BY word),
f AS MATERIALIZED (
  SELECT w.word, CASE WHEN form_n >= 10 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM w LEFT JOIN b USING (word)),
p AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT p.word, f.form FROM p JOIN f ON p.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT p.word, p.root FROM p JOIN f ON p.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN e USING (word)
""",
}
