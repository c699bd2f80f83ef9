"""The registered queries of this subpackage: each applies one operator with
production parameters to its whole table; ``sql`` is DuckDB's way to the same
rows where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, licenses, merkle, minhash, mixing, packing, quality_rules, sharding, simhash, suffix_dedup,
               topk, toxicity, window_dedup)
from .common import prepare


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return self.build(spark, sf_dir)


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_minhash_near_dedup", sql=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 2, len(w))], ' ') AS s
      FROM w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS r(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN m ON d.doc_id = m.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""")
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, num=85, den=100)


@query("op2_suffix_dedup", sql=r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
p AS (SELECT doc_id, b, substr(t, 2 * b + 1, 1198) AS t, least(500, strlen(t) // 2 - b) AS n FROM d, unnest(range(0, strlen(t) // 2, 500)) AS r(b)),
x AS (SELECT doc_id, b + i AS j, substr(t, 2 * i - 1, 2) AS x, CASE WHEN 2 * (i + 99) <= strlen(t) THEN md5(substr(t, 2 * i - 1, 200)) END AS h
      FROM p, unnest(range(1, n + 1)) AS r(i)),
s AS (SELECT *, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, j) > 1 AS start FROM x),
c AS (SELECT *, bool_or(start) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM s),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS opens FROM c),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, count(*) FILTER (opens) AS o,
             string_agg(x, '' ORDER BY j) FILTER (NOT gone) AS t FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(o, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.t, ''))) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id""")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))), ",").alias("families"),
        F.transform("notices", lambda x: x["paragraph"]).alias("paragraphs"))


@query("op4_mix_sources", sql=r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
             [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (SELECT *, least(sum(source_size) OVER ()::DOUBLE * 1.5, sum(cap) OVER ()) AS total,
             coalesce(sum(cap) OVER b, 0.0::DOUBLE) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER b, 0.0::DOUBLE) AS w_left
      FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - cap_before) / w_left AS level FROM l),
n AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS nth FROM c),
o AS (SELECT *, min(CASE WHEN level * w < cap THEN nth END) OVER () AS open FROM n),
f AS (SELECT *, max(CASE WHEN nth = open THEN level END) OVER () AS final FROM o),
t AS (SELECT source, source_size, CASE WHEN open IS NULL OR nth < open THEN cap ELSE least(final * w, cap) END AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT
                                        / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r""")
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"))
    return planned.select(F.col("_row.doc_id").alias("doc_id"), F.col("_size").alias("size"),
                          F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                          (F.col("_copies") * F.col("_size")).alias("taken"))


@query("op5_window_dedup", sql=r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, j, w[j] AS x, CASE WHEN j + 49 <= len(w) THEN md5(array_to_string(w[j:j + 49], ' ')) END AS h
      FROM w, unnest(range(1, len(w) + 1)) AS r(j)),
f AS (SELECT h, min(doc_id) AS m FROM x WHERE h IS NOT NULL GROUP BY h),
s AS (SELECT x.doc_id, x.j, x.x, coalesce(f.m < x.doc_id, false) AS start FROM x LEFT JOIN f ON x.h = f.h),
c AS (SELECT *, bool_or(start) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(x, ' ' ORDER BY j) FILTER (NOT gone) AS t FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id""")
def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.digests(_table(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@query("op7_exact_topk", sql="""
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM q JOIN v ON q.r <> v.r),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantise(_table(spark, sf_dir, "embeddings"))
    asked = rows.filter("name % 50 = 0")
    found = topk.named(topk.maxscore(rows, asked, k=5), rows, asked)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op9_feistel_shards")
def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare(_table(spark, sf_dir, "documents"))


@query("op10_simhash_near")
def op10_simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near(_table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op12_merkle_manifest", sql=r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS size, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                     lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                              lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))) AS crc FROM documents),
l AS (SELECT *, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
             CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                  ELSE text END AS changed FROM d),
f AS (SELECT doc_id, tree, pos, size, leaf, sha256(concat(head, coalesce(strlen(changed) || ':' || changed, '-'))) AS folded FROM l),
n AS (SELECT tree, 0 AS level, pos, size, leaf AS h FROM f
      UNION ALL
      SELECT tree, level + 1, pos // 16, (size + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM n WHERE size > 1
      GROUP BY tree, level, pos // 16, size),
r AS (SELECT tree, level, pos // 16 AS run, list(h ORDER BY pos) AS c FROM n WHERE size > 1 GROUP BY ALL),
c AS (SELECT doc_id, tree, 0 AS level, pos, folded, '' AS proof FROM f
      UNION ALL
      SELECT doc_id, c.tree, c.level + 1, pos // 16,
             sha256(array_to_string(c.c[1:pos % 16] || [folded] || c.c[pos % 16 + 2:], '')),
             proof || array_to_string(c.c[1:pos % 16] || c.c[pos % 16 + 2:], '')
      FROM (SELECT c.*, r.c FROM c JOIN r ON r.tree = c.tree AND r.level = c.level AND r.run = c.pos // 16) AS c),
s AS (SELECT tree, h AS subroot FROM n WHERE size = 1),
m AS (SELECT 0 AS level, tree AS pos, count(*) OVER () AS size, subroot AS h FROM s
      UNION ALL
      SELECT level + 1, pos // 16, (size + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM m WHERE size > 1
      GROUP BY level, pos // 16, size),
t AS (SELECT level, pos // 16 AS run, list(h ORDER BY pos) AS c FROM m WHERE size > 1 GROUP BY ALL),
u AS (SELECT doc_id, 0 AS level, tree AS pos, folded, proof FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1
      UNION ALL
      SELECT doc_id, level + 1, pos // 16, sha256(array_to_string(c[1:pos % 16] || [folded] || c[pos % 16 + 2:], '')),
             proof || array_to_string(c[1:pos % 16] || c[pos % 16 + 2:], '')
      FROM (SELECT u.*, t.c FROM u JOIN t ON t.level = u.level AND t.run = u.pos // 16)),
e AS (SELECT doc_id, folded, proof FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1)
SELECT f.doc_id, f.leaf, s.subroot, m.h AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = m.h AS verified
FROM f JOIN s ON f.tree = s.tree JOIN e ON f.doc_id = e.doc_id JOIN m ON m.size = 1""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(_table(spark, sf_dir, "documents"))


@query("op13_quality_rules", sql=r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, k, j, len(w) AS n, CASE WHEN j + k - 1 <= len(w) THEN md5(array_to_string(w[j:j + k - 1], ' ')) END AS h
      FROM w, unnest(range(1, len(w) + 1)) AS r(j), (VALUES (3), (8), (101)) AS s(k)),
s AS (SELECT *, h IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, k, h) > 1 AS start FROM x),
c AS (SELECT *, CASE WHEN k = 3 THEN bool_or(start) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
                     WHEN k = 8 THEN bool_or(start) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
                     ELSE start END AS hit FROM s),
k AS (SELECT doc_id, count(*) FILTER (hit AND k = 3) AS again, count(*) FILTER (hit AND k = 8) AS covered, bool_or(hit AND k = 101) AS long
      FROM c GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
d AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(again, 0)::BIGINT AS n_repeat_words,
             coalesce(covered, 0)::BIGINT AS n_covered, coalesce(long, false) AS long
      FROM w LEFT JOIN k ON w.doc_id = k.doc_id LEFT JOIN l ON w.doc_id = l.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, base_failed,
       NOT base_failed AND n_covered <= 0.5 * n_words AND NOT long AS kept FROM b""")
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scores(_table(spark, sf_dir, "documents")).drop("longest_repeat")


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))
