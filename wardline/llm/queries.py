"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import centroid_drift as CD
from wardline.llm import chosen_path as CP
from wardline.llm import importance as IMP
from wardline.llm import lattice_lm as LM
from wardline.llm import line_join as LJ
from wardline.llm import packing as PK
from wardline.llm import pii_boost as PII
from wardline.llm import ppm as PPM
from wardline.llm import revisits as RV
from wardline.llm import source_audit as SA
from wardline.llm import token_blocks as TB
from wardline.llm import topk as TK
from wardline.llm import winnow as WN
from wardline.llm.common import fold, table
from wardline.session import shared_dir, use_utc
from wardline.sources.stores import fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return run
    return register


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_lattice_likelihood(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 7) == 2
    model = LM.train(docs, ~held, LM.read_vocabulary(tokenizer_path("piece_bpe_32k.model")))
    return LM.score(docs, model, F.col("doc_id"), held.alias("held_out"))


@query()
def op2_boosted_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = PII.find(docs, PII.train(docs))
    counts = [PII.count_of(F.col("base"), k).alias(f"n_{k}") for k in PII.KINDS]
    return found.select("doc_id", *counts, F.sha2(PII.listed(F.col("base")), 256).alias("base_sha256"),
                        PII.listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))


@query()
def op3_configuration_packing(spark, sf_dir):
    return PK.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS a
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.a, c.a), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op4_threshold_topk(spark, sf_dir):
    return TK.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query()
def op10_ppm_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    model = PPM.train(PPM.context_counts(docs.filter(~held)))
    return PPM.predict(docs, model, F.col("doc_id"), held.alias("held_out"))


@query(r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(generate_series(1, len(w) - least(len(w), 10) + 1), lambda p: array_to_string(w[p:p + least(len(w), 10) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0),
g AS (SELECT r, n, unnest(generate_series(1, len(w) - n + 1)) AS p, w FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
h AS (SELECT r, p, g.n, i.item_id FROM g JOIN i ON g.n = i.n AND i.g = array_to_string(w[p:p + g.n - 1], ' ')),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)""")
def op9_winnowing(spark, sf_dir):
    found = WN.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op5_importance_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = IMP.fit(docs, table(spark, sf_dir, "labels"))
    return IMP.resample(docs, model, F.col("doc_id"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN often USING (g) JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
r(a, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a),
k AS (SELECT a, min(root) AS class_id FROM r GROUP BY a)
SELECT doc_id, class_id, (SELECT count(*) FROM e WHERE e.a = doc_id) AS n_links FROM d JOIN k ON k.a = doc_id""")
def op6_chosen_path(spark, sf_dir):
    return CP.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query(r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT doc_id, i, a[i] AS line, list_sort(list_distinct(regexp_extract_all(translate(a[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS w
  FROM (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i FROM d)),
s AS (SELECT w, len(w) AS n, min((doc_id, i)) AS first, row_number() OVER () AS s FROM l WHERE len(w) > 0 GROUP BY w),
t AS (SELECT s, n, unnest(w) AS t FROM s),
f AS (SELECT t, count(*) AS f FROM t GROUP BY t),
p AS (SELECT s, n, t FROM (SELECT s, n, t, row_number() OVER (PARTITION BY s ORDER BY f, t) AS pos FROM t JOIN f USING (t))
  WHERE pos <= n - CAST(ceil(0.8 * n - 1e-9) AS BIGINT) + 1),
c AS (SELECT DISTINCT x.s AS x, y.s AS y FROM p x JOIN p y ON x.t = y.t AND x.s <> y.s AND 5 * y.n >= 4 * x.n AND 5 * x.n >= 4 * y.n),
m AS (SELECT DISTINCT x FROM c JOIN s a ON a.s = x JOIN s b ON b.s = y
  WHERE b.first < a.first AND 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)),
g AS (SELECT doc_id, i, line, NOT (len(l.w) > 0 AND (s.first <> (doc_id, i) OR m.x IS NOT NULL)) AS keep
  FROM l LEFT JOIN s ON l.w = s.w LEFT JOIN m ON m.x = s.s)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keep), '') AS text, count(*) AS n_lines,
  count(*) FILTER (WHERE NOT keep) AS n_removed FROM g GROUP BY doc_id""")
def op8_line_similarity(spark, sf_dir):
    return LJ.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "__lines.n_lines", "__lines.n_removed")


@query(r"""WITH p AS (SELECT page_id AS p, trim(url) AS u, md5(html) AS md, strlen(html) AS size FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^[^@]*@', ''), '^www\.', ''), ':(80|443)$', '') AS host,
  regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS q FROM p),
k AS (SELECT *, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END ELSE u END AS key,
  '"' || md || '"' AS tag, 'day ' || CAST(p % 97 AS VARCHAR) AS day FROM c),
r AS (SELECT key, p * 2 AS id, 1 AS f, p * 60 AS ts, md AS digest, CASE p % 7 WHEN 6 THEN NULL WHEN 5 THEN 'W/' || tag ELSE tag END AS etag,
    CASE WHEN p % 5 = 4 THEN NULL ELSE day END AS lm, size, p FROM k
  UNION ALL SELECT key, p * 2 + 1, 0, p * 60 + CASE p % 3 WHEN 0 THEN 30 WHEN 1 THEN -30 ELSE 100000 END, CASE WHEN p % 6 = 5 THEN md END,
    CASE p % 6 WHEN 0 THEN tag WHEN 1 THEN 'W/' || tag WHEN 2 THEN '"other"' END, CASE p % 6 WHEN 3 THEN day WHEN 4 THEN 'never' END, size, p FROM k),
w AS (SELECT *, last_value(CASE WHEN f = 1 THEN id END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, f, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ref FROM r),
j AS (SELECT n.id, n.key, n.ts, o.id AS ref, o.digest AS old_digest, o.size, o.p, o.etag AS old_etag, o.lm AS old_lm, n.etag, n.lm,
    CASE WHEN o.id IS NULL THEN 'no_earlier'
      WHEN n.etag IS NOT NULL AND o.etag IS NOT NULL THEN CASE WHEN regexp_replace(n.etag, '^W/', '') = regexp_replace(o.etag, '^W/', '') THEN 'etag' ELSE 'mismatch' END
      WHEN n.lm IS NOT NULL AND o.lm IS NOT NULL THEN CASE WHEN n.lm = o.lm THEN 'last_modified' ELSE 'mismatch' END
      WHEN n.digest IS NOT NULL AND o.digest IS NOT NULL THEN CASE WHEN n.digest = o.digest THEN 'digest' ELSE 'mismatch' END
      ELSE 'unchecked' END AS verdict
  FROM w n LEFT JOIN r o ON n.ref = o.id AND o.f = 1 WHERE n.f = 0)
SELECT id AS record_id, key AS url_key, verdict, CASE WHEN verdict IN ('etag', 'last_modified', 'digest') THEN CAST(ref AS VARCHAR) END AS response_id,
  CASE WHEN verdict IN ('etag', 'last_modified', 'digest') THEN old_digest END AS payload_digest,
  CASE WHEN verdict IN ('etag', 'last_modified', 'digest') THEN array_to_string(list_sort(list_filter([
    'content-type: text/html', 'content-length: ' || CAST(size AS VARCHAR), 'server: s' || CAST(p % 3 AS VARCHAR), 'cache-control: max-age=9',
    'date: ' || CAST(ts AS VARCHAR), 'etag: ' || coalesce(etag, old_etag), 'last-modified: ' || coalesce(lm, old_lm)], lambda x: x IS NOT NULL)), chr(10)) END AS headers
FROM j""")
def op7_revisit_resolution(spark, sf_dir):
    found = RV.resolve(RV.archive_of(table(spark, sf_dir, "pages")))
    return found.select(F.col("id").alias("record_id"), F.col("key").alias("url_key"), "verdict", F.col("response").cast("string").alias("response_id"),
                        "payload_digest", RV.header_lines(F.col("headers")).alias("headers"))


def _rounds(n: int) -> str:
    """Assignments a0, a1, ... and centroids c1, c2, ... of plain rounds from v and c0."""
    assigned = """a{i} AS (SELECT r, c, d FROM (SELECT v.r, m.c, CAST(list_sum(list_transform(list_zip(v.a, m.a), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d,
  row_number() OVER (PARTITION BY v.r ORDER BY d, m.c) AS k FROM v CROSS JOIN c{i} m) WHERE k = 1)"""
    moved = """u{i} AS (SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a{i}.c, unnest(v.a) AS x, unnest(generate_series(1, 64)) AS p FROM a{i} JOIN v USING (r)) GROUP BY c, p),
n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS a FROM u{i} GROUP BY c),
c{j} AS (SELECT o.c, coalesce(n.a, o.a) AS a FROM c{i} o LEFT JOIN n{i} n ON n.c = o.c)"""
    return ",\n".join([assigned.format(i=0), *[x.format(i=i, j=i + 1) for j in range(n) for x, i in ((moved, j), (assigned, j + 1))]])


@query(f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS a FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT c, a FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), a) - 1 AS c, a FROM v) WHERE c < 16),
{_rounds(3)},
i AS (SELECT c, CAST(sum(d) AS BIGINT) AS own, CAST(sum(sum(d)) OVER () AS BIGINT) AS whole FROM a3 GROUP BY c)
SELECT v.vec_id, CAST(a3.c AS INTEGER) AS cluster, a3.d AS distance, i.own AS cluster_inertia, i.whole AS inertia, sha256(array_to_string(c3.a, ',')) AS centroid_sha256
FROM a3 JOIN v USING (r) JOIN c3 ON c3.c = a3.c JOIN i ON i.c = a3.c""")
def op11_geometric_drift(spark, sf_dir):
    found, centroids = CD.clusters(table(spark, sf_dir, "embeddings"))
    return CD.report(found, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query(r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(ln) AS ln FROM k GROUP BY lang),
o AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(o.n, 0) + 5 * v.v) AS BIGINT) AS p, CAST(1 + (1000000000 * (k.ln + 5)) // (v.ln + 5 * v.v) AS BIGINT) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source
  GROUP BY x.lang, x.source, y.source),
a AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
  UNION ALL SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a)
WHERE part = 'pair' OR rank <= 50""")
def op12_dominance_skyband(spark, sf_dir):
    return SA.audit(table(spark, sf_dir, "documents"))


@query()
def op13_patched_blocks(spark, sf_dir):
    path = fresh_dir(shared_dir(spark), "token_blocks")
    TB.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return TB.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)
