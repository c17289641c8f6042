"""Registered queries of the text operators and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from creditspark.llm import bpe, decontaminate, embeddings, htmltext, lines, neardup, phrases, pii, quality, suffix, topk, urls, variants
from creditspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


LINES_SQL = """
WITH pages AS (
  SELECT row_number() OVER () AS page, doc_id, text, lang, source, n_chars FROM documents
), cut AS (
  SELECT page, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place FROM pages
), counted AS (
  SELECT source, line, count(DISTINCT page) AS n FROM cut WHERE trim(line) <> '' GROUP BY source, line
), hosts AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
found AS (
  SELECT c.source, c.line FROM counted c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.n > 1 AND c.n * 1.0 / h.total > 0.1
), slim AS (
  SELECT c.page, coalesce(string_agg(c.line, chr(10) ORDER BY c.place) FILTER (WHERE f.line IS NULL), '') AS text
  FROM cut c LEFT JOIN found f ON c.line = f.line AND c.source IS NOT DISTINCT FROM f.source GROUP BY c.page
), chosen AS (
  SELECT p.*, CASE WHEN p.text IS NOT NULL THEN s.text END AS new FROM pages p LEFT JOIN slim s USING (page)
)
SELECT doc_id, new AS text, lang, source,
       CASE WHEN new IS NOT DISTINCT FROM text THEN n_chars ELSE length(new) END AS n_chars FROM chosen
"""


@query("op7_line_dedup", LINES_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf_dir, "documents"))


CLASSES_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z[:^ascii:]]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE ['raw: ' || text] END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.size, y.size HAVING count(*) >= 0.8 * (x.size + y.size - count(*)) - 1e-9
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
)
SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a
"""


@query("op4_minhash_near_dedup", CLASSES_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


LEAKS_SQL = """
WITH w AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id AS id,
         regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z[:^ascii:]]+') AS words FROM documents
  UNION ALL
  SELECT 'i', row_number() OVER (), item_id,
         regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z[:^ascii:]]+') FROM benchmark
), s AS (
  SELECT DISTINCT kind, row, id, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle
  FROM w WHERE len(words) >= 5
), sizes AS (SELECT row, count(*) AS size FROM s WHERE kind = 'i' GROUP BY row),
both_of AS (
  SELECT d.row AS d, d.id AS doc_id, i.row AS i, i.id AS item_id, count(*) AS shared
  FROM s d JOIN s i ON d.shingle = i.shingle AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL
)
SELECT doc_id, item_id, CAST(shared AS INTEGER) AS shared, shared * 1.0::DOUBLE / size AS containment
FROM both_of JOIN sizes ON sizes.row = both_of.i WHERE shared >= 0.8 * size - 1e-9
"""


@query("op8_benchmark_decontamination", LEAKS_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


TOP_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op10_exact_top_k", TOP_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


@query("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query("op5_url_filters")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op6_pii_surrogates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.protect(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_suffix_array_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), keep=False)


PHRASES_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), sizes AS (SELECT unnest(range(1, 5)) AS size
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, CAST(len(ws) - size + 2 AS BIGINT)), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
  FROM worded, sizes WHERE len(ws) >= size
), f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), found AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 30
), cuts AS (
  SELECT lang, phrase, f, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:size], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM found)
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, k,
         CAST((CAST(2000000 AS HUGEINT) * c.f) // (h.f + t.f) AS BIGINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT DISTINCT q.lang, q.f, array_to_string(q.ws[i:i + s.size - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size)) AS i FROM found) q JOIN sizes s ON s.size > 1 AND s.size < q.size AND i + s.size - 1 <= q.size
), dropped AS (
  SELECT DISTINCT w.lang, w.phrase FROM worst w JOIN inner_ i ON i.lang = w.lang AND i.phrase = w.phrase AND 100 * i.f >= 80 * w.a
), ranked AS (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, n, score
  FROM worst w JOIN totals USING (lang) WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = w.lang AND d.phrase = w.phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query("op13_phrase_collocations", PHRASES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


VARIANTS_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), hexed AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM counted
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(1, CAST(length(x) AS BIGINT), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM hexed, crc
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (SELECT word, unnest(range(1, CAST(length(word) + 1 AS BIGINT))) AS i FROM words
), forms AS (
  SELECT word, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS blank, substr(word, 1, i - 1) || substr(word, i + 1) AS fewer FROM places
), pairs AS (
  SELECT a.word AS a, b.word AS b FROM forms a JOIN forms b ON a.blank = b.blank AND a.word <> b.word
  UNION SELECT f.word, w.word FROM forms f JOIN words w ON f.fewer = w.word
  UNION SELECT w.word, f.word FROM forms f JOIN words w ON f.fewer = w.word
), known AS (
  SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS best, max(n) AS best_n FROM pairs JOIN words ON words.word = b GROUP BY a
), near AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form,
         CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN known ON a = word
), walk AS (
  WITH RECURSIVE step AS (
    SELECT word, word AS last, form AS next FROM near
    UNION ALL SELECT s.word, n.word, n.form FROM step s JOIN near n ON n.word = s.next
  ) SELECT word, last AS root FROM step WHERE next IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM near JOIN walk USING (word)
"""


@query("op11_spelling_variants", VARIANTS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


NEAR_COPIES_SQL = """
WITH RECURSIVE sound AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.row AS a, b.row AS b, b.vec_id FROM sound a JOIN sound b
    ON a.row <> b.row AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT row AS a, row AS b FROM sound UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), heads AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN sound ON row = b GROUP BY a
), counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a
), found AS (
  SELECT vec_id, coalesce(n, 0) AS n_links, component_id FROM sound JOIN heads ON heads.a = row LEFT JOIN counts ON counts.a = row
  UNION ALL
  SELECT vec_id, 0, vec_id FROM embeddings WHERE embedding IS NULL
    OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0
)
SELECT vec_id, CAST(n_links AS BIGINT) AS n_links, CAST(component_id AS BIGINT) AS component_id, coalesce(vec_id = component_id, false) AS kept FROM found
"""


@query("op12_embedding_near_copies", NEAR_COPIES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_copies(table(spark, sf_dir, "embeddings"))
