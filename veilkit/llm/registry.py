"""Registered queries of the package, over whole tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilkit.llm import byte_pairs, pieces
from veilkit.llm.fingerprints import fingerprints
from veilkit.llm.frames import table
from veilkit.llm.languages import identify
from veilkit.llm.lexical import rank
from veilkit.llm.mixing import mix_sources
from veilkit.llm.near_dups import near_duplicates
from veilkit.llm.pages import extract
from veilkit.llm.passages import remove_repeats
from veilkit.llm.phrases import collocations
from veilkit.llm.quality import weigh
from veilkit.llm.secrets import secret_report
from veilkit.llm.vectors import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


@query("op1_mix_sources")
def op1(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op2_quality_resampling")
def op2(spark, sf_dir):
    return weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_document_fingerprints")
def op3(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


@query("op4_near_duplicates")
def op4(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@query("op5_exact_top_k", OP5_SQL)
def op5(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


@query("op6_secret_scan")
def op6(spark, sf_dir):
    return secret_report(table(spark, sf_dir, "documents"))


@query("op7_sentencepiece")
def op7(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"))


@query("op8_page_language")
def op8(spark, sf_dir):
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op9_page_text")
def op9(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


@query("op10_passage_dedup")
def op10(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row_number() OVER () AS row_id, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
size AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
tf AS (SELECT row_id, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
q AS (SELECT item_row, item_id, term, CAST(count(*) AS BIGINT) AS c
      FROM (SELECT item_row, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS item_row, * FROM benchmark) WHERE text IS NOT NULL) GROUP BY ALL),
scored AS (
  SELECT item_row, item_id, row_id, doc_id,
         CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), size GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


@query("op11_lexical_search", OP11_SQL)
def op11(spark, sf_dir):
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS body
  FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, regexp_extract_all(body, '[^\x20\x09]+') AS ws FROM pieces),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, ws, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS i
        FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, CAST(count(*) AS BIGINT) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT * FROM f WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, h.a AS l, t.a AS r, CAST((2000000::HUGEINT * c.a) // (h.a + t.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, CAST(k AS BIGINT))) AS j FROM cand) c
  JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.ws[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, ws, a, k, m, unnest(range(1, CAST(k - m + 2 AS BIGINT))) AS i
        FROM (SELECT *, unnest(range(2, CAST(k AS BIGINT))) AS m FROM cand WHERE k > 2)) GROUP BY ALL)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN inside USING (lang, phrase) JOIN total USING (lang)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a QUALIFY rank <= 2000
"""


@query("op12_phrase_collocations", OP12_SQL)
def op12(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


@query("op13_byte_bpe")
def op13(spark, sf_dir):
    import public_tokenizers

    vocabulary = byte_pairs.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_pairs.digests(byte_pairs.encode(table(spark, sf_dir, "documents"), vocabulary))
