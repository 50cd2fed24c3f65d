"""Search and study operators on documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import search as S
from ..operators import study as U
from ..tables import load

QUERIES = [("q1", "the andand of thereon"), ("q2", "license apache version the"), ("q3", "released under the mit mit license"), ("q4", "nowhere zzz")]
_Q = ", ".join(f"('{i}', '{q}')" for i, q in QUERIES)
_STOP = ", ".join(f"'{w}'" for w in S.STOP)
_TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN (" + _STOP + "))"
_BM25 = f"""d AS (SELECT doc_id AS id, {_TOKENS.format("concat_ws(' ', coalesce(text, ''), CAST(doc_id AS VARCHAR))")} AS t FROM documents),
  w AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
  a AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS.format('query')}) AS term FROM (VALUES {_Q}) q(query_id, query)) GROUP BY 1, 2),
  p AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(t) AS length, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY 1, 2, 3),
  f AS (SELECT term, greatest(1e-9, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM p, w GROUP BY term, n),
  s AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.75 + 0.25 * length / avgdl))), 9) AS score FROM p JOIN a USING (term) JOIN f USING (term), w GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id string, query string")


@query("bm25_topk", f"WITH {_BM25} SELECT query_id, id, score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf):
    return S.bm25(load(spark, sf, "documents"), queries(spark), "doc_id", "text")


@query(
    "like_topk",
    f"""WITH d AS (SELECT doc_id AS id, lower(concat_ws(' ', coalesce(text, ''), CAST(doc_id AS VARCHAR))) AS b FROM documents), q AS (SELECT query_id, {_TOKENS.format('query')} AS t FROM (VALUES {_Q}) q(query_id, query)),
    s AS (SELECT query_id, id, CAST(len(list_filter(t, lambda x: contains(b, x))) AS DOUBLE) AS score FROM d, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) SELECT query_id, id, score, rank FROM r WHERE rank <= 10""",
)
def like_topk(spark, sf):
    return S.substring_search(load(spark, sf, "documents"), QUERIES, "doc_id", "text")


_JUDGED = "SELECT 'q2' AS query_id, doc_id AS id FROM documents WHERE contains(text, 'Apache License') UNION ALL SELECT 'q3', doc_id FROM documents WHERE contains(text, 'MIT License') UNION ALL SELECT 'q4', doc_id FROM documents WHERE source = 'src7'"


def judgments(spark, sf):
    d = load(spark, sf, "documents")
    j = lambda q, c: d.where(c).select(F.lit(q).alias("query_id"), F.col("doc_id").alias("id"))
    return j("q2", F.contains("text", F.lit("Apache License"))).unionByName(j("q3", F.contains("text", F.lit("MIT License")))).unionByName(j("q4", F.col("source") == "src7"))


@query(
    "search_metrics",
    f"""WITH {_BM25}, j AS ({_JUDGED}), h AS (SELECT j.query_id, count(DISTINCT j.id) AS relevant, count(r.id) AS hits, min(r.rank) AS first_rank FROM j LEFT JOIN (SELECT * FROM r WHERE rank <= 10) r ON r.query_id = j.query_id AND r.id = j.id GROUP BY 1)
    SELECT avg(hits / 10) AS p_at_k, avg(hits / relevant) AS r_at_k, avg(coalesce(1 / first_rank, 0)) AS mrr FROM h""",
)
def search_metrics(spark, sf):
    return S.metrics(S.bm25(load(spark, sf, "documents"), queries(spark), "doc_id", "text"), judgments(spark, sf))


#: Five lengths' weights b at k1 = 1.5 and five saturations k1 at b = 0.25.
GRID = list(dict.fromkeys([(1.5, b) for b in (0.0, 0.25, 0.5, 0.75, 1.0)] + [(k1, 0.25) for k1 in (0.5, 1.2, 1.5, 2.0, 3.0)]))
_H = f"h AS (SELECT j.query_id, count(DISTINCT j.id) AS relevant, count(r.id) AS hits, min(r.rank) AS first_rank FROM j LEFT JOIN (SELECT * FROM r WHERE rank <= 10) r ON r.query_id = j.query_id AND r.id = j.id GROUP BY 1)"
_MEANS = "avg(hits / 10) AS p_at_k, avg(hits / relevant) AS r_at_k, avg(coalesce(1 / first_rank, 0)) AS mrr FROM h"


def _at(k1: float, b: float) -> str:
    """The same tables at other parameters."""
    return _BM25.replace("tf * 2.5 / (tf + 1.5 * (0.75 + 0.25 * length / avgdl))", f"tf * {k1 + 1}::DOUBLE / (tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * length / avgdl))")


@query("search_sweep", " UNION ALL ".join(f"SELECT {k1}::DOUBLE AS k1, {b}::DOUBLE AS b, p_at_k, r_at_k, mrr FROM (WITH {_at(k1, b)}, j AS ({_JUDGED}), {_H} SELECT {_MEANS})" for k1, b in GRID))
def search_sweep(spark, sf):
    return S.sweep(load(spark, sf, "documents"), queries(spark), judgments(spark, sf), "doc_id", "text", GRID)


@query("unjudged", "SELECT id, query_id FROM (SELECT doc_id + 500 AS id, 'x' AS query_id FROM documents) WHERE id NOT IN (SELECT doc_id FROM documents)")
def unjudged(spark, sf):
    d = load(spark, sf, "documents")
    return S.unjudged(d.select((F.col("doc_id") + 500).alias("id"), F.lit("x").alias("query_id")), d, "doc_id")


_WORDS = ", ".join(f"'{w}'" for w in dict.fromkeys(U.STOP))
_CONTENT = "(length({0}) >= 3 AND {0} NOT IN (" + _WORDS + "))"


def units(spark, sf):
    """The lines of the documents."""
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("unit", "text"))


@query(
    "tfidf_terms",
    f"""WITH u AS (SELECT doc_id, unnest(range(0, len(l))) AS unit, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    c AS (SELECT doc_id, unit, unnest(regexp_split_to_array(text, '[.;:!?()\\[\\]]')) AS c FROM u WHERE length(trim(text)) > 0),
    x AS (SELECT doc_id, unit, list_transform(regexp_extract_all(c, '[A-Za-z][A-Za-z\\-'']*'), lambda w: lower(w)) AS w FROM c),
    g AS (SELECT doc_id, unit, unnest(list_concat(list_filter(w, lambda z: {_CONTENT.format('z')}), list_transform(list_filter(list_zip(w[:-2], w[2:]), lambda p: {_CONTENT.format('p[1]')} AND {_CONTENT.format('p[2]')}), lambda p: p[1] || ' ' || p[2]))) AS term FROM x),
    n AS (SELECT doc_id, count(*) AS n FROM u WHERE length(trim(text)) > 0 GROUP BY 1), l AS (SELECT doc_id, unit, count(*) AS len FROM g GROUP BY 1, 2),
    t AS (SELECT doc_id, unit, term, count(*) AS c FROM g GROUP BY 1, 2, 3),
    b AS (SELECT doc_id, term, count(*) AS df, max(c / len) AS tf FROM t JOIN l USING (doc_id, unit) GROUP BY 1, 2),
    s AS (SELECT doc_id, term, round(tf * (ln((n + 1) / (df + 1)) + 1) * CASE WHEN contains(term, ' ') THEN 1.6 ELSE 1.0 END, 9) AS weight FROM b JOIN n USING (doc_id)),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS k FROM s) WHERE k <= 15),
    h AS (SELECT DISTINCT doc_id, unnest(string_split(term, ' ')) AS term FROM r WHERE contains(term, ' ')),
    z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM r WHERE contains(term, ' ') OR (doc_id, term) NOT IN (SELECT (doc_id, term) FROM h))
    SELECT doc_id, rank, term, weight FROM z WHERE rank <= 5""",
)
def tfidf_terms(spark, sf):
    return U.tf_idf(units(spark, sf), 5)


@query("summary_sentences")
def summary_sentences(spark, sf):
    return U.summary(units(spark, sf), 3, 20)


@query("definitions")
def definitions(spark, sf):
    return U.definitions(load(spark, sf, "documents"))


@query(
    "page_sections",
    r"""WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS x FROM documents)),
    h AS (SELECT *, trim(line) AS s, list_filter(regexp_split_to_array(trim(line), '\s+'), lambda w: w <> '') AS w FROM l),
    f AS (SELECT *, length(s) BETWEEN 3 AND 90 AND (regexp_matches(s, '^\s*(\d+(\.\d+)*)[.)]?\s+(\S.*)$') OR (NOT regexp_matches(s, '[.,;:]$') AND len(w) <= 12 AND ((upper(s) = s AND lower(s) <> s)
      OR len(list_filter(w, lambda v: regexp_matches(v, '^\p{Lu}'))) >= greatest(1, floor(len(w) * 0.6))))) AS hd FROM h),
    g AS (SELECT *, CAST(sum(CAST(hd AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS section FROM f),
    b AS (SELECT doc_id, section, coalesce(max(CASE WHEN hd THEN s END), 'Introduction') AS title, trim(coalesce(string_agg(CASE WHEN NOT hd THEN line END, ' ' ORDER BY i), '')) AS body FROM g GROUP BY 1, 2)
    SELECT doc_id, section, title, CAST(len(list_filter(regexp_split_to_array(body, '\s+'), lambda v: v <> '')) AS BIGINT) AS words FROM b WHERE words >= 20""",
)
def page_sections(spark, sf):
    s = U.sections(load(spark, sf, "documents"))
    return s.select("doc_id", "section", "title", F.size(F.filter(F.split("body", r"\s+"), lambda x: x != "")).cast("long").alias("words"))


@query("search_by_query", f"WITH {_BM25}, j AS ({_JUDGED}), {_H} SELECT query_id, relevant, hits, first_rank FROM h")
def search_by_query(spark, sf):
    """Relevant documents, hits among the first ten, and the rank of the first, for each judged query."""
    return S.per_query(S.bm25(load(spark, sf, "documents"), queries(spark), "doc_id", "text"), judgments(spark, sf))


_LIKE = f"""d AS (SELECT doc_id AS id, lower(concat_ws(' ', coalesce(text, ''), CAST(doc_id AS VARCHAR))) AS b FROM documents), q AS (SELECT query_id, {_TOKENS.format('query')} AS t FROM (VALUES {_Q}) q(query_id, query)),
    s AS (SELECT query_id, id, CAST(len(list_filter(t, lambda x: contains(b, x))) AS DOUBLE) AS score FROM d, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0)"""


@query("substring_metrics", f"WITH {_LIKE}, j AS ({_JUDGED}), {_H} SELECT {_MEANS}")
def substring_metrics(spark, sf):
    """The baseline's quality, beside search_metrics."""
    return S.metrics(S.substring_search(load(spark, sf, "documents"), QUERIES, "doc_id", "text"), judgments(spark, sf))


_TIDY = "text"
for _bad, _good in U.LIGATURES.items():
    _TIDY = f"replace({_TIDY}, '{_bad}', '{_good.replace(chr(39), chr(39) * 2)}')"
_TIDY = f"regexp_replace({_TIDY}, '-\\n(\\w)', '\\1', 'g')"
_TIDY = f"regexp_replace(regexp_replace({_TIDY}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query("tidied", f"SELECT doc_id, trim({_TIDY}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM documents")
def tidied(spark, sf):
    return load(spark, sf, "documents").select("doc_id", U.tidy(F.col("text")).alias("text"))


@query("glossary")
def glossary(spark, sf):
    """Definitions, and key terms with the first sentence that holds them."""
    return U.glossary(units(spark, sf), load(spark, sf, "documents"))
