"""The engine's queries over the driver's tables, by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import extract, predicates, scoring, text, vectors
from quern.operators import bm25, chunks, evaluate, fusion, graph, ingest, joins, keywords, tree, vector_index
from quern.plans import ports, strategies
from quern.session import read, spread
from quern.sources import readers, sinks
from quern.store import materialised, shared_folder
from quern.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        @wraps(f)
        def run(spark, sf):
            # ranks are 64 bits wide in SQL
            df = f(spark, sf)
            return df.withColumns({c: F.col(c).cast("long") for c in df.columns if c in ("rank", "place")})

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _rule(column: str, rules: dict, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(column, w)} THEN '{n}'" for n, w in rules.items()) + f" ELSE '{otherwise}' END"


def _vote(column: str, rules: dict) -> str:
    counts = {n: " + ".join(f"contains({column}, '{w}')::INT" for w in ws) for n, ws in rules.items()}
    best = "greatest(" + ", ".join(counts.values()) + ")"
    return f"CASE WHEN {best} = 0 THEN NULL " + " ".join(f"WHEN {c} = {best} THEN '{n}'" for n, c in counts.items()) + " END"


def _trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_WORDS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"
_TOKENS = rf"""list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(text), 'điều\s+(\d+)', 'điều_\1', 'g'), 'khoản\s+(\d+)', 'khoản_\1', 'g'), 'điểm\s+([a-z])', 'điểm_\1', 'g'), '[a-zA-Z0-9À-ỹ_]+'), lambda w: length(w) > 1 AND w NOT IN ({_listed(text.LEGAL_STOP_WORDS)}))"""


# sources


@query(rf"SELECT page_id, url, coalesce(map_extract_value(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in text.CONTENT_TYPES.items())}}}, lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1))), 'text') AS content_type FROM pages")
def source_content_type(spark, sf):
    return read(spark, sf, "pages").select("page_id", "url", text.content_type(F.col("url")).alias("content_type"))


@query(r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM t""")
def source_html_text(spark, sf):
    t = read(spark, sf, "pages").select("page_id", text.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


@query(r"SELECT conv_id, count(*) AS n_turns, array_to_string(list_sort(list(DISTINCT role)), ',') AS participants, md5(string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def source_chat_threads(spark, sf):
    return readers.chat_threads(read(spark, sf, "conversations")).select("conv_id", "n_turns", "participants", F.md5("text").alias("text_md5"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents")
def source_markdown_normalised(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(text.markdown_normalised(F.col("text"))).alias("text_md5"))


# chunkers


@query(rf"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: {_trimmed('x')}), lambda x: x <> '') AS p FROM documents) SELECT doc_id, i - 1 AS pos, md5(p[i]) AS text_md5 FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)")
def chunk_paragraphs(spark, sf):
    p = read(spark, sf, "documents").select("doc_id", F.posexplode(chunks.paragraphs(F.col("text"), r"\n+")).alias("pos", "t"))
    return p.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("t").alias("text_md5"))


@query(f"SELECT doc_id, i * {chunks.STEP} AS start, md5(substring(text, i * {chunks.STEP} + 1, {chunks.WINDOW})) AS text_md5 FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - {chunks.WINDOW}) / {chunks.STEP}))::BIGINT + 1)) AS i FROM documents)")
def chunk_windows(spark, sf):
    w = read(spark, sf, "documents").select("doc_id", F.explode(chunks.windows(F.col("text"))).alias("w"))
    return w.select("doc_id", F.col("w.start").cast("long").alias("start"), F.md5("w.text").alias("text_md5"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, w, len(w) AS n, CASE WHEN len(w) <= 1000 THEN 0 ELSE ceil((len(w) - 50) / 450)::BIGINT - 1 END AS last FROM w)
SELECT doc_id, i AS pos, md5(array_to_string(CASE WHEN n <= 1000 THEN w ELSE w[i * 450 + 1 : i * 450 + 500] END, ' ')) AS text_md5 FROM (SELECT *, unnest(range(0, last + 1)) AS i FROM s)""")
def chunk_word_windows(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return d.select("doc_id", F.posexplode(chunks.word_windows(F.col("w"))).alias("pos", "t")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("t").alias("text_md5"))


def _legal_docs(spark, sf) -> DataFrame:
    """Conversations as legal documents, a turn to an article."""
    c = read(spark, sf, "conversations")
    part = F.concat(F.lit("Điều "), (F.col("turn") + 1).cast("string"), F.lit(". "), "text")
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))), lambda s: s["t"]), " ").alias("text")).withColumn("title", F.concat(F.lit("Luật "), F.col("doc_id").cast("string")))


@query(f"SELECT conv_id AS doc_id, (turn + 1)::VARCHAR AS num, md5({_trimmed('text')}) AS body_md5 FROM conversations")
def chunk_articles(spark, sf):
    parts = _legal_docs(spark, sf).select("doc_id", F.explode(chunks.articles(F.col("text"))).alias("p"))
    return parts.select("doc_id", F.col("p.num").alias("num"), F.md5("p.body").alias("body_md5"))


@query(rf"""WITH b AS (SELECT conv_id, turn + 1 AS a, {_trimmed('text')} AS b FROM conversations),
n AS (SELECT conv_id, a, b, regexp_extract_all(b, '{chunks.POINT}', 1) AS nums, list_transform(string_split_regex(b, '{chunks.POINT}'), lambda x: trim({_trimmed('x')})) AS parts FROM b),
f AS (SELECT conv_id, a, b, list_filter(list_transform(range(1, len(parts) + 1), lambda i: {{'num': CASE WHEN i = 1 THEN '0' ELSE nums[i - 1] END, 'body': parts[i]}}), lambda x: x.body <> '') AS found, list_transform(range(0, greatest(0, ceil((length(b) - {chunks.WINDOW}) / {chunks.STEP}))::BIGINT + 1), lambda i: {{'num': 's' || i * {chunks.STEP}, 'body': substring(b, i * {chunks.STEP} + 1, {chunks.WINDOW})}}) AS cut FROM n),
c AS (SELECT conv_id, a, CASE WHEN length(b) <= {chunks.CLAUSE} THEN [{{'num': NULL::VARCHAR, 'body': b}}] WHEN len(found) > 1 THEN found ELSE cut END AS c FROM f),
p AS (SELECT conv_id, a, i, c[i].num AS num, c[i].body AS body FROM (SELECT conv_id, a, c, unnest(range(1, len(c) + 1)) AS i FROM c) WHERE length(c[i].body) > {chunks.SHORTEST}),
k AS (SELECT *, conv_id || '_a' || a || coalesce('_' || num, '') AS base FROM p)
SELECT base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY i) > 1 THEN '~' || row_number() OVER (PARTITION BY base ORDER BY i) ELSE '' END AS chunk_id, conv_id AS doc_id, a::VARCHAR AS article, NULL::VARCHAR AS clause, num AS point, md5('[Luật ' || conv_id || '] Điều ' || a || ': ' || body) AS text_md5 FROM k""")
def chunk_legal(spark, sf):
    # the invented turns have no clauses or points
    return chunks.legal(_legal_docs(spark, sf)).select("chunk_id", "doc_id", "article", "clause", "point", F.md5("text").alias("text_md5"))


@query(r"""WITH marked AS (SELECT doc_id, regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g') AS t FROM documents), s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\x01|\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM marked),
u AS (SELECT doc_id, flatten(list_transform(s, lambda x: CASE WHEN len(string_split_regex(x, '\s+')) > 100 THEN list_filter(list_transform(string_split(regexp_replace(x, '([,;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '') ELSE [x] END)) AS u FROM s),
p AS (SELECT doc_id, list_reduce(list_transform(u, lambda x: {'cur': x, 'n': len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')), 'out': []::VARCHAR[]}), lambda a, b: CASE WHEN a.n + b.n <= 100 THEN {'cur': a.cur || ' ' || b.cur, 'n': a.n + b.n, 'out': a.out} ELSE {'cur': b.cur, 'n': b.n, 'out': list_append(a.out, a.cur)} END) AS p FROM u WHERE len(u) > 0),
c AS (SELECT doc_id, list_append(p.out, p.cur) AS c FROM p)
SELECT doc_id, i - 1 AS pos, md5(c[i]) AS text_md5 FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)""")
def chunk_sentences_packed(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(chunks.sentence_chunks(F.col("text"))).alias("pos", "t"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("t").alias("text_md5"))


# text functions


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t")
def text_legal_tokens(spark, sf):
    t = spread(read(spark, sf, "documents")).select("doc_id", text.legal_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


_KEYWORDS = rf"""words AS (SELECT doc_id, t[i] AS w, i FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_À-ỹ]+') AS t FROM documents))),
counted AS (SELECT doc_id, w, count(*) AS n, min(i) AS pos FROM words WHERE regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({_listed(text.KEYWORD_STOP_WORDS)}) GROUP BY doc_id, w),
keywords AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS r FROM counted QUALIFY r <= 10)"""


@query(f"WITH {_KEYWORDS} SELECT d.doc_id, coalesce(string_agg(w, ',' ORDER BY r), '') AS keywords FROM documents d LEFT JOIN keywords k USING (doc_id) GROUP BY d.doc_id")
def text_frequency_keywords(spark, sf):
    return spread(read(spark, sf, "documents")).select("doc_id", F.array_join(text.frequency_keywords(F.col("text")), ",").alias("keywords"))


@query(rf"""WITH w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents)
SELECT doc_id, round(greatest(0.0, 1.0::DOUBLE - CASE WHEN len(w) < 20 THEN 0.3 ELSE 0 END - CASE WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / greatest(length(text), 1) < 0.5 THEN 0.2 ELSE 0 END - CASE WHEN len(w) > 0 AND len(list_distinct(w)) / len(w) < 0.3 THEN 0.3 ELSE 0 END), 6)::DOUBLE AS quality FROM w""")
def text_quality(spark, sf):
    return spread(read(spark, sf, "documents")).select("doc_id", F.round(text.quality(F.col("text")), 6).alias("quality"))


_INTENT = _rule("q", text.INTENTS, "factual")
_URGENCY = f"CASE WHEN {_any('q', text.URGENT)} THEN 0.9 WHEN {_any('q', text.PRESSING)} THEN 0.7 ELSE 0.5 END"


@query(rf"""SELECT conv_id, turn, {_INTENT} AS intent, ({_URGENCY})::DOUBLE AS urgency, len(list_filter(string_split_regex(q, '\s+'), lambda w: length(w) > 2 AND w NOT IN ({_listed(text.QUERY_STOP_WORDS)})))::BIGINT AS n_keywords FROM (SELECT conv_id, turn, lower(text) AS q FROM conversations)""")
def text_query_analysis(spark, sf):
    q = F.col("text")
    return read(spark, sf, "conversations").select("conv_id", "turn", text.intent(q).alias("intent"), text.urgency(q).alias("urgency"), F.size(text.query_keywords(q)).cast("long").alias("n_keywords"))


@query(f"SELECT page_id, {_vote('t', text.DOCUMENT_TYPES)} AS doc_type, {_vote('t', text.DOMAINS)} AS domain, {_vote('t', text.AUDIENCES)} AS audience FROM (SELECT page_id, lower(html) AS t FROM pages)")
def text_categories(spark, sf):
    t = F.lower("html")
    return read(spark, sf, "pages").select("page_id", text.vote(t, text.DOCUMENT_TYPES).alias("doc_type"), text.vote(t, text.DOMAINS).alias("domain"), text.vote(t, text.AUDIENCES).alias("audience"))


_TTL = "CASE k " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.TTL_DAYS.items()) + " END"
_VOLATILE = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scoring.VOLATILITY.items()) + " END"


@query(f"SELECT page_id, k AS kind, {_TTL}::BIGINT AS ttl_days, {_VOLATILE} AS volatility FROM (SELECT page_id, {_rule('lower(html)', text.LEAF_TYPES, 'factual')} AS k FROM pages)")
def text_knowledge_types(spark, sf):
    k = read(spark, sf, "pages").select("page_id", text.knowledge_type(F.col("html"), F.lit(0)).alias("kind"))
    return k.select("page_id", "kind", scoring.lookup(scoring.TTL_DAYS, F.col("kind"), 60).cast("long").alias("ttl_days"), scoring.lookup(scoring.VOLATILITY, F.col("kind"), "medium").alias("volatility"))


@query("SELECT substring(sha256(lower(trim(text))), 1, 16) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def text_content_hashes(spark, sf):
    d = read(spark, sf, "documents").groupBy(text.content_hash(F.col("text")).alias("content_hash"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


_GRAMS = r"list_distinct(list_transform(range(1, greatest(len({w}) - 3, 1)), lambda i: array_to_string({w}[i : i + 4], ' ')))"


@query(rf"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations),
g AS (SELECT conv_id, turn, CASE WHEN len(w) >= 5 THEN {_GRAMS.format(w='w')} ELSE [] END AS g FROM w)
SELECT a.conv_id, a.turn, CASE WHEN len(a.g) > 0 THEN round(len(list_intersect(a.g, b.g)) / len(a.g), 6) ELSE 0 END::DOUBLE AS overlap FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""")
def text_ngram_overlap(spark, sf):
    c = read(spark, sf, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.ngram_overlap(F.col("text"), F.col("before")), 6).alias("overlap"))


# BM25, nearest neighbours and fusion


def _index(spark, sf) -> bm25.Index:
    return bm25.build(spread(read(spark, sf, "documents")).select(F.col("doc_id").alias("node_id"), text.legal_tokens(F.col("text")).alias("tokens")))


def _bm25(spark, sf, k: int) -> DataFrame:
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.legal_tokens(F.col("text")).alias("tokens"))
    return bm25.best(_index(spark, sf), asked, k)


_BM25 = rf"""docs AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY doc_id, term),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM docs),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY item_id, term),
bm25_all AS (SELECT query_id, doc_id AS node_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN terms USING (term) JOIN postings USING (term), stats GROUP BY query_id, doc_id),
bm25 AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM bm25_all WHERE score > 0)"""


@query(f"""WITH docs AS (SELECT {_TOKENS} AS t FROM documents), each AS (SELECT unnest(list_distinct(t)) AS term FROM docs), raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM each GROUP BY term)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END, 6) AS idf FROM raw""")
def bm25_terms(spark, sf):
    return _index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25} SELECT query_id, node_id, score, rank FROM bm25 WHERE rank <= 50")
def bm25_topk(spark, sf):
    return _bm25(spark, sf, 50)


def _vectors(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("v"))


def _dense(spark, sf, k: int, metric: str = "cosine") -> DataFrame:
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("node_id")).join(_vectors(spark, sf), "node_id").select(F.col("node_id").alias("query_id"), "v")
    return vectors.nearest(_vectors(spark, sf), asked, k, metric, exclude_same=True)


_DENSE = """vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
dense_all AS (SELECT q.vec_id AS query_id, b.vec_id AS node_id, round(list_dot_product(q.v, b.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(b.v, b.v)), 6) AS score FROM vec q JOIN benchmark ON item_id = q.vec_id JOIN vec b ON b.vec_id <> q.vec_id),
dense AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM dense_all)"""


@query(f"WITH {_DENSE} SELECT query_id, node_id, score, rank FROM dense WHERE rank <= 20")
def knn_cosine(spark, sf):
    return _dense(spark, sf, 20)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), g AS (SELECT q.vec_id AS query_id, b.vec_id AS node_id, list_transform(list_zip(q.v, b.v), lambda p: p[1] - p[2]) AS g FROM v q JOIN benchmark ON item_id = q.vec_id JOIN v b ON b.vec_id <> q.vec_id),
d AS (SELECT query_id, node_id, round(-list_dot_product(g, g), 6) AS score FROM g)
SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM d QUALIFY rank <= 20""")
def knn_l2(spark, sf):
    return _dense(spark, sf, 20, "l2")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM v) GROUP BY label, i) GROUP BY label),
g AS (SELECT vec_id, v, c, list_transform(list_zip(v, c), lambda p: abs(p[1] - p[2])) AS g FROM v JOIN c USING (label))
SELECT vec_id, round(1 - list_dot_product(v, c) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(c, c)), 6) AS cosine, round(list_sum(g), 6) AS l1, round(sqrt(list_dot_product(g, g)), 6) AS l2, round(list_max(g), 6) AS linf FROM g""")
def vector_distances(spark, sf):
    m = read(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.col("embedding").alias("v"))
    met = m.join(tree.centroids(m).select("cluster", F.col("v").alias("c")), "cluster")
    return met.select("vec_id", *(F.round(vectors.distance(F.col("v"), F.col("c"), k), 6).alias(k) for k in ("cosine", "l1", "l2", "linf")))


def _fused(weights: dict, k: int) -> str:
    return f"fused AS (SELECT query_id, node_id, round(sum(s), 6) AS score FROM (SELECT query_id, node_id, {weights['bm25']} / ({k} + rank) AS s FROM bm25 WHERE rank <= 50 UNION ALL SELECT query_id, node_id, {weights['dense']} / ({k} + rank) FROM dense WHERE rank <= 50) GROUP BY query_id, node_id)"


_RANKED = "SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM fused"


def _rrf(spark, sf, weights: dict, k: int) -> DataFrame:
    return fusion.ranked(fusion.reciprocal_rank({"bm25": _bm25(spark, sf, 50), "dense": _dense(spark, sf, 50)}, weights, k), ["query_id"], [F.desc("score"), F.col("node_id")])


@query(f"WITH {_BM25}, {_DENSE}, {_fused(fusion.LEGAL_WEIGHTS['single'], fusion.LEGAL_K)} {_RANKED} QUALIFY rank <= 50")
def fusion_rrf_single(spark, sf):
    return _rrf(spark, sf, fusion.LEGAL_WEIGHTS["single"], fusion.LEGAL_K).where("rank <= 50")


@query(f"WITH {_BM25}, {_DENSE}, {_fused(fusion.LEGAL_WEIGHTS['batch'], fusion.LEGAL_K)} {_RANKED} QUALIFY rank <= 60")
def fusion_rrf_batch(spark, sf):
    return _rrf(spark, sf, fusion.LEGAL_WEIGHTS["batch"], fusion.LEGAL_K).where("rank <= 60")


@query(f"WITH {_BM25}, {_DENSE}, {_fused(fusion.HYBRID_WEIGHTS, fusion.HYBRID_K)} {_RANKED} QUALIFY rank <= 20")
def fusion_rrf_hybrid(spark, sf):
    return _rrf(spark, sf, fusion.HYBRID_WEIGHTS, fusion.HYBRID_K).where("rank <= 20")


@query(f"""WITH {_BM25}, {_DENSE}, v AS (SELECT query_id, node_id, (1 - (rank - 1) / count(*) OVER (PARTITION BY query_id)) * 0.6 AS s FROM bm25 WHERE rank <= 50 UNION ALL SELECT query_id, node_id, (1 - (rank - 1) / count(*) OVER (PARTITION BY query_id)) * 0.4 FROM dense WHERE rank <= 50)
SELECT query_id, node_id, round(sum(s) / 2, 6) AS score FROM v GROUP BY query_id, node_id""")
def fusion_rank_votes(spark, sf):
    return fusion.rank_votes({"bm25": _bm25(spark, sf, 50), "dense": _dense(spark, sf, 50)}, {"bm25": 0.6, "dense": 0.4})


_SOURCED = "hits AS (SELECT b.query_id, b.node_id, b.rank, d.source, d.text FROM bm25 b JOIN documents d ON d.doc_id = b.node_id WHERE b.rank <= 50)"


@query(f"""WITH {_BM25}, {_SOURCED}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM hits QUALIFY n <= 3)
SELECT query_id, node_id, source, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM kept QUALIFY place <= 20""")
def fusion_source_diversity(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "source")
    return fusion.diverse(joins.looked_up(_bm25(spark, sf, 50), d), k=20).select("query_id", "node_id", "source", F.col("rank").alias("place"))


@query(f"""WITH {_BM25}, {_SOURCED}, w AS (SELECT query_id, node_id, rank, len({_WORDS})::BIGINT AS tokens FROM hits)
SELECT query_id, node_id, tokens, (sum(tokens) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS cum FROM w QUALIFY cum <= 3500""")
def fusion_token_budget(spark, sf):
    # only what was found is split into words
    hits = joins.looked_up(_bm25(spark, sf, 50), read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text"))
    return fusion.within_budget(hits.withColumn("tokens", F.size(text.words(F.col("text"))).cast("long")).drop("text")).select("query_id", "node_id", "tokens", "cum")


@query(f"""WITH {_BM25}, {_DENSE}, u AS (SELECT query_id, node_id, least(1, score / 10) AS score, 'bm25' AS strategy FROM bm25 WHERE rank <= 50 UNION ALL SELECT query_id, node_id, score, 'dense' FROM dense WHERE rank <= 50)
SELECT query_id, node_id, score, strategy FROM u QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY score DESC, strategy) = 1""")
def fusion_union_max(spark, sf):
    a = _bm25(spark, sf, 50).select("query_id", "node_id", scoring.bm25_clamped(F.col("score")).alias("score"), F.lit("bm25").alias("strategy"))
    b = _dense(spark, sf, 50).select("query_id", "node_id", "score", F.lit("dense").alias("strategy"))
    return fusion.union_max([a, b], ["query_id", "node_id"])


# evaluation


_QRELS = "qrels AS (SELECT item_id AS qid, list(DISTINCT doc_id) FILTER (doc_id IS NOT NULL) AS answer FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id)"


def _qrels(spark, sf) -> DataFrame:
    """item and document where the item's text is part of the document's."""
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("item"))
    d = spread(read(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "text")
    return joins.passages(d, b).select(F.col("key").alias("qid"), F.col("id").alias("doc_id")).distinct()


def _answers(spark, sf) -> tuple[DataFrame, DataFrame]:
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    rel = _qrels(spark, sf).groupBy("qid").agg(F.collect_list(F.col("doc_id").cast("string")).alias("answer"))
    top = _bm25(spark, sf, 5).select(F.col("query_id").alias("qid"), F.col("node_id").alias("id"), "rank")
    return asked.join(rel, "qid", "left"), sinks.submission(top).select("qid", "answer")


_PER_QUERY = f"""{_QRELS}, pred AS (SELECT query_id AS qid, list(node_id ORDER BY rank) AS pred FROM bm25 WHERE rank <= 5 GROUP BY query_id),
m AS (SELECT q.qid, coalesce(len(answer), 0) AS n_gt, coalesce(len(pred), 0) AS n_pred, coalesce(len(list_intersect(answer, pred)), 0) AS hits FROM qrels q LEFT JOIN pred USING (qid))"""


@query(f"WITH {_BM25}, {_PER_QUERY} SELECT qid, n_gt::BIGINT AS n_gt, n_pred::BIGINT AS n_pred, hits::BIGINT AS hits, CASE WHEN n_gt = 0 THEN NULL WHEN n_pred = 0 THEN 0 ELSE round(hits / n_gt, 6) END::DOUBLE AS recall FROM m")
def evaluate_per_query(spark, sf):
    m = evaluate.per_query(*_answers(spark, sf))
    return m.select("qid", F.col("n_gt").cast("long"), F.col("n_pred").cast("long"), F.col("hits").cast("long"), F.round("recall", 6).alias("recall"))


@query(f"WITH {_BM25}, {_PER_QUERY} SELECT round(avg(CASE WHEN n_pred = 0 THEN 0 ELSE hits / n_gt END), 6) AS recall, round(avg(CASE WHEN n_pred = 0 THEN 0 ELSE hits / n_pred END), 6) AS precision, count(*) AS n, 0::BIGINT AS violated FROM m WHERE n_gt > 0")
def evaluate_macro(spark, sf):
    return evaluate.macro(evaluate.per_query(*_answers(spark, sf)))


@query(f"""WITH {_BM25}, {_QRELS}, pred AS (SELECT query_id AS qid, list(node_id) AS pred FROM bm25 WHERE rank <= 10 GROUP BY query_id)
SELECT q.qid, round(coalesce(len(list_intersect(answer, pred)), 0) / len(answer), 6) AS recall, round(coalesce(len(list_intersect(answer, pred)) / least(10, len(pred)), 0), 6) AS precision FROM qrels q LEFT JOIN pred USING (qid) WHERE len(answer) > 0""")
def evaluate_at_10(spark, sf):
    # both are read twice
    top = materialised(_bm25(spark, sf, 10).select(F.col("query_id").alias("qid"), F.col("node_id").alias("id"), "rank"))
    return evaluate.at_k(top, materialised(_qrels(spark, sf).select("qid", F.col("doc_id").alias("id"))), 10)


@query(f"WITH {_BM25} SELECT query_id AS qid, '{{\"answer\":[' || string_agg('\"' || node_id || '\"', ',' ORDER BY rank) || ']}}' AS json FROM bm25 WHERE rank <= 5 GROUP BY query_id")
def sink_submission(spark, sf):
    return sinks.submission(_bm25(spark, sf, 5).select(F.col("query_id").alias("qid"), F.col("node_id").alias("id"), "rank")).select("qid", "json")


# joins


@query(rf"""WITH s AS (SELECT doc_id, list_distinct({_WORDS}) AS s FROM documents), e AS (SELECT doc_id, s, len(s) AS n FROM s WHERE len(s) > 0),
j AS (SELECT a.doc_id AS id, b.doc_id AS other, len(list_intersect(a.s, b.s)) AS i, a.n + b.n AS n FROM e a JOIN e b ON a.doc_id <> b.doc_id AND a.n >= 0.75 * b.n AND b.n >= 0.75 * a.n)
SELECT id, other, round(i / (n - i), 6) AS similarity, row_number() OVER (PARTITION BY id ORDER BY round(i / (n - i), 6) DESC, other) AS rank FROM j WHERE i / (n - i) >= 0.75 QUALIFY rank <= 5""")
def join_set_similarity(spark, sf):
    return joins.set_similarity(spread(read(spark, sf, "documents")).select(F.col("doc_id").alias("id"), text.words(F.col("text")).alias("items")))


@query(rf"""WITH {_KEYWORDS}, q AS (SELECT conv_id * 1000 + turn AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({_listed(text.QUERY_STOP_WORDS)}))) AS k FROM conversations),
a AS (SELECT query_id, len(k) AS n, unnest(k) AS w FROM q)
SELECT query_id, doc_id AS node_id, count(*) AS hits, round(count(*) / any_value(n), 6) AS score FROM a JOIN keywords USING (w) GROUP BY query_id, doc_id""")
def join_keyword_matches(spark, sf):
    index = materialised(spread(read(spark, sf, "documents")).select(F.col("doc_id").alias("node_id"), text.frequency_keywords(F.col("text")).alias("keywords")))
    asked = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), text.query_keywords(F.col("text")).alias("keywords"))
    return joins.keyword_matches(index, asked)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_pending(spark, sf):
    return joins.pending(read(spark, sf, "documents").select("doc_id", "source"), read(spark, sf, "labels"), "doc_id")


@query("SELECT d.doc_id, f.source AS first_source, f.doc_id AS first_doc FROM documents d JOIN (SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text) f USING (text)")
def join_carry_over(spark, sf):
    d = read(spark, sf, "documents")
    old = d.select(F.col("doc_id").alias("node_id"), "text", F.col("source").alias("first_source"), F.col("doc_id").alias("first_doc"))
    return joins.carried_over(d.select("doc_id", "text"), old, "text", ["first_source", "first_doc"]).drop("text")


# importance, usage and ingestion


_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def _signals(spark, sf) -> DataFrame:
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.usage_signals(e, "user_id")


_SIGNALS = "sig AS (SELECT user_id AS node_id, count(*) FILTER (event_type = 'view') AS access_count, max(ts) FILTER (event_type = 'view') AS last_accessed, count(*) FILTER (event_type = 'click') AS positive, count(*) FILTER (event_type = 'error') AS negative, count(*) FILTER (event_type = 'purchase') AS success, count(*) FILTER (event_type = 'error') AS failure FROM events GROUP BY user_id)"


@query(f"WITH {_SIGNALS} SELECT * REPLACE (strftime(last_accessed, '%Y-%m-%d %H:%M:%S') AS last_accessed) FROM sig")
def usage_signals(spark, sf):
    return _signals(spark, sf).withColumn("last_accessed", F.date_format("last_accessed", "yyyy-MM-dd HH:mm:ss"))


def _importance_sql(profile: str) -> str:
    w = scoring.WEIGHTS[profile]
    return f"""WITH {_SIGNALS}, s AS (SELECT node_id, 0.5 AS explicit, least(1.0, access_count / 1000) AS frequency, coalesce(greatest(0.0, 1 - floor((epoch({_AS_OF}) - floor(epoch(last_accessed))) / 86400) / 30), 0) AS recency,
 (node_id % 10) / 10 AS authority, (node_id % 4) / 4 AS criticality, 0.5 AS uniqueness, CASE WHEN positive + negative = 0 THEN 0.5 ELSE positive / (positive + negative) END AS rating, CASE WHEN success + failure = 0 THEN 0.5 ELSE success / (success + failure) END AS outcome,
 greatest(0.0, 1 - floor((epoch({_AS_OF}) - floor(epoch(last_accessed))) / 86400) / 90) AS content FROM sig WHERE last_accessed IS NOT NULL)
SELECT node_id, round(least(1.0, greatest(0.0, ({' + '.join(f'{v} * {k}' for k, v in w.items())}) / {sum(w.values())} * (0.5 + 0.5 * (content + 0.3) / 2) * 1.1)), 6)::DOUBLE AS importance FROM s"""


def _importance(spark, sf, profile: str) -> DataFrame:
    s = _signals(spark, sf).where("last_accessed is not null")
    c = {k: F.col(k) for k in ("access_count", "last_accessed", "positive", "negative", "success", "failure")}
    score = scoring.importance(
        F.lit("2024-02-01 00:00:00").cast("timestamp"), profile, explicit=F.lit(0.5), authority=F.col("node_id") % 10 / 10, criticality=F.col("node_id") % 4 / 4, uniqueness=F.lit(0.5), updated_at=F.col("last_accessed"), checked_at=F.lit(None).cast("timestamp"), boost=F.lit(0.1), **c
    )
    return s.select("node_id", F.round(score, 6).alias("importance"))


@query(_importance_sql("default"))
def importance_default(spark, sf):
    return _importance(spark, sf, "default")


@query(_importance_sql("incident"))
def importance_incident(spark, sf):
    return _importance(spark, sf, "incident")


@query(_importance_sql("onboarding"))
def importance_onboarding(spark, sf):
    return _importance(spark, sf, "onboarding")


@query(f"""WITH a AS (SELECT event_id, floor((epoch({_AS_OF}) - floor(epoch(ts))) / 86400) AS age, (epoch({_AS_OF}) - floor(epoch(ts))) / 3600 AS hours FROM events)
SELECT event_id, round(CASE WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.9 WHEN age <= 90 THEN 0.8 - (age - 30) / 60 * 0.5 ELSE 0.3 END, 6)::DOUBLE AS freshness, round(CASE WHEN hours BETWEEN 0 AND 168 THEN 0.2 * (1 - hours / 168) ELSE 0 END, 6)::DOUBLE AS boost FROM a""")
def freshness_scores(spark, sf):
    as_of, ts = F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp")
    hours = (F.unix_seconds(as_of) - F.unix_seconds(ts)) / 3600
    return read(spark, sf, "events").select("event_id", F.round(scoring.freshness(scoring.whole_days(ts, as_of)), 6).alias("freshness"), F.round(scoring.recency_boost(hours, 0.2, 168), 6).alias("boost"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def ingest_first_of_text(spark, sf):
    return ingest.first_of_text(read(spark, sf, "documents"), "text", "doc_id").select("doc_id", "source")


@query(rf"""WITH t AS (SELECT conv_id, turn, role, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS n FROM conversations)
SELECT conv_id, turn, round(CASE WHEN role = 'assistant' THEN n * 14.0 ELSE n * 1.75 END / 1e6, 9)::DOUBLE AS cost_usd, round(sum(CASE WHEN role = 'assistant' THEN n * 14.0 ELSE n * 1.75 END / 1e6) OVER (PARTITION BY conv_id ORDER BY turn), 9)::DOUBLE AS running_usd FROM t""")
def usage_costs(spark, sf):
    from pyspark.sql import Window

    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    out = F.col("role") == "assistant"
    u = read(spark, sf, "conversations").select("conv_id", "turn", F.lit("chat").alias("model"), F.when(out, 0).otherwise(n).alias("tokens_in"), F.when(out, n).otherwise(0).alias("tokens_out"))
    running = F.sum("cost_usd").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return ingest.costs(u).select("conv_id", "turn", F.round("cost_usd", 9).alias("cost_usd"), F.round(running, 9).alias("running_usd"))


@query(rf"""WITH s AS (SELECT doc_id, list_distinct({_WORDS}) AS s FROM documents), e AS (SELECT doc_id, s, len(s) AS n, doc_id IN (SELECT doc_id FROM labels) AS old FROM s WHERE len(s) > 0),
j AS (SELECT a.doc_id AS new_id, b.doc_id AS existing_id, len(list_intersect(a.s, b.s)) AS i, a.n + b.n AS n FROM e a JOIN e b ON NOT a.old AND b.old AND a.n >= 0.75 * b.n AND b.n >= 0.75 * a.n),
c AS (SELECT new_id, existing_id, round(i / (n - i), 6) AS similarity FROM j WHERE i / (n - i) >= 0.75 QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY round(i / (n - i), 6) DESC, existing_id) = 1)
SELECT new_id, existing_id, similarity, CASE WHEN similarity >= 0.98 THEN 'SKIP' WHEN similarity >= 0.9 THEN 'REPLACE' ELSE 'MERGE' END AS decision FROM c""")
def ingest_conflicts(spark, sf):
    """Documents without a label against those with one: the most similar by words, and what is done about it."""
    d = spread(read(spark, sf, "documents")).select("doc_id", text.words(F.col("text")).alias("items"))
    done = read(spark, sf, "labels").select("doc_id").distinct()
    marked = d.join(done.withColumn("old", F.lit(1)), "doc_id", "left").select(F.struct(F.coalesce("old", F.lit(0)).alias("old"), "doc_id").alias("id"), "items")
    pairs = joins.set_similarity(marked, top=1, across="old").where("id.old = 0 and other.old = 1")
    sims = pairs.select(F.col("id.doc_id").alias("new_id"), F.col("other.doc_id").alias("existing_id"), "similarity")
    return ingest.decide(ingest.conflicts(sims)).select("new_id", "existing_id", "similarity", "decision")


@query("""WITH s AS (SELECT l.doc_id AS node_id, d.text FROM labels l JOIN documents d USING (doc_id)), n AS (SELECT doc_id AS node_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
e AS (SELECT text, min(node_id) AS existing_id FROM s GROUP BY text), c AS (SELECT existing_id, count(*) AS k, any_value(e.text) AS t FROM n JOIN e USING (text) GROUP BY existing_id)
SELECT s.node_id, md5(s.text || repeat(chr(10) || chr(10) || '---' || chr(10) || chr(10) || s.text, coalesce(c.k, 0))) AS text_md5, (1 + coalesce(c.k, 0))::BIGINT AS version FROM s LEFT JOIN c ON c.existing_id = s.node_id
UNION ALL SELECT node_id, md5(text), 1 FROM n WHERE text NOT IN (SELECT text FROM e)""")
def ingest_merge(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text")
    done = read(spark, sf, "labels").select(F.col("doc_id").alias("node_id"))
    stored, new = d.join(done, "node_id", "left_semi").withColumn("version", F.lit(1)), d.join(done, "node_id", "left_anti")
    first = stored.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("node_id").alias("existing_id"))
    decisions = new.select(F.col("node_id").alias("new_id"), F.sha2("text", 256).alias("h")).join(first, "h").select("new_id", "existing_id", F.lit("MERGE").alias("decision"))
    return ingest.apply_decisions(stored, new, decisions).select("node_id", F.md5("text").alias("text_md5"), F.col("version").cast("long").alias("version"))


# graph


def _edges(spark, sf) -> DataFrame:
    n, c, s = (read(spark, sf, t) for t in ("nation", "customer", "supplier"))
    name = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    a = n.select(name("region", "n_regionkey").alias("src"), name("nation", "n_nationkey").alias("dst"), F.lit("contains").alias("relation"))
    b = c.select(name("nation", "c_nationkey").alias("src"), name("customer", "c_custkey").alias("dst"), F.lit("home_of").alias("relation"))
    return a.union(b).union(s.select(name("nation", "s_nationkey").alias("src"), name("supplier", "s_suppkey").alias("dst"), F.lit("seat_of").alias("relation")))


_EDGES = "edges AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS relation FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'home_of' FROM customer UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'seat_of' FROM supplier)"


@query(f"WITH {_EDGES}, a AS (SELECT 'region:' || r_regionkey AS start, dst AS node, 1 AS distance FROM region JOIN edges ON src = 'region:' || r_regionkey), b AS (SELECT start, dst AS node, 2 AS distance FROM a JOIN edges ON src = node) SELECT start, node, min(distance)::BIGINT AS distance FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY start, node")
def graph_traverse(spark, sf):
    starts = read(spark, sf, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("start"))
    return graph.traverse(_edges(spark, sf), starts, 2, "outgoing").withColumn("distance", F.col("distance").cast("long"))


@query(f"""WITH RECURSIVE {_EDGES}, steps AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), p AS (SELECT ['region:0', b] AS path FROM steps WHERE a = 'region:0' UNION ALL SELECT list_append(path, b) FROM p JOIN steps ON a = path[-1] WHERE len(path) <= 3 AND path[-1] <> 'supplier:1' AND NOT list_contains(path, b))
SELECT array_to_string(path, '>') AS path, (len(path) - 1)::BIGINT AS length FROM p WHERE path[-1] = 'supplier:1'""")
def graph_paths(spark, sf):
    return graph.simple_paths(_edges(spark, sf), "region:0", "supplier:1", 3).select(F.array_join("path", ">").alias("path"), F.col("length").cast("long").alias("length"))


@query("""WITH RECURSIVE e AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation), s AS (SELECT 'nation:' || s_nationkey AS start FROM supplier GROUP BY 1),
n1 AS (SELECT DISTINCT start, src AS node FROM s JOIN e ON dst = start), n2 AS (SELECT DISTINCT start, dst AS node FROM n1 JOIN e ON src = node WHERE dst <> start)
SELECT start, node, min(d)::BIGINT AS distance FROM (SELECT start, node, 1 AS d FROM n1 UNION ALL SELECT start, node, 2 FROM n2) GROUP BY start, node""")
def graph_related_nations(spark, sf):
    e = read(spark, sf, "nation").select(F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("dst"))
    starts = read(spark, sf, "supplier").select(F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("start")).distinct()
    return graph.traverse(e, starts, 2).withColumn("distance", F.col("distance").cast("long"))


@query("WITH l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) SELECT a.s AS a, b.s AS b, count(*) AS n FROM l a JOIN l b ON a.o = b.o AND a.s < b.s GROUP BY a.s, b.s HAVING count(*) >= 2")
def graph_cooccurrence(spark, sf):
    return graph.cooccurrence(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_suppkey").alias("entity")), 2)


@query("""WITH e AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_returnflag AS relation, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT least(src, dst) AS a, greatest(src, dst) AS b, (1.0 + 0.5 * (count(*) - 1))::DOUBLE AS weight, arg_min(relation, {'o': ord, 'r': relation}) AS relation FROM e GROUP BY 1, 2""")
def graph_edge_weights(spark, sf):
    li, o, c, s = (read(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.accumulated(e.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")))


@query(f"WITH {_EDGES}, x AS (SELECT unnest([src, dst]) AS id FROM edges) SELECT 'entity' AS what, regexp_extract(id, '^[a-z]+') AS kind, count(DISTINCT id) AS n FROM x GROUP BY kind UNION ALL SELECT 'edge', relation, count(*) FROM edges GROUP BY relation")
def graph_stats(spark, sf):
    e = _edges(spark, sf)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.stats(ids.withColumn("type", F.regexp_extract("id", "^[a-z]+", 0)), e)


# trees


def _members(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("node_id"), F.col("embedding").alias("v"))


_CENTERS = "vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), centers AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM vec) GROUP BY label, i) GROUP BY label)"
_COS = "round(list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a})) / sqrt(list_dot_product({b}, {b})), 6)"


@query(f"""WITH {_CENTERS}, g AS (SELECT label, vec_id, list_transform(list_zip(v, c), lambda p: p[1] - p[2]) AS g FROM vec JOIN centers USING (label)), r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(list_dot_product(g, g), 6), vec_id) AS rank FROM g QUALIFY rank <= 3)
SELECT r.label AS cluster, count(*) AS n, string_agg(substring(d.text, 1, 200), chr(10) ORDER BY rank) AS summary FROM r JOIN documents d ON d.doc_id = r.vec_id GROUP BY r.label""")
def tree_extractive_summaries(spark, sf):
    m = _members(spark, sf)
    near = tree.nearest_members(m, tree.centroids(m))
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), F.substring("text", 1, 200).alias("t"))
    return near.join(d, "node_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda s: s["t"]), "\n").alias("summary"))


@query(f"""WITH {_CENTERS}, s AS (SELECT vec_id AS node_id, centers.label AS parent, {_COS.format(a='v', b='c')} AS similarity FROM vec, centers)
SELECT v.vec_id AS node_id, x.parent, x.similarity FROM vec v LEFT JOIN (SELECT * FROM s WHERE similarity >= 0.25 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY similarity DESC, parent) = 1) x ON x.node_id = v.vec_id""")
def tree_best_parents(spark, sf):
    m = _members(spark, sf)
    got = tree.best_parents(m.select("node_id", "v"), tree.centroids(m).select(F.col("cluster").alias("parent"), "v"))
    return got.select("node_id", F.col("parent").cast("int").alias("parent"), "similarity")


@query(f"""WITH {_CENTERS}, q AS (SELECT vec_id AS query_id, v FROM vec JOIN benchmark ON item_id = vec_id), p AS (SELECT query_id, centers.label, row_number() OVER (PARTITION BY query_id ORDER BY {_COS.format(a='v', b='c')} DESC, centers.label) AS r FROM q, centers QUALIFY r <= 3),
s AS (SELECT query_id, vec.vec_id AS node_id, {_COS.format(a='q.v', b='vec.v')} AS score FROM p JOIN q USING (query_id) JOIN vec USING (label))
SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 10""")
def tree_beam(spark, sf):
    m = _members(spark, sf)
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("node_id")).join(m, "node_id").select(F.col("node_id").alias("query_id"), "v")
    return tree.beam(asked, tree.centroids(m).select(F.col("cluster").cast("long").alias("parent"), "v"), m.select(F.col("cluster").cast("long").alias("parent"), "node_id", "v"), 3, 10)


@query("SELECT label AS cluster, source, count(*) AS n FROM embeddings JOIN documents ON doc_id = vec_id GROUP BY label, source QUALIFY row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, source) <= 20")
def tree_citations(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "source")
    n = _members(spark, sf).select("cluster", "node_id").join(d, "node_id").groupBy("cluster", "source").agg(F.count(F.lit(1)).alias("n"))
    return fusion.ranked(n, ["cluster"], [F.desc("n"), F.col("source")]).where("rank <= 20").drop("rank")


@query("SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY ROLLUP (source, lang)")
def tree_stats(spark, sf):
    return read(spark, sf, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars")).select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("lang", F.lit("*")).alias("lang"), "n", "mean_chars")


@query()
def tree_kmeans_levels(spark, sf):
    return tree.kmeans_levels(_members(spark, sf).select("node_id", "v"))


@query()
def tree_soft_clusters(spark, sf):
    return tree.soft_clusters(_members(spark, sf).select("node_id", "v"), 4)


# routing and context


@query(f"SELECT conv_id, turn, unnest(string_split(CASE WHEN intent = 'troubleshooting' AND urgency > 0.7 THEN 'incident' {' '.join(f"WHEN intent = '{k}' THEN '{','.join(v)}'" for k, v in strategies.ROUTES.items())} ELSE '{','.join(strategies.OTHER_ROUTE)}' END, ',')) AS strategy FROM (SELECT conv_id, turn, {_INTENT} AS intent, {_URGENCY} AS urgency FROM (SELECT conv_id, turn, lower(text) AS q FROM conversations))")
def route_strategies(spark, sf):
    c = read(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("query_id"), "text")
    return strategies.routed(c).select("query_id.conv_id", "query_id.turn", "strategy")


@query("SELECT conv_id, turn, md5(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), chr(10))) AS context_md5 FROM conversations")
def context_last_turns(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, 0)
    return read(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.array_join(F.collect_list("text").over(w), "\n")).alias("context_md5"))


# streams


def _streamed(spark, sf, plan, mode: str, files: int | None = 100) -> DataFrame:
    folder = shared_folder(spark)
    schema = read(spark, sf, "events").schema
    # a folder or a file: the stream reads what the pattern matches
    rows = streams.stream(spark, f"{sf}/events.parque[t]", schema, files).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.run_once(plan(rows), f"{folder}/out", f"{folder}/checkpoint", mode)
    return spark.read.parquet(f"{folder}/out")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY event_type")
def stream_usage_counters(spark, sf):
    return _streamed(spark, sf, streams.usage_counters, "complete")


@query("SELECT event_id, event_type FROM events")
def stream_without_repeats(spark, sf):
    # the whole table in one trigger: no row of it is late, in whatever order its files lie
    return _streamed(spark, sf, lambda e: streams.without_repeats(e, "event_id", "ts").select("event_id", "event_type"), "append", None)


@query(rf"""WITH w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents)
SELECT doc_id, round(greatest(0.0, 1.0::DOUBLE - CASE WHEN len(w) < 20 THEN 0.3 ELSE 0 END - CASE WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / greatest(length(text), 1) < 0.5 THEN 0.2 ELSE 0 END - CASE WHEN len(w) > 0 AND len(list_distinct(w)) / len(w) < 0.3 THEN 0.3 ELSE 0 END), 6)::DOUBLE AS quality FROM w""")
def stream_analysis(spark, sf):
    folder = shared_folder(spark)
    rows = streams.stream(spark, f"{sf}/documents.parque[t]", read(spark, sf, "documents").schema)
    streams.run_once(rows.select("doc_id", F.round(text.quality(F.col("text")), 6).alias("quality")), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


# extraction


@query("SELECT conv_id AS doc_id, 'ARTICLE' AS type, 'Điều ' || (turn + 1) || '.' AS value FROM conversations UNION ALL SELECT conv_id, 'LEGAL_TERM', t FROM (SELECT conv_id, lower(string_agg('Điều ' || (turn + 1) || '. ' || text, ' ' ORDER BY turn)) AS x FROM conversations GROUP BY conv_id), (SELECT unnest([" + _listed(extract.LEGAL_TERMS) + "]) AS t) WHERE contains(x, t)")
def extract_legal_entities(spark, sf):
    return _legal_docs(spark, sf).select("doc_id", F.explode(extract.legal_entities(F.col("text"))).alias("e")).select("doc_id", "e.type", "e.value")


_HTML = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
#: A sentence that has something for the patterns, in a few forms.
_SAID = "' The auth-service depends on pay-db-' || page_id % 3 || ' and calls billing-api. It is owned by Team Alpha. Jane Doe of the storage team uses Kafka, GET /v1/users and cpu_total on 2024-03-0' || page_id % 9 || '. Urgent: fix it.'"


def _told_pages(spark, sf) -> DataFrame:
    return spread(read(spark, sf, "pages")).select("page_id", F.concat(text.html_text(F.col("html")), F.expr(_SAID.replace("||", ",").join(("concat(", ")")))).alias("t"))


#: A letter beyond ASCII is a word's to Java, not to RE2: for the SQL it is one that is a word's to both.
_ASCII = r"regexp_replace(t, '[À-ɏͰ-ϿЀ-ӿḀ-ỿ]', '_', 'g')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_ENTITIES = " UNION ".join(f"SELECT page_id, '{kind}' AS type, regexp_replace(lower(v), '^\\s+|\\s+$', '', 'g') AS name FROM (SELECT page_id, unnest({' || '.join(f'regexp_extract_all({_ASCII if kind in ("person", "endpoint") else f"lower({_ASCII})"}, {_quoted(p)}, 1)' for p in patterns)}) AS v FROM t)" for kind, patterns in extract.ENTITY_PATTERNS.items())
_RELATIONS = " UNION ".join(f"SELECT page_id, s AS source, '{kind}' AS relation, x AS target FROM (SELECT page_id, unnest(regexp_extract_all(lower(t), {_quoted(p)}, {2 if swap else 1})) AS s, unnest(regexp_extract_all(lower(t), {_quoted(p)}, {1 if swap else 2})) AS x FROM t)" for p, kind, swap in extract.RELATION_PATTERNS)


@query(f"WITH t AS (SELECT page_id, {_HTML} || {_SAID} AS t FROM pages) {_ENTITIES}")
def extract_entities(spark, sf):
    return _told_pages(spark, sf).select("page_id", F.explode(extract.entities(F.col("t"))).alias("e")).select("page_id", "e.type", "e.name")


@query(f"WITH t AS (SELECT page_id, {_HTML} || {_SAID} AS t FROM pages), e AS ({_ENTITIES}) SELECT page_id, type, name, instr(CASE WHEN type IN ('person', 'endpoint') THEN t ELSE lower(t) END, CASE type WHEN 'person' THEN 'Jane Doe' ELSE name END) - 1 AS start, substring(t, greatest(0, instr(CASE WHEN type = 'person' THEN t ELSE lower(t) END, CASE type WHEN 'person' THEN 'Jane Doe' ELSE name END) - 51) + 1, 50 + length(name) + 50) AS context FROM e JOIN t USING (page_id) WHERE type = 'technology' OR (type = 'person' AND name = 'jane doe')")
def extract_entity_contexts(spark, sf):
    """Where entities are first found, and the text around them."""
    e = _told_pages(spark, sf).select("page_id", F.explode(extract.entities(F.col("t"))).alias("e"))
    return e.where("e.type = 'technology' or (e.type = 'person' and e.name = 'jane doe')").select("page_id", "e.type", "e.name", F.col("e.start").cast("long").alias("start"), "e.context")


@query(f"WITH t AS (SELECT page_id, {_HTML} || {_SAID} AS t FROM pages), e AS ({_ENTITIES}), r AS ({_RELATIONS}) SELECT page_id, source, relation, target, CASE WHEN source IN (SELECT name FROM e WHERE e.page_id = r.page_id) AND target IN (SELECT name FROM e WHERE e.page_id = r.page_id) THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM r")
def extract_relationships(spark, sf):
    t = _told_pages(spark, sf).withColumn("names", extract.entity_names(F.col("t")))
    return t.select("page_id", F.explode(extract.relationships(F.col("t"), F.col("names"))).alias("r")).select("page_id", "r.source", "r.relation", "r.target", "r.confidence").distinct()


_DATES = " + ".join(f"len(regexp_extract_all(t, {_quoted(p)}, 1))" for p in extract.DATES)
_SECTIONS = " ".join(f"WHEN '{k}' THEN ({' + '.join(f'contains(l, {_quoted(w)})::INT' for w in ws)}) / {len(ws)}" for k, ws in text.SECTIONS.items())


@query(f"""WITH t AS (SELECT page_id, {_HTML} || {_SAID} AS t FROM pages), l AS (SELECT page_id, t, lower(t) AS l FROM t), m AS (SELECT page_id, t, l, {_vote('l', text.DOCUMENT_TYPES)} AS document_type, {_vote('l', text.DOMAINS)} AS domain, {_vote('l', text.AUDIENCES)} AS audience FROM l)
SELECT page_id, document_type, domain, audience, least(5, {_DATES})::INT AS n_dates, CASE WHEN {_any('l', extract.URGENT)} THEN 'critical' WHEN {_any('l', extract.SOON)} THEN 'high' WHEN {_any('l', extract.LATER)} THEN 'low' END AS urgency,
 round(greatest(0.1, (1.0::DOUBLE - CASE WHEN {_any('l', ["todo", "tbd", "placeholder", "[insert"])} THEN 0.3 ELSE 0 END) * CASE document_type {_SECTIONS} ELSE 1.0 END), 6)::DOUBLE AS completeness FROM m""")
def extract_metadata(spark, sf):
    return _told_pages(spark, sf).select("page_id", extract.metadata(F.col("t")).alias("m")).select("page_id", "m.document_type", "m.domain", "m.audience", F.size("m.dates").alias("n_dates"), "m.urgency", F.round("m.completeness", 6).alias("completeness"))


# strategies


def _asked(spark, sf) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _keyword_search(spark, sf, k: int = 50, ahead: DataFrame | None = None):
    """Search by BM25, scores as similarities.

    All texts that will be asked (ahead: text), where given, are searched in one pass over the documents, and searches look them up.
    """
    index = _index(spark, sf)

    def search(queries: DataFrame) -> DataFrame:
        tokens = queries.select("query_id", text.legal_tokens(F.col("text")).alias("tokens"))
        return bm25.best(index, tokens, k).select("query_id", "node_id", scoring.bm25_clamped(F.col("score")).alias("score"))

    if ahead is None:
        return search
    key = F.xxhash64("text")
    found = materialised(search(ahead.select(key.alias("query_id"), "text").dropDuplicates(["query_id"])))
    return lambda queries: queries.select("query_id", key.alias("key")).join(found.withColumnRenamed("query_id", "key"), "key").drop("key")


def _ahead(asked: DataFrame) -> DataFrame:
    """All texts that strategies ask for queries (text): themselves, their variants, clauses and hypotheses."""
    t = F.col("text")
    return asked.select(F.explode(F.concat(F.array(t), strategies.variants(t), strategies.with_sub_queries(t), strategies.hypotheses(t))).alias("text")).distinct()


_IMPORTANT = "imp AS (SELECT d.doc_id, d.source, coalesce(0.5 + 0.5 * l.quality, 0.5) AS importance FROM documents d LEFT JOIN labels l USING (doc_id))"


def _nodes(spark, sf) -> DataFrame:
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "source")
    q = read(spark, sf, "labels").select(F.col("doc_id").alias("node_id"), "quality")
    return d.join(q, "node_id", "left").select("node_id", "source", F.coalesce(0.5 + 0.5 * F.col("quality"), F.lit(0.5)).alias("importance"), F.lit(0).alias("layer"))


@query(f"""WITH {_DENSE}, {_IMPORTANT}, s AS (SELECT query_id, node_id, round(0.7 * score + 0.3 * importance, 7) AS score FROM dense JOIN imp ON doc_id = node_id WHERE rank <= 50)
SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 10""")
def strategy_semantic(spark, sf):
    met = _dense(spark, sf, 50).join(_nodes(spark, sf), "node_id").select("query_id", "node_id", F.round(scoring.combined_score(F.col("score"), F.col("importance")), 7).alias("score"))
    return fusion.ranked(met, ["query_id"], [F.desc("score"), F.col("node_id")]).where("rank <= 10")


_KEYS = rf"array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({_listed(text.QUERY_STOP_WORDS)})), ' ')"


def _found(of: str = "variants", to: str = "v", most: int = 50) -> str:
    """SQL of what the texts of a table (qid, v, text) find: the best nodes of each, with BM25 as similarity, as `<to>top`."""
    return rf"""{to}asked AS (SELECT qid, v, term, count(*) AS qtf FROM (SELECT qid, v, unnest({_TOKENS}) AS term FROM {of}) GROUP BY qid, v, term),
{to}all AS (SELECT qid, v, doc_id AS node_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM {to}asked JOIN terms USING (term) JOIN postings USING (term), stats GROUP BY qid, v, doc_id),
{to}top AS (SELECT qid, v, node_id, least(1.0::DOUBLE, score / 10) AS s FROM {to}all WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid, v ORDER BY score DESC, node_id) <= {most})"""


_VARIANTS = rf"""variants2 AS (SELECT item_id AS qid, 0 AS v, text FROM benchmark UNION ALL SELECT item_id, 1, {_KEYS} FROM benchmark),
variants AS (SELECT * FROM variants2 UNION ALL SELECT qid, 2, CASE intent {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in strategies.REWORDED.items())} END || text FROM (SELECT item_id, {_INTENT} AS intent FROM (SELECT item_id, lower(text) AS q FROM benchmark)) JOIN variants2 ON qid = item_id AND v = 1 WHERE intent IN ({_listed(strategies.REWORDED)}))"""
_CLAUSES = rf"""clauses AS (SELECT item_id AS qid, text AS whole, list_filter(list_transform(string_split_regex(text, '(?i)\s+(?:and|or)\s+|[,;?]\s*'), lambda x: trim(x)), lambda x: x <> '') AS c FROM benchmark),
variants AS (SELECT qid, 0 AS v, whole AS text FROM clauses UNION ALL SELECT qid, i, c[i] FROM (SELECT qid, whole, c, unnest(range(1, len(c) + 1)) AS i FROM clauses) WHERE c[i] <> whole AND list_position(c, c[i]) = i)"""
_TEMPLATES = {k: v.replace("'", "''") for k, v in strategies.HYPOTHESES.items()}
_HYPOTHESES = rf"""guessed AS (SELECT item_id, text, {_KEYS} AS keys, {_INTENT} AS intent FROM (SELECT item_id, text, lower(text) AS q FROM benchmark)),
variants AS (SELECT item_id AS qid, 0 AS v, replace(CASE intent WHEN 'procedural' THEN '{_TEMPLATES["procedural"]}' WHEN 'troubleshooting' THEN '{_TEMPLATES["troubleshooting"]}' ELSE '{_TEMPLATES["other"]}' END, '{{keywords}}', CASE WHEN keys <> '' THEN keys ELSE text END) AS text FROM guessed)"""


@query(f"WITH {_BM25}, {_VARIANTS}, {_found()} SELECT qid AS query_id, node_id, round(max(s), {strategies.PLACES}) AS score FROM vtop GROUP BY qid, node_id")
def strategy_multi_query(spark, sf):
    return strategies.multi_query(_asked(spark, sf), _keyword_search(spark, sf)).withColumn("score", F.round("score", strategies.PLACES))


@query(f"WITH {_BM25}, {_CLAUSES}, {_found()} SELECT qid AS query_id, node_id, round(least(1.0, max(s) * (1 + 0.2 * (count(*) - 1))), {strategies.PLACES})::DOUBLE AS score FROM vtop GROUP BY qid, node_id")
def strategy_decomposition(spark, sf):
    got = strategies.decomposition(_asked(spark, sf), _keyword_search(spark, sf), strategies.with_sub_queries(F.col("text")))
    return got.withColumn("score", F.round("score", strategies.PLACES))


@query(f"""WITH {_BM25}, {_HYPOTHESES}, {_found()}, h AS (SELECT qid, node_id, round(least(1.0, 0.9 * arg_min(s, v) + 0.1 * (count(*) - 1)), {strategies.PLACES})::DOUBLE AS score FROM vtop GROUP BY qid, node_id)
SELECT qid AS query_id, node_id, score FROM h UNION ALL SELECT query_id, node_id, round(least(1.0::DOUBLE, score / 10), {strategies.PLACES}) FROM bm25 WHERE rank <= 50 AND (query_id, node_id) NOT IN (SELECT (qid, node_id) FROM h)""")
def strategy_hyde(spark, sf):
    asked, guess = _asked(spark, sf), strategies.hypotheses(F.col("text"))
    ahead = asked.select(F.explode(F.concat(F.array("text"), guess)).alias("text"))
    got = strategies.hyde(asked, _keyword_search(spark, sf, ahead=ahead), guess)
    return got.select("query_id", "node_id", F.round("score", strategies.PLACES).alias("score"))


@query(rf"""WITH {_BM25}, {_KEYWORDS}, k AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({_listed(text.QUERY_STOP_WORDS)})))) AS w FROM benchmark),
g AS (SELECT DISTINCT query_id, doc_id AS node_id FROM k JOIN keywords USING (w)), u AS (SELECT query_id, node_id, 0.4::DOUBLE * 0.8 AS s FROM g UNION ALL SELECT query_id, node_id, 0.6::DOUBLE * least(1.0::DOUBLE, score / 10) FROM bm25 WHERE rank <= 50)
SELECT query_id, node_id, round(sum(s), {strategies.PLACES})::DOUBLE AS score FROM u GROUP BY query_id, node_id""")
def strategy_hybrid_graph_tree(spark, sf):
    asked = _asked(spark, sf)
    index = materialised(spread(read(spark, sf, "documents")).select(F.col("doc_id").alias("node_id"), text.frequency_keywords(F.col("text")).alias("keywords")))
    linked = joins.keyword_matches(index, asked.select("query_id", text.query_keywords(F.col("text")).alias("keywords")))
    return strategies.hybrid(linked, _keyword_search(spark, sf)(asked))


@query(f"""WITH {_BM25}, {_VARIANTS.replace("variants AS", "reworded AS")}, {_CLAUSES.replace("variants AS", "parted AS")}, {_HYPOTHESES.replace("variants AS", "supposed AS").replace("guessed", "guesses")}, {_found("reworded", "m", 30)}, {_found("parted", "d", 30)}, {_found("supposed", "h", 30)}, {_IMPORTANT},
route AS (SELECT item_id AS query_id, CASE WHEN {_INTENT} = 'troubleshooting' AND {_URGENCY} > 0.7 THEN 'incident' ELSE {_INTENT} END AS r FROM (SELECT item_id, lower(text) AS q FROM benchmark)),
own AS (SELECT query_id, node_id, least(1.0::DOUBLE, score / 10) AS s FROM bm25 WHERE rank <= 30), hyde AS (SELECT qid AS query_id, node_id, least(1.0, 0.9 * arg_min(s, v) + 0.1 * (count(*) - 1)) AS s FROM htop GROUP BY qid, node_id),
each AS (SELECT query_id, node_id, s, 'bm25_hybrid' AS strategy FROM own UNION ALL SELECT * , 'hyde' FROM (SELECT * FROM hyde UNION ALL SELECT * FROM own WHERE (query_id, node_id) NOT IN (SELECT (query_id, node_id) FROM hyde))
  UNION ALL SELECT qid, node_id, max(s), 'multi_query' FROM mtop GROUP BY qid, node_id UNION ALL SELECT qid, node_id, least(1.0, max(s) * (1 + 0.2 * (count(*) - 1))), 'query_decomposition' FROM dtop GROUP BY qid, node_id),
taken AS (SELECT e.* FROM each e JOIN route USING (query_id) WHERE r <> 'incident' AND (strategy IN ('hyde', 'bm25_hybrid') OR (strategy = 'query_decomposition' AND r NOT IN ('procedural', 'troubleshooting')) OR (strategy = 'multi_query' AND r NOT IN ('procedural', 'relational', 'troubleshooting'))) QUALIFY row_number() OVER (PARTITION BY query_id, strategy ORDER BY s DESC, node_id) <= 30),
best AS (SELECT query_id, node_id, max(s) AS s, arg_min(strategy, {{'s': -s, 'n': strategy}}) AS strategy FROM taken GROUP BY query_id, node_id),
scored AS (SELECT query_id, node_id, strategy, round(0.7 * s + 0.3 * importance, {strategies.PLACES})::DOUBLE AS score FROM best JOIN imp ON doc_id = node_id)
SELECT query_id, node_id, score, strategy, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM scored QUALIFY rank <= 10""")
def strategy_orchestrated(spark, sf):
    search = _keyword_search(spark, sf, 30, _ahead(_asked(spark, sf)))
    each = {"hyde": lambda q: strategies.hyde(q, search, strategies.hypotheses(F.col("text"))), "multi_query": lambda q: strategies.multi_query(q, search), "query_decomposition": lambda q: strategies.decomposition(q, search, strategies.with_sub_queries(F.col("text"))), "bm25_hybrid": search}
    return strategies.retrieve(_asked(spark, sf), each, _nodes(spark, sf))


@query(rf"""WITH {_BM25}, h AS (SELECT b.query_id, b.rank, d.source, d.text, min(b.rank) OVER (PARTITION BY b.query_id, d.source) AS first FROM bm25 b JOIN documents d ON d.doc_id = b.node_id WHERE b.rank <= 10),
n AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS n FROM h)
SELECT query_id, md5(string_agg('[' || n || '] ' || source || chr(10) || regexp_replace(text, '[
]+', ' ', 'g'), chr(10) || chr(10) ORDER BY rank)) AS context_md5, count(DISTINCT source)::BIGINT AS n_sources FROM n GROUP BY query_id""")
def answer_context(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text", "source")
    got = strategies.cited_context(_bm25(spark, sf, 10), d)
    return got.select("query_id", F.md5("context").alias("context_md5"), F.size("citations").cast("long").alias("n_sources"))


@query()
def answer_questions(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text", "source")
    context = strategies.cited_context(_bm25(spark, sf, 3), d)
    model = ports.Ports()
    return _asked(spark, sf).join(context, "query_id").select("query_id", model.answer(F.col("text"), F.col("context")).alias("answer"), F.size("citations").alias("n_sources"))


# trees again


@query(f"""WITH {_CENTERS}, s AS (SELECT vec_id AS node_id, centers.label AS parent, {_COS.format(a='v', b='c')} AS similarity FROM vec, centers), b AS (SELECT node_id, parent FROM s WHERE similarity >= 0.25 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY similarity DESC, parent) = 1)
SELECT parent::BIGINT AS parent, count(*) AS n FROM b GROUP BY parent UNION ALL SELECT NULL, count(*) FROM vec WHERE vec_id NOT IN (SELECT node_id FROM b) HAVING count(*) > 0""")
def tree_insert(spark, sf):
    m = _members(spark, sf)
    got = tree.insert(m.select("node_id", "v"), tree.centroids(m).select(F.col("cluster").cast("long").alias("parent"), "v"))
    return got.groupBy(F.when(~F.col("is_new"), F.col("parent")).alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS tree_id, doc_id AS old_index, row_number() OVER (ORDER BY source, doc_id) - 1 AS new_index FROM documents")
def tree_merge(spark, sf):
    return tree.merge(read(spark, sf, "documents").select(F.col("source").alias("tree_id"), F.col("doc_id").alias("index")))


@query()
def tree_build(spark, sf):
    model = ports.Ports()
    leaves = read(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("v")).join(read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text"), "node_id")
    nodes, edges = tree.build(leaves, model.summarise, model.embed)
    return nodes.join(edges.groupBy(F.col("parent").alias("node_id")).agg(F.count(F.lit(1)).alias("children")), "node_id", "left").select("node_id", "layer", F.coalesce("children", F.lit(0)).alias("children"))


# predicates and keywords


_NODE = "n AS (SELECT doc_id AS node_id, text, source, CASE doc_id % 5 WHEN 0 THEN 'procedural' WHEN 1 THEN 'contextual' WHEN 2 THEN 'relational' WHEN 3 THEN 'policy' ELSE 'factual' END AS kind, CASE doc_id % 6 WHEN 0 THEN 'archived' WHEN 1 THEN 'deprecated' ELSE 'valid' END AS status, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 200) AS seen_at FROM documents)"


def _typed_nodes(spark, sf) -> DataFrame:
    """Documents as nodes with a type, a status and a time worked out from their id."""
    i = F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, ("procedural", "contextual", "relational", "policy", "factual"))), (i % 5).cast("int"))
    status = F.get(F.array(*map(F.lit, ("archived", "deprecated", "valid", "valid", "valid", "valid"))), (i % 6).cast("int"))
    return read(spark, sf, "documents").select(i.alias("node_id"), "text", "source", kind.alias("kind"), status.alias("status"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((i % 200).cast("int"))).alias("at"))


@query(f"WITH {_NODE} SELECT node_id, status NOT IN ('archived', 'deprecated') AND seen_at > TIMESTAMP '2024-03-01' AS active, floor((epoch(TIMESTAMP '2024-08-01') - epoch(seen_at)) / 86400) > CASE kind WHEN 'procedural' THEN 90 WHEN 'contextual' THEN 1 WHEN 'relational' THEN 30 WHEN 'policy' THEN 180 ELSE 60 END AS stale FROM n")
def node_status(spark, sf):
    n = _typed_nodes(spark, sf)
    return n.select("node_id", predicates.active(F.col("status"), F.col("at"), F.lit("2024-03-01").cast("timestamp")).alias("active"), predicates.stale(F.col("at"), F.col("kind"), F.lit("2024-08-01").cast("timestamp")).alias("stale"))


@query(f"WITH {_NODE}, {_KEYWORDS}, k AS (SELECT doc_id, list(w) AS k FROM keywords GROUP BY doc_id) SELECT node_id, len(list_intersect(coalesce(k, []), ['ation', 'ndre', 'ered', 'und', 'les'])) > 0 AS matches FROM n LEFT JOIN k ON doc_id = node_id")
def node_keyword_matches(spark, sf):
    wanted = F.array(*map(F.lit, ("ATION", "ndre", "Ered", "und", "les")))
    return spread(read(spark, sf, "documents")).select(F.col("doc_id").alias("node_id"), F.coalesce(predicates.matches_keywords(text.frequency_keywords(F.col("text")), wanted), F.lit(False)).alias("matches"))


@query("SELECT doc_id AS node_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100")
def node_sample(spark, sf):
    return predicates.sampled(read(spark, sf, "documents").select(F.col("doc_id").alias("node_id")), "node_id", 100)


@query(f"WITH {_NODE}, l AS (SELECT node_id, text, node_id % 4 AS layer FROM n) SELECT node_id, round(0.5 + 0.1 * layer / 3, 6)::DOUBLE AS explicit, round(0.5 + 0.1 * layer / 3 + 0.1 * least(1.0, length(text) / 500), 6)::DOUBLE AS authority FROM l")
def node_built_importance(spark, sf):
    b = predicates.built_importance(F.col("doc_id") % 4, F.lit(3), F.col("text"), F.lit(0))
    return read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), b.alias("b")).select("node_id", F.round("b.explicit", 6).alias("explicit"), F.round("b.authority", 6).alias("authority"))


@query(f"""WITH docs AS (SELECT conv_id * 1000 + turn AS node_id, {_TOKENS} AS t FROM conversations), grams AS (SELECT node_id, unnest(list_concat(list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END), CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) ELSE [] END)) AS term FROM docs),
tf AS (SELECT node_id, term, count(*) AS tf FROM grams GROUP BY node_id, term), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT node_id, term, tf * idf AS w FROM tf JOIN idf USING (term)), s AS (SELECT node_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY node_id)), 6) AS score FROM w)
SELECT node_id, term, score, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, term) AS rank FROM s QUALIFY rank <= 10""")
def keywords_tfidf(spark, sf):
    c = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node_id"), keywords.ngrams(text.legal_tokens(F.col("text"))).alias("terms"))
    return keywords.tfidf(c)


@query(f"""WITH {_KEYWORDS}, leaf AS (SELECT DISTINCT 'd' || doc_id AS node_id, w AS keyword FROM keywords), up AS (SELECT 's' || source AS node_id, keyword, count(*) AS n FROM leaf JOIN documents ON 'd' || doc_id = node_id GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY 's' || source ORDER BY count(*) DESC, keyword) <= 10),
root AS (SELECT 'root' AS node_id, keyword, count(*) AS n FROM up GROUP BY keyword QUALIFY row_number() OVER (ORDER BY count(*) DESC, keyword) <= 10)
SELECT node_id, keyword, 1::BIGINT AS n FROM leaf UNION ALL SELECT * FROM up UNION ALL SELECT * FROM root""")
def keywords_propagated(spark, sf):
    d = spread(read(spark, sf, "documents"))
    leaf = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    parent = F.concat(F.lit("s"), "source")
    own = d.select(leaf.alias("node_id"), F.explode(text.frequency_keywords(F.col("text"))).alias("keyword"))
    edges = d.select(parent.alias("parent"), leaf.alias("child")).union(d.select(F.lit("root"), parent).distinct())
    return keywords.propagated(own, edges, 10, 2)


# a legal graph and its retrieval


@query(rf"""WITH {_KEYWORDS}, links AS (SELECT doc_id, w FROM keywords), asked AS (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({_listed(text.QUERY_STOP_WORDS)}))) AS entity FROM benchmark)
SELECT query_id, 'd' || doc_id AS node_id, round(count(*) * 0.5, 6)::DOUBLE AS score FROM asked JOIN links ON w = entity GROUP BY query_id, doc_id""")
def graph_retrieval(spark, sf):
    # the keywords are asked for in four places
    d = materialised(spread(read(spark, sf, "documents")).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_id"), F.explode(text.frequency_keywords(F.col("text"))).alias("w")))
    entity = F.concat(F.lit("e:"), "w")
    # entity nodes stand under their value; documents are their neighbours
    terms = d.select(F.col("w").alias("term"), entity.alias("node_id"), F.col("w").alias("value")).distinct()
    asked = _asked(spark, sf).select("query_id", F.explode(text.query_keywords(F.col("text"))).alias("entity"))
    return graph.retrieval_scores(terms, d.select(entity.alias("src"), F.col("node_id").alias("dst")), d.select("node_id").distinct(), asked)


@query()
def index_ivf(spark, sf):
    index = vector_index.build(_vectors(spark, sf))
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("node_id")).join(_vectors(spark, sf), "node_id").select(F.col("node_id").alias("query_id"), "v")
    return vector_index.search(index, asked, 20)


@query()
def tree_best_mixture(spark, sf):
    return tree.best_mixture(_members(spark, sf).select("node_id", "v"), 6)


# ingestion as one plan


@query(rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: {_trimmed('x')}), lambda x: x <> '') AS p FROM documents), c AS (SELECT doc_id, i - 1 AS pos, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id, pos) = 1), w AS (SELECT *, {_WORDS} AS w FROM f),
q AS (SELECT doc_id, pos, text, round(greatest(0.0, 1.0::DOUBLE - CASE WHEN len(w) < 20 THEN 0.3 ELSE 0 END - CASE WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / greatest(length(text), 1) < 0.5 THEN 0.2 ELSE 0 END - CASE WHEN len(w) > 0 AND len(list_distinct(w)) / len(w) < 0.3 THEN 0.3 ELSE 0 END), 6)::DOUBLE AS quality FROM w)
SELECT doc_id, pos, substring(md5(text), 1, 8) AS chunk_hash, quality FROM q WHERE quality >= 0.6""")
def ingest_chunks(spark, sf):
    d = spread(read(spark, sf, "documents")).select("doc_id", "text")
    got = ingest.process(d, lambda t: chunks.paragraphs(t, r"\n+"), least=0.6)
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), F.substring(F.md5("text"), 1, 8).alias("chunk_hash"), F.round("quality", 6).alias("quality"))


# the legal graph, semantic chunks, stateful streams


_LEGAL_IDS = "ent AS (SELECT conv_id::VARCHAR AS doc, 'entity_Điều ' || (turn + 1) || '._ARTICLE' AS e FROM conversations UNION SELECT conv_id::VARCHAR, 'entity_' || substring(t, 1, 30) || '_LEGAL_TERM' FROM (SELECT conv_id, lower(string_agg('Điều ' || (turn + 1) || '. ' || text, ' ' ORDER BY turn)) AS x FROM conversations GROUP BY conv_id), (SELECT unnest([" + _listed(extract.LEGAL_TERMS) + "]) AS t) WHERE contains(x, t))"


@query(f"WITH {_LEGAL_IDS}, arts AS (SELECT DISTINCT e FROM ent WHERE e LIKE '%ARTICLE') SELECT doc AS a, e AS b, 'contains' AS relation, 1.0::DOUBLE AS weight FROM ent UNION ALL SELECT x.e, y.e, 'co_occurs', 0.5 FROM arts x JOIN arts y ON x.e < y.e")
def graph_legal_edges(spark, sf):
    # articles share the word "điều"; the invented texts have no relation words
    return graph.legal(_legal_docs(spark, sf).select(F.col("doc_id").alias("node_id"), "text"))[1]


@query()
def chunk_semantic_cuts(spark, sf):
    units = spread(read(spark, sf, "documents")).select("doc_id", F.posexplode(chunks.sentences(F.col("text"))).alias("pos", "t"))
    sized = units.select("doc_id", "pos", F.size(text.words(F.col("t"))).alias("tokens"), ports.hashed_embedding(F.col("t")).alias("v"))
    return chunks.semantic_cuts(sized).select("doc_id", "pos", "tokens", "cut")


@query("SELECT user_id AS node_id, round(sum(value), 6) AS boost FROM (SELECT user_id, value, ts, max(ts) OVER (PARTITION BY user_id) AS newest FROM events) WHERE epoch(ts) > epoch(newest) - 86400 GROUP BY user_id")
def stream_lasting_boosts(spark, sf):
    def plan(rows: DataFrame) -> DataFrame:
        return streams.lasting_boosts(rows.withWatermark("ts", "60 days").select(F.col("user_id").alias("node_id"), F.col("value").alias("boost"), "ts"))

    return _streamed(spark, sf, plan, "update").groupBy("node_id").agg(F.max_by("boost", "batch").alias("boost"))


@query("SELECT doc_id % 3 AS tree_id, count(*) AS nodes, max(doc_id % 4)::BIGINT AS layers FROM documents GROUP BY 1")
def source_trees(spark, sf):
    path = shared_folder(spark)
    d = read(spark, sf, "documents").select((F.col("doc_id") % 3).alias("tree_id"), F.col("doc_id").alias("node_id"), "text", (F.col("doc_id") % 4).alias("layer"))
    sinks.save_tree(d, path)
    return sinks.list_trees(spark, path).select(F.col("tree_id").cast("long").alias("tree_id"), "nodes", F.col("layers").cast("long").alias("layers"))


from quern.plans import growth_queries, more_queries, retrieval_queries  # noqa: E402, F401  # register their queries here
