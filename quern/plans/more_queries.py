"""More of the engine's queries: graphs with filters and paths, tree upkeep, caches and budgets, lookups, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import extract, predicates, scoring, text, vectors
from quern.operators import chunks, fusion, graph, ingest, joins, tree
from quern.plans import ingestion, ports
from quern.plans.queries import _CENTERS, _COS, _EDGES, _IMPORTANT, _NODE, _SIGNALS, _WORDS, _edges, _listed, _members, _signals, _typed_nodes, query
from quern.session import read, spread
from quern.sources import readers

# sources and sinks


@query("SELECT doc_id, max(n) AS version FROM (SELECT doc_id, 1 AS n FROM documents UNION ALL SELECT doc_id, 2 FROM labels) GROUP BY doc_id")
def sink_restored(spark, sf):
    a = read(spark, sf, "documents").select("doc_id", F.lit(1).alias("version"))
    b = read(spark, sf, "labels").select("doc_id", F.lit(2).alias("version"))
    return readers.restored([a, b], "doc_id", "version")


@query("SELECT doc_id, 'embedding-small|' || sha256(text) AS embedding_key, 'chat|' || doc_id % 4 || '|60|' || sha256(text) AS summary_key FROM documents")
def cache_keys(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", ingest.embedding_key("embedding-small", t).alias("embedding_key"), ingest.summary_key("chat", F.col("doc_id") % 4, 60, t).alias("summary_key"))


@query("SELECT sha256(text) AS key, count(*) AS asked, (min(doc_id) % 3 = 0)::BOOLEAN AS hit FROM documents GROUP BY 1")
def cache_hits_and_misses(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    have = d.groupBy("key").agg(F.min("doc_id").alias("first")).where("first % 3 = 0").select("key", F.lit(True).alias("hit"))
    got, _ = ingest.cached(d, have, "key", lambda missing: missing.select("key", F.lit(False).alias("hit")))
    return got.groupBy("key").agg(F.count(F.lit(1)).alias("asked"), F.first("hit").alias("hit"))


@query(rf"""WITH g AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS a, regexp_extract_all(lower(text || ' more words at the end'), '[a-z0-9]+') AS b FROM g),
n AS (SELECT conv_id, turn, CASE WHEN len(a) >= 5 THEN list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i : i + 4], ' '))) ELSE [] END AS a, CASE WHEN len(b) >= 5 THEN list_distinct(list_transform(range(1, len(b) - 3), lambda i: array_to_string(b[i : i + 4], ' '))) ELSE [] END AS b FROM w)
SELECT conv_id, turn FROM n WHERE len(a) > 0 AND len(list_intersect(a, b)) / len(a) >= 0.9""")
def cache_stale_summaries(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("summary"), F.concat("text", F.lit(" more words at the end")).alias("context"))
    return ingest.stale_summaries(c).select("conv_id", "turn")


@query("""WITH u AS (SELECT event_id, user_id, ts, floor(value)::BIGINT AS n FROM events), c AS (SELECT event_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) - n AS before FROM u)
SELECT event_id, before * 1.75 / 1e6 <= 0.0005 AS allowed FROM c""")
def usage_budget(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "ts", F.lit("chat").alias("model"), F.floor("value").alias("tokens_in"), F.lit(0).alias("tokens_out"))
    # no whole number of tokens costs the budget to the cent, so sums of doubles decide as whole ones do
    return ingest.within_budget(e, 0.0005, "user_id", ["ts", "event_id"]).select("event_id", "allowed")


@query("""WITH c AS (SELECT substring(sha256(doc_id || '|' || text), 1, 16) AS change_id, doc_id FROM documents)
SELECT change_id, CASE WHEN doc_id % 4 <> 0 THEN 'pending' WHEN doc_id % 8 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM c""")
def sink_pending_changes(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text")
    changes = ingest.submitted(d, F.lit(1))
    verdicts = ingest.submitted(d.where("node_id % 4 = 0"), F.lit(2)).join(ingest.submitted(d.where("node_id % 8 = 0"), F.lit(2)).select("change_id", F.lit(True).alias("yes")), "change_id", "left")
    return ingest.changed_status(ingest.reviewed(changes, verdicts.select("change_id", F.coalesce("yes", F.lit(False)).alias("approved"), "at")))


# chunks


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)\{\{.*?\}\}', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM pages")
def chunk_without_provenance(spark, sf):
    p = read(spark, sf, "pages")
    return p.select("page_id", F.md5(text.without_provenance(F.concat(F.lit("Source: wiki\nURL: http://x\n"), "html"))).alias("text_md5"))


_PACKED = r"""units AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS u FROM documents),
packing AS (SELECT doc_id, list_reduce(list_transform(u, lambda x: {'cur': x, 'n': len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')), 'out': []::VARCHAR[]}), lambda a, b: CASE WHEN a.n + b.n <= 500 THEN {'cur': a.cur || chr(10) || chr(10) || b.cur, 'n': a.n + b.n, 'out': a.out} ELSE {'cur': b.cur, 'n': b.n, 'out': list_append(a.out, a.cur)} END) AS p FROM units WHERE len(u) > 0),
chunks AS (SELECT doc_id, list_append(p.out, p.cur) AS c FROM packing)"""


@query(f"WITH {_PACKED} SELECT doc_id, i - 1 AS pos, md5(c[i]) AS text_md5 FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM chunks)")
def chunk_plain_packed(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(chunks.packed(chunks.paragraphs(F.col("text"), r"\n+"))).alias("pos", "t"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("t").alias("text_md5"))


@query(rf"""WITH {_PACKED}, w AS (SELECT doc_id, c, list_transform(c, lambda x: list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) AS w FROM chunks)
SELECT doc_id, i - 1 AS pos, md5(CASE WHEN i = 1 THEN c[i] ELSE array_to_string(w[i - 1][greatest(len(w[i - 1]) - 19, 1) :], ' ') || chr(10) || chr(10) || c[i] END) AS text_md5 FROM (SELECT doc_id, c, w, unnest(range(1, len(c) + 1)) AS i FROM w)""")
def chunk_packed_with_overlap(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(chunks.packed_with_overlap(chunks.paragraphs(F.col("text"), r"\n+"), 500, 20)).alias("pos", "t"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("t").alias("text_md5"))


@query(r"""WITH marked AS (SELECT doc_id, regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g') AS t FROM documents), s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\x01|\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM marked)
SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS text_md5 FROM s""")
def chunk_sentences(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", chunks.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("text_md5"))


@query(r"""WITH b AS (SELECT conv_id, list_filter(string_split(string_agg(text, chr(10) || chr(10) ORDER BY turn), chr(10) || chr(10)), lambda x: trim(x) <> '') AS u FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, list_reduce(list_transform(u, lambda x: {'cur': x, 'n': len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')), 'out': []::VARCHAR[]}), lambda a, b: CASE WHEN a.n + b.n <= 500 THEN {'cur': a.cur || chr(10) || chr(10) || b.cur, 'n': a.n + b.n, 'out': a.out} ELSE {'cur': b.cur, 'n': b.n, 'out': list_append(a.out, a.cur)} END) AS p FROM b WHERE len(u) > 0)
SELECT conv_id, md5(array_to_string(list_append(p.out, p.cur), '|')) AS chunks_md5 FROM p""")
def chunk_code_dispatched(spark, sf):
    """Conversations as code: blocks between blank lines, by content type."""
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n\n").alias("text"))
    return c.select("conv_id", F.md5(F.array_join(chunks.dispatched(F.col("text"), F.lit("code")), "|")).alias("chunks_md5"))


@query(r"SELECT conv_id, string_agg(trim(text), '|' ORDER BY turn) AS bodies, count(*) AS n FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations) GROUP BY conv_id")
def chunk_markdown_sections(spark, sf):
    """Conversations as markdown: each turn a section under a heading."""
    part = F.concat(F.lit("## Turn\n"), "text")
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))), lambda s: s["t"]), "\n").alias("text"))
    s = c.select("conv_id", chunks.markdown_sections(F.col("text")).alias("s"))
    return s.select("conv_id", F.array_join(F.transform("s", lambda x: F.trim(F.regexp_replace(x["body"], r"^## Turn\n?", ""))), "|").alias("bodies"), F.size("s").cast("long").alias("n"))


@query("SELECT conv_id, turn, turn + 1 AS num, md5(trim(text)) AS body_md5 FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations)")
def chunk_clauses(spark, sf):
    """Turns as a clause each, cut out of one text."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", chunks.clauses(F.concat(F.lit("Khoản "), (F.col("turn") + 1).cast("string"), F.lit(". "), "text")).alias("c"))
    return c.select("conv_id", "turn", F.explode("c").alias("c")).select("conv_id", "turn", F.col("c.num").cast("long").alias("num"), F.md5("c.body").alias("body_md5"))


@query(r"""WITH u AS (SELECT conv_id, list('## Turn' || chr(10) || t ORDER BY turn) AS u FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations) GROUP BY conv_id),
p AS (SELECT conv_id, list_reduce(list_transform(u, lambda x: {'cur': x, 'n': len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')), 'out': []::VARCHAR[]}), lambda a, b: CASE WHEN a.n + b.n <= 60 THEN {'cur': a.cur || chr(10) || chr(10) || b.cur, 'n': a.n + b.n, 'out': a.out} ELSE {'cur': b.cur, 'n': b.n, 'out': list_append(a.out, a.cur)} END) AS p FROM u),
c AS (SELECT conv_id, list_append(p.out, p.cur) AS c FROM p), w AS (SELECT conv_id, c, list_transform(c, lambda x: list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) AS w FROM c)
SELECT conv_id, i - 1 AS pos, md5(CASE WHEN i = 1 THEN c[i] ELSE array_to_string(w[i - 1][greatest(len(w[i - 1]) - 9, 1) :], ' ') || chr(10) || chr(10) || c[i] END) AS text_md5 FROM (SELECT conv_id, c, w, unnest(range(1, len(c) + 1)) AS i FROM w)""")
def chunk_markdown_packed(spark, sf):
    """Conversations as markdown, a section a turn, packed with overlap."""
    part = F.concat(F.lit("## Turn\n"), F.regexp_replace("text", r"^\s+|\s+$", ""))
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))), lambda s: s["t"]), "\n").alias("text"))
    return c.select("conv_id", F.posexplode(chunks.markdown_packed(F.col("text"), 60, 10)).alias("pos", "t")).select("conv_id", F.col("pos").cast("long").alias("pos"), F.md5("t").alias("text_md5"))


@query(r"""WITH u AS (SELECT conv_id, turn, text, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n, [length(text) % 5, length(text) % 7, length(text) % 3, 1]::DOUBLE[] AS v FROM conversations),
s AS (SELECT *, list_dot_product(v, x) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(x, x))) AS sim FROM (SELECT *, lead(v) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM u)),
f AS (SELECT *, coalesce(sim < least(0.99, greatest(0.0, least(0.78, avg(sim) OVER (PARTITION BY conv_id) - 0.5 * stddev_pop(sim) OVER (PARTITION BY conv_id)))), true) AS cut FROM s),
g AS (SELECT conv_id, list({'t': text, 'n': n, 'cut': cut} ORDER BY turn) AS u FROM f GROUP BY conv_id),
segments AS (SELECT conv_id, list_reduce(list_prepend({'cur': '', 'n': 0, 'out': []::VARCHAR[], 't': '', 'm': 0, 'cut': false}, list_transform(u, lambda x: {'cur': '', 'n': 0, 'out': []::VARCHAR[], 't': x.t, 'm': x.n, 'cut': x.cut})), lambda a, b:
  CASE WHEN b.cut AND (CASE WHEN a.cur <> '' AND a.n + b.m > 60 THEN b.m ELSE a.n + b.m END) >= 20 THEN {'cur': '', 'n': 0, 'out': list_append(CASE WHEN a.cur <> '' AND a.n + b.m > 60 THEN list_append(a.out, a.cur) ELSE a.out END, CASE WHEN a.cur = '' OR a.n + b.m > 60 THEN b.t ELSE a.cur || ' ' || b.t END), 't': '', 'm': 0, 'cut': false}
  ELSE {'cur': CASE WHEN a.cur = '' OR a.n + b.m > 60 THEN b.t ELSE a.cur || ' ' || b.t END, 'n': CASE WHEN a.cur <> '' AND a.n + b.m > 60 THEN b.m ELSE a.n + b.m END, 'out': CASE WHEN a.cur <> '' AND a.n + b.m > 60 THEN list_append(a.out, a.cur) ELSE a.out END, 't': '', 'm': 0, 'cut': false} END) AS p FROM g),
whole AS (SELECT conv_id, CASE WHEN p.cur = '' THEN p.out ELSE list_append(p.out, p.cur) END AS u FROM segments),
packing AS (SELECT conv_id, list_reduce(list_transform(u, lambda x: {'cur': x, 'n': len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')), 'out': []::VARCHAR[]}), lambda a, b: CASE WHEN a.n + b.n <= 60 THEN {'cur': a.cur || chr(10) || chr(10) || b.cur, 'n': a.n + b.n, 'out': a.out} ELSE {'cur': b.cur, 'n': b.n, 'out': list_append(a.out, a.cur)} END) AS p FROM whole)
SELECT conv_id AS doc_id, i - 1 AS pos, md5(c[i]) AS text_md5 FROM (SELECT conv_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT conv_id, list_append(p.out, p.cur) AS c FROM packing))""")
def chunk_semantic(spark, sf):
    """Turns as units, cut where neighbours differ and packed; vectors from the turns' lengths, so that SQL has them too."""
    n = F.length("text")
    v = F.array(*(x.cast("double") for x in (n % 5, n % 7, n % 3, F.lit(1))))
    units = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("tokens"), v.alias("v"))
    return chunks.semantic_chunks(units, 60, 20, 0).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("text").alias("text_md5"))


# predicates, lookups and scores


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'procedural' WHEN 1 THEN 'factual' WHEN 2 THEN 'temporal' WHEN 3 THEN 'policy' ELSE 'factual' END AS kind FROM documents")
def node_parsed_types(spark, sf):
    name = F.get(F.array(*map(F.lit, (" Runbook", "DOCS", "postmortem ", "sla", "unheard of"))), (F.col("doc_id") % 5).cast("int"))
    return read(spark, sf, "documents").select("doc_id", scoring.parsed_type(name).alias("kind"))


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' AND (user_id % 3 = 0 OR ts + INTERVAL 7 DAY >= TIMESTAMP '2024-01-15 00:00:00')")
def graph_active_edges(spark, sf):
    ts = F.col("ts").cast("timestamp")
    e = read(spark, sf, "events").select("event_id", ts.alias("valid_from"), F.when(F.col("user_id") % 3 != 0, ts + F.expr("INTERVAL 7 DAY")).alias("valid_until"))
    return graph.active(e, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey % 2 = 0 AND (contains(lower(s_name), '00') OR contains(lower('Alias ' || s_nationkey), '00')) UNION ALL SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 1 AND contains(lower(s_name), '1')")
def node_entities_found(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd").alias("type"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("display"), F.array(F.concat(F.lit("Alias "), F.col("s_nationkey").cast("string"))).alias("aliases"), F.array(F.lit("x"), F.lit("y")).alias("tags"))
    even = predicates.find_entities(s, "even", "00", tags=["y"])
    return even.select("id").union(predicates.find_entities(s.withColumn("aliases", F.lit(None).cast("array<string>")), "odd", "1").select("id"))


@query(f"WITH {_IMPORTANT} SELECT doc_id AS node_id, importance FROM imp WHERE importance >= 0.6 ORDER BY importance DESC, doc_id LIMIT 50")
def node_most_important(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"))
    q = read(spark, sf, "labels").select(F.col("doc_id").alias("node_id"), "quality")
    return predicates.by_importance(d.join(q, "node_id", "left").select("node_id", F.coalesce(0.5 + 0.5 * F.col("quality"), F.lit(0.5)).alias("importance")), "importance", 0.6, 50)


@query(f"WITH {_NODE} SELECT node_id, kind IN ('procedural', 'policy') AS leaf, (node_id % 4)::BIGINT AS layer FROM n WHERE node_id % 4 > 0 OR source = 'src0'")
def node_layers_and_flags(spark, sf):
    n = _typed_nodes(spark, sf).withColumn("layer", F.col("node_id") % 4)
    return n.where((F.col("layer") > 0) | (F.col("source") == "src0")).select("node_id", F.col("kind").isin("procedural", "policy").alias("leaf"), "layer")


@query("SELECT conv_id, turn, round(((contains(t, 'a')::INT + contains(t, 'zq')::INT + contains(t, 'en')::INT) / 3)::DOUBLE, 6) AS ratio FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)")
def node_symptom_ratio(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.round(predicates.symptom_ratio(F.array(*map(F.lit, ("A", "zq", "EN"))), F.col("text")), 6).alias("ratio"))


@query("SELECT s_suppkey AS id, contains(lower(s_name), '7') OR s_nationkey = 7 AS expert, s_nationkey % 3 = 0 AS critical FROM supplier")
def node_experts_and_tiers(spark, sf):
    expertise = F.array("s_name", F.when(F.col("s_nationkey") == 7, "Area 7"), F.lit("other"))
    tier = F.when(F.col("s_nationkey") % 3 == 0, " p1").when(F.col("s_nationkey") % 3 == 1, "P2")
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), predicates.expert_in(F.filter(expertise, lambda x: x.isNotNull()), F.lit("7")).alias("expert"), predicates.critical(tier).alias("critical"))


@query("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS total, round(1 / (1 + list_dot_product(v, v)), 6) AS similarity FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def vector_normalised(spark, sf):
    v = F.col("embedding")
    n = read(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), vectors.normalised(v).alias("u"), F.round(scoring.similarity_of_distance(vectors.dot(v, v)), 6).alias("similarity"))
    return n.select("vec_id", "norm", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), "similarity")


@query("""WITH s AS (SELECT doc_id, (doc_id % 11) / 10 AS a, (doc_id % 7) / 6 AS b, (doc_id % 5) / 4 AS c FROM documents)
SELECT doc_id, round(0.4 * a + 0.3 * b + 0.15 * c, 6) AS rerank, round(0.7 * a + 0.3 * b, 6) AS combined, round(0.7 * greatest(0.0, least(1.0, a * 2 - 0.5)) + 0.3 * b, 6) AS blended, round(0.30 * a + 0.25 * b + 0.20 * c + 0.15 * a + 0.10 * b, 6) AS analysed, CASE WHEN doc_id % 3 + doc_id % 4 = 0 THEN 0.5 ELSE round((doc_id % 3) / (doc_id % 3 + doc_id % 4), 6) END AS success FROM s""")
def score_blends(spark, sf):
    i = F.col("doc_id")
    a, b, c = i % 11 / 10, i % 7 / 6, i % 5 / 4
    out = {"rerank": scoring.rerank_score(a, b, c), "combined": scoring.combined_score(a, b), "blended": scoring.cross_encoder_blend(a * 2 - 0.5, b), "analysed": predicates.analysed_importance(a, b, c, a, b), "success": scoring.ratio(i % 3, i % 4)}
    return read(spark, sf, "documents").select("doc_id", *(F.round(x, 6).alias(n) for n, x in out.items()))


@query(rf"""WITH w AS (SELECT conv_id, turn, list_distinct({_WORDS}) AS w, lag(list_distinct({_WORDS})) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, round(0.3 * least(0.2, 0.05 * len(list_intersect(w, before))), 6)::DOUBLE AS boost FROM w WHERE before IS NOT NULL""")
def score_context_boost(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf, "conversations").withColumn("w", F.array_distinct(text.words(F.col("text")))).withColumn("before", F.lag("w").over(w)).where("before is not null")
    return c.select("conv_id", "turn", F.round(scoring.context_boost(F.col("w"), F.col("before")), 6).alias("boost"))


@query("""WITH k AS (SELECT doc_id, list_transform([' ' || source, upper(source), lang, 'x' || doc_id % 3, '', lang], lambda x: trim(x)) AS k FROM documents),
u AS (SELECT doc_id, i, k[i] AS w FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i FROM k)), f AS (SELECT doc_id, i, w, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) AS r FROM u WHERE w <> ''), g AS (SELECT doc_id, i, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f WHERE r = 1)
SELECT doc_id, string_agg(w, ',' ORDER BY i) AS keywords FROM g WHERE n <= 3 GROUP BY doc_id""")
def text_normalised_keywords(spark, sf):
    k = F.array(F.concat(F.lit(" "), "source"), F.upper("source"), F.col("lang"), F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string")), F.lit(""), F.col("lang"))
    return read(spark, sf, "documents").select("doc_id", F.array_join(text.normalised_keywords(k, 3), ",").alias("keywords"))


@query("""WITH h AS (SELECT user_id AS query_id, event_id AS node_id, event_type AS source, round(value, 2) AS score FROM events), a AS (SELECT * FROM h WHERE source IN ('view', 'click')), b AS (SELECT * FROM h)
SELECT query_id, source, max(score) AS score FROM h GROUP BY query_id, source""")
def fusion_best_per_source(spark, sf):
    h = read(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("node_id"), F.col("event_type").alias("source"), F.round("value", 2).alias("score"))
    return fusion.best_per(h, ["query_id", "source"], [F.desc("score"), F.col("node_id")]).select("query_id", "source", "score")


@query("""WITH h AS (SELECT user_id AS query_id, event_type AS node_id, round(max(value), 2) AS score FROM events GROUP BY 1, 2), a AS (SELECT * FROM h WHERE node_id IN ('view', 'click')), b AS (SELECT query_id, node_id, score + 1 AS score FROM h)
SELECT query_id, node_id, round(score, 2) AS score FROM a UNION ALL SELECT query_id, node_id, round(score, 2) FROM b WHERE node_id NOT IN ('view', 'click')""")
def fusion_union_first(spark, sf):
    h = read(spark, sf, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("node_id")).agg(F.round(F.max("value"), 2).alias("score"))
    got = fusion.union_first([h.where(F.col("node_id").isin("view", "click")), h.withColumn("score", F.col("score") + 1)], ["query_id", "node_id"])
    return got.select("query_id", "node_id", F.round("score", 2).alias("score"))


@query(f"""WITH w AS (SELECT source AS query_id, doc_id AS node_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, len({_WORDS})::BIGINT AS tokens FROM documents)
SELECT query_id, node_id, (sum(tokens) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS cum FROM w QUALIFY cum - tokens <= 3500""")
def fusion_budget_overshoot(spark, sf):
    d = fusion.ranked(read(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("node_id"), F.size(text.words(F.col("text"))).cast("long").alias("tokens")), ["query_id"], [F.col("node_id")])
    return fusion.within_budget(d, overshoot=True).select("query_id", "node_id", "cum")


@query("SELECT tree, doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM (SELECT source AS tree, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 10) QUALIFY rank <= 20")
def fusion_top_per_tree(spark, sf):
    """The best of each tree, and of these the best of all."""
    each = fusion.ranked(read(spark, sf, "documents").select(F.col("source").alias("tree"), "doc_id", "n_chars"), ["tree"], [F.desc("n_chars"), F.col("doc_id")]).where("rank <= 10").drop("rank")
    return fusion.ranked(each.orderBy(F.desc("n_chars"), "doc_id").limit(20).withColumn("all", F.lit(1)), ["all"], [F.desc("n_chars"), F.col("doc_id")]).select("tree", "doc_id", "rank")


@query("SELECT doc_id, source FROM (SELECT doc_id, source FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0) UNION SELECT doc_id, source FROM documents WHERE lang = 'de' EXCEPT SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0")
def join_id_sets(spark, sf):
    d = read(spark, sf, "documents")
    part = lambda c: d.where(c).select("doc_id", "source")
    return part("lang = 'en'").intersect(part("doc_id % 2 = 0")).union(part("lang = 'de'")).distinct().subtract(part("doc_id % 3 = 0"))


@query("""WITH n AS (SELECT n_nationkey AS key, lower(n_name) AS name FROM nation)
SELECT c.conv_id, c.turn, n.key FROM conversations c JOIN n ON contains(lower(c.text || ' ' || 'seen in ' || (SELECT n_name FROM nation WHERE n_nationkey = c.conv_id % 25)), n.name)""")
def join_substring(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    c = read(spark, sf, "conversations").join(n.select(F.col("key").alias("k"), F.col("name").alias("seen")), F.col("conv_id") % 25 == F.col("k")).select("conv_id", "turn", F.concat("text", F.lit(" seen in "), "seen").alias("t"))
    return joins.substring_matches(n, c, F.col("name"), F.col("t")).select("conv_id", "turn", "key")


@query(rf"""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, list_sort(list_distinct(list_filter({_WORDS}, lambda w: length(w) > 2)))[1:2] AS k FROM conversations), d AS (SELECT doc_id, list_distinct({_WORDS}) AS w FROM documents)
SELECT query_id, doc_id AS node_id, len(k)::BIGINT AS hits, 1.0::DOUBLE AS score FROM q JOIN d ON len(k) > 0 AND len(list_intersect(k, w)) = len(k)""")
def join_keywords_all(spark, sf):
    d = spread(read(spark, sf, "documents")).select(F.col("doc_id").alias("node_id"), text.words(F.col("text")).alias("keywords"))
    w = F.filter(text.words(F.col("text")), lambda x: F.length(x) > 2)
    q = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.slice(F.array_sort(F.array_distinct(w)), 1, 2).alias("keywords"))
    return joins.keyword_matches(d, q, match_all=True)


@query("SELECT node_id, doc_id FROM (SELECT vec_id AS node_id, doc_id, label FROM embeddings JOIN documents ON doc_id = vec_id) WHERE label % 2 = 0")
def join_node_documents(spark, sf):
    """Leaves of one level with the documents they come from."""
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), (F.col("label") % 2).alias("level"))
    return v.where("level = 0").join(read(spark, sf, "documents").select("doc_id"), F.col("node_id") == F.col("doc_id")).select("node_id", "doc_id")


# graphs


_RELATED = "rel AS (SELECT src, dst, relation, CASE relation WHEN 'contains' THEN 0.9 WHEN 'home_of' THEN 0.5 ELSE 0.8 END AS confidence FROM edges)"


def _related(spark, sf) -> DataFrame:
    return _edges(spark, sf).withColumn("confidence", F.when(F.col("relation") == "contains", 0.9).when(F.col("relation") == "home_of", 0.5).otherwise(0.8))


@query(f"""WITH {_EDGES}, {_RELATED}, kept AS (SELECT src, dst FROM rel WHERE confidence >= 0.7 AND relation IN ('contains', 'seat_of')), steps AS (SELECT src AS a, dst AS b FROM kept UNION SELECT dst, src FROM kept),
s AS (SELECT 'region:' || r_regionkey AS start FROM region), p1 AS (SELECT start, b AS node, [start, b] AS path FROM s JOIN steps ON a = start), p2 AS (SELECT start, b AS node, list_append(path, b) AS path FROM p1 JOIN steps ON a = node WHERE b <> start),
p3 AS (SELECT start, b AS node, list_append(path, b) AS path FROM p2 JOIN steps ON a = node WHERE b <> start), whole AS (SELECT start, node, 1 AS d, path FROM p1 UNION ALL SELECT start, node, 2, path FROM p2 UNION ALL SELECT start, node, 3, path FROM p3)
SELECT start, node, min(d)::BIGINT AS distance, array_to_string(arg_min(path, {{'d': d, 'p': path}}), '>') AS path FROM whole WHERE node LIKE 'supplier:%' GROUP BY start, node""")
def graph_traverse_paths(spark, sf):
    starts = read(spark, sf, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("start"))
    targets = read(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node"))
    got = graph.traverse_paths(_related(spark, sf), starts, 3, relations=["contains", "seat_of"], least=0.7, targets=targets)
    return got.select("start", "node", F.col("distance").cast("long").alias("distance"), F.array_join("path", ">").alias("path"))


@query(f"WITH {_EDGES} SELECT 'nation:' || n_nationkey AS id, src, dst, relation FROM nation JOIN edges ON src = 'nation:' || n_nationkey WHERE relation = 'seat_of' UNION ALL SELECT src, src, dst, relation FROM edges WHERE src = 'region:1' AND dst = 'nation:1'")
def graph_relationships(spark, sf):
    ids = read(spark, sf, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    e = _edges(spark, sf)
    one = graph.between(e, "region:1", "nation:1", "contains")
    return graph.relationships(e, ids, "both", "seat_of").select("id", "src", "dst", "relation").union(one.select(F.col("src").alias("id"), "src", "dst", "relation"))


@query(f"WITH {_EDGES}, b AS (SELECT src AS id, dst AS other FROM edges UNION SELECT dst, src FROM edges) SELECT id, other FROM b WHERE id LIKE 'nation:%'")
def graph_related_entities(spark, sf):
    ids = read(spark, sf, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    return graph.related(_edges(spark, sf), ids)


@query(f"WITH {_EDGES} SELECT src || '>' || dst || '_inv' AS id, dst AS src, src AS dst, 'related_to' AS relation FROM edges WHERE relation <> 'contains' UNION ALL SELECT src || '>' || dst || '_inv', dst, src, '{extract.INVERSE.get('contains', 'related_to')}' FROM edges WHERE relation = 'contains'")
def graph_inverted(spark, sf):
    return graph.inverted(_edges(spark, sf).withColumn("id", F.concat("src", F.lit(">"), "dst")))


@query(f"WITH {_EDGES} SELECT src, dst, relation FROM edges UNION ALL SELECT id, kind, 'entity' FROM (SELECT DISTINCT id, regexp_extract(id, '^[a-z]+') AS kind FROM (SELECT unnest([src, dst]) AS id FROM edges))")
def graph_serialised(spark, sf):
    """A graph as lines of JSON and back."""
    e = _edges(spark, sf)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("kind", F.regexp_extract("id", "^[a-z]+", 0))
    entities, edges = graph.from_rows(graph.to_rows(ids, e), "id string, kind string", "src string, dst string, relation string")
    return edges.select("src", "dst", "relation").union(entities.select("id", "kind", F.lit("entity")))


@query(f"WITH {_EDGES}, last AS (SELECT user_id AS id, arg_max(event_type, {{'t': ts, 'e': event_id}}) AS event_type FROM events GROUP BY user_id) SELECT id, event_type FROM last")
def graph_latest_versions(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("id"), "event_type", F.struct("ts", "event_id").alias("at"))
    return graph.latest(e, ["id"], "at").select("id", "event_type")


@query(f"WITH {_EDGES} SELECT src, dst, relation FROM edges WHERE src NOT IN ('nation:3', 'region:2') AND dst NOT IN ('nation:3', 'region:2')")
def graph_without_entities(spark, sf):
    gone = spark.createDataFrame([("nation:3",), ("region:2",)], "id string")
    return graph.without_entities(_edges(spark, sf), gone)


@query(f"WITH {_EDGES}, near AS (SELECT 'nation:7' AS n UNION SELECT src FROM edges WHERE dst = 'nation:7' UNION SELECT dst FROM edges WHERE src = 'nation:7') SELECT src, dst, relation FROM edges WHERE src IN (SELECT n FROM near) AND dst IN (SELECT n FROM near)")
def graph_neighbourhood(spark, sf):
    return graph.neighbourhood(_edges(spark, sf), spark.createDataFrame([("nation:7",)], "start string"), 1).select("src", "dst", "relation")


@query(f"""WITH {_EDGES}, steps AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), s AS (SELECT * FROM (VALUES ('nation:1', 0), ('nation:2', 1)) t(start, ord)), one AS (SELECT start, ord, b AS node, 1 AS d FROM s JOIN steps ON a = start), two AS (SELECT start, ord, b AS node, 2 AS d FROM one JOIN steps ON a = node WHERE b <> start),
m AS (SELECT start, ord, node, min(d) AS d FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY start, ord, node)
SELECT node, start, d::BIGINT AS distance FROM m QUALIFY row_number() OVER (PARTITION BY node ORDER BY ord, d) = 1 ORDER BY distance, node LIMIT 15""")
def graph_query(spark, sf):
    starts = spark.createDataFrame([("nation:1", 0), ("nation:2", 1)], "start string, ord int")
    return graph.query(_edges(spark, sf), starts, 2, 15).withColumn("distance", F.col("distance").cast("long"))


# trees


@query(f"""WITH {_CENTERS}, q AS (SELECT vec_id AS query_id, v FROM vec JOIN benchmark ON item_id = vec_id), mid AS (SELECT label % 3 AS parent, label, c FROM centers),
top AS (SELECT parent AS node, list(x ORDER BY i) AS c FROM (SELECT parent, i, avg(c[i]) AS x FROM (SELECT parent, c, unnest(range(1, len(c) + 1)) AS i FROM mid) GROUP BY parent, i) GROUP BY parent),
a AS (SELECT query_id, node, {_COS.format(a='q.v', b='top.c')} AS score FROM q, top QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_COS.format(a='q.v', b='top.c')} DESC, node) <= 2),
b AS (SELECT query_id, label AS node, {_COS.format(a='q.v', b='mid.c')} AS score FROM a JOIN q USING (query_id) JOIN mid ON mid.parent = a.node QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_COS.format(a='q.v', b='mid.c')} DESC, label) <= 2),
c AS (SELECT query_id, vec.vec_id AS node, {_COS.format(a='q.v', b='vec.v')} AS score FROM b JOIN q USING (query_id) JOIN vec ON vec.label = b.node)
SELECT query_id, node::BIGINT AS node_id, 2 AS level, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM a UNION ALL SELECT query_id, node, 1, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) FROM b
UNION ALL SELECT query_id, node, 0, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) <= 10""")
def tree_descend(spark, sf):
    """A beam of two through three levels: groups of labels, labels, vectors."""
    m = _members(spark, sf)
    mid = tree.centroids(m).select((F.col("cluster") % 3).cast("long").alias("parent"), F.col("cluster").cast("long").alias("node_id"), "v")
    top = tree.centroids(mid.select(F.col("parent").alias("cluster"), "node_id", "v")).select(F.lit(None).cast("long").alias("parent"), F.col("cluster").alias("node_id"), "v")
    leaves = m.select(F.col("cluster").cast("long").alias("parent"), "node_id", "v")
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("node_id")).join(m, "node_id").select(F.col("node_id").alias("query_id"), "v")
    return tree.descend(asked, [top, mid, leaves], 2, 10)


def _parents(spark, sf) -> DataFrame:
    """Documents under the quarter of their id, up to document 0."""
    return read(spark, sf, "documents").where("doc_id > 0").select(F.floor(F.col("doc_id") / 4).alias("parent"), F.col("doc_id").alias("child"))


_PARENTS = "par AS (SELECT doc_id // 4 AS parent, doc_id AS child FROM documents WHERE doc_id > 0)"


@query(f"WITH RECURSIVE {_PARENTS}, d AS (SELECT 0::BIGINT AS node_id, 0 AS depth UNION ALL SELECT child, depth + 1 FROM d JOIN par ON parent = node_id) SELECT node_id, depth FROM d")
def tree_depths(spark, sf):
    return tree.depths(_parents(spark, sf))


@query(f"WITH {_PARENTS} SELECT parent, array_to_string(list_sort(list(child)), ',') AS children, count(*)::INT AS n FROM par GROUP BY parent")
def tree_children(spark, sf):
    return tree.children_of(_parents(spark, sf)).select("parent", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"), "n")


@query(f"WITH RECURSIVE {_PARENTS}, up AS (SELECT DISTINCT parent AS node_id, 1 AS height FROM par WHERE child % 37 = 5 UNION SELECT parent, height + 1 FROM up JOIN par ON child = node_id) SELECT node_id, max(height) AS height FROM up GROUP BY node_id")
def tree_touched(spark, sf):
    """What stands over changed documents, up to the root."""
    return tree.touched(read(spark, sf, "documents").where("doc_id % 37 = 5").select(F.col("doc_id").alias("node_id")), _parents(spark, sf))


@query(rf"""WITH first AS (SELECT label + 100000 AS p, string_agg(text, chr(10) || chr(10) ORDER BY vec_id) AS t, count(*) AS n FROM (SELECT label, vec_id, text, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, sum(len({_WORDS})) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings JOIN documents ON doc_id = vec_id) WHERE r <= 50 AND (w <= 12000 OR r = 1) GROUP BY label),
changed AS (SELECT DISTINCT label + 100000 AS p FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 40 = 3)
SELECT p AS node_id, md5(array_to_string(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')[1:60], ' ')) AS text_md5 FROM first JOIN changed USING (p)""")
def tree_resummarised(spark, sf):
    """New summaries over changed leaves; the others keep theirs."""
    # parents stand below zero, where no leaf's id is, however many leaves there are
    leaves = _members(spark, sf).select("node_id", (-1 - F.col("cluster")).cast("long").alias("parent")).join(read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text"), "node_id")
    edges = leaves.select("parent", F.col("node_id").alias("child"))
    nodes = leaves.select("node_id", "text").union(edges.select(F.col("parent").alias("node_id"), F.lit("old")).distinct())
    got = tree.resummarised(nodes, edges, leaves.where("node_id % 40 = 3").select("node_id"), ports.leading_summary)
    return got.where((F.col("node_id") < 0) & (F.col("text") != "old")).select((100000 - 1 - F.col("node_id")).alias("node_id"), F.md5("text").alias("text_md5"))


@query("""WITH d AS (SELECT source AS tree_id, doc_id AS node_id, 1 AS version FROM documents)
SELECT tree_id, node_id, CASE WHEN node_id % 9 = 0 THEN 2 ELSE version END AS version FROM d WHERE tree_id NOT IN ('src1', 'src2') UNION ALL SELECT 'src2', doc_id, 3 FROM labels UNION ALL SELECT tree_id, -1, 2 FROM d WHERE tree_id NOT IN ('src1', 'src2') GROUP BY tree_id""")
def tree_mutated(spark, sf):
    """A forest with nodes changed and added, a tree taken out and one put in another's place."""
    d = read(spark, sf, "documents").select(F.col("source").alias("tree_id"), F.col("doc_id").alias("node_id"), F.lit(1).alias("version"))
    new = d.where("node_id % 9 = 0").withColumn("version", F.lit(2)).union(d.select("tree_id", F.lit(-1).cast("long"), F.lit(2)).distinct())
    forest = tree.without_tree(tree.with_nodes(d, new), spark.createDataFrame([("src1",)], "tree_id string"))
    return tree.with_tree(forest, read(spark, sf, "labels").select(F.lit("src2").alias("tree_id"), F.col("doc_id").alias("node_id"), F.lit(3).alias("version")))


@query("SELECT doc_id AS node_id, min(layer)::BIGINT AS layer FROM (SELECT doc_id, doc_id % 4 AS layer FROM documents UNION ALL SELECT doc_id, 2 FROM labels) GROUP BY doc_id")
def tree_layer_map(spark, sf):
    a = read(spark, sf, "documents").groupBy((F.col("doc_id") % 4).alias("layer")).agg(F.collect_list("doc_id").alias("nodes"))
    b = read(spark, sf, "labels").agg(F.lit(2).cast("long").alias("layer"), F.collect_list("doc_id").alias("nodes"))
    return tree.layer_map(a.unionByName(b))


@query("SELECT source AS tree_id, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY source")
def tree_by_type(spark, sf):
    """All nodes of the trees of some types, in one table."""
    return read(spark, sf, "documents").where(F.col("lang").isin("en", "fr")).groupBy(F.col("source").alias("tree_id")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, length(text) % 5 = 0 AS head, length(text) AS n FROM conversations) SELECT conv_id, turn, (sum(head::INT) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS section, (n > lead(n) OVER (PARTITION BY conv_id ORDER BY turn)) AS longer FROM t""")
def context_running_sections(spark, sf):
    """A section number that grows at each heading, and each row held against the next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf, "conversations").withColumn("n", F.length("text"))
    return c.select("conv_id", "turn", F.sum((F.col("n") % 5 == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("section"), (F.col("n") > F.lead("n").over(w)).alias("longer"))


# ingestion


@query(f"""WITH {_SIGNALS}, last AS (SELECT user_id, arg_max(event_type, {{'t': ts, 'e': event_id}}) AS e, arg_max(value, {{'t': ts, 'e': event_id}}) AS v FROM events GROUP BY user_id)
SELECT user_id AS node_id, CASE WHEN e = 'view' AND v >= 50 THEN 'validated' WHEN e = 'view' THEN 'pending' WHEN e = 'click' THEN 'stale' WHEN e = 'purchase' THEN 'deprecated' ELSE 'new' END AS status FROM last""")
def ingest_lifecycle(spark, sf):
    e = read(spark, sf, "events")
    kinds = F.create_map(*map(F.lit, ("view", "validate", "click", "stale", "purchase", "deprecate")))
    events = e.select(F.col("user_id").alias("node_id"), kinds[F.col("event_type")].alias("event"), (F.col("value") / 50 * 0.8).alias("confidence"), F.struct("ts", "event_id").alias("at"))
    return ingest.lifecycle(e.select(F.col("user_id").alias("node_id"), F.lit("new").alias("status")).distinct(), events)


@query("SELECT user_id AS query_id, count(*) AS n, max(round(value, 2)) AS best, max(round(value, 2)) > 0.5 AS success FROM events GROUP BY user_id")
def ingest_observations(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.round("value", 2).alias("score"))
    return ingestion.observed(e, F.lit(0)).drop("at")
