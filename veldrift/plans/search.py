"""Queries for retrieval, text, graphs and the keyed store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graphs, retrieval, vector_index
from ..sources import files
from .adapters import GRAPH, graph, table
from .registry import Registry

R = Registry()
ACC, FOLD = retrieval.ACCENTED, retrieval.FOLDED


def docs(s, d: str) -> DataFrame:
    return table(s, d, "documents")


def chunks(s, d: str) -> DataFrame:
    return docs(s, d).select(F.col("doc_id").alias("id"), "text", "source")


def questions(s, d: str) -> DataFrame:
    """Benchmark items are the queries."""
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


TOK = f"regexp_extract_all(translate(lower({{}}), '{ACC}', '{FOLD}'), '[a-z0-9_]+')"
BM25 = f"""post AS (SELECT term, id, count(*) AS tf FROM (SELECT doc_id AS id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY 1, 2),
lens AS (SELECT doc_id AS id, len({TOK.format('text')}) AS dl FROM documents), stats AS (SELECT count(*) AS n, avg(dl) AS mean FROM lens),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
bm AS (SELECT query_id, id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))) AS score FROM asked JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (id), stats GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM bm) WHERE rank <= 10)"""
R.table("inverted_index", lambda s, d: retrieval.postings(chunks(s, d)), BM25, "post", {"term": None, "id": None, "tf": None})
R.table("bm25_top10", lambda s, d: retrieval.bm25_top(chunks(s, d), questions(s, d), 10), BM25, "lex", {"query_id": None, "id": None, "score": 6, "rank": None})


def vectors(s, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("source"))


def asked_vectors(s, d: str) -> DataFrame:
    """Stated queries: every vector whose id is divisible by 50."""
    return vectors(s, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


VEC = """vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, 'label' || label AS source FROM embeddings), vq AS (SELECT id AS query_id, v AS q FROM vecs WHERE id % 50 = 0),
sims AS (SELECT query_id, id, source, list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))) AS score FROM vecs, vq),
near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM sims) WHERE rank <= 10)"""
R.table("vector_top10", lambda s, d: retrieval.vector_search(vectors(s, d), asked_vectors(s, d), 10), VEC, "near", {"query_id": None, "id": None, "score": 5, "rank": None})


def indexed(s, d: str) -> DataFrame:
    """Recall at 10 of the index against the exact search, as whether it is at least 0.9."""
    found = vector_index.search(vector_index.build(vectors(s, d)), asked_vectors(s, d), 10)
    r = vector_index.recall(found, retrieval.vector_search(vectors(s, d), asked_vectors(s, d), 10))
    return r.select("queries", (F.col("recall") >= 0.9).alias("recall_at_least_090"))


R.table("vector_index_recall", indexed, "", "(SELECT count(*) AS queries, true AS recall_at_least_090 FROM embeddings WHERE vec_id % 50 = 0)", {"queries": None, "recall_at_least_090": None})


def fused(s, d: str) -> DataFrame:
    """Cosine ranking and the same vectors ranked by id distance, fused."""
    first = retrieval.vector_search(vectors(s, d), asked_vectors(s, d), 10)
    return retrieval.fuse(first, retrieval.nearest_ids(vectors(s, d), asked_vectors(s, d), 10))


R.table(
    "rank_fusion", fused,
    VEC + """, gaps AS (SELECT * FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY -abs(id - query_id) DESC, id) AS INTEGER) AS rank FROM vecs, vq) WHERE rank <= 10)""",
    """(SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS score,
      CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'both' WHEN b.id IS NOT NULL THEN 'lexical' ELSE 'vector' END AS match FROM near a FULL JOIN gaps b ON a.query_id = b.query_id AND a.id = b.id)""",
    {"query_id": None, "id": None, "score": 8, "match": None},
)


def golden(s, d: str) -> DataFrame:
    """A query vector wants vectors of its own label."""
    return vectors(s, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("source").alias("prefix"))


def results(s, d: str) -> DataFrame:
    return retrieval.vector_search(vectors(s, d), asked_vectors(s, d), 10).join(vectors(s, d).select("id", "source"), "id")


R.table(
    "retrieval_metrics", lambda s, d: retrieval.metrics(results(s, d), golden(s, d)),
    VEC + ", g AS (SELECT id AS query_id, source AS prefix FROM vecs WHERE id % 50 = 0), m AS (SELECT g.query_id, min(rank) FILTER (starts_with(near.source, prefix)) AS first, CAST(bool_or(starts_with(near.source, prefix)) AS INTEGER) AS n FROM g LEFT JOIN near USING (query_id) GROUP BY 1)",
    "(SELECT avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0 END) AS hit_rate, avg(coalesce(n, 0)) AS recall, avg(coalesce(1 / first, 0)) AS mrr, count(*) AS queries FROM m)", {"hit_rate": 6, "recall": 6, "mrr": 6, "queries": None},
)


def hybrid(s, d: str) -> DataFrame:
    texts = chunks(s, d).join(vectors(s, d).select("id", "v"), "id")
    q = questions(s, d).join(vectors(s, d).select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return retrieval.hybrid_search(texts, q, k=5, min_similarity=-1.0, max_per_source=2)


HYB = BM25.replace("FROM documents", "FROM texts").replace("WHERE rank <= 10", "WHERE rank <= 15").replace("FROM benchmark", "FROM asks") + ", " + VEC.replace("WHERE rank <= 10", "WHERE rank <= 15").replace("vecs AS", "all_vecs AS").replace("FROM vecs, vq", "FROM tv, hq").replace("FROM vecs WHERE", "FROM all_vecs WHERE")
HYB = """texts AS (SELECT d.* FROM documents d SEMI JOIN embeddings ON vec_id = doc_id), asks AS (SELECT b.* FROM benchmark b SEMI JOIN embeddings ON vec_id = item_id),
tv AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, t.source FROM embeddings JOIN texts t ON doc_id = vec_id), hq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings SEMI JOIN asks ON item_id = vec_id), """ + HYB
HYB += """, fu AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS score,
  CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'both' WHEN b.id IS NOT NULL THEN 'lexical' ELSE 'vector' END AS match FROM near a FULL JOIN lex b ON a.query_id = b.query_id AND a.id = b.id),
top15 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM fu) WHERE n <= 15),
capped AS (SELECT * FROM (SELECT top15.* EXCLUDE n, tv.source, list_cosine_similarity(v, q) AS similarity, row_number() OVER (PARTITION BY query_id, tv.source ORDER BY round(score, 9) DESC, id) AS n FROM top15 JOIN tv USING (id) JOIN hq USING (query_id)) WHERE n <= 2)"""
HYBRID = {"query_id": None, "id": None, "score": 8, "match": None, "source": None, "similarity": 5, "rank": None}
R.table("hybrid_search", hybrid, HYB, "(SELECT * FROM (SELECT * EXCLUDE n, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM capped) WHERE rank <= 5)", HYBRID)
R.table(
    "retrieval_evaluation", lambda s, d: retrieval.metrics(hybrid(s, d), questions(s, d).select("query_id", F.explode(F.array(F.lit("src1"), F.lit("src2"))).alias("prefix")), every=True),
    HYB + """, final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM capped) WHERE rank <= 5),
    m AS (SELECT item_id, min(rank) FILTER (starts_with(source, 'src1') OR starts_with(source, 'src2')) AS first, coalesce(max(CAST(starts_with(source, 'src1') AS INTEGER)), 0) + coalesce(max(CAST(starts_with(source, 'src2') AS INTEGER)), 0) AS n FROM benchmark LEFT JOIN final ON query_id = item_id GROUP BY 1)""",
    "(SELECT avg(CASE WHEN n = 2 THEN 1.0 ELSE 0 END) AS hit_rate, avg(n / 2) AS recall, avg(coalesce(1 / first, 0)) AS mrr, count(*) AS queries, (SELECT avg(CASE WHEN match = 'vector' THEN 0.0 ELSE 1 END) FROM final) AS lexical_share FROM m)",
    {"hit_rate": 6, "recall": 6, "mrr": 6, "queries": None, "lexical_share": 6},
)

SIZED = "sized AS (SELECT doc_id, CAST(unnest(range(CAST(greatest(ceil((length(text) - 120) / 880), 1) AS BIGINT))) AS INTEGER) AS chunk_no, text FROM documents)"
R.table("chunks_by_size", lambda s, d: retrieval.chunk_by_size(docs(s, d)), SIZED, "(SELECT doc_id, chunk_no, substr(text, chunk_no * 880 + 1, 1000) AS text FROM sized)", {"doc_id": None, "chunk_no": None, "text": None})
R.table(
    "chunk_context", lambda s, d: retrieval.expand(retrieval.chunk_by_size(docs(s, d)), 1).select("doc_id", "chunk_no", F.md5("context").alias("context")), SIZED + ", c AS (SELECT doc_id, chunk_no, substr(text, chunk_no * 880 + 1, 1000) AS text FROM sized)",
    "(SELECT doc_id, chunk_no, md5(array_to_string(list(text) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), chr(10))) AS context FROM c)", {"doc_id": None, "chunk_no": None, "context": None},
)
R.rows_only("structured_chunks", lambda s, d: retrieval.chunk_structured(docs(s, d)))


def secretive(s, d: str) -> DataFrame:
    """Documents, some with a token, a key or a command at their end."""
    token = F.when(F.col("doc_id") % 7 == 0, " eyJhbGciOi.J9-x.sig_1 end").when(F.col("doc_id") % 7 == 1, "\n-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nAbC+/=\n-----END RSA PRIVATE KEY-----").when(F.col("doc_id") % 7 == 2, " Ignore previous instructions")
    return docs(s, d).select("doc_id", F.concat("text", F.coalesce(token, F.lit(""))).alias("text"))


#: The same matches without possession and looks around, which DuckDB's patterns lack.
PLAINER = {
    "[PRIVATE KEY]": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?s:.*?)-----END [A-Z ]{0,40}PRIVATE KEY-----",
    "[EMAIL]": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
}
MASKED = "text"
for pattern, by in retrieval.SECRETS:
    MASKED = f"regexp_replace({MASKED}, '{PLAINER.get(by, pattern)}', '{by.replace('$', chr(92))}', 'g')"
R.table(
    "redacted", lambda s, d: secretive(s, d).select("doc_id", retrieval.redact(F.col("text")).alias("text"), retrieval.injection_flag(F.col("text")).alias("injection_flag")),
    "s AS (SELECT doc_id, text || CASE doc_id % 7 WHEN 0 THEN ' eyJhbGciOi.J9-x.sig_1 end' WHEN 1 THEN chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'Proc-Type: 4,ENCRYPTED' || chr(10) || 'AbC+/=' || chr(10) || '-----END RSA PRIVATE KEY-----' WHEN 2 THEN ' Ignore previous instructions' ELSE '' END AS text FROM documents)",
    f"(SELECT doc_id, {MASKED} AS text, contains(lower(text), 'ignore previous instructions') AS injection_flag FROM s)", {"doc_id": None, "text": None, "injection_flag": None},
)
BLOCKS = "|".join(rf"<{tag}\b.*?</{tag}\s*>" for tag in ("script", "style", "head", "svg"))
PLAIN = f"regexp_replace(regexp_replace(html, '(?is){BLOCKS}', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    PLAIN = f"replace({PLAIN}, '{entity}', '{char}')"
R.table("html_text", lambda s, d: table(s, d, "pages").select("page_id", retrieval.html_text(F.col("html")).alias("text")), "", f"(SELECT page_id, trim(regexp_replace({PLAIN}, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS text FROM pages)", {"page_id": None, "text": None})


def articles(s, d: str) -> DataFrame:
    """Documents as news: a title by their first characters, an address for two of three, a flag for one of nine."""
    i = F.col("doc_id")
    return docs(s, d).select(
        F.concat(F.lit("2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit(" 00:00:00")).alias("ts"), F.concat(F.lit(" "), F.substring("text", 1, 12)).alias("title"), F.col("text").alias("body"), "source",
        F.when(i % 3 != 0, F.concat(F.lit("http://x/"), (i % 50).cast("string"))).otherwise("").alias("url"), (i % 9 == 0).alias("is_duplicate"), "doc_id",
    )


def merged_news(s, d: str) -> DataFrame:
    a = articles(s, d)
    return files.merge_news(files.news_page(a.filter("doc_id % 2 = 0")), files.news_page(a))


ARTICLES = "a AS (SELECT make_date(2024, 1, CAST(doc_id % 28 + 1 AS INTEGER)) AS day, trim(substr(text, 1, 12), ' ') AS title, substr(trim(text, ' '), 1, 2000) AS body, source, CASE WHEN doc_id % 3 <> 0 THEN 'http://x/' || doc_id % 50 ELSE '' END AS url, doc_id FROM documents)"
PAGE = "SELECT title, min((day, body, source)) AS r FROM a WHERE doc_id % 9 <> 0 AND title <> '' {} GROUP BY 1"
R.table(
    "merged_news", lambda s, d: merged_news(s, d).select("title", F.to_date("ts").alias("day"), F.md5("body").alias("body"), "source"), ARTICLES + f", old AS ({PAGE.format('AND doc_id % 2 = 0')}), new AS ({PAGE.format('')})",
    "(SELECT title, r[1] AS day, md5(r[2]) AS body, r[3] AS source FROM old UNION ALL SELECT title, r[1], md5(r[2]), r[3] FROM new ANTI JOIN old USING (title))", dict.fromkeys(["title", "day", "body", "source"]),
)
R.table(
    "news_by_day", lambda s, d: files.daily_count(articles(s, d)), ARTICLES.replace("trim(substr(text, 1, 12), ' ')", "' ' || substr(text, 1, 12)"),
    "(SELECT date, count(*) AS count FROM (SELECT min(day) AS date FROM a GROUP BY CASE WHEN url <> '' THEN url ELSE title END) GROUP BY 1)", {"date": None, "count": None},
)


def responses(s, d: str) -> DataFrame:
    """Documents as works: a response of one result each, and one that is not JSON."""
    i = F.col("doc_id").cast("string")
    words = F.create_map(F.lit("second"), F.array(F.lit(1)), F.lit("first"), F.array(F.lit(0), F.lit(2)))
    one = F.struct(
        F.concat(F.lit(" "), F.col("source")).alias("display_name"), (F.lit(2000) + F.col("doc_id") % 25).alias("publication_year"), F.concat(F.lit("id"), i).alias("id"), F.concat(F.lit("https://doi.org/10.X/"), i).alias("doi"),
        F.col("n_chars").alias("cited_by_count"), F.when(F.col("doc_id") % 2 == 0, words).alias("abstract_inverted_index"), F.array(F.struct(F.struct(F.col("lang").alias("display_name")).alias("author"))).alias("authorships"),
    )
    return docs(s, d).select(F.when(F.col("doc_id") % 10 == 0, "no JSON").otherwise(F.to_json(F.struct(F.array(one).alias("results")))).alias("json"))


R.table(
    "paper_records", lambda s, d: files.works(responses(s, d)).withColumn("authors", F.array_join("authors", ",")), "",
    "(SELECT source AS title, CASE WHEN doc_id % 2 = 0 THEN 'first second first' ELSE '' END AS abstract, coalesce(lang, '') AS authors, CAST(2000 + doc_id % 25 AS INTEGER) AS year, 'id' || doc_id AS url, '10.x/' || doc_id AS doi, n_chars AS citations, 'works' AS source FROM documents WHERE doc_id % 10 <> 0)",
    dict.fromkeys(["title", "abstract", "authors", "year", "url", "doi", "citations", "source"]),
)
STOP = ("that", "this", "with", "from", "para", "como", "nicht", "eine", "dans", "pour")
R.table(
    "keywords", lambda s, d: retrieval.keywords(docs(s, d)), f"kw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{4,}}')) AS word FROM documents) WHERE word NOT IN {STOP} GROUP BY 1, 2)",
    "(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS INTEGER) AS rank FROM kw) WHERE rank <= 12)", {"doc_id": None, "word": None, "n": None, "rank": None},
)
R.table(
    "keyword_relevance", lambda s, d: docs(s, d).select("doc_id", retrieval.relevance(F.col("text"), ["the", "and", "der", "que"]).alias("relevance")), "",
    "(SELECT doc_id, (CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'and') AS INTEGER) + CAST(contains(lower(text), 'der') AS INTEGER) + CAST(contains(lower(text), 'que') AS INTEGER)) / 4 AS relevance FROM documents)", {"doc_id": None, "relevance": 6},
)
R.table(
    "dedup_keep_best", lambda s, d: retrieval.best_of(docs(s, d), F.lower("text"), [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id"), "",
    "(SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(text) ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1)", {"doc_id": None},
)


def versions(s, d: str) -> tuple[DataFrame, DataFrame]:
    """An index of the documents and their state now: some new, some gone, some changed."""
    x = docs(s, d).select(F.col("doc_id").cast("string").alias("source"), F.substring(F.md5("text"), 1, 16).alias("file_hash"), "doc_id")
    old = x.filter("doc_id % 10 <> 0").drop("doc_id")
    new = x.filter("doc_id % 10 <> 1").select("source", F.when(F.col("doc_id") % 10 == 2, F.lit("changed")).otherwise(F.col("file_hash")).alias("file_hash"))
    return old, new


VERSIONS = "x AS (SELECT CAST(doc_id AS VARCHAR) AS source, substr(md5(text), 1, 16) AS file_hash, doc_id FROM documents)"
R.table(
    "index_freshness", lambda s, d: retrieval.freshness(*versions(s, d)), VERSIONS,
    "(SELECT source, CASE doc_id % 10 WHEN 0 THEN 'new' WHEN 1 THEN 'deleted' WHEN 2 THEN 'stale' ELSE 'fresh' END AS status FROM x)", {"source": None, "status": None},
)
R.table("index_upsert", lambda s, d: retrieval.upsert(*versions(s, d)), VERSIONS, "(SELECT source, CASE doc_id % 10 WHEN 2 THEN 'changed' ELSE file_hash END AS file_hash FROM x WHERE doc_id % 10 <> 1)", {"source": None, "file_hash": None})

ADJ = GRAPH + ", adj AS (SELECT DISTINCT * FROM (SELECT source AS id, target AS neighbour FROM edges WHERE source <> target UNION ALL SELECT target, source FROM edges WHERE source <> target)), deg AS (SELECT id, count(*) AS degree FROM adj GROUP BY 1), best AS (SELECT * FROM deg WHERE degree >= 3 ORDER BY degree DESC, id LIMIT 10)"
R.table("graph_degrees", lambda s, d: graphs.degrees(graphs.adjacency(graph(s, d)[1])), ADJ, "deg", {"id": None, "degree": None})
R.table(
    "graph_hubs", lambda s, d: graphs.hubs(*graph(s, d)), ADJ + """, ch AS (SELECT best.id, best.degree, coalesce(type, 'unknown') AS t, community FROM best JOIN adj USING (id) LEFT JOIN nodes ON nodes.id = neighbour),
    ty AS (SELECT id, string_agg(t || '=' || c, ',' ORDER BY t || '=' || c) AS child_types FROM (SELECT id, t, count(*) AS c FROM ch GROUP BY 1, 2) GROUP BY 1),
    co AS (SELECT id, community AS dominant_community FROM (SELECT id, community, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, community) AS n FROM ch WHERE community IS NOT NULL GROUP BY 1, 2) WHERE n = 1)""",
    "(SELECT best.id, degree AS n_children, child_types, dominant_community, label, type FROM best LEFT JOIN ty USING (id) LEFT JOIN co USING (id) LEFT JOIN nodes USING (id))",
    dict.fromkeys(["id", "n_children", "child_types", "dominant_community", "label", "type"]),
)


def correlated(s, d: str) -> DataFrame:
    n, e = graph(s, d)
    return graphs.correlated_children(n, e, graphs.hubs(n, e))


R.table(
    "correlated_children", correlated, ADJ + """, ch AS (SELECT * FROM (SELECT best.id, neighbour AS c, deg.degree AS d, row_number() OVER (PARTITION BY best.id ORDER BY deg.degree DESC, neighbour) AS n FROM best JOIN adj USING (id) JOIN deg ON deg.id = neighbour) WHERE n <= 200),
    pr AS (SELECT x.id, x.c AS a, y.c AS b, x.d AS da, y.d AS db FROM ch x JOIN ch y ON x.id = y.id AND x.n < y.n),
    sh AS (SELECT pr.id, a, b, da, db, count(v.id) AS shared FROM pr LEFT JOIN (SELECT u.id, u.neighbour, w.id AS other FROM adj u JOIN adj w ON u.neighbour = w.neighbour WHERE u.id IN (SELECT c FROM ch) AND w.id IN (SELECT c FROM ch)) v ON v.id = a AND v.other = b GROUP BY 1, 2, 3, 4, 5),
    sc AS (SELECT sh.id, a, b, shared / (da + db - shared) + CASE WHEN adj.id IS NULL THEN 0 ELSE 0.5 END AS score, shared FROM sh LEFT JOIN adj ON adj.id = a AND adj.neighbour = b)""",
    "(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, a DESC, b DESC) AS INTEGER) AS rank FROM sc WHERE score > 0) WHERE rank <= 5)", {"id": None, "a": None, "b": None, "score": 6, "shared": None, "rank": None},
)


def pruned(s, d: str) -> DataFrame:
    n, e = graph(s, d)
    kept, left = graphs.prune(n, e, types=["region"], ids=["n1"], drop_isolated=True)
    return graphs.prune_stats(n, e, kept, left)


R.table(
    "graph_prune", pruned, GRAPH + """, kn AS (SELECT * FROM nodes WHERE type <> 'region' AND id <> 'n1'), ke AS (SELECT * FROM edges WHERE source IN (SELECT id FROM kn) AND target IN (SELECT id FROM kn)),
    kk AS (SELECT * FROM kn WHERE id IN (SELECT source FROM ke UNION SELECT target FROM ke))""",
    "(SELECT (SELECT count(*) FROM nodes) - (SELECT count(*) FROM kk) AS nodes_removed, (SELECT count(*) FROM edges) - (SELECT count(*) FROM ke) AS edges_removed, (SELECT count(*) FROM kk) AS nodes_remaining, (SELECT count(*) FROM ke) AS edges_remaining)",
    dict.fromkeys(["nodes_removed", "edges_removed", "nodes_remaining", "edges_remaining"]),
)


def writes(s, d: str) -> DataFrame:
    """Entries from events: kind is the event's type, key its user; an hour's time to live by event."""
    e = table(s, d, "events")
    return e.select(
        F.col("event_type").alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("event_id") % 2 == 0, "session").otherwise("project").alias("scope"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"), F.col("event_id").cast("double").alias("created"), F.col("event_id").cast("double").alias("accessed"),
        (F.col("event_id") % 13).cast("int").alias("access_count"), (600 + F.col("event_id") % 5000).cast("int").alias("ttl"),
    )


STORE = """w AS (SELECT event_type AS kind, 'u' || user_id AS key, CASE WHEN event_id % 2 = 0 THEN 'session' ELSE 'project' END AS scope, 'v' || event_id AS value, CAST(event_id AS DOUBLE) AS created, CAST(event_id AS DOUBLE) AS accessed,
  CAST(event_id % 13 AS INTEGER) AS access_count, CAST(600 + event_id % 5000 AS INTEGER) AS ttl FROM events),
store AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY created DESC, value DESC) AS n FROM w) WHERE n = 1)"""
ENTRY = dict.fromkeys(["kind", "key", "scope", "value", "created", "access_count", "ttl"])
store = lambda s, d: graphs.latest(writes(s, d))
NOW = 10_500.0
R.table("store_upsert", store, STORE, "store", ENTRY)
R.table(
    "store_touch", lambda s, d: graphs.touch(store(s, d), writes(s, d).filter("created % 3 = 0").select("kind", "key", F.col("created").alias("at"))), STORE,
    "(SELECT store.kind, store.key, access_count + coalesce(n, 0) AS access_count, greatest(accessed, coalesce(last, accessed)) AS accessed FROM store LEFT JOIN (SELECT kind, key, count(*) AS n, max(created) AS last FROM w WHERE created % 3 = 0 GROUP BY 1, 2) r ON r.kind = store.kind AND r.key = store.key)",
    dict.fromkeys(["kind", "key", "access_count", "accessed"]),
)
R.table("store_search", lambda s, d: graphs.search(store(s, d), "U1", limit=10), STORE, "(SELECT * FROM store WHERE contains(lower(key), 'u1') OR contains(lower(value), 'u1') ORDER BY accessed DESC, kind, key LIMIT 10)", ENTRY)
R.table("store_evict", lambda s, d: graphs.evict(store(s, d), NOW, 50), STORE, f"(SELECT * FROM store WHERE {NOW} - created <= ttl ORDER BY accessed DESC, kind, key LIMIT 50)", ENTRY)
R.table("store_decay", lambda s, d: graphs.decay(store(s, d), NOW, after=500.0), STORE, f"(SELECT * REPLACE (CASE WHEN access_count < 1 AND {NOW} - created > 500 THEN greatest(300, CAST(floor(ttl * 0.5) AS INTEGER)) ELSE ttl END AS ttl) FROM store)", ENTRY)
R.table("store_ranked", lambda s, d: graphs.ranked(store(s, d), NOW), STORE, f"(SELECT *, (1 - ({NOW}::DOUBLE - accessed) / greatest(ttl, 1)) * 0.6::DOUBLE + least(1.0::DOUBLE, access_count / 10) * 0.4::DOUBLE AS score FROM store WHERE {NOW} - created <= ttl ORDER BY round(score, 9) DESC, kind, key LIMIT 10)", ENTRY | {"score": 8})
R.table("store_counts", lambda s, d: graphs.counts(store(s, d)), STORE, "(SELECT kind, count(*) AS n FROM store GROUP BY 1)", {"kind": None, "n": None})
