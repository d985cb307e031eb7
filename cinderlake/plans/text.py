"""Articles: documents with similarity, clustering, URLs and headlines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinderlake.functions import text as T
from cinderlake.operators import dense as D
from cinderlake.operators import near as N
from cinderlake.operators import text as X
from cinderlake.session import table, written

#: Cosines from which articles belong together: by terms, and by embeddings.
COSINE, DENSE = 0.35, 0.85


def _articles(spark, d):
    """Articles dealt out to all cores: their file may be a single row group, and cutting texts is most of the work."""
    return table(spark, d, "documents").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism)


def _weights(spark, d, min_tokens=0):
    return X.tfidf(table(spark, d, "documents"), "doc_id", F.coalesce("text", F.lit("")), min_tokens)


def tfidf_top_terms(spark, d):
    w = _weights(spark, d).select("id", "term", F.round("weight", 6).alias("weight"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "term"))
    return w.withColumn("place", place).where("place <= 5")


def tfidf_pairs(spark, d):
    pairs = X.tfidf_pairs(written(_weights(spark, d), "weights"), COSINE)
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine"))


def campaign_clusters(spark, d):
    docs = table(spark, d, "documents")
    edges = X.tfidf_pairs(written(_weights(spark, d, 5), "weights"), COSINE)
    edges = X.suppress_series(edges, docs, "doc_id", "source", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)))
    out = X.clusters(edges, docs, "doc_id")
    size = F.count(F.lit(1)).over(Window.partitionBy("cluster"))
    return out.withColumn("size", size)


def cluster_summary(spark, d):
    c = campaign_clusters(spark, d)
    return c.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("size") > 1).alias("multi"), F.max("size").alias("largest"))


def dense_pairs(spark, d):
    out = D.dense_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", DENSE)
    return out.select("a", "b", F.round("cosine", 6).alias("cosine"))


def dense_clusters(spark, d):
    vectors = table(spark, d, "embeddings")
    out = X.clusters(written(D.dense_pairs(vectors, "vec_id", "embedding", DENSE), "dense"), vectors, "vec_id")
    return out


def simhash_near_pairs(spark, d):
    prints = written(table(spark, d, "documents").select("doc_id", T.simhash_column(F.coalesce("text", F.lit(""))).alias("fp")), "prints")
    return N.near_pairs(prints, "doc_id", "fp", 6)


def simhash_greedy(spark, d):
    return X.greedy_kept(_articles(spark, d), "doc_id", F.coalesce("text", F.lit("")), 6)


def canonical_urls(spark, d):
    url = T.canonical_url(F.col("url"))
    return table(spark, d, "pages").select("page_id", url.alias("canonical"), F.sha2(url, 256).alias("hash"))


def canonical_urls_exact(spark, d):
    return table(spark, d, "pages").select("page_id", T.canonical_url_exact(F.col("url")).alias("canonical"))


def url_duplicates(spark, d):
    pages = table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))
    return pages.groupBy("canonical").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))


def series_keys(spark, d):
    title = F.split_part(F.coalesce("text", F.lit("")), F.lit("."), F.lit(1))
    docs = table(spark, d, "documents").select("doc_id", "source", T.series_key(title).alias("k"))
    n = F.count(F.lit(1)).over(Window.partitionBy("source", "k"))
    return docs.withColumn("members", n).where("k <> ''")


def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.main_text(F.col("html")).alias("text"))


def token_spend(spark, d):
    docs = table(spark, d, "documents").select("source", T.tokens_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))


def sentence_counts(spark, d):
    text = F.coalesce("text", F.lit(""))
    found = F.filter(F.split(text, r"(?<=[.!?])|\n"), lambda s: (F.length(s) > 1) & F.right(s, F.lit(1)).isin(".", "!", "?"))
    words = F.transform(found, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")))
    return table(spark, d, "documents").select("doc_id", F.size(found).alias("sentences"), F.coalesce(F.array_max(words), F.lit(0)).alias("longest"))


def classified(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", T.hacktivist(F.concat_ws(" ", "text", F.lit(""))).alias("hacktivist"), F.lower("text").contains("license").alias("license"))


QUERIES = {f.__name__: f for f in (
    tfidf_top_terms, tfidf_pairs, campaign_clusters, cluster_summary, dense_pairs, dense_clusters, simhash_near_pairs, simhash_greedy, canonical_urls, canonical_urls_exact,
    url_duplicates, series_keys, html_to_text, token_spend, sentence_counts, classified,
)}

_TFIDF = f"""w AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9.-]{{2,}}'), lambda t: t NOT IN ({", ".join(repr(t) for t in X.STOPWORDS)})) AS t FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM w WHERE len(t) >= MIN_TOKENS) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT id, term, df, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM w)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term)),
wt AS (SELECT id, term, df, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM raw)"""
_PAIRS = f"""p AS (SELECT x.id AS a, y.id AS b, sum(x.weight * y.weight) AS cosine FROM wt x JOIN wt y ON x.term = y.term AND x.id < y.id GROUP BY 1, 2 HAVING sum(x.weight * y.weight) >= {COSINE} AND bool_or(x.df <= greatest(2, (SELECT count(*) FROM documents) // 2)))"""
_WORDS = "(?:" + "|".join(T.SERIES_WORDS) + ")"
_SINGULAR = "CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN w[:-4] || 'y' WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[:-2] ELSE w END"


def _series(title: str) -> str:
    plain = rf"trim(regexp_replace(regexp_replace(lower({title}), '\b\d+(?:st|nd|rd|th)?\b|\b{_WORDS}\b', ' ', 'g'), '[^a-z]+', ' ', 'g'))"
    return f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: {_SINGULAR}), ' ')"


_CLUSTERS = f"""{_TFIDF.replace("MIN_TOKENS", "5")}, {_PAIRS}, k AS (SELECT doc_id, source, {_series("string_split(coalesce(text, ''), chr(10))[1]")} AS k FROM documents),
m AS (SELECT *, count(*) OVER (PARTITION BY source, k) AS n FROM k WHERE source IS NOT NULL AND k <> ''),
e AS (SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM m x JOIN m y ON x.source = y.source AND x.k = y.k WHERE x.doc_id = a AND y.doc_id = b AND x.n >= 3)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS cluster FROM documents LEFT JOIN r ON a = doc_id GROUP BY doc_id)"""
_DENSE = f"SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= {DENSE}"
_CANON = r"""(SELECT page_id, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1)) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical FROM
(SELECT page_id, u, regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') AS path, array_to_string(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(?:TRACK)')), '&') AS q FROM
(SELECT page_id, u, regexp_replace(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*', '') AS rest FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages))))""".replace("TRACK", "|".join(T.TRACKING))

ORACLES = {
    "tfidf_top_terms": f"WITH {_TFIDF.replace('MIN_TOKENS', '0')} SELECT id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY id ORDER BY round(weight, 6) DESC, term) AS place FROM wt QUALIFY place <= 5",
    "tfidf_pairs": f"WITH {_TFIDF.replace('MIN_TOKENS', '0')}, {_PAIRS} SELECT a, b, round(cosine, 6) AS cosine FROM p",
    "campaign_clusters": f"WITH RECURSIVE {_CLUSTERS} SELECT doc_id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM c",
    "cluster_summary": f"WITH RECURSIVE {_CLUSTERS}, s AS (SELECT cluster, count(*) AS size FROM c GROUP BY 1) SELECT count(*) AS clusters, count(*) FILTER (size > 1) AS multi, max(size) AS largest FROM s",
    "dense_pairs": f"SELECT a, b, round(cosine, 6) AS cosine FROM ({_DENSE})",
    "dense_clusters": f"WITH RECURSIVE e AS ({_DENSE}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT vec_id, least(vec_id, coalesce(min(b), vec_id)) AS cluster FROM embeddings LEFT JOIN r ON a = vec_id GROUP BY vec_id",
    "canonical_urls": f"SELECT page_id, canonical, sha256(canonical) AS hash FROM {_CANON}",
    "url_duplicates": f"SELECT canonical, min(page_id) AS first, count(*) AS n FROM {_CANON} GROUP BY 1",
    "series_keys": f"SELECT doc_id, source, k, count(*) OVER (PARTITION BY source, k) AS members FROM (SELECT doc_id, source, {_series("string_split(coalesce(text, ''), '.')[1]")} AS k FROM documents) WHERE k <> ''",
    "token_spend": "SELECT source, CAST(sum(greatest(1, length(coalesce(text, '')) // 4)) AS BIGINT) AS tokens, count(*) AS n FROM documents GROUP BY source",
    "sentence_counts": r"""WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]') AS f FROM documents)
SELECT doc_id, CAST(len(f) AS INTEGER) AS sentences, CAST(coalesce(list_max(list_transform(f, lambda x: len(regexp_extract_all(x, '\S+')))), 0) AS INTEGER) AS longest FROM s""",
    "classified": "SELECT doc_id, " + " OR ".join(f"contains(lower(coalesce(text, '')), '{p}')" for p in T.HACKTIVIST) + " AS hacktivist, contains(lower(text), 'license') AS license FROM documents",
}
