"""Similarity and clustering of articles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cinderlake.functions.text import series_key, simhash_column
from cinderlake.operators.graph import connected_components
from cinderlake.operators.near import near_any, near_pairs
from cinderlake.session import dealt, written

#: Words that say nothing about a report.
STOPWORDS = (
    "the", "and", "for", "that", "with", "this", "from", "have", "has", "been", "are", "was", "were", "will", "would", "can", "could", "should", "may", "might", "not", "but", "they", "their",
    "there", "then", "than", "when", "what", "which", "who", "whom", "whose", "how", "why", "all", "any", "some", "each", "other", "into", "over", "under", "about", "after", "before", "during",
    "through", "between", "more", "most", "such", "only", "own", "same", "also", "its", "his", "her", "our", "your", "you", "using", "used", "use", "new", "news", "said", "says", "according",
    "report", "reports", "reported", "research", "researchers", "blog", "post", "article", "read", "however", "while", "where", "these", "those", "them", "via", "out", "per", "get",
)


#: Words of three or more of a-z, 0-9, hyphen and dot that begin with a letter or digit.
TOKEN = r"([a-z0-9][a-z0-9\-.]{2,})"


def tokens(text: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Words of three or more of a-z, 0-9, hyphen and dot that begin with a letter or digit, stop words left out."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN)), lambda t: ~t.isin(*stop))


#: Terms that are sent to all executors; more are joined by a shuffle. Documents of a task while their words are counted.
FEW_TERMS, TASK_DOCUMENTS = 1_000_000, 10_000


def tfidf(docs: DataFrame, id_col: str, text: Column, min_tokens: int = 0) -> DataFrame:
    """``id, term, weight``: (1 + ln tf)(ln((1 + n) / (1 + df)) + 1), of length 1 per document; besides ``df``, ``n`` and a number ``term_id`` of each term.

    Texts are dealt by id and cut once: a document's words are counted where its text is, the counts are written, and all that follows reads them. ``df`` is
    aggregated per term before it is joined; n counts all documents, those with fewer than ``min_tokens`` included.
    """
    texts = dealt(docs.select(F.col(id_col).alias("id"), text.alias("text")), TASK_DOCUMENTS, "id")
    words = texts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN))).alias("term"))
    tf = words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")).where(~F.col("term").isin(*STOPWORDS))
    if min_tokens:
        tf = tf.withColumn("_t", F.sum("tf").over(Window.partitionBy("id"))).where(F.col("_t") >= min_tokens).drop("_t")
    tf = written(tf, "tfidf-counts")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = written(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("term_id", F.monotonically_increasing_id()), "tfidf-df")
    raw = tf.join(F.broadcast(df) if df.count() <= FEW_TERMS else df, "term").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("weight"), "df", "n", "term_id")


#: A block as one row: ids of its documents, its terms in order, in how many documents each is and whether it counts, and those documents (places in ids) and their weights, term by term.
BLOCK = "own int, ids binary, terms binary, counts binary, few binary, docs binary, weights binary"


def _block(own: int, part):
    """Rows (id, term, weight, few) of one block as one row of ``BLOCK``."""
    import numpy as np
    import pyarrow as pa

    whose, term, weight, few = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "term", "weight", "few"))
    ids, docs = np.unique(whose, return_inverse=True)
    order = np.lexsort((docs, term))
    terms, first, counts = np.unique(term[order], return_index=True, return_counts=True)
    columns = (ids.astype(np.int64), terms.astype(np.int64), counts.astype(np.int64), few[order][first].astype(bool), docs[order].astype(np.int32), weight[order].astype(np.float64))
    return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], ["own", "ids", "terms", "counts", "few", "docs", "weights"])


def _blocks(batches):
    """All rows of a task, which are one block's, as one row."""
    import pyarrow as pa

    batches = [b for b in batches if b.num_rows]
    if batches:
        part = pa.Table.from_batches(batches).combine_chunks()
        yield _block(part.column("own")[0].as_py(), part)


#: Entries that a step of a product holds at once.
STEP = 1_000_000


def _runs(begin, size):
    """Places of runs of ``size`` from ``begin`` on, one after another."""
    import numpy as np

    ends = np.cumsum(size)
    out = np.repeat(begin - (ends - size), size)
    out += np.arange(len(out))
    return out


def _portions(size, most: int):
    """Slices of consecutive items whose sizes add up to about ``most``."""
    import numpy as np

    ends = np.cumsum(size)
    if not len(ends) or ends[-1] <= most:
        return [slice(0, len(ends))]
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(ends)]
    return [slice(i, j) for i, j in zip(cuts, cuts[1:])]


def _products(x: tuple, y: tuple, threshold: float, dense: int) -> tuple:
    """Pairs (a, b, cosine) of two blocks (columns of ``BLOCK`` after own) that reach ``threshold`` and share a term that counts; and how many pairs were added up in full.

    Document by document of the one block, products are added up along the lists of its terms in the other. What the most common terms have in common isn't: it is
    at most the product of the two norms over these terms. A pair that can reach the threshold with that is added up in full, in double precision. Up to which term
    that goes is chosen for each document by its work: products along lists, and pairs that are left. Terms that fewer than ``dense`` pairs share are always added up.
    """
    import numpy as np

    ids_x, ids_y, least = x[0], y[0], threshold - 1e-9
    both, *places = np.intersect1d(x[1], y[1], assume_unique=True, return_indices=True)
    few, sides = y[3][places[1]], []
    for (ids, _, counts, _, docs, weights), place in zip((x, y), places):
        size = counts[place]
        at = _runs((np.cumsum(counts) - counts)[place], size)
        sides.append((size, docs[at].astype(np.int64), weights[at], np.repeat(np.arange(len(both)), size), len(ids)))
    (size_x, doc_x, weight_x, term_x, n_x), (size_y, doc_y, weight_y, term_y, n_y) = sides
    out, none = [], np.empty(0, np.int64)
    if not len(both):
        return none, none, np.empty(0), 0

    # common[l] of the most common terms are left to the bound at level l; born is the first level at which a term is
    meets = size_x * size_y
    bounded = int((meets >= dense).sum())
    common = [0, *[int(2 ** (k / 2)) for k in range(12, 80) if 2 ** (k / 2) < bounded], *[bounded][: bounded > 0]]
    rank = np.empty(len(both), np.int64)
    rank[np.argsort(-meets, kind="stable")] = np.arange(len(both))
    born, levels = np.searchsorted(common, rank, side="right"), len(common)
    table = lambda doc, term, value, n: np.bincount(doc * (levels + 1) + born[term], value, n * (levels + 1)).reshape(n, levels + 1)
    norms_x, norms_y = (np.sqrt(table(doc, term, weight * weight, n).cumsum(1)[:, :levels]) for _, doc, weight, term, n in sides)
    work = table(doc_x, term_x, size_y[term_x], n_x)
    work = work.sum(1)[:, None] - work.cumsum(1)[:, :levels]
    full = 0.6 * len(doc_y) / n_y + 20
    for k in range(levels):
        reach = (least - 0.04) / np.maximum(norms_x[:, k], 1e-9)
        work[:, k] += full * (n_y - np.searchsorted(np.sort(norms_y[:, k]), reach))
    level = work.argmin(1)

    # both blocks document by document, the other one by its terms as well
    own = lambda doc, n: np.argsort(doc.astype(np.uint16) if n <= 1 << 16 else doc, kind="stable")
    begin = np.cumsum(size_y) - size_y
    most = np.maximum.reduceat(weight_y, begin)
    chance = np.bincount(doc_x, weight_x * most[term_x], n_x) >= least
    order = own(doc_x, n_x)
    of_x, by_x = np.searchsorted(doc_x[order], np.arange(n_x + 1)).tolist(), (term_x[order], weight_x[order])
    order = own(doc_y, n_y)
    sizes = np.bincount(doc_y, minlength=n_y)
    begins, by_y = np.cumsum(sizes) - sizes, (term_y[order], weight_y[order])
    highest, columns = norms_y.max(0), np.ascontiguousarray(norms_y.T)
    whole, dots, compared = np.zeros(len(both)), np.zeros(n_y), 0
    for i in np.flatnonzero(chance).tolist():
        terms, weights = by_x[0][of_x[i] : of_x[i + 1]], by_x[1][of_x[i] : of_x[i + 1]]
        k, bound = level[i], norms_x[i, level[i]]
        some = born[terms] > k
        t, w = terms[some], weights[some]
        size = size_y[t]
        for n, part in enumerate(_portions(size, STEP)):
            at = _runs(begin[t[part]], size[part])
            sums = np.bincount(doc_y[at], weight_y[at] * np.repeat(w[part], size[part]), n_y)
            dots = dots + sums if n else sums
        j = np.flatnonzero(dots >= least - bound * highest[k])
        if len(j):
            j = j[(dots[j] + bound * columns[k][j] >= least) & (ids_x[i] < ids_y[j] if ids_x is ids_y else True)]
        if not len(j):
            continue
        compared += len(j)
        whole[terms] = weights
        for part in _portions(sizes[j], STEP):
            to = j[part]
            at = _runs(begins[to], sizes[to])
            value, pair = whole[by_y[0][at]], np.repeat(np.arange(len(to)), sizes[to])
            cosine = np.bincount(pair, value * by_y[1][at], len(to))
            if (cosine >= threshold).any():
                counts = np.bincount(pair, (value > 0) & few[by_y[0][at]], len(to)) > 0
                hit = np.flatnonzero((cosine >= threshold) & counts)
                out.append((np.full(len(hit), ids_x[i]), ids_y[to[hit]], cosine[hit]))
        whole[terms] = 0
    if not out:
        return none, none, np.empty(0), compared
    a, b, cosine = map(np.concatenate, zip(*out))
    return np.minimum(a, b), np.maximum(a, b), cosine, compared


def leading(weights: DataFrame, threshold: float) -> DataFrame:
    """``id, term`` of the rarest terms of each document, as many as leave the others a norm below ``threshold``.

    Two documents of that cosine share one of them: the rarer ends of both lists are cut at the same order of terms, and what all other terms have in
    common is less than the norm of the longer rest.
    """
    order = Window.partitionBy("id").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    rest = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(order))
    return weights.withColumn("_rest", rest).where(F.col("_rest") >= threshold - 1e-6).select("id", "term")


#: Pairs a document, of which one has the terms of both joined again; where more are to be expected, blocks are multiplied. A few documents are always joined.
MEETINGS, FEW_DOCUMENTS = 2, 2000


def tfidf_pairs(weights: DataFrame, threshold: float, block: int = 12_000, dense: int = 500, most_meetings: float = 0.02) -> DataFrame:
    """``a, b, cosine`` of document pairs at or over ``threshold``, each once, that share a term which is in half of the ``n`` documents at most.

    A term in ``df`` documents counts for that if ``df`` is at most the larger of 2 and n / 2. Without columns ``df`` and ``n`` (how many documents have the
    term, and there are) any pair counts.

    Where topics are many, few documents share a leading term, and those pairs are compared: their terms are joined and the cosine is added up. Where they
    share more than ``most_meetings`` of all pairs (texts of one language and threshold 0.35), or over ``MEETINGS`` pairs a document, documents are dealt into
    blocks and compared by products of pairs of blocks (see :func:`block_products`); that is quadratic in the documents, but needs no more disk than the
    vectors and the result.
    """
    if "df" not in weights.columns:
        weights = weights.join(weights.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").withColumn("n", F.lit(None).cast("long"))
    share, documents = _shared(weights, threshold)
    if share > most_meetings or (documents > FEW_DOCUMENTS and share * documents / 2 > MEETINGS):
        return written(block_products(weights, threshold, block, dense, documents).where("a IS NOT NULL").select("a", "b", "cosine"), "tfidf-pairs")
    index = written(leading(weights, threshold), "tfidf-leading")
    pairs = index.select(F.col("id").alias("a"), "term").join(index.select(F.col("id").alias("b"), "term"), "term").where("a < b").select("a", "b").distinct()
    pairs = written(pairs, "tfidf-candidates")
    wa = weights.select(F.col("id").alias("a"), "term", F.col("weight").alias("wa"), _few().alias("few"))
    wb = weights.select(F.col("id").alias("b"), "term", F.col("weight").alias("wb"))
    dot = pairs.join(wa, "a").join(wb, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"), F.max("few").alias("few"))
    return dot.where((F.col("cosine") >= threshold) & F.col("few")).drop("few")


def _few() -> Column:
    """Whether a term is in few enough documents to count."""
    return F.col("n").isNull() | (F.col("df") <= F.greatest(F.lit(2), F.expr("n div 2")))


def _shared(weights: DataFrame, threshold: float, some: int = 8, least: int = 1000, most: int = 10_000) -> tuple[float, int]:
    """How many pairs of documents share a leading term, as a share of all pairs (a term more often counts more), and the number of documents.

    Of more than ``least`` documents one in ``some`` is looked at, or about ``most``, by a hash of the id: the share decides how pairs are found, not which.
    """
    documents = weights.select("id").distinct().count()
    some = max(some, documents // most)
    part = weights.where(F.pmod(F.xxhash64("id"), F.lit(some)) == 0) if documents > least else weights
    index = leading(part, threshold)
    met = index.groupBy("term").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0
    seen = documents / some if documents > least else documents
    return met / max(seen * seen / 2, 1), documents


#: Blocks that documents are dealt into at least, so that all cores have pairs of them, if they have so many documents each.
LEAST_BLOCKS, LEAST_BLOCK = 10, 1000


def block_products(weights: DataFrame, threshold: float, block: int, dense: int, documents: int | None = None) -> DataFrame:
    """``a, b, cosine`` of pairs at or over the threshold, and rows without ids whose ``n`` is the number of pairs that a task added up in full.

    A block is one row of a written table, and pairs of blocks are its product with itself, which reads the table again and again but neither shuffles nor
    copies it: disk grows with the vectors, not with pairs of blocks. Of x, y and y, x one is taken, by turns, so that tasks have equal shares.
    """
    documents = weights.select("id").distinct().count() if documents is None else documents
    if "df" not in weights.columns:
        weights = weights.withColumn("df", F.lit(0)).withColumn("n", F.lit(None).cast("long"))
    if "term_id" not in weights.columns:
        weights = weights.join(written(weights.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "tfidf-terms"), "term")
    own = max(1, -(-documents // min(block, max(LEAST_BLOCK, documents // LEAST_BLOCKS))))
    rows = weights.select(F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias("own"), F.col("id").cast("long").alias("id"), F.col("term_id").alias("term"), F.col("weight").cast("double").alias("weight"), _few().alias("few"))
    blocks = written(rows.repartitionById(own, "own").mapInArrow(_blocks, BLOCK), "tfidf-blocks")
    x, y = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "xy")
    pairs = x.join(y.hint("shuffle_replicate_nl"), F.expr("(x_own < y_own) = ((x_own + y_own) % 2 = 1)"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = (np.int64, np.int64, np.int64, bool, np.int32, np.float64)
        for batch in batches:
            for r in range(batch.num_rows):
                sides: tuple = ([], [])
                number = [batch.column(c)[r].as_py() for c in (0, 1 + len(kinds))]
                for side, first in zip(sides, (1, 2 + len(kinds))):
                    side += [np.frombuffer(batch.column(first + c)[r].as_buffer(), kind) for c, kind in enumerate(kinds)]
                a, b, cosine, n = _products(sides[0], sides[0] if number[0] == number[1] else sides[1], threshold, dense)
                yield pa.RecordBatch.from_arrays([pa.array([*a.tolist(), None], pa.int64()), pa.array([*b.tolist(), None], pa.int64()), pa.array([*cosine.tolist(), None], pa.float64()), pa.array([None] * len(a) + [n], pa.int64())], ["a", "b", "cosine", "n"])

    return pairs.mapInArrow(run, "a long, b long, cosine double, n long")


def suppress_series(edges: DataFrame, docs: DataFrame, id_col: str, source: str, title: Column, least: int = 3) -> DataFrame:
    """Edges (a, b) without those inside a recurring series: one source, one headline template, ``least`` members."""
    # written: texts are read once, not for the series and again for either end of the edges
    key = written(docs.select(F.col(id_col).alias("_id"), F.col(source).alias("_s"), series_key(title).alias("_k")).where("_s IS NOT NULL AND _k <> ''"), "series-keys")
    series = key.groupBy("_s", "_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    member = key.join(series, ["_s", "_k"]).select("_id", F.struct("_s", "_k").alias("_series"))
    a, b = member.select(F.col("_id").alias("a"), F.col("_series").alias("_a")), member.select(F.col("_id").alias("b"), F.col("_series").alias("_b"))
    return edges.join(a, "a", "left").join(b, "b", "left").where("NOT coalesce(_a = _b, false)").drop("_a", "_b")


def clusters(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """``node, cluster``: single-link clusters by their smallest node; a node without edges is its own."""
    found = connected_components(edges, "a", "b").select(F.col("node").alias("_n"), "component")
    return nodes.select(node).join(found, F.col(node) == F.col("_n"), "left").select(node, F.coalesce("component", node).alias("cluster"))


#: Fingerprints of the first batch of the greedy choice, how many times more of them the next one has than all before it, and edges that one task decides.
FIRST_BATCH, GROWTH, TASK_EDGES = 20_000, 7, 100_000


def greedy_kept(docs: DataFrame, id_col: str, text: Column, most: int = 6) -> DataFrame:
    """``id, kept``: in the order of ids, a document is dropped if within ``most`` bits of one kept before.

    Fingerprints are decided in batches in the order of ids. Those of a batch within reach of one kept in an earlier batch are dropped without listing pairs
    (:func:`near_any`), so crowds are met once; pairs are listed only among the few that are left, and decided by :func:`_dropped`.
    """
    prints = written(docs.select(F.col(id_col).alias("id"), simhash_column(text).alias("fp")), "greedy-prints")
    groups = written(prints.groupBy("fp").agg(F.min("id").alias("id")), "greedy-groups")
    n, bounds, size = groups.count(), [], FIRST_BATCH
    if n > FIRST_BATCH:
        some = sorted(r["id"] for r in groups.select("id").orderBy(F.xxhash64("id")).limit(2000).collect())
        while size < n:
            bounds.append(some[len(some) * size // n])
            size *= 1 + GROWTH
    kept = None
    for low, high in zip([None, *bounds], [*bounds, None]):
        batch = groups if low is None else groups.where(F.col("id") >= low)
        batch = batch if high is None else batch.where(F.col("id") < high)
        if kept is not None:
            batch = written(batch.join(near_any(batch, kept, "fp", most).distinct(), "fp", "left_anti"), "greedy-batch")
        gone = _dropped(near_pairs(batch, "id", "fp", most))
        new = written(batch.join(gone.withColumnRenamed("b", "id"), "id", "left_anti").select("id", "fp"), "greedy-kept")
        kept = new if kept is None else kept.unionByName(new)
    first = kept.select(F.col("id").alias("_first"), "fp")
    return prints.join(first, "fp", "left").select("id", (F.col("_first").isNotNull() & (F.col("id") == F.col("_first"))).alias("kept"))


def _dropped(edges: DataFrame) -> DataFrame:
    """``b``: who is dropped if in the order of ids, of every edge a, b (a < b), b goes if a stays.

    The choice is made in rounds, everywhere at once: whoever has no undecided smaller neighbour stays, and its neighbours are dropped. Each round goes on with
    the edges among the undecided only, until ``TASK_EDGES`` at most are left, which one task decides in their order.
    """
    edges, gone = written(edges, "greedy-edges"), None
    while edges.count() > TASK_EDGES:
        # whoever has no undecided smaller neighbour is kept, and drops its neighbours
        later = written(edges.select(F.col("b").alias("a")).distinct(), "greedy-later")
        dropped = written(edges.join(later, "a", "left_anti").select("b").distinct(), "greedy-dropped")
        gone = dropped if gone is None else gone.unionByName(dropped)
        edges = written(edges.join(dropped, "b", "left_anti").join(dropped.withColumnRenamed("b", "a"), "a", "left_anti"), "greedy-edges")

    def decide(batches):
        import pyarrow as pa

        out: dict = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a not in out:
                    out[b] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(out), kind)], ["b"])

    kind = to_arrow_type(edges.schema["b"].dataType)
    rest = edges.select("a", "b").coalesce(1).sortWithinPartitions("a").mapInArrow(decide, f"b {edges.schema['b'].dataType.simpleString()}")
    return rest if gone is None else gone.unionByName(rest)


def main_text(html: Column) -> Column:
    """Visible text of an article or body, without scripts, styles, navigation and asides."""
    def one(page: str) -> str:
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            skipped = {"script", "style", "nav", "aside", "footer", "header", "title", "noscript"}
            blocks = {"p", "div", "li", "br", "h1", "h2", "h3", "tr", "article", "section"}

            def __init__(self):
                super().__init__()
                self.off, self.out = 0, []

            def handle_starttag(self, tag, attrs):
                self.off += tag in self.skipped
                if tag in self.blocks:
                    self.out.append("\n")

            def handle_endtag(self, tag):
                self.off = max(0, self.off - (tag in self.skipped))

            def handle_data(self, data):
                if not self.off:
                    self.out.append(data)

        reader = Reader()
        reader.feed(page)
        reader.close()
        lines = (" ".join(line.split()) for line in "".join(reader.out).split("\n"))
        return "\n".join(line for line in lines if line)

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(html)
