"""Entity matching: aliases, containment, fuzzy names, suffixes and ranges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.functions import fuzzy
from cinderlake.functions.text import host, normal_name
from cinderlake.operators.terms import terms_found
from cinderlake.session import written

#: Terms and entries of a list that are held against rows one by one, at most.
FEW_TERMS = 32
#: Domains that host other people's things, in the order in which they are tried.
PLATFORM_DOMAINS = (
    "microsoft.com", "windows.net", "azureedge.net", "apple.com", "google.com", "googleapis.com", "github.com", "githubusercontent.com", "gitlab.com", "supabase.co", "amazonaws.com",
    "cloudfront.net", "workers.dev", "pages.dev", "dropbox.com", "mediafire.com", "discord.com", "discordapp.com", "pastebin.com", "t.me", "talosintelligence.com", "welivesecurity.com",
    "unit42.paloaltonetworks.com", "sentinelone.com", "trendmicro.com", "securelist.com", "cisa.gov", "bleepingcomputer.com", "thedfirreport.com",
)


def match_names(left: DataFrame, left_id: str, names: str, right: DataFrame, right_id: str, right_name: str) -> DataFrame:
    """``left_id, right_id``: the first of the array ``names`` that a right row has, normalised; of right rows
    with one name the largest id counts."""
    build = right.groupBy(normal_name(F.col(right_name)).alias("_k")).agg(F.max(right_id).alias(right_id)).where("_k <> ''")
    probe = left.select(left_id, F.posexplode(names).alias("_pos", "_name")).select(left_id, "_pos", normal_name(F.col("_name")).alias("_k"))
    hit = probe.join(build, "_k")
    return hit.groupBy(left_id).agg(F.min_by(right_id, "_pos").alias(right_id))


def match_two_tier(left: DataFrame, left_id: str, addresses: str, names: str, by_address: DataFrame, by_name: DataFrame) -> DataFrame:
    """Any address first, else the names. The right sides are (key, target)."""
    a = left.select(left_id, F.posexplode(addresses).alias("_pos", "key")).join(by_address, "key").groupBy(left_id).agg(F.min_by("target", "_pos").alias("_a"))
    n = left.select(left_id, F.posexplode(names).alias("_pos", "_n")).withColumn("key", normal_name(F.col("_n"))).join(by_name, "key").groupBy(left_id).agg(F.min_by("target", "_pos").alias("_b"))
    out = left.select(left_id).join(a, left_id, "left").join(n, left_id, "left")
    return out.select(left_id, F.coalesce("_a", "_b").alias("target"), F.when(F.col("_a").isNotNull(), "address").when(F.col("_b").isNotNull(), "name").alias("rung"))


def watch_contains(rows: DataFrame, row_id: str, text: Column, watch: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``watch_id, row_id`` where a text has a watched term (``watch_id, term``); known pairs are left out.

    Up to ``FEW_TERMS`` terms are looked for one by one without leaving the JVM, more by one automaton.
    """
    few = [(r["watch_id"], r["term"]) for r in watch.where("term IS NOT NULL").distinct().limit(FEW_TERMS + 1).collect()]
    if few and len(few) <= FEW_TERMS:
        terms = F.array(*[F.struct(F.lit(i).cast(watch.schema["watch_id"].dataType).alias("watch_id"), F.lower(F.lit(t)).alias("term")) for i, t in few])
        low = rows.select(row_id, F.lower(text).alias("_t"))
        hits = low.select(row_id, F.explode(F.array_distinct(F.filter(terms, lambda w: F.contains(F.col("_t"), w["term"])))).alias("w"))
        out = hits.select(F.col("w.watch_id").alias("watch_id"), row_id)
    else:
        out = terms_found(rows, row_id, text, watch, "watch_id", "term")
    return out if known is None else out.join(known, ["watch_id", row_id], "left_anti")


def watch_fuzzy(victims: DataFrame, row_id: str, name: str, domain: str, watch: DataFrame, threshold: int = 85) -> DataFrame:
    """``watch_id, row_id, match``: fuzzy matches of a watch list (``watch_id, name, domain, keywords``, keywords between commas).

    The first of domain, name and keywords in their order that reaches the threshold is the match; domains and keywords under three letters
    match nothing, and names under three letters have no match by name or keyword. Each distinct (name, domain) is looked at once. A list of up to ``FEW_TERMS``
    entries is held against them in blocks; of a longer one, distinct texts meet by the letters that they must share
    (:func:`_near_texts`, :func:`_near_parts`), and only those pairs are scored.
    """
    few = watch.limit(FEW_TERMS + 1).collect()
    if len(few) <= FEW_TERMS:
        return _watch_few(victims, row_id, name, domain, few, threshold)
    known = written(watch.select("watch_id", *[fuzzy.text_column("tidy", F.coalesce(c, F.lit(""))).alias(c) for c in ("name", "domain")], fuzzy.text_column("sorted_words", F.coalesce("name", F.lit(""))).alias("ws"), "keywords"), "fuzzy-watch")
    keys = F.posexplode(F.transform(F.split(F.coalesce("keywords", F.lit("")), ","), F.trim)).alias("pos", "raw")
    words = known.where("length(name) >= 3").select("watch_id", keys).where("trim(raw) <> ''").select("watch_id", "pos", fuzzy.text_column("tidy", F.col("raw")).alias("w")).where("length(w) >= 3")
    distinct = victims.select(F.col(name).alias("_n"), F.col(domain).alias("_d")).distinct()
    texts = [fuzzy.text_column(kind, F.coalesce(c, F.lit(""))).alias(v) for kind, c, v in (("tidy", "_n", "vn"), ("tidy", "_d", "vd"), ("sorted_words", "_n", "vs"))]
    distinct = written(distinct.select("_n", "_d", *texts), "fuzzy-victims")
    long_names = distinct.where("length(vn) >= 3")
    sides = (
        ("fuzzy_domain", "ratio", known.where("length(domain) >= 3").select("watch_id", F.lit(0).alias("pos"), F.col("domain").alias("w")), distinct.where("length(vd) >= 3").withColumn("v", F.col("vd")), _near_texts),
        ("fuzzy_name", "ratio", known.where("length(name) >= 3").select("watch_id", F.lit(0).alias("pos"), F.col("ws").alias("w")), long_names.withColumn("v", F.col("vs")), _near_texts),
        ("fuzzy_keyword", "partial_ratio", words, long_names.withColumn("v", F.col("vn")), _near_parts),
    )
    found = None
    for rank, (label, kind, ours, theirs, near) in enumerate(sides):
        theirs = theirs.select("_n", "_d", "v")
        some = lambda df, c: df.select(c).where(F.col(c) != "").distinct()
        pairs = near(some(ours, "w"), "w", some(theirs, "v"), "v", threshold)
        scored = pairs.withColumn("score", fuzzy.ratio_column(kind, F.col("w"), F.col("v"))).where(F.col("score") >= threshold)
        hit = ours.join(scored, "w").join(theirs, "v").select("watch_id", "_n", "_d", F.struct(F.lit(rank).alias("rank"), "pos", F.concat(F.lit(f"{label}:"), "score").alias("match")).alias("m"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("watch_id", "_n", "_d").agg(F.min("m").alias("m"))
    joined = victims.join(best, F.col(name).eqNullSafe(F.col("_n")) & F.col(domain).eqNullSafe(F.col("_d")))
    return joined.select("watch_id", row_id, "m.match")


def _watch_few(victims: DataFrame, row_id: str, name: str, domain: str, watch: list, threshold: int) -> DataFrame:
    tidy = lambda s: (s or "").lower().strip()
    held = [(w["watch_id"], tidy(w["name"]), tidy(w["domain"]) or None, [tidy(k) for k in (w["keywords"] or "").split(",") if k.strip()]) for w in watch]

    def run(names: pd.Series, domains: pd.Series) -> pd.Series:
        found = [[{"watch_id": i, "match": m} for i, wn, wd, wk in held if (m := fuzzy.match_label(wn, wd, wk, n, d, threshold))] for n, d in zip(names, domains)]
        return pd.Series(found)

    distinct = victims.select(F.col(name).alias("_n"), F.col(domain).alias("_d")).distinct()
    hits = distinct.select("_n", "_d", F.explode(F.pandas_udf(run, "array<struct<watch_id:int,match:string>>")("_n", "_d")).alias("m"))
    joined = victims.join(hits, F.col(name).eqNullSafe(F.col("_n")) & F.col(domain).eqNullSafe(F.col("_d")))
    return joined.select("m.watch_id", row_id, "m.match")


def _numbered(texts: DataFrame, text: str, width: int, mark: str) -> DataFrame:
    """``text, pair``: runs of ``width`` neighbouring letters with the number of their occurrence; a shorter text is one run."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (width - 1), F.lit(1)))
    runs = F.transform(at, lambda i: F.substring(F.col(text), i, F.lit(width)))
    nth = lambda x, i: F.concat_ws(mark, x, F.size(F.filter(F.slice(F.col("_runs"), F.lit(1), i + 1), lambda y: y == x)))
    return texts.select(text, runs.alias("_runs")).select(text, F.explode(F.transform("_runs", nth)).alias("pair"))


def _letter_pairs(texts: DataFrame, text: str) -> DataFrame:
    """``text, pair``: neighbouring letters with the number of their occurrence; a single letter stands for itself."""
    return _numbered(texts, text, 2, "#")


def _leading_pairs(pairs: DataFrame, text: str, frequency: DataFrame, share: float, reach: float) -> DataFrame:
    """The rarest letter pairs of each text, as many as make sure that any text within reach has one among its own.

    Texts of m and n letters differ by d <= share (m + n) insertions and deletions, of which one breaks a pair of the text and
    the other two: (3 d + m - n) / 2 at most, with n from m / reach. All other pairs are common.
    """
    m = F.length(text)
    lost = F.floor(((1 + 3 * share) * m - (1 - 3 * share) * F.ceil(m / F.lit(reach) - 1e-9)) / 2 + 1e-9)
    nth = F.row_number().over(Window.partitionBy(text).orderBy(F.coalesce("_f", F.lit(0)), "pair"))
    return pairs.join(frequency, "pair", "left").withColumn("_nth", nth).where(F.col("_nth") <= lost + 1).select(text, "pair")


def _letters(texts: DataFrame, text: str) -> DataFrame:
    """``text, pair``: single letters with the number of their occurrence."""
    return _numbered(texts, text, 1, "'")


def _near_parts(names: DataFrame, name: str, others: DataFrame, other: str, threshold: int, longest: float = 1.0) -> DataFrame:
    """``name, other`` of which the shorter can have a ratio of ``threshold`` with some part of the longer, no others being lost.

    A part that is like enough leaves the shorter all but so many of its letter pairs, and all but fewer of its letters. So the longer text has one of the
    shorter's rarest pairs, one more than can be lost; where a text has no more than can be lost, one of its rarest letters. A part is up to ``longest`` times
    as long as the shorter.
    """
    share = 1 - (threshold - 0.5) / 100
    reach = 2 * 100 / (threshold - 0.5) - 1 + 1e-9

    def half(short: DataFrame, s: str, long: DataFrame, t: str, fits) -> DataFrame:
        tokens = _letter_pairs(long, t).unionByName(_letters(long, t))
        frequency = tokens.groupBy("pair").agg(F.count(F.lit(1)).alias("_f"))
        m = F.length(s)
        least = F.ceil(m / F.lit(reach) - 1e-9)
        # what can be lost is a linear function of the part's length, so largest for the shortest or the longest part
        lost = lambda k: F.greatest(*[F.floor(((1 + k * share) * m - (1 - k * share) * p) / 2 + 1e-9) for p in (least, m * longest)])
        pairs_lost, letters_lost = lost(3), lost(1)
        by_pairs = m - 1 > pairs_lost
        nth = F.row_number().over(Window.partitionBy(s).orderBy(F.coalesce("_f", F.lit(0)), "pair"))
        rarest = lambda df, lost: df.join(frequency, "pair", "left").withColumn("_nth", nth).where(F.col("_nth") <= lost + 1).select(s, "pair")
        marks = rarest(_letter_pairs(short.where(by_pairs), s), pairs_lost).unionByName(rarest(_letters(short.where(~by_pairs), s), letters_lost))
        return marks.join(tokens, "pair").where(fits).select(name, other).distinct()

    n, o = F.length(name), F.length(other)
    return half(names, name, others, other, n <= o).unionByName(half(others, other, names, name, o < n))


def _near_texts(names: DataFrame, name: str, others: DataFrame, other: str, threshold: int) -> DataFrame:
    """``name, other`` that can have a ratio of ``threshold``, no others being lost.

    From 85 on they share one of their leading letter pairs; below, the longer has one of the shorter's rarest pairs or letters.
    """
    reach = 2 * 100 / (threshold - 0.5) - 1 + 1e-9  # the score is rounded before it is compared
    fits = (F.length(other) <= F.length(name) * reach) & (F.length(name) <= F.length(other) * reach)
    if threshold < 85:
        return _near_parts(names, name, others, other, threshold, reach).where(fits)
    cut = _letter_pairs(others, other)
    frequency = cut.groupBy("pair").agg(F.count(F.lit(1)).alias("_f"))
    share = 1 - (threshold - 0.5) / 100
    a, b = _leading_pairs(_letter_pairs(names, name), name, frequency, share, reach), _leading_pairs(cut, other, frequency, share, reach)
    return a.join(b, "pair").where(fits).select(name, other).distinct()


def resolve(names: DataFrame, name: str, actors: DataFrame, actor_id: str, actor_name: str, aliases: DataFrame, threshold: int = 85) -> DataFrame:
    """Ladder of exact name, approved alias (alias, actor_id), fuzzy ratio; more than one hit on a rung is ambiguous.

    The fuzzy rung compares what is left with the distinct names of actors that share a leading letter pair.
    """
    key = lambda c: F.lower(F.trim(F.col(c)))
    todo = names.select(key(name).alias("k")).where("k <> ''").distinct()
    exact = actors.groupBy(key(actor_name).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(actor_id).alias("id"))
    alias = aliases.select(key("alias").alias("k"), actor_id).distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(actor_id).alias("id"))
    one = todo.join(exact, "k").withColumn("rung", F.lit("exact"))
    two = todo.join(one, "k", "left_anti").join(alias, "k").withColumn("rung", F.lit("alias"))
    rest = todo.join(one, "k", "left_anti").join(two, "k", "left_anti")
    known = actors.select(key(actor_name).alias("other"), F.col(actor_id).alias("id")).where("other <> ''")
    near = written(_near_texts(rest, "k", known.select("other").distinct(), "other", threshold), "resolve-near")
    scored = near.withColumn("score", fuzzy.ratio_column("ratio", F.col("k"), F.col("other"))).where(F.col("score") >= threshold).join(known, "other")
    best = scored.groupBy("k").agg(F.max(F.struct("score", F.lit(1))).alias("_m"), F.collect_list(F.struct("score", "id")).alias("all"))
    top = F.filter("all", lambda x: x["score"] == F.col("_m.score"))
    three = best.select("k", F.size(F.array_distinct(F.transform(top, lambda x: x["id"]))).cast("long").alias("n"), F.array_min(F.transform(top, lambda x: x["id"])).alias("id"), F.lit("fuzzy").alias("rung"))
    found = one.unionByName(two).unionByName(three)
    out = todo.join(found, "k", "left")
    return out.select("k", F.coalesce(F.when(F.col("n") > 1, "ambiguous").otherwise(F.col("rung")), F.lit("unknown")).alias("rung"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def suffix_match(rows: DataFrame, url: str, domains: tuple[str, ...] = PLATFORM_DOMAINS) -> DataFrame:
    """``platform``: the first listed domain that the host is or ends in; onion hosts have none."""
    h = host(F.col(url))
    ends = lambda d: (h == d) | h.endswith("." + d)
    first = F.coalesce(*[F.when(ends(d), F.lit(d)) for d in domains])
    return rows.withColumn("host", h).withColumn("platform", F.when(~h.endswith(".onion"), first))


def range_lookup(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, cell: int) -> DataFrame:
    """Each point with every span that covers it, by equi-join on cells of ``cell`` units.

    A span is entered in each cell it touches, so the join is as skew-safe as its cells are small.
    """
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
    return points.withColumn("_cell", F.floor(F.col(at) / cell)).join(cells, "_cell").where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("_cell")


def as_of_span(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, part: str) -> DataFrame:
    """Each point with the last span of its part that begins at or before it, null if that has ended."""
    p = points.select(part, F.col(at).alias("_at"), F.lit(1).alias("_point"), F.struct(*points.columns).alias("_row"), F.lit(None).cast("struct<lo:bigint,hi:bigint>").alias("_span"))
    s = spans.select(part, F.col(lo).alias("_at"), F.lit(0).alias("_point"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.struct(F.col(lo).cast("bigint").alias("lo"), F.col(hi).cast("bigint").alias("hi")).alias("_span"))
    last = F.last("_span", ignorenulls=True).over(Window.partitionBy(part).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0))
    out = p.unionByName(s).withColumn("_span", last).where("_point = 1")
    covers = F.col("_span.hi") >= F.col("_at")
    return out.select("_row.*", F.when(covers, F.col("_span.lo")).alias("span_lo"), F.when(covers, F.col("_span.hi")).alias("span_hi"))


def corroboration(findings: DataFrame, value: str, source: str) -> DataFrame:
    """``value, source, others``: distinct known other sources of a value, counted per value and not per pair."""
    own = findings.where(F.col(value).isNotNull()).select(value, source).distinct()
    all_of = own.groupBy(value).agg(F.count(source).alias("_n"))
    return own.join(all_of, value).select(value, source, (F.col("_n") - F.when(F.col(source).isNull(), 0).otherwise(1)).alias("others"))


def chain(edges: DataFrame, src: str, dst: str, hops: int | None = 10) -> DataFrame:
    """``src, target, n``: where each start ends after following its edge up to ``hops`` times, and how often it did.

    Of several edges of a start the smallest counts. Pointers double: jumps of 1, 2, 4 ... edges are put together by the
    binary digits of ``hops``, so 10 hops are four joins. Without ``hops`` chains are followed to their ends, however long; the number of
    joins is the logarithm of the longest, and a start whose chain runs into a circle has a null target.
    """
    e = edges.groupBy(F.col(src).alias("s")).agg(F.min(dst).alias("t")).where("t IS NOT NULL AND s IS NOT NULL").withColumn("n", F.lit(1))

    def after(one: DataFrame, two: DataFrame) -> DataFrame:
        on = two.select(F.col("s").alias("_s"), F.col("t").alias("_t"), F.col("n").alias("_n"))
        return one.join(on, F.col("t") == F.col("_s"), "left").select("s", F.coalesce("_t", "t").alias("t"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))

    if hops is not None:
        out, jump, left = None, e, hops
        while left:
            if left & 1:
                out = jump if out is None else after(jump, out)
            left >>= 1
            if left:
                jump = written(after(jump, jump), "chain")
        return out.select(F.col("s").alias(src), F.col("t").alias("target"), "n")
    jump = written(e.withColumn("n", F.col("n").cast("long")), "chain")
    starts, longest = jump.count(), 1
    while longest <= starts:
        nxt = written(after(jump, jump), "chain")
        if nxt.where(F.col("n") == 2 * longest).isEmpty():  # nobody used the whole of both jumps: all have arrived
            jump = nxt
            break
        jump, longest = nxt, 2 * longest
    # on a chain of more edges than there are starts a start has come twice
    return jump.select(F.col("s").alias(src), F.when(F.col("n") <= starts, F.col("t")).alias("target"), "n")


def route_edges(edges: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """Edges (src, dst) by the kinds (id, kind) of their ends: ``kind>kind`` to DataFrame, lazily."""
    a = nodes.select(F.col("id").alias("src"), F.col("kind").alias("src_kind"))
    b = nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
    both = edges.join(a, "src").join(b, "dst")
    kinds = (("group", "technique"), ("group", "software"), ("software", "technique"))
    return {f"{x}>{y}": both.where((F.col("src_kind") == x) & (F.col("dst_kind") == y)) for x, y in kinds}
