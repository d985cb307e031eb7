"""An article's way through the states of analysis, what its findings may change, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.functions.indicators import anchor
from cinderlake.operators.ingest import insert_absent
from cinderlake.session import written

#: The states in their order, those that end an article's way well, and the relation that makes two names one.
STATES = ("triage", "classify", "extract_ioc", "map_ttp", "diamond_model", "narrative", "adversary_sketch", "verify")
FINISHED = ("ok", "dropped")
SAME_ACTOR, UNSTATED = "same_actor", "unstated"
#: Kinds of indicators that stay an adversary's own, and the fields of a group that take them.
INFRASTRUCTURE = {"btc_address": "btc_addresses", "url": "profile_urls"}


def attempt_status(attempts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keys, status, attempts, detail`` from a ladder of attempts (outcome, detail).

    The first answer or refusal ends it: ``answered`` is ok and ``irrelevant`` dropped, ``refused`` gives its detail as status
    and isn't an attempt. Otherwise the last one counts: ``failed`` (nobody answered) is an error, ``rejected`` is staged for a human.
    """
    end = F.col("outcome").isin("answered", "irrelevant", "refused", "unwired")
    rows = attempts.groupBy(*keys).agg(
        F.min(F.when(end, F.struct(F.col(order).alias("o"), "outcome", "detail"))).alias("first"), F.max(F.struct(F.col(order).alias("o"), "outcome", "detail")).alias("last"),
        F.array_agg(F.struct(F.col(order).alias("o"), "outcome")).alias("all"),
    )
    by = F.coalesce("first", "last")
    word = F.create_map(*[F.lit(x) for x in ("answered", "ok", "irrelevant", "dropped", "unwired", "error", "failed", "error", "rejected", "staged")])
    tried = F.size(F.filter("all", lambda a: (a["o"] <= by["o"]) & (a["outcome"] != "refused")))
    return rows.select(*keys, F.when(by["outcome"] == "refused", by["detail"]).otherwise(F.try_element_at(word, by["outcome"])).alias("status"), tried.alias("attempts"), by["detail"].alias("detail"))


def progress(articles: DataFrame, article: str, body: str, runs: DataFrame) -> DataFrame:
    """``article, done, at, why``: finished states in a row, the state that comes next or where it stopped, and why.

    A finished state is not run again. An article without body stops at the first state, one that triage drops at triage, and
    any other status but ok stops at its state.
    """
    have = runs.where(F.col("state").isin(*STATES)).groupBy(article).agg(F.map_from_entries(F.collect_list(F.struct("state", "status"))).alias("_by"))
    rows = articles.join(have, article, "left")
    status = F.transform(F.array(*map(F.lit, STATES)), lambda s: F.coalesce(F.try_element_at("_by", s), F.lit("")))
    halt = F.array_position(F.transform(status, lambda s: s == "ok"), False)  # the first that isn't ok, 0 if all are
    at = F.get(F.array(*map(F.lit, STATES)), (halt - 1).cast("int"))
    own = F.get(status, (halt - 1).cast("int"))
    blank = F.coalesce(F.col(body), F.lit("")) == ""
    why = F.when(blank, "the article has no body").when(halt == 0, "finished").when(own == "dropped", "not relevant").when(own == "", "next").otherwise(own)
    done = F.when(blank, 0).when(halt == 0, len(STATES)).otherwise(halt - 1).cast("int")
    return rows.select(article, done.alias("done"), F.when(blank, STATES[0]).otherwise(F.coalesce(at, F.lit(""))).alias("at"), why.alias("why"))


def ingest_cycle(seeds: DataFrame, sources: DataFrame, entries: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources (source, enabled), articles (url, source, body) and the queue for full texts after one cycle.

    Seeds are inserted where absent and never change a source; entries (source, url) of enabled sources become articles where their
    url is new; articles of enabled sources without body are queued. Each phase is written before the next.
    """
    all_sources = written(sources.unionByName(insert_absent(sources, seeds, ["source"], ["source"])), "cycle-sources")
    on = all_sources.where("enabled").select("source")
    new = entries.join(on, "source", "left_semi").select("url", "source", F.lit(None).cast("string").alias("body"))
    all_articles = written(articles.select("url", "source", "body").unionByName(insert_absent(articles, new, ["url"], ["source"])), "cycle-articles")
    return all_sources, all_articles, fulltext_queue(all_articles, all_sources)


def fulltext_queue(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """``url, source`` of articles without body whose source is enabled."""
    return articles.where("coalesce(body, '') = ''").join(sources.where("enabled").select("source"), "source").select("url", "source")


def actors_of(output: Column) -> Column:
    """``array<struct<name,relation,related_to,evidence_quote>>`` of an output's named_actors, which are texts or objects."""
    kind = "name string, relation string, related_to string, evidence_quote string"
    each = F.from_json(F.get_json_object(output, "$.named_actors"), "array<string>")

    def one(e: Column) -> Column:
        read = F.from_json(e, kind)
        object_ = e.startswith("{")
        return F.struct(
            F.when(object_, read["name"]).otherwise(e).alias("name"), F.when(object_, F.coalesce(read["relation"], F.lit(UNSTATED))).otherwise(UNSTATED).alias("relation"),
            F.when(object_, F.coalesce(read["related_to"], F.lit(""))).otherwise("").alias("related_to"), F.when(object_, F.coalesce(read["evidence_quote"], F.lit(""))).otherwise("").alias("evidence_quote"),
        )

    return F.filter(F.coalesce(F.transform(each, one), F.array().cast(f"array<struct<{kind.replace(' string', ':string')}>>")), lambda a: F.coalesce(a["name"], F.lit("")) != "")


def ground_actors(rows: DataFrame, article: str, body: str, output: str) -> DataFrame:
    """One row per named actor: kept, reduced (its relation has no quotation in the article and is taken back) or rejected
    (its name isn't in the article)."""
    a = rows.select(article, F.col(body).alias("_body"), F.posexplode(actors_of(F.col(output))).alias("nth", "a")).select(article, "_body", "nth", "a.*")
    there = anchor(F.col("_body"), F.col("name"), True)["start"].isNotNull()
    backed = anchor(F.col("_body"), F.nullif(F.col("evidence_quote"), F.lit("")), True)["start"].isNotNull()
    a = a.withColumn("_there", there).withColumn("_backed", backed)
    state = F.when(~F.col("_there"), "name_not_in_article").when((F.col("relation") == UNSTATED) | F.col("_backed"), "kept").otherwise("relation_unsupported")
    reduced = F.col("state") == "relation_unsupported"
    out = a.withColumn("state", state).withColumn("claimed", F.col("relation"))
    return out.select(
        article, "nth", "name", "state", "claimed", F.when(reduced, UNSTATED).otherwise(F.col("relation")).alias("relation"), F.when(reduced, "").otherwise(F.col("related_to")).alias("related_to"),
        F.when(reduced, "").otherwise(F.col("evidence_quote")).alias("evidence_quote"),
    )


def projected(articles: DataFrame, article: str, runs: DataFrame) -> DataFrame:
    """Articles with article_type, summary_md and recommendations_md from the runs' outputs (state, output as JSON).

    What a state hasn't produced stays; empty recommendations become null.
    """
    field = lambda name: F.get_json_object("output", f"$.{name}")
    seen = lambda state: F.max(F.col("state") == state)
    found = runs.groupBy(article).agg(
        F.max(F.when(F.col("state") == "classify", field("article_type"))).alias("_type"), F.max(F.when(F.col("state") == "narrative", field("summary_md"))).alias("_summary"),
        F.max(F.when(F.col("state") == "narrative", field("recommendations_md"))).alias("_advice"), seen("classify").alias("_c"), seen("narrative").alias("_n"),
    )
    both = articles.join(found, article, "left")
    take = lambda flag, new, old: F.when(F.coalesce(F.col(flag), F.lit(False)), new).otherwise(F.col(old))
    return both.withColumns({
        "article_type": take("_c", F.col("_type"), "article_type"), "summary_md": take("_n", F.col("_summary"), "summary_md"), "recommendations_md": take("_n", F.nullif(F.col("_advice"), F.lit("")), "recommendations_md"),
    }).drop("_type", "_summary", "_advice", "_c", "_n")


def promoted(findings: DataFrame, article: str, excluded: DataFrame, key: Column) -> DataFrame:
    """``article, field, values``: infrastructure from findings (finding_kind, decision, payload) that the gate let pass.

    Only wallets and addresses of sites are an adversary's own. Values whose ``key`` is in ``excluded`` (key) belong to others. Without any exclusions
    nothing is promoted: a list that can't be checked isn't one that excludes nothing.
    """
    kinds = F.create_map(*[F.lit(x) for pair in INFRASTRUCTURE.items() for x in pair])
    rows = findings.where("finding_kind = 'ioc' AND decision = 'auto'").select(article, F.get_json_object("payload", "$.ioc_type").alias("_t"), F.get_json_object("payload", "$.value").alias("value"))
    rows = rows.withColumn("field", F.try_element_at(kinds, F.col("_t"))).where("field IS NOT NULL AND coalesce(value, '') <> ''").withColumn("_k", key)
    held = excluded.select(F.col("key").alias("_k")).distinct()
    some = held.agg((F.count(F.lit(1)) > 0).alias("_some"))
    kept = rows.join(held, "_k", "left_anti").crossJoin(F.broadcast(some)).where("_some")
    return kept.groupBy(article, "field").agg(F.array_sort(F.collect_set("value")).alias("values"))


def payload_sources(findings: DataFrame, articles: DataFrame, article: str, source: str) -> DataFrame:
    """``finding_kind, target, value, sources``: distinct known sources that propose a value, read from the payload, for a target."""
    own = findings.select(article, "finding_kind", "target", F.get_json_object("payload", "$.value").alias("value")).where("value IS NOT NULL")
    both = own.join(articles.select(article, source).where(F.col(source).isNotNull()), article)
    return both.groupBy("finding_kind", "target", "value").agg(F.count_distinct(source).alias("sources"))


def synonyms(actors: DataFrame, known: DataFrame) -> DataFrame:
    """``name, target``: names that are said to be the same actor as a known one (key, target) and aren't known themselves."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    said = actors.where((F.col("relation") == SAME_ACTOR) & (F.trim("related_to") != "")).select("name", key("name").alias("_own"), key("related_to").alias("key"))
    once = known.groupBy("key").agg(F.min("target").alias("target"), F.count_distinct("target").alias("_n"))
    hit = said.join(once.where("_n = 1").drop("_n"), "key")
    return hit.join(once.select(F.col("key").alias("_own")), "_own", "left_anti").select("name", "target").distinct()


def regraded(sources: DataFrame, grades: DataFrame, key: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Sources with the grades of ``grades`` (key, grade, by), and an audit row (key, before, after, by, at) per change."""
    both = sources.join(grades.select(key, F.col("grade").alias("_new"), "by"), key, "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("grade"))
    audit = both.where(changed).select(key, F.col("grade").alias("before"), F.col("_new").alias("after"), "by", at.alias("at"))
    return both.withColumn("grade", F.coalesce("_new", "grade")).drop("_new", "by"), audit


def overrides(audit: DataFrame, article: str, kind: str = "tlp_override") -> DataFrame:
    """Overrides of one kind, newest first per article: ``nth`` is 1 for the newest."""
    nth = F.row_number().over(Window.partitionBy(article).orderBy(F.desc("at"), F.desc("audit_id")))
    return audit.where(F.col("kind") == kind).withColumn("nth", nth)


def report(narratives: DataFrame, article: str) -> DataFrame:
    """``article, markdown``: title, bottom line with its confidence, and the sections that have a text.

    Columns: title, key_judgement, confidence, summary_md, recommendations_md, cluster_summary, actor_lines (array), likelihood,
    false_flag_note, shared_infrastructure_note, source_name, published, source_url; all may be null.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    some = lambda c: F.nullif(text(c), F.lit(""))
    lines = F.nullif(F.array_join(F.filter(F.coalesce("actor_lines", F.array().cast("array<string>")), lambda x: x != ""), "\n"), F.lit(""))
    adversary = F.concat_ws("\n\n", some("cluster_summary"), lines)
    adversary = F.concat_ws("\n\n", F.nullif(adversary, F.lit("")), F.when((adversary != "") & some("likelihood").isNotNull(), F.concat(F.lit("Assessed likelihood: "), some("likelihood"), F.lit("."))))
    section = lambda head, body: F.when(F.trim(body) != "", F.concat(F.lit(f"## {head}\n\n"), F.trim(body), F.lit("\n\n"))).otherwise("")
    bottom = F.when(some("key_judgement").isNotNull(), F.concat(F.lit("**Bottom line.** "), some("key_judgement"), F.coalesce(F.concat(F.lit(" ("), some("confidence"), F.lit(")")), F.lit("")), F.lit("\n\n"))).otherwise("")
    whole = F.concat(
        F.lit("# "), F.coalesce(some("title"), F.lit("Untitled report")), F.lit("\n*Title as published by the source; this report has none of its own.*\n\n"), bottom,
        section("What the reporting establishes", text("summary_md")), section("The adversary", adversary),
        section("Gaps and deception", F.concat_ws("\n\n", some("false_flag_note"), some("shared_infrastructure_note"))), section("Recommended action", text("recommendations_md")),
        section("Source", F.concat_ws(" · ", some("source_name"), some("published"), some("source_url"))),
    )
    return narratives.select(article, F.concat(F.rtrim(F.regexp_replace(whole, r"\s+$", "")), F.lit("\n")).alias("markdown"))


def actor_line(name: Column, kind: Column, authority: Column, aliases: Column, evidence: Column) -> Column:
    """One named actor with whoever vouches for the name; empty without a name."""
    others = F.slice(F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.lower(a) != F.lower(name)), 1, 4)
    also = F.when(F.size(others) > 0, F.concat(F.lit(", also known as "), F.array_join(others, ", "))).otherwise("")
    line = (
        F.when(kind == "known_actor", F.concat(F.lit("- **"), name, F.lit("**"), also, F.lit(" ("), authority, F.lit(")")))
        .when(kind.isin("malware", "tool"), F.concat(F.lit("- "), name, F.lit(" — "), kind, F.lit(", not an actor ("), authority, F.lit(")")))
        .when(kind == "cluster_designator", F.concat(F.lit("- "), name, F.lit(" — a cluster "), authority, F.lit(" has not named")))
        .when(kind == "vendor_named", F.concat(F.lit("- "), name, F.lit(" — "), evidence))
        .otherwise(F.concat(F.lit("- "), name, F.lit(" — recognised by no catalogue held here")))
    )
    return F.when(F.coalesce(name, F.lit("")) == "", "").otherwise(line)


def cluster_text(title: Column, body: Column, most: int = 4000) -> Column:
    """What an article is clustered by: its title twice and the beginning of its body; without title its body."""
    has = F.coalesce(title, F.lit("")) != ""
    return F.when(has, F.concat_ws(" ", title, title, F.substring(F.coalesce(body, F.lit("")), 1, most))).otherwise(F.coalesce(body, F.lit("")))


def backend(requested: str, vectors_there: bool) -> str:
    """Which vectors to cluster by: ``auto`` takes embeddings if there are any; what is asked for is never replaced."""
    if requested not in ("auto", "tfidf", "embedding"):
        raise ValueError(requested)
    return ("embedding" if vectors_there else "tfidf") if requested == "auto" else requested


def encoded(tokens: DataFrame, id_col: str, word: str, vectors: DataFrame, width: int) -> DataFrame:
    """``id_col, vector``: mean of the words' vectors (word, vector), of length 1, in single precision; zeros without known words.

    Sums are taken per dimension on the map side, so an article passes the shuffle as one row per task.
    """
    dims = [F.avg(F.get("vector", F.lit(k)).cast("double")).alias(f"_{k}") for k in range(width)]
    mean = tokens.join(vectors, word, "left").groupBy(id_col).agg(*dims)
    v = F.array(*[F.coalesce(f"_{k}", F.lit(0.0)) for k in range(width)])
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return mean.select(id_col, F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).cast("array<float>").alias("vector"))
