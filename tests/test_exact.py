"""Queries and operators that SQL can't express, against plain versions in Python."""

import random
import re
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from cinderlake.functions import fuzzy, indicators
from cinderlake.functions.text import simhash64
from cinderlake.operators import articles, guards, matching, style
from cinderlake.operators import text as X
from cinderlake.plans import matching as plans_matching

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def prints(documents):
    return {k: simhash64(t) & (1 << 64) - 1 for k, t in documents.items()}


def near(a, b):
    return (a ^ b).bit_count() <= 6


def test_near_pairs(spark, prints):
    got = {(r["a"], r["b"]) for r in QUERIES["simhash_near_pairs"](spark, SF).collect()}
    least = {}
    for k in sorted(prints):
        least.setdefault(prints[k], k)
    own = sorted(least.values())
    want = {(a, b) for a in own for b in own if a < b and near(prints[a], prints[b])} | {(least[v], k) for k, v in prints.items() if least[v] != k}
    assert got == want and len(got) > 20


def test_greedy(spark, prints):
    kept = []
    for k in sorted(prints):
        if not any(near(prints[k], prints[j]) for j in kept):
            kept.append(k)
    assert {r["id"] for r in QUERIES["simhash_greedy"](spark, SF).where("kept").collect()} == set(kept)


def test_watch_fuzzy(spark):
    got = {(r["watch_id"], r["p_partkey"], r["match"]) for r in QUERIES["watch_fuzzy_join"](spark, SF).collect()}
    want = set()
    for p in spark.read.parquet(f"{SF}/part.parquet").collect():
        for w in plans_matching.FUZZY:
            m = fuzzy.match_label(w["name"].lower().strip(), (w.get("domain") or "").lower().strip() or None, [k.strip().lower() for k in (w.get("keywords") or "").split(",") if k.strip()], p["p_name"], p["p_brand"], 80)
            if m:
                want.add((w["id"], p["p_partkey"], m))
    assert got == want and got


@pytest.mark.parametrize("threshold", [85, 92, 70])
def test_resolve_loses_no_name(spark, threshold):
    rnd = random.Random(threshold)
    word = lambda n: "".join(rnd.choice("abcde ") for _ in range(n)).strip() or "a"
    actors = sorted({word(rnd.randrange(1, 22)) for _ in range(60)})

    def edited(w):
        w = list(w)
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(w) + 1)
            w[k : k + rnd.randrange(2)] = [rnd.choice("abcde")] * rnd.randrange(2)
        return "".join(w).strip()

    names = sorted({edited(rnd.choice(actors)) for _ in range(150)} - {""})
    a = spark.createDataFrame(list(enumerate(actors)), "actor_id int, name string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {(r["k"], r["other"]) for r in matching._near_texts(n.withColumnRenamed("name", "k"), "k", a.select(F.col("name").alias("other")), "other", threshold).collect()}
    want = {(x, y) for x in names for y in actors if fuzzy.ratio(x, y) >= threshold}
    assert want <= got and (threshold < 85 or len(got) < len(names) * len(actors) / 2)


def test_urls_exact(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    for r in QUERIES["canonical_urls_exact"](spark, SF).collect():
        own, was = urlsplit(r["canonical"]), urlsplit(pages[r["page_id"]])
        assert own.netloc == was.netloc.lower() and own.fragment == "" and not re.search(r"(^|&)utm_", own.query)


def test_main_text(spark):
    for r in QUERIES["html_to_text"](spark, SF).collect():
        assert not re.search(r"<(script|style|p|div)\b", r["text"]) and "margin:0" not in r["text"]


def test_hint_has_all_indicators(spark, documents):
    texts = [*documents.values(), "hxxp://a", "a [dot] bc", "x@y.de", "2001:db8::1", "1.2.3[.]4", "f" * 32, "bc1" + "q" * 20, "no hint here. None", "foo​.com", "1" + "a" * 26]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    hinted = {r["k"] for r in rows.where(F.col("t").rlike(indicators.HINT)).collect()}
    assert all(k in hinted for k, t in enumerate(texts) if indicators.scan(t)) and len(texts) - 3 not in hinted


def test_scan_of_the_query(spark, documents):
    got = sorted((r["doc_id"], r["kind"], r["value"], r["start"], r["end"]) for r in QUERIES["ioc_scan"](spark, SF).collect())
    assert got == sorted((k, i["kind"], i["value"], i["start"], i["end"]) for k, t in documents.items() for i in indicators.scan(t))
    assert all(documents[k][a:b].lower() == v.lower() for k, kind, v, a, b in got if kind in ("ipv4", "sha1", "email"))


@pytest.mark.parametrize(("body", "quote", "found"), [
    ("He said “Starland RAT.” It ran", "'Starland RAT.'", "“Starland RAT.”"),
    ("an aside — as ever — was\n\n  made", "an aside as ever was made", "an aside — as ever — was\n\n  made"),
    ("- first item\n- second item", "first item second item", "first item\n- second item"),
    ("well–known group", "well-known group", "well–known group"),
    ("one two three four five", "one two ... five", "one two three four five"),
    ("one two three four five", "four … two", None),
    ("uncertain times", "certain times", None),
    ("at evil[.]com today", "evil.com today", "evil[.]com today"),
])
def test_quotes(body, quote, found):
    at = indicators.Anchored(body).find_quote(quote)
    assert (body[slice(*at)] if at else None) == found


@pytest.mark.parametrize(("body", "values", "found"), [
    ("see evil.com.br and evil.com.", ("evil.com",), "evil.com"), ("see evil.com.br", ("evil.com",), None), ("x hxxp://a[.]b/c y", ("http://a.b/c",), "hxxp://a[.]b/c"), ("only EVIL[.]com", ("nothing", "evil.com"), "EVIL[.]com"), ("a_b", ("b",), None), ("in İstanbul: evil.com", ("evil.com",), "evil.com"),
])
def test_values(body, values, found):
    at = indicators.Anchored(body).find(*values)
    assert (body[slice(*at)] if at else None) == found


def test_quotes_of_the_query(spark, documents):
    for r in QUERIES["quote_grounding"](spark, SF).collect():
        words = documents[r["doc_id"]].split()
        if r["start"] is not None:
            assert documents[r["doc_id"]][r["start"] : r["end"]].split() == words[2:6]


def test_windows_of_the_query(spark, documents):
    for r in QUERIES["context_windows"](spark, SF).collect():
        t = documents[r["doc_id"]]
        at = len(t) // 2
        a, b = max(0, at - 40), min(len(t), min(at + 10, len(t)) + 40)
        while a > 0 and not t[a - 1].isspace():
            a -= 1
        while b < len(t) and not t[b].isspace():
            b += 1
        assert r["w"] == " ".join(t[a:b].split())


def plain_breaches(text):
    """Rules by rule, phrase by phrase."""
    word = lambda p: [(m.start(), m.end()) for m in re.finditer(rf"(?<!\w){re.escape(p)}(?!\w)", text, re.I)]
    out = []
    for rule in style.NOTES:
        phrases = style.PHRASES[rule]
        spans = sorted({s for p in phrases for s in word(p)}, key=lambda s: (s[0], -s[1]))
        if rule in style.OUTERMOST:
            spans = [s for k, s in enumerate(spans) if not any(o[0] <= s[0] and s[1] <= o[1] for o in spans[:k])]
        out += [(rule, text[a:b], a, b) for a, b in spans]
    at = 0
    for n, m in enumerate([*re.finditer(r"[.!?](?:\s|$)", text), None]):
        part = text[at : m.start() + 1 if m else len(text)]
        if part.strip():
            begin = at + (len(part) - len(part.lstrip()) if m else 0)
            s = part.strip()
            if len(re.findall(r"[A-Za-z0-9][\w'-]*", s)) > 35:
                out.append(("sentence_length", s, begin, begin + len(s)))
            some = lambda w, s=s: re.search(rf"(?<!\w){w}(?!\w)", s, re.I)
            if not any(map(some, style.CONDITION_WORDS)):
                out += [("bare_conditional", w, begin + some(w).start(), begin + some(w).end()) for w in style.PHRASES["bare_conditional"] if some(w)]
            if n == 0:
                hit = next((some(p) for p in style.PHRASES["chronology_first"] if some(p)), None)
                if hit:
                    out.append(("chronology_first", hit.group(), begin + hit.start(), begin + hit.end()))
        at = m.end() if m else at
    return sorted(out, key=lambda b: (b[2], b[0], b[3]))


def test_style():
    rnd = random.Random(3)
    phrases = [p for own in style.PHRASES.values() for p in own] + ["if", "uncertain", "more", "caféshould", "plain words here"]
    for _ in range(300):
        text = "".join(rnd.choice(phrases).replace("the", rnd.choice(("the", "The"))) + rnd.choice((" ", ". ", "! ", "\n", ", ", ".")) for _ in range(rnd.randrange(60)))
        assert [b[:4] for b in style.breaches(text, advice_allowed=False)] == plain_breaches(text)
    assert style.breaches(" \n") == [] and not any(b[0] == "advice_in_summary" for b in style.breaches("You should."))


def test_style_queries(spark):
    rows = QUERIES["style_breaches"](spark, SF).collect()
    assert {r["rule"] for r in rows} >= {*style.PHRASES, "sentence_length"}
    assert sum(r["n"] for r in QUERIES["style_report"](spark, SF).collect()) == len(rows)
    worst = QUERIES["style_worst"](spark, SF).collect()
    per_doc = {}
    for r in rows:
        per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + 1
    assert all(r["n"] == per_doc[r["doc_id"]] for r in worst) and max(r["n"] for r in worst) == max(per_doc.values())


def test_actors(spark):
    output = '{"named_actors": ["Alpha Team", {"name": "Beta", "relation": "same_actor", "related_to": "Alpha", "evidence_quote": "beta is alpha"}, {"name": "Gamma", "relation": "operator_of"}, {"relation": "x"}, "", {"name": "Delta"}]}'
    rows = spark.createDataFrame([(1, "The Alpha team met Beta: Beta is Alpha. Delta left.", output), (2, "Beta, and Alpha Team", output), (3, None, None), (4, "x", "no json")], "id int, body string, output string")
    got = {(r["id"], r["name"]): (r["state"], r["relation"]) for r in articles.ground_actors(rows, "id", "body", "output").collect()}
    assert got[1, "Alpha Team"] == got[1, "Delta"] == ("kept", "unstated") and got[1, "Beta"] == ("kept", "same_actor")
    assert got[1, "Gamma"][0] == "name_not_in_article" and got[2, "Beta"] == ("relation_unsupported", "unstated") and len(got) == 8


def test_nothing_is_promoted_unchecked(spark):
    findings = spark.createDataFrame([(1, "ioc", "auto", '{"ioc_type": "url", "value": "http://a.onion"}')], "a int, finding_kind string, decision string, payload string")
    none = spark.createDataFrame([], "key string")
    assert articles.promoted(findings, "a", none, F.col("value")).count() == 0
    assert articles.promoted(findings, "a", spark.createDataFrame([("b",)], "key string"), F.col("value")).count() == 1


def test_backend():
    assert [articles.backend(*x) for x in (("auto", True), ("auto", False), ("embedding", False), ("tfidf", True))] == ["embedding", "tfidf", "embedding", "tfidf"]
    with pytest.raises(ValueError):
        articles.backend("other", True)


def test_guards(spark, tmp_path):
    rows = spark.createDataFrame([("[{\"a\": 1}, {\"a\": 2}]",), (" {\"a\": 3}",), ("oops",), (None,)], "p string")
    assert [r["d"]["a"] if r["d"] else None for r in rows.select(guards.detail(F.col("p"), "struct<a:int>").alias("d")).collect()] == [1, 3, None, None]
    spark.range(3).write.parquet(str(tmp_path / "good"))
    out, status = guards.poll(spark, {"good": str(tmp_path / "good"), "bad": str(tmp_path / "none")}, lambda s, p: s.read.parquet(p))
    assert out.count() == 3 and [n for n, s in status if s.startswith("ok")] == ["good"] and len(status) == 2
    assert guards.run_named({"a": lambda x: x + 1}, ["b", "a"], 1) == ({"a": 2}, ["b"])
    path = guards.save_baseline(spark.createDataFrame([("n", '{"a": "number"}')], "name string, structure string"), "name", "structure")
    assert guards.load_baseline(spark, path).collect()[0]["structure"] == '{"a": "number"}'


def test_cosines_as_plain_sums(spark):
    """Repeated terms, short and long texts, at a low threshold."""
    rnd = random.Random(2)
    vocabulary = [f"t{k:03}" for k in range(40)]
    docs = [(k, " ".join(w for w in rnd.choices(vocabulary, k=rnd.randrange(1, 12)) for _ in range(rnd.choice((1, 1, 8))))) for k in range(80)]
    weights = X.tfidf(spark.createDataFrame(docs, "id long, text string"), "id", F.col("text"))
    own = {}
    for r in weights.collect():
        own.setdefault(r["id"], {})[r["term"]] = r["weight"]
    want = {(a, b): sum(w * own[b].get(t, 0) for t, w in own[a].items()) for a in own for b in own if a < b}
    for dense in (1, 10**9):
        got = {(r["a"], r["b"]): r["cosine"] for r in X.tfidf_pairs(weights, 0.35, block=30, dense=dense).collect()}
        assert got.keys() == {p for p, c in want.items() if c >= 0.35} and all(abs(c - want[p]) < 1e-9 for p, c in got.items()) and len(got) > 50
