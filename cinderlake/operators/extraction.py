"""Reconciling proposed findings with what an article really has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.functions.indicators import HINT, anchor, indicators
from cinderlake.functions.text import refang


def candidates(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per indicator that an article has. Articles without a hint of any don't pass through Python."""
    return docs.where(F.col(text).rlike(HINT)).select(id_col, F.explode(indicators(F.col(text))).alias("i")).select(id_col, "i.*")


def reconcile(proposed: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Proposals (id, seq, kind, value) with kept or the reason: not in the article, or a duplicate."""
    key = lambda c: F.lower(refang(F.trim(c)))
    have = found.select(id_col, "kind", F.lower("value").alias("_k"), "start").groupBy(id_col, "kind", "_k").agg(F.min("start").alias("start"))
    p = proposed.withColumn("_k", key(F.col("value")))
    both = p.join(have, [id_col, "kind", "_k"], "left")
    nth = F.row_number().over(Window.partitionBy(id_col, "kind", "_k").orderBy("seq"))
    state = F.when(F.col("start").isNull(), "model_only").when(nth > 1, "duplicate").otherwise("kept")
    return both.withColumn("state", state).drop("_k")


def reconcile_capped(proposed: DataFrame, id_col: str, seq: str, key: str, known: Column, quote: Column, anchored: Column, cap: int = 10, least: int = 16) -> DataFrame:
    """Ladder over proposals in order: cap of kept ones, unknown key, weak quotation, not in the text, duplicate."""
    good = known & (F.length(quote) >= least) & anchored
    first = F.row_number().over(Window.partitionBy(id_col, key, "_good").orderBy(seq)) == 1
    rows = proposed.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_first", first)
    before = F.coalesce(F.sum((F.col("_good") & F.col("_first")).cast("int")).over(Window.partitionBy(id_col).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    state = (
        F.when(before >= cap, "cap").when(~known, "unknown").when(F.length(quote) < least, "weak").when(~F.coalesce(anchored, F.lit(False)), "unanchored").when(~F.col("_first"), "duplicate").otherwise("kept")
    )
    return rows.withColumn("state", state).drop("_good", "_first")


def ground(rows: DataFrame, text: str, quote: str) -> DataFrame:
    """Rows with the place of their quotation in the text, null where it isn't found."""
    return rows.withColumn("at", anchor(F.col(text), F.col(quote), True))


def lower_if_unanchored(level: Column, anchored: Column) -> Column:
    """A confidence one step down where nothing anchors it."""
    return F.when(anchored, level).otherwise(F.when(level == "high", "medium").otherwise("low"))


def distinct_claims(claims: DataFrame, id_col: str, claim: str, label: Column) -> DataFrame:
    """Claims folded by their wording (blanks, case, closing punctuation aside); the worst label counts.

    Quality by the share of observed claims: over 0.8 high, from 0.5 moderate, else low.
    """
    text = F.regexp_replace(F.lower(F.trim(F.regexp_replace(claim, r"\s+", " "))), r"[.;:!? ]+$", "")
    folded = claims.groupBy(id_col, text.alias("_c")).agg(F.max(label).alias("worst"))
    out = folded.groupBy(id_col).agg(F.count(F.lit(1)).alias("claims"), F.avg(F.when(F.col("worst") == 0, 1.0).otherwise(0.0)).alias("share"))
    return out.withColumn("quality", F.when(F.col("share") > 0.8, "high").when(F.col("share") >= 0.5, "moderate").otherwise("low"))
