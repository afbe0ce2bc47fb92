"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Trusted text are the rows labelled quality 1 (and not 0 as well). Their word pairs are counted in shards, and every
document's pairs are joined with the counts of their shard (wordkn.py), which gives its perplexity a word. A document is kept
if that is at most the ``HIGH`` quantile, widened by ``SLACK``, of trusted documents of its language.

A model knows the pairs of what it has learnt, so the quantiles are of trusted documents that it hasn't: one in ``FOLDS``, by
crc32 of the id, teaches nothing and gives the limits. A language with under ``LEAST`` of these uses the quantile of all.

Defined cases: a null or empty text has a null perplexity and isn't kept. A null language is a language of its own. Rows
that repeat a doc_id are judged each. Without trusted documents there are no limits and every text is kept. An empty table
gives no rows; a very long text is scored whole; equal perplexities fall on the same side of a limit. Only doc_id, lang and
text are read, so other columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Scratch, cut, id_fold, likely
from feedloom.llm.wordkn import PairModel

HIGH = 0.99
SLACK = 1.05
FOLDS = 10
LEAST = 50
#: Limits of so many languages are broadcast; more are joined.
LANGUAGES = 10_000


def perplexity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, high, kept for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).groupBy("doc_id").agg(F.min("q").alias("least"), F.max("q").alias("most"))
    trusted = trusted.filter("least = 1 AND most = 1 AND doc_id IS NOT NULL").select("doc_id")
    held = id_fold("doc_id", FOLDS) == 0
    taught = trusted.filter(~held)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scratch = Scratch(docs.sparkSession)
    model = PairModel(lambda: likely(docs, taught).join(taught.hint("merge"), "doc_id", "left_semi"), size, scratch)
    scored = model.score(docs, "doc_id long, lang string")
    scored = scored.select("doc_id", "lang", F.col("n").alias("n_tokens"), F.when(F.col("n") > 1, F.exp(-F.col("loglik") / F.col("n"))).alias("perplexity"))
    scored = cut(scored)
    scratch.close()

    known = scored.join(trusted.filter(held), "doc_id", "left_semi").filter("perplexity IS NOT NULL")
    bound = F.percentile_approx("perplexity", HIGH, 10_000)
    limits = known.groupBy("lang").agg(bound.alias("high"), F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    limits = cut(limits.select(F.col("lang").alias("_lang"), "high"))
    limits = F.broadcast(limits) if limits.count() <= LANGUAGES else limits
    high = known.agg(bound).first()[0]
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    out = out.withColumn("high", F.coalesce(F.col("high"), F.lit(high).cast("double")) * SLACK)
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.coalesce("high", F.lit(float("inf"))), F.lit(False)))
