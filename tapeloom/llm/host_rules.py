"""Quality rules of documents and of their hosts.

A document fails by rules on its own words and lines. Failures are added up by host, each host's
rate is drawn to the mean of all by a beta prior fitted to the hosts' rates, and hosts whose drawn
rate is too high are refused with all their documents. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is refused above this drawn failure rate.
MAX_HOST_RATE = 0.5
BLANK = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though used often in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more in ``words``."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twin = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return let(ordered, lambda s: F.aggregate(positions(s), start, step, lambda a: a["n"]))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    return let(words, of)


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed).

    Null texts have no words and so fail; a null host is a host of its own. Texts of any length are
    taken whole. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(F.col("doc_id"), F.col(host).alias("host"), text.alias("t")).select(
        "doc_id",
        "host",
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(
            F.filter(F.split("t", BLANK), lambda w: w != ""),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")),
        ).alias("w"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.select("doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words").withColumn("base_failed", failed)


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, drawn_rate, host_kept) of each host of ``document_rules``.

    The prior's alpha and beta have the mean and variance of the hosts' rates. Where these show no
    spread (one host, or equal rates) a rate stays the mean of all hosts' rates.
    """
    hosts = rules.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"))
    size = F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1
    drawn = F.when((F.col("var") > 0) & (F.col("size") > 0), (F.col("n_failed") + F.col("mean") * F.col("size")) / (F.col("n_docs") + F.col("size"))).otherwise(F.col("mean"))
    prior = prior.withColumn("size", F.when(F.col("var") > 0, size))
    # One row on the right: no product of tables.
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", drawn.alias("drawn_rate")).withColumn("host_kept", F.col("drawn_rate") <= max_rate)


def quality_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The columns of ``document_rules`` with the host's verdict and ``kept``: neither the document
    nor its host fails. One row for each row of ``docs``."""
    rules = cut(document_rules(docs, host), "document-rules")
    refused = host_verdicts(rules, max_rate).filter("not host_kept").select(F.col("host").alias("refused"), F.lit(True).alias("hit"))
    joined = rules.join(refused, rules.host.eqNullSafe(refused.refused), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("hit").isNull()).drop("refused", "hit")
