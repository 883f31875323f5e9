"""Benchmark passages in documents, by a positional inverted index.

A benchmark item gives windows of consecutive words. The corpus is counted once for the benchmark's
terms; then postings (term, doc_id, pos) are stored of each window's rarest terms only. A window's
candidates are the places of its rarest term, less the term's offset, that the offset-adjusted lists
of its next rarest terms hold too. Candidates are compared with the document's words in full. The same
lists give proximity matches: an item's rarest distinct terms within a span of words, in any order. All
of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, small_side

WINDOW_WORDS, RAREST, SPAN = 10, 3, 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
#: What stands between words, and words: the separators one by one, as the JVM's regexes test a set of single
#: characters several times faster than ranges. A-Z are word characters, which are lower-cased after splitting.
BETWEEN, WORD = f"[{_SEPARATORS}]+", f"[^{_SEPARATORS}]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z (and no other letters) in lower case."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def _tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, fold): fold has all letters in lower case, so equal words have equal folds."""
    lead = F.col("text").rlike(rf"\A{BETWEEN}").cast("int")
    each = docs.select("doc_id", lead.alias("lead"), F.posexplode(F.split("text", BETWEEN)).alias("p", "w")).filter("w <> ''")
    return each.select("doc_id", (F.col("p") - F.col("lead")).alias("pos"), F.lower("w").alias("fold"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(fold, n): how often the folds in ``terms`` stand in all of ``docs``."""
    return _tokens(docs).join(small_side(terms, "fold"), "fold").groupBy("fold").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, pos) of the terms in ``terms`` (fold, term)."""
    return _tokens(docs).join(small_side(terms, "fold"), "fold").select("term", "doc_id", "pos")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, words) of the items with an id and words."""
    return benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)


def windows_of(items: DataFrame, size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, wkey, length, folds), and (wid, item_id) of the items that have them; wkey is
    a hash of the window's words.

    An item of fewer words than ``size``, but not none, is one window. Items without text or id have
    none.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (size - 1)))
    cuts = items.select("item_id", "words", F.explode(starts).alias("s")).select("item_id", F.slice("words", F.col("s"), F.lit(size)).alias("ws"))
    named = cut(cuts.select("item_id", "ws", F.array_join("ws", " ").alias("wtext")).distinct(), "item-windows")
    distinct = named.groupBy("wtext").agg(F.first("ws").alias("ws"))
    own = cut(distinct.select(F.monotonically_increasing_id().alias("wid"), "wtext", F.size("ws").alias("length"), F.transform("ws", lambda w: F.lower(w)).alias("folds")), "windows")
    return own.select("wid", window_key(F.col("wtext")).alias("wkey"), "length", "folds"), cut(named.join(own, "wtext").select("wid", "item_id"), "window-items")


def window_key(text: Column) -> Column:
    """Two independent hashes, 128 bits in all, so that no window's text goes with each candidate."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.reverse(text), F.length(text)).alias("b"))


def _indexed(docs: DataFrame, items: DataFrame, windows: DataFrame, rarest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows whose terms all occur in the corpus, with their rarest places (wid, wkey, length, places
    [(n, fold, o, term)]); the items with their rarest distinct terms (item_id, terms); and the postings
    (term, doc_id, pos) of just these terms, from one count and one pass over all of ``docs``."""
    each = windows.select("wid", F.posexplode("folds").alias("o", "fold"))
    counts = cut(term_counts(docs, cut(each.select("fold").distinct(), "terms")).select("fold", "n", F.monotonically_increasing_id().alias("term")), "term-counts")
    placed = each.join(counts, "fold").groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("n", "fold", "o", "term"))).alias("places"))
    plan = placed.join(windows, "wid").filter(F.size("places") == F.col("length"))
    plan = cut(plan.select("wid", "wkey", "length", F.slice("places", 1, rarest).alias("places")), "window-plan")
    terms = items.select("item_id", F.explode("words").alias("w")).select("item_id", F.lower("w").alias("fold")).distinct().join(counts, "fold")
    near = terms.groupBy("item_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "fold", "term"))), 1, rarest).alias("p"))
    near = cut(near.select("item_id", F.col("p.term").alias("terms")), "item-plan")
    used = plan.select(F.explode("places.term").alias("term")).unionByName(near.select(F.explode("terms").alias("term"))).distinct()
    return plan, near, cut(postings(docs, cut(counts.join(used, "term").select("fold", "term"), "used-terms")), "postings")


def candidates(plan: DataFrame, index: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(wid, doc_id, start): where a window's rarest terms all stand at their offsets."""
    at = lambda k, f: F.coalesce(F.get("places", F.lit(k))[f], F.get("places", F.lit(0))[f])
    flat = plan.select("wid", *(at(k, f).alias(f"{f}{k}") for k in range(rarest) for f in ("term", "o")))
    found = index.join(small_side(flat), index.term == flat.term0).withColumn("start", F.col("pos") - F.col("o0")).filter("start >= 0").drop("term", "pos")
    for k in range(1, rarest):
        other = index.select(F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.col("term").alias("t"))
        found = found.join(other, (F.col("doc_id") == F.col("d")) & (F.col("start") + F.col(f"o{k}") == F.col("p")) & (F.col(f"term{k}") == F.col("t")), "left_semi")
    return found.select("wid", "doc_id", "start")


def _n_hit(matched: Column) -> Column:
    """Words inside any of the stretches (start, length)."""
    spans = F.sort_array(F.transform(matched, lambda c: F.struct(c["start"].alias("s"), (c["start"] + c["length"]).alias("e"))))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["e"]).alias("reach"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), step, lambda a: a["n"])


def _exact(docs: DataFrame, plan: DataFrame, index: DataFrame, rarest: int) -> DataFrame:
    """(doc_id, h, n_hit, wids) of the rows of ``docs`` (doc_id, text; none null) with windows, h being
    the text's hash. A document's candidates are numbers only, no more than its words times the windows
    that start with the same terms."""
    found = cut(candidates(plan, index, rarest), "candidates")
    per_doc = cut(found.join(small_side(plan.select("wid", "wkey", "length")), "wid").groupBy("doc_id").agg(F.collect_list(F.struct("wid", "start", "length", "wkey")).alias("cands")), "candidates-by-document")
    same = F.xxhash64("text").alias("h")  # tells rows of one doc_id apart
    texts = docs.join(small_side(per_doc.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text", same).dropDuplicates(["doc_id", "h"])
    holds = lambda w: F.filter("cands", lambda c: window_key(F.array_join(F.slice(w, c["start"] + 1, c["length"]), " ")) == c["wkey"])
    matched = F.get(F.transform(F.array(words_of(F.col("text"))), lambda w: F.transform(holds(w), lambda c: F.struct(c["wid"].alias("wid"), c["start"].alias("start"), c["length"].alias("length")))), F.lit(0))
    return cut(texts.join(per_doc, "doc_id").select("doc_id", "h", matched.alias("m")).filter(F.size("m") > 0).select("doc_id", "h", _n_hit(F.col("m")).cast("long").alias("n_hit"), F.array_distinct("m.wid").alias("wids")), "hits")


def _near(near: DataFrame, index: DataFrame, span: int) -> DataFrame:
    """(doc_id, item_id, pos): places of an item's rarest term that have all of its ``near`` (item_id,
    terms) within ``span`` words. Places meet by buckets of ``span`` words, so a frequent pair of terms
    in one document does not meet in all its pairs."""
    bucket = lambda c: F.call_function("div", c, F.lit(span)).cast("int")
    own = near.select(F.explode("terms").alias("term")).distinct()
    index = cut(index.filter("doc_id is not null").join(small_side(cut(own, "item-terms")), "term"), "item-postings")
    anchors = index.join(small_side(near.select("item_id", "terms", F.get("terms", F.lit(0)).alias("term"))), "term").select("doc_id", "item_id", F.col("pos").alias("at"), "terms")
    lone = anchors.filter(F.size("terms") == 1).select("doc_id", "item_id", F.col("at").alias("pos"))
    asked = anchors.filter(F.size("terms") > 1).select("doc_id", "item_id", "at", F.size("terms").alias("n"), F.explode(F.slice("terms", 2, 100)).alias("term"))
    asked = asked.withColumn("bucket", F.explode(F.sequence(bucket(F.greatest(F.col("at") - span, F.lit(0))), bucket(F.col("at") + span))))
    met = asked.join(index.withColumn("bucket", bucket(F.col("pos"))), ["doc_id", "term", "bucket"]).filter(F.abs(F.col("pos") - F.col("at")) <= span)
    held = met.groupBy("doc_id", "item_id", "at").agg(F.count_distinct("term").alias("k"), F.first("n").alias("n")).filter("k = n - 1")
    return lone.unionByName(held.select("doc_id", "item_id", F.col("at").alias("pos"))).distinct()


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def hit_rows(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, rarest: int = RAREST) -> DataFrame:
    """(doc_id, h) of the rows of ``docs`` (doc_id, text) with a window of ``benchmark``; h is xxhash64 of
    the text, a null one being empty."""
    docs, items = _prepared(docs), items_of(benchmark)
    windows, _ = windows_of(items, size)
    plan, _, index = _indexed(docs, items.limit(0), windows, rarest)
    return _exact(docs, plan, index, rarest).select("doc_id", "h")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, rarest: int = RAREST, span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, near_items) for each row of ``docs`` (doc_id, text).

    n_words counts the text's words, n_hit those inside any occurrence of a window of ``benchmark``
    (item_id, text), items the ids of items with such windows, sorted as strings. near_items are the
    items whose ``rarest`` rarest distinct terms (by occurrences in the corpus, then as strings; those that
    the corpus lacks aside) stand within ``span`` words of a place of the rarest. Texts are taken
    whole. Null and empty texts have no words; a row without doc_id has no hits; repeated rows each get
    the same result; different texts of one doc_id share near_items, their places counting together. Without items nothing is hit. Other
    columns are ignored.
    """
    docs, items = _prepared(docs), items_of(benchmark)
    windows, of_items = windows_of(items, size)
    plan, near, index = _indexed(docs, items, windows, rarest)
    hits = _exact(docs, plan, index, rarest)
    of_hits = hits.select("doc_id", "h", F.explode("wids").alias("wid")).join(small_side(of_items, "item_id"), "wid").groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    hit = hits.select("doc_id", "h", "n_hit").join(of_hits, ["doc_id", "h"])
    close = cut(_near(near, index, span).select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("near_items")), "near-items")
    counted = docs.select("doc_id", F.xxhash64("text").alias("h"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return counted.join(hit, ["doc_id", "h"], "left").join(small_side(close), "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")
    )


def exact_matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, rarest: int = RAREST) -> DataFrame:
    """``matches`` without near_items."""
    return matches(docs, benchmark, size, rarest).drop("near_items")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, rarest: int = RAREST) -> DataFrame:
    """(doc_id, item_id, pos): places of an item's rarest term that have all its ``rarest`` rarest distinct
    terms within ``span`` words, in any order; of an item with one term, that term's places. Items with a
    term that the corpus lacks are matched by those that it has. Null and empty texts, rows without doc_id
    and items without words match nothing; a place of repeated rows comes once. Empty tables give no rows."""
    docs, items = _prepared(docs), items_of(benchmark)
    windows, _ = windows_of(items, 1)
    _, near, index = _indexed(docs, items, windows, rarest)
    return _near(near, index, span)
