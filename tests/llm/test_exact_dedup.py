from collections import defaultdict

from pyspark.sql import functions as F

from tapeloom.llm import exact_dedup
from tapeloom.llm.common import shared_path


def _plain(rows):
    """doc_id -> (keep_id, group_size), a list of it as doc_ids repeat."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for members in groups.values():
        keep = max((m for m in members if m is not None), default=None)
        out += [(m, keep, len(members)) for m in members]
    return sorted(out, key=repr)


ROWS = [(k, f"text {k % 7}") for k in range(60)] + [(100, None), (101, ""), (102, "x" * 400_000), (103, "x" * 400_000), (104, "x" * 399_999 + "y"), (7, "text 0"), (None, "text 1"), (None, "alone"), (200, "same"), (200, "same"), (201, "Same"), (202, "é"), (203, "é")]


def _found(rows):
    return sorted(((r.doc_id, r.keep_id, r.group_size) for r in rows), key=repr)


def test_groups_of_equal_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    clash = docs.select("*", *(F.lit(1).alias(c) for c in ("digest", "file", "row", "n", "keeper", "_metadata", "kept_text"))).repartition(7)
    for table in (docs, clash):
        got = exact_dedup.exact_duplicates(table).collect()
        assert _found(got) == _plain(ROWS)
        kept = [(r.keep_id, bytes(r.digest)) for r in got if r.kept]
        assert len(kept) == len(set(kept)) == len({t or "" for _, t in ROWS})
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_a_digest_of_different_texts_is_refuted_by_their_bytes(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs, lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 2, "0"))).collect()
    assert _found(got) == _plain(ROWS)
    assert len([r for r in got if r.kept]) == len({t or "" for _, t in ROWS})


def test_state_outlives_a_query_and_takes_files_in_several_batches(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").filter("doc_id is not null")
    folder = shared_path(spark, "restart")
    path = f"{folder}/docs"

    def add(part):
        part.repartition(3).write.mode("append").parquet(path)
        docs = spark.read.parquet(path)
        exact_dedup.located(docs).drop("text").join(known(), ["file", "row"], "left_anti").select("digest", "doc_id", "file", "row").write.mode("append").parquet(f"{folder}/catalogue")
        return {(bytes(r.digest), r.keeper.doc_id, r.n) for r in exact_dedup.absorb(spark, f"{folder}/catalogue", f"{folder}/state", 1).collect()}

    def known():
        try:
            return spark.read.parquet(f"{folder}/catalogue").select("file", "row")
        except Exception:
            return spark.createDataFrame([], "file string, row long")

    first = add(rows.filter("doc_id % 2 = 0"))
    both = add(rows.filter("doc_id % 2 = 1"))
    want = {(bytes(r.digest), r.keeper.doc_id, r.n) for r in exact_dedup.seen(exact_dedup.located(spark.read.parquet(path)).drop("text")).collect()}
    assert both == want and first != both


def test_an_empty_table_and_settings_that_stay(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and got.columns == ["doc_id", "keep_id", "group_size", "kept", "digest"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
