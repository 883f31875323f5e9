"""The numbered queries: each applies its operator to its whole table and derives the asked columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import alignment, chat, decontaminate, exact_dedup, host_rules, packing, quality, repeats, secret_scan, simhash, toxicity, url_rules, whitening
from tapeloom.llm.common import held_out, load


def op1_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    ids = lambda c: F.sha2(F.array_join(c, ","), 256)
    near = [F.size("near_items").cast("long").alias("n_near_items"), ids("near_items").alias("near_items_sha256")]
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *near)


OP1_SQL = r"""
with texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id::varchar as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as g, least(10, len(w)) as n
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0)),
sizes as (select distinct n from windows),
places as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from texts, sizes)),
hits as (select doc_id, i, n, item_id from places join windows using (g, n)),
words as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
own as (select doc_id, count(distinct item_id)::bigint as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by 1),
terms as (select distinct item_id, lower(unnest(w)) as fold from items),
tokens as (select doc_id, lower(unnest(w)) as fold, unnest(range(0, len(w))) as pos from texts),
used as (select * from tokens where fold in (select fold from terms)),
rare as (
  select item_id, fold, row_number() over (partition by item_id order by n, fold) as k
  from terms join (select fold, count(*) as n from used group by 1) using (fold) qualify k <= 3),
anchors as (select doc_id, item_id, pos as at from rare join used using (fold) where k = 1),
met as (
  select a.doc_id, a.item_id, a.at, count(distinct r.fold) as n
  from anchors a join rare r using (item_id) join used u on u.doc_id = a.doc_id and u.fold = r.fold and u.pos between a.at - 20 and a.at + 20 group by 1, 2, 3),
near as (
  select doc_id, count(distinct item_id)::bigint as n_near_items, string_agg(distinct item_id, ',' order by item_id) as near_ids
  from met join (select item_id, count(*) as want from rare group by 1) using (item_id) where n = want group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
  coalesce(n_near_items, 0)::bigint as n_near_items, sha256(coalesce(near_ids, '')) as near_items_sha256
from texts left join words using (doc_id) left join own using (doc_id) left join near using (doc_id)
"""


def op2_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    learn = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, learn)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path())


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(load(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    of = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(secret_scan.joined(of(*kinds)), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.decide_urls(load(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: The tables' pages hold no canonical links or refreshes (tests have some), so a component here is a
#: normal form.
OP5_SQL = r"""
with parsed as (
  select page_id, coalesce(instr(url, '://') > 0, false) as real,
    case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) as query, real from parsed),
urls as (
  select *, case when real then host || regexp_replace(path, '/$', '') || case when kept <> '' then '?' || kept else '' end end as node
  from (select *, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]*|ref|fbclid|gclid)(=|$)')), '&') as kept from split)),
ruled as (
  select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from urls),
verdicts as (select *, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' end as own from ruled),
told as (select node, bool_or(own = 'allow') as allow from verdicts where own is not null and node is not null group by 1)
select page_id, host, path, rule, coalesce(own, case when coalesce(allow, true) then 'allow' else 'block' end) as verdict
from verdicts left join told using (node)
"""


def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    learn = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    machine = quality.train(docs, learn)
    scored = quality.score(docs.select("doc_id", "text", "n_chars"), machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(load(spark, sf_dir, "documents")).drop("spans")


#: A conversation whose texts hold the template's own strings.
TRICKY = r"\### Assistant: </turn> ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat.read_back(chat.format_conversations(turns.unionByName(own)))


OP9_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
steps as (
  select *, lag(role, 1, 'start') over w as before, lead(role) over w is null as last
  from turns window w as (partition by conv_id order by turn, role, text)),
sized as (
  select *, length(role) + length(text)
    + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g'))
    + length('### : ') + length('</turn>') + 1 as chars,
    (before, role) in (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))
    and (not last or role = 'assistant') as ok
  from steps)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars, bool_and(ok) as valid
from sized group by conv_id
"""


def op10_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.quality_rules(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
with texts as (
  select doc_id, source, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
line as (
  select doc_id, l, count(*) as n
  from (select doc_id, unnest(string_split(t, chr(10))) as l from texts) where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1, 2),
dup_lines as (select doc_id, sum(n - 1)::bigint as n_dup_lines from line group by 1),
windows as (
  select doc_id, i, (w[i], w[i + 1], w[i + 2]) as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from texts)),
repeated as (select doc_id, i from windows qualify count(*) over (partition by doc_id, g) > 1),
covered as (
  select doc_id, count(distinct p)::bigint as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as p from repeated) group by 1),
rules as (
  select doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from texts left join dup_lines using (doc_id) left join covered using (doc_id)),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from rules),
hosts as (select source, count(*) as n, count(*) filter (base_failed) as f from failed group by 1),
prior as (select avg(f / n) as m, var_pop(f / n) as v from hosts),
drawn as (
  select source, case when v > 0 and m * (1 - m) / v - 1 > 0
    then (f + m * (m * (1 - m) / v - 1)) / (n + m * (1 - m) / v - 1) else m end as rate
  from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rate <= 0.5 as kept
from failed join drawn on failed.source is not distinct from drawn.source
"""

def op11_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP13_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""

QUERIES = {f.__name__: f for f in (op1_positional_index, op2_toxicity_mil, op3_bm25_packing, op4_secret_scan, op5_url_rules, op6_quality_fm, op7_simhash_near_dedup, op8_prefix_free_repeats, op9_chat_formatting, op10_host_quality_rules, op11_token_spans, op12_spectrum_whitening, op13_exact_dedup)}
ORACLE_SQL: dict[str, str] = {"op1_positional_index": OP1_SQL, "op5_url_rules": OP5_SQL, "op9_chat_formatting": OP9_SQL, "op10_host_quality_rules": OP10_SQL, "op13_exact_dedup": OP13_SQL}
