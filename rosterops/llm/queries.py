"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterops.llm import decontam, divergence, embeddings, langid, licenses, packing, pii, quality, simhash, spelling, topk, urlrules, wavelet
from rosterops.llm.frames import crc_of_id, new_folder, pick

#: Fixed: the url rules (host, path, verdict).
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def vocabulary() -> str:
    """The tokenizer file of the packing and output queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_model(docs: DataFrame) -> langid.Model:
    """Automata of the documents that are not held out."""
    return langid.fit(docs.filter(F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) != 2))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=1, width=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    return langid.identify(pick(docs, doc_id="doc_id", text="text"), language_model(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages"), rules)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "wavelet")
    wavelet.write_tokens(table(spark, sf_dir, "documents"), vocabulary(), folder, end_id=2)
    return wavelet.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.statistics(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    known = quality.labelled(stats.filter(~held_out), table(spark, sf_dir, "labels"))
    scored = stats.select("doc_id", held_out.alias("held_out"), quality.fit(known).score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_report(decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, k=20)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_simhash": op3_simhash,
    "op4_url_filter": op4_url_filter,
    "op5_pii": op5_pii,
    "op6_license_scan": op6_license_scan,
    "op7_token_output": op7_token_output,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_top_k": op10_top_k,
    "op11_spelling": op11_spelling,
    "op12_divergence": op12_divergence,
    "op13_embeddings": op13_embeddings,
}

_URL_SQL = """
with cut as (
  select page_id, case when url like '%://%' then regexp_replace(substr(url, instr(url, '://') + 3), '[?#].*$', '', 's') else '' end as rest from pages
), parts as (
  select page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         case when instr(rest, '/') > 0 then substr(rest, instr(rest, '/')) else '' end as path from cut
), rules(rule_host, rule_path, rule_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best as (
  select page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) as rule,
         max_by(rule_verdict, length(rule_host || rule_path)) as verdict
  from parts left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id, host, path
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from best
"""

_LEAK_SQL = r"""
with words as (
  select 'd' as side, cast(doc_id as varchar) as id, doc_id, text from documents union all
  select 'i', cast(item_id as varchar), null, text from benchmark
), split as (
  select side, id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from words
), cuts as (
  select distinct id as item_id, least(len(w), 10) as n,
    unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) as cut
  from split where side = 'i' and len(w) > 0
), lengths as (select distinct n from cuts),
grams as (
  select doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {'k': i, 'cut': array_to_string(w[i : i + n - 1], ' ')})) as g
  from split, lengths where side = 'd' and len(w) >= n
), found as (select doc_id, g.k as k, grams.n, item_id from grams join cuts on grams.n = cuts.n and g.cut = cuts.cut),
spread as (select doc_id, unnest(range(k, k + n)) as p from found),
hits as (select doc_id, count(distinct p) as n_hit from spread group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct doc_id, item_id from found) group by doc_id
)
select split.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(s, '')) as items_sha256, n_hit is not null as contaminated
from split left join hits using (doc_id) left join named using (doc_id) where side = 'd'
"""

_TOP_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored)
select query_id, cast(r as int) as rank, vec_id, score from ranked where r <= 20
"""

# The CRC-32 of the bytes of ``cast(doc_id as varchar) || ':' || run``, a byte at a time by its own eight steps.
_SPELLING_SQL = r"""
with recursive runs as (
  select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as k
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as r from documents) where length(r) >= 7 group by all
), steps as (
  select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c >> 1, if(c & 1 = 1, 3988292384, 0)), b)) as t
), hashed as (
  select run, k, xor(list_reduce(
      flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''), lambda x:
        if(unicode(x) < 128, [cast(unicode(x) as bigint)], [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]))),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), cast(4294967295 as bigint)), 4294967295) as h
  from runs, steps
), words as (
  select word, cast(sum(k) as bigint) as n from (
    select if(h % 31 = 0, substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2), run) as word, k from hashed
  ) where length(word) >= 7 group by word having sum(k) >= 2
), fewer as (
  select distinct word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from words)
), pairs as (
  select distinct a.word, b.word as near from fewer a join fewer b on a.i = b.i and a.rest = b.rest where a.word <> b.word
  union select words.word, fewer.word from words join fewer on words.word = fewer.rest
  union select fewer.word, words.word from words join fewer on words.word = fewer.rest
), best as (
  select word, count(*) as n_near, first(near order by n desc, near) as form, max(n) as form_n from pairs join (select word as near, n from words) using (near) group by word
), forms as (
  select word, n, coalesce(n_near, 0) as n_near, if(form_n >= 10 * n, form, null) as form, if(form_n >= 10 * n, form_n, null) as form_n
  from words left join best using (word)
), chains as (
  select word, word as root from forms union all
  select chains.word, forms.form from chains join forms on forms.word = chains.root where forms.form is not null
), roots as (select chains.word, root from chains join forms on forms.word = root where forms.form is null)
select forms.word, form, root, n, cast(n_near as bigint) as n_near, cast(form_n as bigint) as form_n from forms join roots using (word)
"""

_DIVERGENCE_SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), tokens as (select id, lang, source, unnest(list_filter(string_split_regex(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term from d),
kept as (select lang, term from tokens group by lang, term having count(distinct id) >= 30),
counts as (select lang, source, term, count(*) as n from tokens join kept using (lang, term) group by all),
sizes as (select lang, count(*) as v from kept group by lang),
groups as (
  select lang, source, coalesce(sum(n), 0) as total, coalesce(any_value(v), 0) as v
  from (select distinct lang, source from d) left join counts using (lang, source) left join sizes using (lang) group by lang, source
), full_counts as (
  select lang, source, term, coalesce(n, 0) as n, total, v from groups join kept using (lang) left join counts using (lang, source, term)
), priced as (
  select lang, source, term, n, cast(1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v) as bigint) as p from full_counts
), whole as (
  select lang, term, cast(1 + (1000000000::hugeint * (sum(n) + 5)) // (any_value(all_n) + 5 * any_value(v)) as bigint) as q
  from counts join (select lang, sum(n) as all_n from counts group by lang) using (lang) join sizes using (lang) group by lang, term
), sums as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from priced a join priced b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, b.source as item, cast(coalesce(value, 0) as bigint) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source
), terms as (select lang, source, term as item, p - q as value from priced join whole using (lang, term) where n > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as r from pairs union all
  select * from (select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as r from terms) where r <= 50
)
select lang, source, part, item, value, cast(r as int) as rank from ranked
"""

_VECTOR_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, links.b from reach join links on reach.b = links.a),
roots as (select a as vec_id, min(b) as component_id from reach group by a),
degrees as (select a as vec_id, count(*) as n from links group by a)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, vec_id = component_id as kept from roots left join degrees using (vec_id)
"""

ORACLES = {
    "op4_url_filter": _URL_SQL, "op9_decontamination": _LEAK_SQL, "op10_top_k": _TOP_SQL,
    "op11_spelling": _SPELLING_SQL, "op12_divergence": _DIVERGENCE_SQL, "op13_embeddings": _VECTOR_SQL,
}
