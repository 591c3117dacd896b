"""The queries of the corpus operators, with production parameters over whole tables, and SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import langid, licences, media, minhash, mixing, pieces, quality, runs, sharding, simhash, texts_sql, tokencount, trie, winnowing
from lanewright.llm.common import table


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digest(winnowing.edited_and_next(table(spark, sf_dir, "documents")))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels))


def op4_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.with_shards(table(spark, sf_dir, "documents")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load()
    return pieces.digest(pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ranks = table(spark, sf_dir, "documents"), tokencount.read_ranks()
    docs = docs.select("doc_id", "text", tokencount.standard_edits(F.coalesce("text", F.lit(""))).alias("edits"))
    return tokencount.follow(tokencount.trees(docs, ranks, ["edits"]), ranks).drop("edited")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.media_columns(table(spark, sf_dir, "documents")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return runs.digest(runs.scan(docs.select("doc_id", runs.standard_rewrite(docs["doc_id"], docs["text"]).alias("text"))))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"))


def op13_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_winnowing, op2_source_mix, op3_quality_classifier, op4_shuffled_shards, op5_license_scan, op6_minhash_neardup, op7_sentencepiece, op8_language_id, op9_token_counts,
        op10_media_columns, op11_periodic_runs, op12_conversation_trie, op13_simhash_neardup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op11_periodic_runs": texts_sql.PERIODIC_RUNS,
    "op12_conversation_trie": texts_sql.CONVERSATION_TRIE,
    "op1_winnowing": r"""
with texts as (
  select doc_id, coalesce(text, '') as text from documents
), pairs as (
  select doc_id, text, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next_text, length(text) // 4 as cut from texts
), edits as (
  select doc_id, text, substring(text, 1, length(text) - cut) || substring(next_text, 1, cut) as edited from pairs
), sides as (
  select doc_id, 0 as of_edit, text as t from edits union all select doc_id, 1, edited from edits
), codes as (
  select doc_id, of_edit, n, i, cast(unicode(lower(x)) as bigint) as h
  from (select doc_id, of_edit, length(t) as n, unnest(range(1, length(t) + 1)) as i, unnest(string_split(t, '')) as x from sides where length(t) > 30)
), two as (
  select doc_id, of_edit, n, i, (h * 1103515245 + lead(h, 1) over w) % 2147483647 as h from codes window w as (partition by doc_id, of_edit order by i)
), four as (
  select doc_id, of_edit, n, i, (h * 1685009738 + lead(h, 2) over w) % 2147483647 as h from two window w as (partition by doc_id, of_edit order by i)
), eight as (
  select doc_id, of_edit, n, i, (h * 1611783494 + lead(h, 4) over w) % 2147483647 as h from four window w as (partition by doc_id, of_edit order by i)
), sixteen as (
  select doc_id, of_edit, n, i, (h * 1789443467 + lead(h, 8) over w) % 2147483647 * 2147483648 + 2147483648 - i as g from eight window w as (partition by doc_id, of_edit order by i)
), least_ as (
  select doc_id, of_edit, n, i, min(g) over (partition by doc_id, of_edit order by i rows between current row and 15 following) as m from sixteen where i <= n - 15
), long_ as (
  select doc_id, of_edit, m from least_ where i <= n - 30 group by all
), prints as (
  select doc_id, of_edit, list(m order by -m % 2147483648) as f from long_ group by doc_id, of_edit
  union all
  select doc_id, of_edit, case when c[1] < 0 then [] else [list_min(list_transform(range(1, greatest(len(c) - 15, 1) + 1),
    lambda i: list_reduce(c[i:i + 15], lambda a, x: (a * 1103515245 + x) % 2147483647) * 2147483648 + 2147483648 - i))] end
  from (select doc_id, of_edit, list_transform(string_split(t, ''), lambda x: cast(unicode(lower(x)) as bigint)) as c from sides where length(t) <= 30)
), rows_ as (
  select e.doc_id, e.text, e.edited, a.f as f, b.f as g, coalesce(lead(a.f) over (order by e.doc_id), first_value(a.f) over (order by e.doc_id)) as h
  from edits e join prints a on a.doc_id = e.doc_id and a.of_edit = 0 join prints b on b.doc_id = e.doc_id and b.of_edit = 1
), hashed as (
  select *, list_distinct(list_transform(f, lambda x: x // 2147483648)) as fh, list_distinct(list_transform(g, lambda x: x // 2147483648)) as gh,
    list_distinct(list_transform(h, lambda x: x // 2147483648)) as hh from rows_
), common as (
  select *, len(list_intersect(fh, gh)) as fg, len(list_intersect(fh, hh)) as fhh from hashed
)
select doc_id, length(text) as n_chars, sha256(edited) as edited_sha256, array_to_string(f, ' ') as fingerprint, array_to_string(g, ' ') as edited_fingerprint,
  case when len(fh) + len(gh) = 0 then 1.0e0 else fg / cast(len(fh) + len(gh) - fg as double) end as near_edited,
  case when len(fh) + len(hh) = 0 then 1.0e0 else fhh / cast(len(fh) + len(hh) - fhh as double) end as near_next
from common
""",
    "op6_minhash_neardup": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words
), posted as (
  select doc_id, len(s) as n, unnest(s) as g from sets
), links as (
  select a.doc_id as x, b.doc_id as y from posted a join posted b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(x, y) as (
  select doc_id, doc_id from documents union select reach.x, links.y from reach join links on reach.y = links.x
), least as (
  select x, min(y) as component_id from reach group by x
)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from sets join least on x = doc_id
""",
}
