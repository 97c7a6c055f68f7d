"""Registered queries of the training-data operators and their DuckDB checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import audit, compression, hardneg, hilbert, lines, mixing, ordinal, packing, pitmanyor, quality, sequences, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` with its optional DuckDB check."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


MIX_SQL = """
with recursive d as (
  select doc_id, coalesce(source, chr(1)) as q, length(coalesce(text, '')) + 1 as size, md5(cast(doc_id as varchar)) as h from documents),
r as (
  select *, cast(coalesce(sum(size) over (partition by q order by h, size rows between unbounded preceding and 1 preceding), 0) as bigint) as at0,
         cast(sum(size) over (partition by q) as bigint) as total from d),
t as (select q, any_value(total) as total, sqrt(any_value(total)) * sqrt(sqrt(any_value(total))) as w from r group by q),
s as (select q, total, greatest(cast(floor(w / (select sum(w) from t) * 1000) as bigint), 1) as share from t),
p as (select list(share order by q) as a, list(q order by q) as qs, cast(sum(share) as bigint) as period from s),
e(slot, done, best) as (
  select cast(-1 as bigint), list_transform(a, lambda x: cast(0 as bigint)), cast(0 as bigint) from p
  union all
  select n.slot, list_transform(n.done, lambda x, i: case when i = n.best then x + 1 else x end), n.best
  from (
    select e.slot + 1 as slot, e.done,
           list_min(list_filter(list_transform(e.done, lambda x, i:
             case when (x * p.period) // p.a[i] <= e.slot + 1
                  then (((x + 1) * p.period + p.a[i] - 1) // p.a[i]) * 100000 + i end), lambda z: z is not null)) % 100000 as best
    from e, p where e.slot + 1 < p.period) n),
c as (
  select p.qs[best] as q, p.a[best] as share, p.period, slot,
         row_number() over (partition by best order by slot) - 1 as job
  from e, p where slot >= 0),
f as (
  select max(((s.total - 1) // 16384 // c.share) * c.period + c.slot) as last
  from s join c on c.q = s.q and c.job = ((s.total - 1) // 16384) % c.share),
x as (
  select r.*, unnest(range(0, ((f.last // p.period + 1) * s.share * 16384 - 1) // r.total + 1)) as epoch
  from r join s using (q), f, p),
y as (select *, (at0 + epoch * total) // 16384 as block, (at0 + epoch * total) % 16384 as start from x)
select y.doc_id, nullif(y.q, chr(1)) as source, cast(y.epoch as bigint) as epoch, cast(y.block as bigint) as block,
       cast((y.block // c.share) * c.period + c.slot as bigint) as slot, cast(y.start as bigint) as start
from y join c on c.q = y.q and c.job = y.block % c.share, f
where (y.block // c.share) * c.period + c.slot <= f.last or y.epoch = 0
"""


@query("op1_mixing", MIX_SQL)
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Where the mixture puts every document of every source, shares tempered by size."""
    docs = table(spark, folder, "documents").select("doc_id", "source", (F.length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"))
    mixed = mixing.mix(docs, size=F.col("size"))
    return mixed.select("doc_id", "source", "epoch", "block", "slot", "start")


@query("op3_sequences")
def op3_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents, written to sequence files and read back."""
    return sequences.sequence_digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash.simhash_components(table(spark, folder, "documents").select("doc_id", "text"))


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in windows that show the sources' shares of all tokens."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


@query("op8_quality_ratio")
def op8_quality_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics and the ratio verdict of all documents; trusted are those labelled as good."""
    trusted = table(spark, folder, "labels").filter("quality = 1")
    return quality.judge(table(spark, folder, "documents"), trusted)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents, their disguises restored."""
    return toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_ordinal")
def op9_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """Grades of all documents: 0 poor, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return ordinal.grades(table(spark, folder, "documents"), table(spark, folder, "labels"), grade, 3)


@query("op2_hilbert")
def op2_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty nearest vectors of every twentieth id."""
    return hilbert.search(table(spark, folder, "embeddings"), 20, 20)


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Class and verdict of every line of all documents."""
    return lines.line_classes(table(spark, folder, "documents"))


@query("op10_pitman_yor")
def op10_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probabilities of all documents by the hierarchical model and by the add-one unigram."""
    return pitmanyor.score_texts(table(spark, folder, "documents"))


@query("op11_compression")
def op11_compression(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents by the dictionary that shortens their text most."""
    return compression.identify(table(spark, folder, "documents"))


AUDIT_SQL = """
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         case when len(w) < 100 then 1 else 0 end
         + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
         + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) then 4 else 0 end
         + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
         + case when d.doc_id > min(d.doc_id) over (partition by t) then 16 else 0 end as mask
  from d left join l using (doc_id)),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by 1, 2),
f as (select i, cast(1 << i as bigint) as bit, chr(cast(65 + i as integer)) as letter from range(5) r(i)),
o as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s as (
  select filter_order, cast(step as integer) as step, bits[step] as bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) as bigint) as before
  from o, range(1, 6) g(step)),
g as (
  select part, filter_order, step, bit,
         coalesce(sum(n) filter ((mask & (before | bit)) = 0), 0) as kept,
         coalesce(sum(n) filter ((mask & bit) > 0 and (mask & before) = 0), 0) as removed,
         coalesce(sum(n) filter ((mask & bit) > 0 and (mask & before) > 0), 0) as redundant,
         coalesce(sum(n) filter (mask = bit), 0) as unique_fails,
         coalesce(sum(good) filter ((mask & bit) > 0 and (mask & before) = 0), 0) as good_lost,
         coalesce(sum(toxic) filter ((mask & bit) > 0 and (mask & before) = 0), 0) as toxic_lost
  from c, s group by 1, 2, 3, 4)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from g
"""


@query("op12_audit", AUDIT_SQL)
def op12_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove, alone and in every order, for each language of all documents."""
    return audit.audit(spark, f"{folder.rstrip('/')}/documents.parquet", table(spark, folder, "labels"))


NEGATIVES_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else cast(label as bigint) end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label as own, b.vec_id as other_id, b.label,
         cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where label = own
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id,
       cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as integer) as rank,
       s.other_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and s.label <> s.own
where 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10
"""


@query("op13_negatives", NEGATIVES_SQL)
def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, a seventh of the labels moved on by one."""
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hardneg.mine(vectors)
