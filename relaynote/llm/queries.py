"""The corpus operators as queries over the tables of a folder: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, decontam, exact_dedup, langid, line_dedup, lm_score, mixing, packing, simhash, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(_table(spark, sf_dir, "documents"), *paths)


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, those too that lose all turns to the damage: zeros, no edits and an empty text."""
    talks = _table(spark, sf_dir, "conversations")
    fixed = conversations.repair(conversations.damage(talks))
    every = talks.select(F.col("conv_id").alias("_of")).distinct()
    rows = every.join(fixed, every["_of"].eqNullSafe(fixed["conv_id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    text = F.coalesce("repaired", F.lit("")).cast("binary")
    return rows.select(F.col("_of").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(text, 256).alias("repaired_sha256"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


ORACLE_OP7 = """
with docs as (select doc_id, text, coalesce(source, '') as site, string_split(text, chr(10)) as parts from documents),
lines as (select doc_id, site, unnest(parts) as line from docs),
spread as (select line from lines where trim(line) <> '' group by line having count(distinct site) >= 10),
marked as (select l.doc_id, count(*) as n from lines l join spread s on l.line = s.line group by l.doc_id),
judged as (
  select d.doc_id, d.text, d.parts, coalesce(len(d.parts), 0) as n_lines, coalesce(m.n, 0) as n,
         m.n is not null and m.n < len(list_filter(d.parts, lambda x: trim(x) <> '')) as cut
  from docs d left join marked m on d.doc_id = m.doc_id),
kept as (
  select j.doc_id, string_agg(p.line, chr(10) order by p.i) as text
  from judged j, unnest(j.parts) with ordinality as p(line, i)
  where j.cut and not exists (select 1 from spread s where s.line = p.line) group by j.doc_id)
select j.doc_id, case when j.cut then coalesce(k.text, '') else j.text end as text,
       cast(j.n_lines as bigint) as n_lines, cast(case when j.cut then j.n else 0 end as bigint) as n_removed
from judged j left join kept k on j.doc_id = k.doc_id
"""

ORACLE_OP10 = """
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
"""


ORACLE_OP5 = """
with q as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
           where embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
scored as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
           from q a join q b on a.vec_id % 100 = 0 and b.vec_id <> a.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 10
"""

ORACLE_OP6 = """
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select *, strlen(html) as payload_bytes, sha1(html) as payload_digest, max(page_id) over (partition by html) as keep from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> keep then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> keep then keep end as refers_to
from s
"""

def _step(state: str, cost: str, letter: str) -> str:
    """A state of the fold is its cost in eight digits and its audit, so least() compares both; null is out of reach."""
    return f"lpad(cast(cast({state}[1:8] as bigint) + {cost} as varchar), 8, '0') || {state}[9:] || {letter}"


ORACLE_OP12 = rf"""
with recursive written as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
-- crc32, bit by bit, of ASCII keys
bits as (
  select k, 0 as i, cast(4294967295 as bigint) as h from (select distinct k from written)
  union all
  select k, i + 1, case when i % 9 = 0 then xor(h, cast(ascii(k[i // 9 + 1]) as bigint))
                        when h % 2 = 1 then xor(h // 2, cast(3988292384 as bigint)) else h // 2 end
  from bits where i < 9 * length(k)),
kinds as (select k, xor(h, cast(4294967295 as bigint)) % 20 as kind from bits where i = 9 * length(k)),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when kind = 3 then [1, 2] else [1] end) as copy
  from written join kinds using (k) where kind <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen from damaged),
rows as (
  select *, role[1] as ini, case when not regexp_matches(text, '[^ 	-]') then 'b' when seen > 1 then 'd'
            when not regexp_matches(text, '[.!?][ 	-]*\z') then 't' else '.' end as fault,
         lag(role[1]) over (partition by conv_id order by pos) as ini_before
  from placed),
counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
         count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
         count(*) filter (pos > 1 and ini_before || ini not in ('su', 'ua', 'au')) as illegal
  from rows group by conv_id),
folds as (
  select conv_id, cast(0 as bigint) as pos, '00000000' as e, cast(null as varchar) as s, cast(null as varchar) as u, cast(null as varchar) as a from counts
  union all
  select conv_id, pos + 1, {_step("e", "3", "'D'")},
         least({_step("s", "3", "'D'")}, case when stays and ini = 's' then {_step("e", "cut", "'K'")} end),
         least({_step("u1", "3", "'D'")}, case when stays then {_step("least(e, s, a1)", "cut + case when ini = 'u' then 0 else 2 end", "case when ini = 'u' then 'K' else 'R' end")} end),
         least({_step("a1", "3", "'D'")}, case when stays then {_step("u1", "cut + case when ini = 'a' then 0 else 2 end", "case when ini = 'a' then 'K' else 'R' end")} end)
  from (
    select f.*, r.ini, r.fault not in ('b', 'd') as stays, case when r.fault = 't' then 1 else 0 end as cut,
           least(u, {_step("e", "2", "'I'")}, {_step("s", "2", "'I'")}, {_step("a", "2", "'I'")}) as u1,
           least(a, {_step("u", "2", "'I'")}, {_step("e", "4", "'II'")}, {_step("s", "4", "'II'")}) as a1
    from folds f join rows r on r.conv_id is not distinct from f.conv_id and r.pos = f.pos + 1)),
best as (
  select f.conv_id, least(e, a, {_step("u", "2", "'I'")}, {_step("e", "4", "'II'")}, {_step("s", "4", "'II'")}) as b
  from folds f join counts c on c.conv_id is not distinct from f.conv_id and c.n = f.pos),
letters as (
  select conv_id, b[9:] as audit, unnest(range(1, length(b) - 7)) as i from best),
edits as (
  select conv_id, audit, i, audit[i] as letter, length(regexp_replace(audit[1:i], 'I', '', 'g')) as pos,
         length(regexp_replace(audit[1:i-1], 'D', '', 'g')) - length(regexp_replace(audit, 'D', '', 'g')) % 2 as spot from letters),
lines as (
  select e.conv_id, e.i, case when letter = 'K' then r.role else case when spot % 2 = 0 then 'user' else 'assistant' end end || ':' ||
         case when letter = 'I' then '' else r.text end as line
  from edits e left join rows r on r.conv_id is not distinct from e.conv_id and r.pos = e.pos where letter <> 'D'),
texts as (select conv_id, string_agg(line, chr(10) order by i) as text from lines group by conv_id)
select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cast(b[1:8] as bigint), 0) as cost,
       coalesce(b[9:], '') as audit, sha256(coalesce(text, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id
left join best on best.conv_id is not distinct from o.conv_id
left join texts on texts.conv_id is not distinct from o.conv_id
"""

ORACLE_OP13 = r"""
with d as (select row_number() over () as r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bs as (select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0),
bw as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as win from bs),
ds as (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n),
dw as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as win from ds),
hits as (select * from dw where win in (select win from bw)),
places as (select r, unnest(range(i, i + n)) as p from hits),
n_hits as (select r, count(distinct p) as n_hit from places group by r),
pairs as (select distinct h.r, bw.item from hits h join bw on h.win = bw.win),
found as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from pairs group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(f.n_items, 0) as n_items,
       coalesce(f.items_sha256, sha256('')) as items_sha256, h.n_hit is not null as contaminated
from d left join n_hits h on d.r = h.r left join found f on d.r = f.r
"""

ORACLE_SQL_BY_QUERY = {
    "op5_exact_topk": ORACLE_OP5, "op6_warc_zip": ORACLE_OP6, "op7_line_dedup": ORACLE_OP7, "op10_exact_dedup": ORACLE_OP10,
    "op12_repair_conversations": ORACLE_OP12, "op13_decontaminate": ORACLE_OP13,
}  # fmt: skip


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL_BY_QUERY)
