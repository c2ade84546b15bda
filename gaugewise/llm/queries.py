"""Registered queries of the operators and their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugewise.llm import (
    ann, dualtree, jaccard_join, licences, linededup, merkle, mixing, packing, quality, toxicity, warc, winnowing,
    wrappers)
from gaugewise.llm.common import stage, table, text_or_empty
from gaugewise.session import fresh_path, tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def vocabulary() -> dict:
    """The byte-level vocabulary of 50,257 ids; its one special token keeps its id, as in `tokenizers`."""
    import public_tokenizers
    return {"vocabulary": str(public_tokenizers.path("byte_bpe_50k.tiktoken")), "pattern": public_tokenizers.PATTERN,
            "whole": str(public_tokenizers.path("byte_bpe_50k.json")),
            "special": {"<|endoftext|>": 50256}}


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), **vocabulary())


@query("op8_mixing", r"""
with d as (
  select doc_id, source, md5('mix' || coalesce(doc_id::varchar, '')) as key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as pos
  from d group by source),
w as (select *, [3, 1, 2][(pos % 3 + 1)::int] as weight from s),
f as (
  select *, ((select sum(source_size) from w) * 1.5::double - coalesce(sum(source_size) over (
      order by source_size::double / weight, pos rows between unbounded preceding and 1 preceding), 0) * 2)
    / sum(weight) over (order by source_size::double / weight, pos rows between current row and unbounded following)
    as level from w),
v as (
  select level from f where source_size * 2 >= level * weight order by source_size::double / weight, pos limit 1),
t as (
  select source, source_size, least(source_size * 2::double, coalesce((select level from v) * weight,
    source_size * 2::double)) as target from f),
p as (
  select doc_id, size, source_size, target, round(target)::bigint as quota,
    coalesce(sum(size) over (partition by d.source order by key, doc_id, size
      rows between unbounded preceding and 1 preceding), 0)::bigint as place
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (greatest(0, least(size, quota - place)) + greatest(0, least(size, quota - place - source_size)))::bigint as taken
from p""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once, so that the texts are read and split into words once.
    rows = mixing.drawn(stage(table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.words(text_or_empty()).alias("n_words")), "sizes"))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda sum_, piece: sum_ + piece["words"])
    return rows.select("doc.doc_id", "size", "source_size", "target", taken.alias("taken"))


def _licence_sql() -> str:
    """Every place where a key phrase stands, and the IDF-weighted share of its template around it."""
    rows = ", ".join(f"({i}, '{t.label}', {t.base}, {t.words}, {t.keys}, {t.at})" for i, t in enumerate(
        licences.TEMPLATES))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with tpl(t, label, base, words, keys, at_word) as (values {rows}),
d as (select doc_id, row_number() over () as r, regexp_extract_all({lower}, '{licences.WORD}') as ws from documents),
vocab as (select distinct unnest(words) as w from tpl),
seen as (select r, unnest(list_distinct(ws)) as w from d),
idf as (select vocab.w, ln(((select count(*) from d) + 1) / (count(seen.r) + 1)) as idf
        from vocab left join seen using (w) group by vocab.w),
tw as (select t, i, words[i] as w, at_word from tpl, range(1, 40) g(i) where i <= len(words)),
weights as (select tw.*, idf / sum(idf) over (partition by t) as weight from tw join idf using (w)),
places as (
  select r, t, label, base, unnest(list_filter(range(0, len(ws) - len(keys) + 1),
    lambda i: ws[i + 1:i + len(keys)] = keys)) as word from d, tpl where len(ws) >= len(keys)),
scored as (
  select p.r, p.t, p.word, sum(case when p.word - at_word + i >= 1 and d.ws[p.word - at_word + i] = w
    then weight else 0 end) as score
  from places p join weights using (t) join d on d.r = p.r group by p.r, p.t, p.word)
select doc_id, len(ws)::bigint as n_words, count(word) filter (base) as n_base,
  min(word) filter (base) as first_word, max(word) filter (base) as last_word,
  coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels,
  coalesce(string_agg(distinct label, ',' order by label), '') as labels,
  least(round(coalesce(max(score), 0), 6), 1.0) as score
from d left join (select * from places join scored using (r, t, word)) x using (r) group by r, doc_id, ws"""


@query("op4_licences", _licence_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.reported(licences.scanned(table(spark, sf_dir, "documents")))


@query("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        winnowing.digest(F.col("grams")).alias("fingerprint"),
        winnowing.digest(F.col("edited_grams")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("op6_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "severity", "grade",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.scored(docs, quality.trained(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc.doc_id", quality.held_out(F.col("doc.doc_id")).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op1_line_dedup", r"""
with d as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as no from documents),
l as (select doc_id, no, line, list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+')) as ws from d),
c as (select line, any_value(ws) as ws, min((doc_id, no)) as first, row_number() over () as c from l group by line),
w as (select c, len(ws) as n, unnest(ws) as w from c),
df as (select w, count(*) as df from w group by w),
p as (select * from (select c, n, w, row_number() over (partition by c order by df, w) as r from w join df using (w))
      where r <= n - ceil(0.8 * n - 1e-9) + 1),
pairs as (select distinct a.c as a, b.c as b from p a join p b using (w) where a.c <> b.c),
gone as (select distinct x.c from pairs join c x on x.c = pairs.a join c y on y.c = pairs.b
         where y.first < x.first and 5 * len(list_intersect(x.ws, y.ws))
           >= 4 * (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws)))),
r as (select doc_id, no, len(l.ws) > 0 and ((doc_id, no) <> c.first or gone.c is not null) as removed
      from l join c using (line) left join gone using (c))
select doc_id, count(*) as n_lines, count(*) filter (removed) as n_removed,
  coalesce(string_agg(no::varchar, ',' order by no) filter (removed), '') as removed_lines
from r group by doc_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.decided(table(spark, sf_dir, "documents"))
    gone = F.filter(F.transform("removed", lambda gone, i: F.when(gone, i.cast("string"))), lambda i: i.isNotNull())
    return rows.select("doc_id", F.size("removed").cast("long").alias("n_lines"), F.size(gone).cast("long").alias(
        "n_removed"), F.array_join(gone, ",").alias("removed_lines"))


@query("op5_nearest")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.searched(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op10_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wrappers.extracted(table(spark, sf_dir, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def _manifest_sql(fanout: int = merkle.FANOUT) -> str:
    """Lists of digests by level, grown by a recursive query over sources, then over the sources' last nodes."""
    part = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
    parents = f"""list_transform(range(0, (len(hs) + {fanout - 1}) // {fanout}),
      lambda i: sha256(array_to_string(hs[{fanout} * i + 1:{fanout} * i + {fanout}], '')))"""
    head = " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

    def siblings(i: str) -> str:
        own, run = f"({i} // power)", f"({i} // power // {fanout} * {fanout})"
        return (f"{{'b': array_to_string(hs[{run} + 1:{own}], ''), "
                f"'a': array_to_string(hs[{own} + 2:{run} + {fanout}], '')}}")

    return rf"""
with recursive d as (
  select doc_id, source, row_number() over () as r, sha256({head} || {part.format("text")}) as leaf,
    sha256({head} || {part.format("replace(text, chr(10), '')")}) as short,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''),
      lambda c: ascii(c)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: xor(x >> 1, (x & 1) * 3988292384::bigint))), 4294967295) % 2 = 0 as even from documents),
f as (select *, case when even then short else leaf end as tampered,
        row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from d),
lists as (
  select source, 0 as level, 1::bigint as power, list(leaf order by i) as hs from f group by source
  union all select source, level + 1, power * {fanout}, {parents} from lists where len(hs) > 1),
subs as (select source, hs[1] as subroot, row_number() over (order by source nulls first) - 1 as j
         from lists where len(hs) = 1),
tops as (
  select 0 as level, 1::bigint as power, list(subroot order by j) as hs from subs
  union all select level + 1, power * {fanout}, {parents} from tops where len(hs) > 1),
steps as (
  select r, level, {siblings("i")} as s from f join lists on f.source is not distinct from lists.source and len(hs) > 1
  union all
  select r, 1000 + level, {siblings("j")} from f join subs on f.source is not distinct from subs.source, tops
  where len(hs) > 1),
paths as (select r, list(s order by level) as path from steps group by r),
out as (
  select doc_id, leaf, subroot, (select hs[1] from tops where len(hs) = 1) as root, tampered,
    coalesce(path, []) as path from f join subs on f.source is not distinct from subs.source left join paths using (r)),
folded as (
  select *, list_reduce(list_prepend({{'b': tampered, 'a': ''}}, path),
    lambda h, s: {{'b': sha256(s.b || h.b || s.a), 'a': ''}}).b as folded_root from out)
select doc_id, leaf, subroot, root,
  sha256(array_to_string(list_transform(path, lambda s: s.b || s.a), '')) as proof_sha256,
  folded_root, folded_root = root as verified from folded"""


@query("op13_manifest", _manifest_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


@query("op12_warc", f"""
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest,
        row_number() over (partition by html order by page_id nulls last) as r,
        min(page_id) over (partition by html) as first from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes < {warc.LEAST} or r = 1 then 'response' else 'revisit' end as record_type,
  case when payload_bytes >= {warc.LEAST} and r > 1 then first end as refers_to from f""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).drop("url")


def _search_sql() -> str:
    terms = (f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             f"'abcdefghijklmnopqrstuvwxyz'), '{dualtree.WORD}')")
    return rf"""
with d as (select row_number() over () as r, doc_id, {terms} as ws from documents),
tf as (select r, w, count(*)::bigint as tf from (select r, unnest(ws) as w from d) group by r, w),
total as (select count(*)::bigint as docs, sum(len(ws))::bigint as words from d where len(ws) > 0),
weight as (select w, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as weight
           from tf, total group by w, docs),
item as (select i, item_id, w, count(*)::bigint as n from (
           select row_number() over () as i, item_id, unnest({terms}) as w from benchmark) group by i, item_id, w),
length as (select r, doc_id, 25 + (75 * len(ws)::bigint * docs) // words as m from d, total where len(ws) > 0),
scored as (
  select i, item_id, r, doc_id, sum(n * weight * ((1000000000::bigint * tf) // (1000 * tf + 8 * m)))::bigint as score
  from item join weight using (w) join tf using (w) join length using (r) group by i, item_id, r, doc_id),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id nulls last)::int as rank
           from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= {dualtree.K}"""


@query("op11_search", _search_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
