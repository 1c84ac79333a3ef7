"""The registered query of each operator and, where SQL can say it, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm import bpe, langid
from careflow.llm.centroids import cluster
from careflow.llm.fingerprints import fingerprint_edits
from careflow.llm.licenses import scan
from careflow.llm.near_dedup import near_duplicates
from careflow.llm.negatives import hard_negatives
from careflow.llm.packing import pack
from careflow.llm.search import build_index, search
from careflow.llm.substring import repeated_passages
from careflow.llm.token_counts import count_edits
from careflow.llm.token_files import read_documents, write_ids
from careflow.llm.url_graph import judge_urls
from careflow.session import load

#: The vocabulary of the encoding queries.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The vocabulary of the token files.
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 0, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), VOCABULARY).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document: 20 code points go at a third, 30 of its own come in at two thirds, and the last word is joined to the first 10."""
    docs = load(spark, sf_dir, "documents")
    n = F.length("text")

    def step(edit: int, start: Column, stop: Column, new: Column) -> Column:
        return F.struct(F.lit(edit).alias("edit"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), new.alias("new"))

    third = F.floor(n / 3)
    steps = F.array(
        step(1, third, third + 20, F.lit("")), step(2, F.floor(2 * n / 3), F.floor(2 * n / 3), F.substring("text", 1, 30)),
        step(3, n * 2, n * 2, F.substring("text", 1, 10)))
    edits = docs.select("doc_id", F.inline(steps))
    return count_edits(docs, edits, VOCABULARY)


@query("op4_search", r"""
with w as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) as term from documents),
f as (select doc_id, term, count(*) as tf from w group by 1, 2),
l as (select doc_id, count(*) as n from w group by 1),
g as (select count(*) as n_docs, avg(n) as mean from l),
d as (select term, count(*) as df from f group by 1),
s as (select q.doc_id as query_id, f.doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * l.n / mean))), 6) as score
  from f q join d on d.term = q.term join f on f.term = q.term join l on l.doc_id = f.doc_id cross join g where q.doc_id % 100 = 0 group by 1, 2)
select query_id, row_number() over (partition by query_id order by score desc, doc_id)::int as rank, doc_id, score from s
qualify rank <= 10
""")
def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = search(build_index(docs), docs.where(F.col("doc_id") % 100 == 0))
    return found.withColumn("score", F.round("score", 6))


def _parts_sql(digests: str) -> str:
    """The sixteen part hashes of a list of MD5 digests, in DuckDB."""
    parts = [(1, 2, "g")] + [(1 + 2 * i, 2, bound) for i, bound in enumerate(["08"] * 3 + ["04"] * 4 + ["02"] * 4 + ["01"] * 4)]
    own = [f"list_filter({digests}, lambda d: substr(d, {place}, {width}) < '{bound}')" for place, width, bound in parts]
    return "[" + ", ".join(f"case when len({o}) > 0 then substr(md5(array_to_string({o}, '')), 1, 16) else '-' end" for o in own) + "]"


FINGERPRINT_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n_chars from documents),
x as (select *, coalesce(lead(doc_id) over (order by doc_id desc), (select max(doc_id) from d)) as next_id from d),
y as (select x.doc_id, x.text, x.n_chars, x.next_id, substr(x.text, 1, x.n_chars - x.n_chars // 3) || substr(n.text, 1, x.n_chars // 3) as edited from x join d n on n.doc_id = x.next_id),
t as (select doc_id, 0 as e, unnest(list_distinct(string_split_regex(lower(text), '[^\p{L}\p{N}]+'))) as term from y
  union all select doc_id, 1, unnest(list_distinct(string_split_regex(lower(edited), '[^\p{L}\p{N}]+'))) from y),
l as (select term from t where e = 0 and term <> '' group by 1 having count(*) > 1 and count(*) >= 0.002 * (select count(*) from d) and count(*) <= 0.2 * (select count(*) from d)),
h as (select doc_id, e, list(md5(term) order by term) as g from t semi join l on l.term = t.term group by 1, 2),
p as (select doc_id, e, PARTS as p from h),
f as (select y.doc_id, s.e, md5(case s.e when 0 then y.text else y.edited end) as m, coalesce(p.p, list_transform(range(16), lambda i: '-')) as p
  from y cross join (select unnest([0, 1]) as e) s left join p on p.doc_id = y.doc_id and p.e = s.e),
c as (select y.doc_id, y.n_chars, sha256(y.edited) as edited_sha256, a.p as a, b.p as b, c.p as c, a.m as am, b.m as bm, c.m as cm
  from y join f a on a.doc_id = y.doc_id and a.e = 0 join f b on b.doc_id = y.doc_id and b.e = 1 join f c on c.doc_id = y.next_id and c.e = 0),
u as (select *, len(list_filter(range(1, 17), lambda i: a[i] <> '-' or b[i] <> '-')) as ub, len(list_filter(range(1, 17), lambda i: a[i] <> '-' and a[i] = b[i])) as eb,
  len(list_filter(range(1, 17), lambda i: a[i] <> '-' or c[i] <> '-')) as uc, len(list_filter(range(1, 17), lambda i: a[i] <> '-' and a[i] = c[i])) as ec from c)
select doc_id, n_chars, edited_sha256,
  case when len(list_filter(a, lambda v: v <> '-')) > 0 then array_to_string(a, '.') else 'text:' || am end as fingerprint,
  case when len(list_filter(b, lambda v: v <> '-')) > 0 then array_to_string(b, '.') else 'text:' || bm end as edited_fingerprint,
  case when ub > 0 then eb / ub else (am = bm)::int::double end as near_edited, case when uc > 0 then ec / uc else (am = cm)::int::double end as near_next from u
""".replace("PARTS", _parts_sql("g"))


@query("op5_fingerprints", FINGERPRINT_SQL)
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(load(spark, sf_dir, "documents"))


@query("op6_near_dedup", r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as g
  from w where ws is not null),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as u, b.doc_id as v, count(*) as i from s a join s b on a.g = b.g and a.doc_id > b.doc_id group by 1, 2),
e as (select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * i >= 85 * (a.n + b.n - i)),
both_ways as (select u, v from e union select v, u from e),
reach as (select doc_id as a, doc_id as b from documents union select r.a, t.v from reach r join both_ways t on r.b = t.u),
c as (select a, min(b) as component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n on n.doc_id = d.doc_id join c on c.a = d.doc_id
""")
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), size=3, percent=85, rows=6, bands=25).select("doc_id", "n_shingles", "component_id", "kept")


@query("op9_repeated_passages", r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, i, list_slice(ws, i, i + 19) as k from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w)),
r as (select doc_id, i, row_number() over (partition by k order by doc_id, i) as rn from g),
c as (select distinct doc_id, i + o as at from r, range(20) t(o) where rn > 1),
x as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as at from w),
y as (select x.doc_id, string_agg(word, ' ' order by x.at) as kept, count(*) as n_kept from x left join c on c.doc_id = x.doc_id and c.at = x.at
  where c.at is null group by 1)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join y on y.doc_id = w.doc_id
""")
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(load(spark, sf_dir, "documents"), window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))


@query("op8_licenses", r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
t as (select doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' as s from w),
p as (select doc_id, i - 1 as pos,
    case when ws[i] = 'mit' and ws[i + 1] = 'license' then 'mit' when ws[i] = 'apache' and ws[i + 1] = 'license' then 'apache'
      when ws[i] = 'general' and ws[i + 1] = 'public' and ws[i + 2] = 'license' then 'gpl' end as label
  from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w)),
b as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word from p where label is not null group by 1),
m(label, pattern) as (values
  ('mit', ' (released|licensed|distributed|available) under (the terms of )?the mit license '),
  ('mit', ' permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the software )?to deal in the software without restriction '),
  ('apache-2.0', ' licensed under the apache license (version )?2 0 '),
  ('gpl-2.0', ' gnu general public license (as published by the free software foundation )?(either )?(version|v) 2 '),
  ('gpl-3.0', ' gnu general public license (as published by the free software foundation )?(either )?(version|v) 3 '),
  ('cc-by-4.0', ' (released|licensed) under (a )?(the )?cc by 4 0 '),
  ('cc-by-sa-4.0', ' (released|licensed) under (a )?(the )?cc by sa 4 0 '),
  ('cc-by-nc-4.0', ' (released|licensed) under (a )?(the )?cc by nc 4 0 '),
  ('bsd', ' redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met '),
  ('mpl-2.0', ' subject to the terms of the mozilla public license (version )?(v )?2 0 '),
  ('rights-reserved', ' copyright( [^ ]+){1,12} all rights reserved ')),
f as (select doc_id, label from t, m where regexp_matches(s, pattern)),
l as (select doc_id, label, 1 as full_text from f union all select doc_id, label, 0 from p where label is not null)
select w.doc_id, len(w.ws) as n_words, coalesce(b.n_base, 0) as n_base, b.first_word, b.last_word,
  coalesce((select string_agg(label, ',' order by label) from (select distinct label from p where p.doc_id = w.doc_id and label is not null)), '') as base_labels,
  coalesce((select string_agg(label, ',' order by label) from (select distinct label from l where l.doc_id = w.doc_id)), '') as labels,
  coalesce((select case max(full_text) when 1 then 1.0 when 0 then 0.5 end from l where l.doc_id = w.doc_id), 0.0)::double as score
from w left join b on b.doc_id = w.doc_id
""")
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents")).drop("spans")


@query("op10_url_filter")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"))


@query("op11_token_files")
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    manifest = write_ids(docs, BYTE_VOCABULARY, end_id=2)
    return read_documents(manifest, docs.schema["doc_id"].dataType.simpleString()).withColumnRenamed("id", "doc_id")


def _clusters_sql(k: int = 16, dims: int = 64, rounds: int = 3) -> str:
    """Every round spelled out: distances to all centroids, the smallest (distance, number), floors of the means."""
    ctes = [f"""v as (select vec_id, list_transform(embedding, lambda x: floor({dims} * x::double)::bigint) as v from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})""", f"""
c0 as (select row_number() over (order by h) - 1 as k, v as c from (select v, sha256('1:' || vec_id) as h from v order by h limit {k}))"""]
    for r in range(rounds + 1):
        ctes.append(f"""
a{r} as (select vec_id, v, min(row(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, k)) as best from v cross join c{r} group by 1, 2),
b{r} as (select vec_id, v, best[1] as distance, best[2] as k from a{r})""")
        if r < rounds:
            ctes.append(f"""
s{r} as (select k, i, sum(v[i])::hugeint as s, count(*)::hugeint as n from b{r}, range(1, {dims + 1}) t(i) group by 1, 2),
c{r + 1} as (select c{r}.k, coalesce(m.c, c{r}.c) as c from c{r} left join (select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from s{r} group by 1) m on m.k = c{r}.k)""")
    return "with " + ",".join(ctes) + f"""
select vec_id, b.k::int as cluster, distance, (sum(distance) over (partition by b.k))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256
from b{rounds} b join c{rounds} c on c.k = b.k
"""


@query("op12_centroids", _clusters_sql())
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(load(spark, sf_dir, "embeddings"))


@query("op13_hard_negatives", """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id, (row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id))::int as rank, s.id as negative_id,
  p.score as positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score
qualify rank <= 5
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(load(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)
