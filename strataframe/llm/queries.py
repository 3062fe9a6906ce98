"""One query per operator over its whole table, with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strataframe.llm import (
    exact_dedup,
    labelled,
    language_nb,
    licences,
    merkle,
    minhash,
    mixing,
    packing,
    phrases,
    quality_mil,
    quality_rules,
    token_records,
    toxicity,
    url_filter,
)
from strataframe.plans.storage import fresh_path

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _query(name: str, sql: str | None = None):
    def register(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIXING_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as place from s),
w as (
  select *, case place % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as weight, 2e0 * source_size as cap from r),
f as (
  select *, (1.5e0 * sum(source_size) over ()
      - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as rate
  from w),
t as (
  select source, source_size, place,
    least(cap, coalesce(max(case when cap / weight > rate then rate end) over () * weight, cap)) as target
  from f),
g as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as rounds from t),
e as (
  select d.*, g.source_size, g.place, g.target, g.rounds, g.target - g.rounds * g.source_size as rest,
    sum(size) over (partition by d.source order by h, doc_id, size rows unbounded preceding)::bigint as stop
  from d join g on d.source is not distinct from g.source),
q as (
  select *, max(rest) over (partition by source)
    - coalesce(max(case when stop <= rest then stop end) over (partition by source), 0) as gap
  from e),
c as (
  select *, row_number() over (partition by source order by
      case when stop > rest and abs(size - gap) < gap then 0 else 1 end, abs(size - gap), h, doc_id, stop) = 1
    and stop > rest and abs(size - gap) < gap as closes
  from q),
k as (
  select *, rounds + case when stop <= rest and rest > 0 then 1 when closes then 1 else 0 end as copies,
    case when rounds = 0 and closes then rest - gap else stop - size end / nullif(target, 0) as share
  from c),
u as (select *, least(coalesce(share, 0), 1) as y from k)
select doc_id, size, source_size, round(target, 6) as target, copies::bigint as copies, (copies * size)::bigint as taken,
  case when copies > 0 then round(case
    when place % 3 = 0 then 2 * y / (1.5 + sqrt(2.25 - 2 * y))
    when place % 3 = 1 then y
    when y >= 0.3125 then 0.5 + 2 * (y - 0.3125) / (1 + sqrt(1 + 3 * (y - 0.3125)))
    else 2 * y / (0.25 + sqrt(0.0625 + 3 * y)) end, 6) end as first_position
from u
"""


@_query("op1_mixing", MIXING_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "copies", "taken",
        F.round(F.get("positions", F.lit(0)), 6).alias("first_position"),
    ).orderBy("first_position", F.xxhash64("doc_id"), "doc_id")


@_query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = labelled.held_out("doc_id", 4, 2)
    model = quality_mil.fit_quality(docs.filter(~held), labels.filter(~held))
    scored = docs.select("doc_id", held.alias("held_out"), quality_mil.quality_score(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@_query(
    "op3_exact_dedup",
    """
    with d as (
      select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
      from documents)
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
      doc_id is not distinct from max(doc_id) over g as kept, text_sha256
    from d window g as (partition by text_sha256)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(_table(spark, sf_dir, "documents"))


@_query("op4_minhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


@_query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = labelled.held_out("doc_id", 4, 2)
    model = toxicity.fit_toxicity(docs.filter(~held), labels.filter(~held))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.toxicity_score(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in licences.all_templates())

LICENCES_SQL = rf"""
with f as (
  select doc_id, coalesce(text, '') as text, coalesce(source, '') || '/' || coalesce(lang, '') || '/'
    || case when regexp_matches(coalesce(text, ''), '(?i)licen[sc]e|all rights reserved|public domain')
       then 'LICENSE.' else '' end || coalesce(doc_id::varchar, '') as path
  from documents),
p as (
  select doc_id, path, unnest(string_split_regex(regexp_replace(text, '([.!?])[ 	]+', '' || chr(10), 'g'), chr(10))) as content from f
  union all select doc_id, path, unnest(string_split(text, chr(10))) from f
  union all select doc_id, path, text from f where path like '%/LICENSE.%'),
n as (
  select distinct * from p
  where regexp_matches(content, '(?i)licen[sc]e|all rights reserved|public domain')),
t(licence, notice) as (values {_TEMPLATE_ROWS}),
tw as (
  select licence, notice, word, count(*) as tf
  from (select licence, notice, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+(?:[.+-][a-z0-9]+)*')) as word from t) group by all),
i as (select word, ln(((select count(*) from t) + 1) / (count(*) + 1)) + 1 as idf from tw group by word),
tv as (select licence, notice, tw.word, tf * idf as w from tw join i on tw.word = i.word),
tn as (select licence, notice, sqrt(sum(w * w)) as norm from tv group by all),
tu as (select licence, notice, word, w / norm as u from tv join tn using (licence, notice)),
cw as (
  select content as id, word, count(*) as tf
  from (select content, unnest(regexp_extract_all(lower(content), '[a-z0-9]+(?:[.+-][a-z0-9]+)*')) as word from (select distinct content from n)) group by all),
w as (select id, cw.word, tf * coalesce(idf, ln((select count(*) from t) + 1) + 1) as w from cw left join i on cw.word = i.word),
norms as (select id, sqrt(sum(w * w)) as norm from w group by id),
dots as (select id, licence, notice, sum(w * u) as dot from w join tu on w.word = tu.word group by all),
scored as (select d.id, d.licence, round(dot / norm, 6) as cosine from dots d join norms x on x.id = d.id),
own as (
  select doc_id, path, licence, cosine from n join scored s on s.id = n.content where cosine >= 0.8
  qualify row_number() over (partition by doc_id, path order by cosine desc, licence) = 1),
granting as (
  select regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, min(licence) as granted from own where path like '%/LICENSE.%' group by 1),
out as (
  select f.doc_id, f.path, o.licence, o.cosine, coalesce(g2.granted, g1.granted) as granted
  from f left join own o on o.doc_id is not distinct from f.doc_id and o.path = f.path
  left join granting g2 on g2.dir = regexp_extract(f.path, '^(.*)/[^/]*$', 1)
  left join granting g1 on g1.dir = regexp_extract(f.path, '^([^/]*)/.*$', 1))
select doc_id, path, coalesce(licence, granted) as licence, cosine,
  case when licence is not null then 'own' when granted is not null then 'inherited' else 'none' end as origin
from out
"""


@_query("op6_licence_scan", LICENCES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as files below source/lang; a text with a notice is a licence file of its directory."""
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    name = F.when(text.rlike(licences.CUE), "LICENSE.").otherwise("")
    path = F.concat(
        F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), name,
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
    )
    return licences.licence_scan(docs.select("doc_id", path.alias("path"), "text"))


@_query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER)


URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

URL_SQL = r"""
with r(host, path, verdict) as (values {rules}),
p as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
q as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from p),
v as (
  select q.*, r.host || r.path as rule, r.verdict
  from q left join r on (q.host = r.host or ends_with(q.host, '.' || r.host)) and starts_with(q.path, r.path)
  qualify row_number() over (partition by page_id, q.host, q.path order by length(r.host || r.path) desc nulls last) = 1)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from v
""".format(rules=", ".join(map(str, URL_RULES)))


@_query("op8_url_filter", URL_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), rules)


@_query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = labelled.held_out("doc_id", 3, 1)
    model = language_nb.fit_languages(docs.filter(~held))
    found = docs.select("doc_id", held.alias("held_out"), language_nb.predict_language(model, docs).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


@_query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


PHRASES_SQL = r"""
with texts as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
cut as (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from texts),
pieces as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from cut),
grams as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase
  from (select lang, k, w, unnest(range(1, len(w) - k + 2)) as i from pieces, (select unnest(range(1, 5)) as k))),
f as (select lang, k, phrase, string_split(phrase, ' ') as w, count(*) as f from grams group by lang, k, phrase having count(*) >= 30),
cuts as (
  select c.lang, c.k, c.phrase, c.f as a, j, l.f as l, r.f as r, ((2000000::hugeint * c.f) // (l.f + r.f))::bigint as score
  from (select *, unnest(range(1, k)) as j from f) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[: c.j], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.j + 1 :], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (
  select lang, f, array_to_string(w[i : i + m - 1], ' ') as phrase
  from (select lang, f, w, m, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from f))),
covered as (select distinct f.lang, f.phrase from f join inside i on i.lang = f.lang and i.phrase = f.phrase where 100 * i.f >= 80 * f.f),
sizes as (select lang, count(*) as n from grams where k = 1 group by lang)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, n, score
from best b join sizes s on s.lang = b.lang where not exists (from covered c where c.lang = b.lang and c.phrase = b.phrase)
qualify rank <= 2000
"""


@_query("op11_phrases", PHRASES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(phrases.mine_phrases(_table(spark, sf_dir, "documents")))


MERKLE_SQL = r"""
with recursive
bytes as (
  select v, list_reduce(list_prepend(v::bigint, range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as crc
  from range(256) t(v)),
crcs as (select list(crc order by v) as crc from bytes),
d as (
  select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_text,
    coalesce(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, x: xor(c >> 8, crcs.crc[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0, false) as tampered
  from documents, crcs),
f as (
  select doc_id, source, tampered,
    concat(
      coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-')) as head,
    coalesce(strlen(text) || ':' || text, '-') as tail, coalesce(strlen(lower_text) || ':' || lower_text, '-') as lower_tail
  from d),
leaves as (
  select doc_id, coalesce('=' || source, '') as tree, sha256(head || tail) as leaf, sha256(head || case when tampered then lower_tail else tail end) as seen
  from f),
numbered as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n from leaves),
grown as (
  select tree, 0 as level, i, n, leaf as digest from numbered
  union all
  select tree, any_value(level) + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' order by i)) from grown where n > 1 group by tree, i // 16),
subroots as (
  select tree, digest as subroot, row_number() over (order by tree) - 1 as i, count(*) over () as n from grown where n = 1),
tops as (
  select 0 as level, i, n, subroot as digest from subroots
  union all
  select any_value(level) + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' order by i)) from tops where n > 1 group by i // 16),
steps as (
  select x.doc_id, x.tree, x.i as leaf_i, s.level,
    coalesce(string_agg(s.digest, '' order by s.i) filter (s.i < x.i // (16 ** s.level)::bigint), '') as before,
    coalesce(string_agg(s.digest, '' order by s.i) filter (s.i > x.i // (16 ** s.level)::bigint), '') as after
  from numbered x join grown s on s.tree = x.tree and s.n > 1 and s.i // 16 = x.i // (16 ** (s.level + 1))::bigint group by all
  union all
  select x.doc_id, x.tree, x.i, 1000 + s.level,
    coalesce(string_agg(s.digest, '' order by s.i) filter (s.i < r.i // (16 ** s.level)::bigint), ''),
    coalesce(string_agg(s.digest, '' order by s.i) filter (s.i > r.i // (16 ** s.level)::bigint), '')
  from numbered x join subroots r on r.tree = x.tree join tops s on s.n > 1 and s.i // 16 = r.i // (16 ** (s.level + 1))::bigint group by all),
proofs as (
  select tree, leaf_i, list({'before': before, 'after': after, 'd': ''} order by level) as proof, string_agg(before || after, '' order by level) as siblings
  from steps group by tree, leaf_i),
folded as (
  select x.doc_id, x.leaf, r.subroot, (select digest from tops where n = 1) as root, sha256(coalesce(siblings, '')) as proof_sha256,
    list_reduce(list_prepend({'before': '', 'after': '', 'd': seen}, coalesce(proof, [])),
      lambda a, s: {'before': '', 'after': '', 'd': sha256(s.before || a.d || s.after)}).d as folded_root
  from numbered x join subroots r on r.tree = x.tree left join proofs p on p.tree = x.tree and p.leaf_i = x.i)
select *, folded_root = root as verified from folded
"""


@_query("op12_merkle_manifest", MERKLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, and what they say of rows whose text lost its capitals in a fifth of the cases."""
    docs = _table(spark, sf_dir, "documents")
    text = F.translate("text", exact_dedup.UPPER, exact_dedup.UPPER.lower())
    seen = merkle.leaf_digest([*merkle.COLUMNS[:-1], text])
    manifest = merkle.build_manifest(docs, carry={"seen": F.when(labelled.held_out("doc_id", 5, 0), seen)})
    rows = manifest.proofs().withColumn("seen", F.coalesce(merkle.hexed("seen"), "leaf"))
    folded = rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest("proof").alias("proof_sha256"), merkle.fold("seen", "proof").alias("folded_root")
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


@_query("op13_token_records")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to the shared folder in doc_id order and read back from the files, checksums verified."""
    path = fresh_path(spark, "token_records")
    token_records.write_token_records(_table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_records.read_records(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
