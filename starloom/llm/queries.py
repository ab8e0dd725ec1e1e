"""One registered query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode_ids, encode_texts
from .collocations import collocations
from .contamination import find_contamination
from .hosts import DAMPING, ROUNDS, SEED_SHARE, THRESHOLD, judge_urls
from .language import held_out, identify, learn
from .maxent import train_and_score
from .packing import pack_documents
from .records import new_folder, read_records, write_records
from .simhash import near_duplicates
from .spelling import spelling_variants
from .substring import dedup_substrings
from .topk import top_k
from .trie import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(f):
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SUBSTRING_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 33)) as i, w from d where len(w) >= 35),
k as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as g from s),
r as (select g from k group by g having count(*) > 1),
c as (select distinct doc_id, unnest(range(i, i + 35)) as p from k join r using (g)),
x as (select doc_id, list(p) as gone from c group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
       sha256(array_to_string(case when gone is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: not list_contains(gone, z[2])), lambda z: z[1]) end, ' ')) as kept_sha256
from d left join x using (doc_id)
"""


@query("op4_substring_dedup", SUBSTRING_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup_substrings(table(spark, folder, "documents"), window=35, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


CONTAMINATION_SQL = r"""
with lowered as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as a, 'abcdefghijklmnopqrstuvwxyz' as b),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents, lowered),
m as (select item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark, lowered),
g as (select distinct item_id::varchar as item, l, array_to_string(w[i:i + l - 1], ' ') as g
      from (select item_id, w, least(len(w), 10) as l, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from m where len(w) > 0)),
s as (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as i from d, (select distinct l from g) where len(w) >= l),
h as (select doc_id, i, l, item from (select doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') as g from s) join g using (l, g)),
p as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + l)) as p from h) group by doc_id),
n as (select doc_id, count(distinct item) as n, string_agg(distinct item, ',' order by item) as t from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(p.n, 0)::bigint as n_hit, coalesce(n.n, 0)::bigint as n_items,
       sha256(coalesce(n.t, '')) as items_sha256, coalesce(p.n, 0) > 0 as contaminated
from d left join p using (doc_id) left join n using (doc_id)
"""


@query("op2_benchmark_decontamination", CONTAMINATION_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), n=10, keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_sql() -> str:
    """The same judgement in SQL, its rounds written out."""
    a, b = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    text = rf"""with p as materialized (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{a}', '{b}') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path, html from pages),
r(rh, rp, v) as (values {rules}),
f as (select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as v from p, r
      where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id),
q as materialized (select p.page_id, host, path, rule, v from p left join f using (page_id)),
c as (select host, count(*) as n, count(*) filter (v = 'allow') as t, count(*) filter (v = 'block') as d from q where host <> '' group by host),
s0 as materialized (select 'trust' as k, host from c where t > 0 and t >= {SEED_SHARE} * n union all select 'distrust', host from c where d > 0 and d >= {SEED_SHARE} * n),
z as (select k, count(*) as m from s0 group by k),
s as materialized (select k, host, 1.0::double / m as x from s0 join z using (k)),
l as (select host as src, translate(regexp_extract(x, '^//([^/?#]*)', 1), '{a}', '{b}') as dst
      from (select host, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?(//[^\s"''<>]+)', 1)) as x from p where host <> '')),
e0 as materialized (select src, dst, count(*) as n from l where dst <> '' and dst <> src group by src, dst),
e1 as (select 'trust' as k, src, dst, n from e0 union all select 'distrust', dst, src, n from e0),
e as materialized (select k, src, dst, n / sum(n) over (partition by k, src) as w from e1),
y0 as materialized (select k, host, x as r from s)"""
    for i in range(1, ROUNDS + 1):
        text += rf""",
t{i} as materialized (select e.k, dst as host, {DAMPING} * sum(r * w) as r from y{i - 1} y join e on e.k = y.k and src = host group by e.k, dst),
u{i} as (select k, {DAMPING} - coalesce(sum(r), 0) as lost from (select distinct k from s) left join t{i} using (k) group by k),
y{i} as materialized (select k, host, sum(r) as r from (select k, host, r from t{i} union all select k, host, {1 - DAMPING} * x + x * lost from s join u{i} using (k)) group by k, host)"""
    return text + rf""",
w as (select host, coalesce(sum(r * m) filter (k = 'trust'), 0) as t, coalesce(sum(r * m) filter (k = 'distrust'), 0) as d from y{ROUNDS} join z using (k) group by host)
select page_id, q.host, path, rule, coalesce(v, case when coalesce(d, 0) >= {THRESHOLD} and coalesce(d, 0) > coalesce(t, 0) then 'block' else 'allow' end) as verdict
from q left join w on w.host = q.host"""


@query("op8_url_filter", url_sql())
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), URL_RULES, keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=4, distance=4, keep=["doc_id"]).drop("component_print")


def word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_curve_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack_documents(table(spark, folder, "documents"), word_bpe(), length=2048, end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_token_records")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    files = new_folder(spark)
    index = write_records(table(spark, folder, "documents"), files, word_bpe(), end=1)
    return read_records(index, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = held_out(F.col("doc_id"), 4)
    filters = learn(docs.where(~out))
    return identify(docs.select("doc_id", "text"), filters, keep=["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


TOP_K_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s) where rank <= 5
"""


@query("op6_exact_top_k", TOP_K_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query("op9_lm_scoring")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 7)
    scored = train_and_score(table(spark, folder, "documents"), ~out, keep=["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op12_bpe_stream")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    decoded = decode_ids(encode_texts(table(spark, folder, "documents"), tokenizer, keep=["doc_id"]), tokenizer)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


COLLOCATION_SQL = r"""
with t as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from t),
s as (select lang, w, unnest(range(1, len(w) + 1)) as i from w where len(w) > 0),
p as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) as k from s)),
f as materialized (select lang, k, phrase, count(*) as a from p group by all having count(*) >= 100),
m as (select lang, count(*) as n from s group by lang),
c as (select * from f where k > 1),
x as (select lang, unnest([array_to_string(string_split(phrase, ' ')[1:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:k], ' ')]) as phrase, a from c where k > 2),
g as (select c.* from c left join (select lang, phrase, max(a) as most from x group by all) y using (lang, phrase) where most is null or 100 * most < 100 * a),
u as (select lang, phrase, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') as head, array_to_string(string_split(phrase, ' ')[j + 1:k], ' ') as tail from (select *, unnest(range(1, k)) as j from g)),
v as (select u.lang, u.phrase, u.a, j, h.a as l, t.a as r, n, ((1000 * u.a::hugeint * n::hugeint) // (h.a::hugeint * t.a::hugeint))::bigint as score
      from u join f h on h.lang = u.lang and h.phrase = head join f t on t.lang = u.lang and t.phrase = tail join m on m.lang = u.lang),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as o from v) where o = 1),
z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select lang, rank, phrase, a, l, r, n, score from z where rank <= 2000
"""


@query("op11_collocations", COLLOCATION_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"), least=100, best=2_000)


SPELLING_SQL = r"""
with recursive step as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
d as (select coalesce(doc_id::varchar, '') || ':' as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+') as w from documents),
o as (select id, w, count(*) as n from (select id, unnest(w) as w from d) group by all),
h as (select w, n, xor(list_reduce(flatten(list_transform(string_split(id || w, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195, unicode(c)::bigint - 64] end)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as h from o, step),
g as (select case when h % 199 = 0 then left(w, (h % length(w))::bigint) || substr(w, (h % length(w) + 2)::bigint) else w end as word, n from h),
v as materialized (select word, sum(n)::bigint as n from g where length(word) >= 6 group by word having sum(n) >= 5),
x as materialized (select word, n, i, left(word, i - 1) || substr(word, i + 1) as less from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
e as (select a.word, b.word as near, b.n as m from x a join x b on a.i = b.i and a.less = b.less and a.word <> b.word
      union select a.word, b.word, b.n from v a join x b on a.word = b.less union select b.word, a.word, a.n from v a join x b on a.word = b.less),
k as (select word, count(*) as n_near, max(m) as m from e group by word),
f as (select word, min(near) as form, any_value(e.m) as form_n from e join k using (word) where e.m = k.m group by word),
j as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * v.n then form end as form, case when form_n >= 5 * v.n then form_n end as form_n from v left join k using (word) left join f using (word)),
r(word, root) as (select word, word from j union all select r.word, j.form from r join j on j.word = r.root where j.form is not null),
z as (select r.word, r.root from r join j on j.word = r.root where j.form is null)
select j.word, form, root, n, n_near, form_n from j join z using (word)
"""


@query("op13_spelling_variants", SPELLING_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"), shortest=6, least=5, factor=5)
