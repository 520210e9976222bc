"""The queries of the numbered operators and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from virocohort.llm import bpe, collocations, exact_dedup, language_id, license_scan, line_quality, multi_index, packing, simhash, spelling, token_files, url_filter, warc
from virocohort.llm.common import table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


@query("""
with t as (select doc_id, coalesce(text, '') text, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) text_sha256 from documents)
select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by text_sha256) group_size,
       row_number() over w = 1 kept, text_sha256
from t window w as (partition by text_sha256 order by length(text) desc, doc_id rows between unbounded preceding and unbounded following)""")
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on every machine."""
    return public_tokenizers.path(name)


LANGUAGES = ("de", "en", "es", "fr")


@query()
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Pages, with markup, address and host, and documents, whose lang column declares and whose source is the host."""
    docs = language_id.documents_as_rows(table(spark, folder, "documents"))
    pages = language_id.pages_as_rows(table(spark, folder, "pages"))
    both = docs.withColumn("kind", F.lit("document")).unionByName(pages.withColumn("kind", F.lit("page")))
    found = language_id.identify(both, language_id.text_model(docs, LANGUAGES), LANGUAGES)
    return found.select("kind", F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
                        "language", "posterior", "accepted", "text_language", "declared", "host")


@query()
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(spark, table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), "spaced", 0, 50257)


@query()
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest_documents(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query()
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), "words")


@query()
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_scan(table(spark, folder, "documents"))


@query()
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_dedup(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


RULES = "('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')"


@query(f"""
with rules as (select * from (values {RULES}) as r(rhost, rpath, rverdict)),
p as (select page_id, url, coalesce(case when contains(url, '://') then substr(url, instr(url, '://') + 3) end, '') rest from pages),
q as (select *, regexp_extract(rest, '^[^/?#]*') raw from p),
r as (select *, translate(raw, '{url_filter.UPPER}', '{url_filter.LOWER}') host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path from q),
m as (select url, max_by(rhost || rpath, length(rhost || rpath)) rule, max_by(rverdict, length(rhost || rpath)) verdict
      from (select distinct url, host, path from r) join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by url)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from r left join m using (url)""")
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql(f"select * from values {RULES} as r(host, path, verdict)")
    return url_filter.url_filter(table(spark, folder, "pages"), rules)


@query("""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha1(coalesce(html, '')) sha from pages),
g as (select *, min(page_id) over (partition by sha) one from p)
select page_id, payload_bytes, list_aggregate(list_transform(range(0, 40, 5), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
         lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, i + 1, 5))::int >> k) & 31), 1)), 'string_agg', '')), 'string_agg', '') payload_digest,
       case when page_id = one then 'response' else 'revisit' end record_type, case when page_id <> one then one end refers_to
from g""")
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op10_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.search(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


LOWERED = f"translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}')"


@query(f"""
with d as (select coalesce(lang, 'und') lang, {LOWERED} t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) piece from d),
w as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') ws from p),
totals as (select lang, sum(len(ws))::bigint n from w group by lang),
g as (select lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) phrase from w, (select unnest(range(1, 6)) m)),
f as (select lang, m, phrase, count(*) a from g group by all having count(*) >= 100),
c as (select lang, m, phrase, a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') part, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') rest
      from (select *, unnest(range(1, m)) k from f where m > 1)),
s as (select c.*, x.a l, y.a r, n, (1000::hugeint * c.a * n // (x.a::hugeint * y.a))::bigint score from c join f x on x.lang = c.lang and x.phrase = part join f y on y.lang = c.lang and y.phrase = rest join totals on totals.lang = c.lang),
one as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (select * from one where not exists (select 1 from f where f.lang = one.lang and f.m > one.m and f.a = one.a and contains(' ' || f.phrase || ' ', ' ' || one.phrase || ' '))),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000""")
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query()
def op12_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(f"""
with recursive tab as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) tab),
d as (select coalesce(doc_id::varchar, '') id, {LOWERED} t from documents),
r as (select id, unnest(regexp_extract_all(t, '[a-z\u00c0-\u00ff]+')) run from d),
u as (select id, run, count(*) c, hex(encode(id || ':' || run)) x from r where length(run) >= 6 group by all),
h as (select run, c, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) h from u, tab),
v as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end word, sum(c)::bigint n from h group by 1 having length(word) >= 6 and sum(c) >= 5),
e as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) cut from (select *, unnest(range(1, length(word) + 1)) i from v)),
shorter as (select distinct e.word, e.n, v.word near, v.n near_n from e join v on v.word = e.cut),
pairs as (select * from shorter union all select near, near_n, word, n from shorter union all select a.word, a.n, b.word, b.n from e a join e b on a.i = b.i and a.cut = b.cut and a.word <> b.word),
best as (select word, n, near, near_n, count(*) over (partition by word) n_near from pairs qualify row_number() over (partition by word order by near_n desc, near) = 1),
forms as (select v.word, v.n, coalesce(n_near, 0) n_near, case when near_n >= 5 * v.n then near end form, case when near_n >= 5 * v.n then near_n end form_n from v left join best using (word)),
chain as (select word, word root, form ahead from forms union all select chain.word, forms.word, forms.form from chain join forms on forms.word = chain.ahead)
select word, form, root, n, n_near, form_n from forms join (select word, root from chain where ahead is null) using (word)""")
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))
