"""The registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import bpe, conversations, decontamination, language, licenses, pii, quality, sharding, simhash, spelling, suffixes, token_store, topk
from quoin.llm.common import fresh_path, read_table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, vocabulary_path())
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(read_table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, distance=3)
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.deduplicated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start)
    return kept.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = fresh_path(spark, "tokens")
    token_store.write(read_table(spark, sf_dir, "documents").select("doc_id", "text"), store, vocabulary_path(), end_id=2)
    return token_store.read_sums(spark, store, token_store.width_of(vocabulary_path())).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.judged(docs, read_table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, read_table(spark, sf_dir, "labels"), keep_text=False).select("doc_id", "held_out", "score", "predicted")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.judged(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


OP9_SQL = """
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.r, a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.vec_id % 20 = 0 and a.r <> b.r
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
where rank <= 20
"""


#: The 256 remainders of crc32, as a table of one row.
CRC_TABLE = """
crc_table as materialized (
  select list(list_reduce([cast(i as bigint), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as crcs
  from range(256) t(i)
)"""
#: crc32 of the UTF-8 bytes whose hexadecimal digits are in h, beside crc_table.
CRC_OF_H = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(0, cast(length(h) / 2 as bigint)), lambda k: cast(16 * (strpos('0123456789ABCDEF', h[2 * k + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * k + 2]) - 1 as bigint))),
  lambda c, y: xor(c // 256, crcs[cast(xor(c % 256, y) as bigint) + 1])))"""

OP11_SQL = f"""
with recursive {CRC_TABLE},
runs as (
  select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[a-zÀ-ÿ]+')) as run from documents
),
hashed as (
  select run, times, {CRC_OF_H} as crc
  from (select run, hex(encode(id || ':' || run)) as h, count(*) as times from runs group by id, run), crc_table
),
damaged as (
  select case when crc % 97 = 0 then substr(run, 1, cast(crc % length(run) as bigint)) || substr(run, cast(crc % length(run) as bigint) + 2) else run end as word, times from hashed
),
words as materialized (select word, cast(sum(times) as bigint) as n from damaged where length(word) >= 5 group by word having sum(times) >= 3),
cut as materialized (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as other from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, w.word from cut c join words w on w.word = c.rest
  union select w.word, c.word from cut c join words w on w.word = c.rest
),
ranked as (
  select near.word, other, n, count(*) over (partition by near.word) as n_near, row_number() over (partition by near.word order by n desc, other) as place
  from near join words on words.word = other
),
judged as materialized (
  select w.word, w.n, coalesce(r.n_near, 0) as n_near, case when r.n >= 2 * w.n then r.other end as form, case when r.n >= 2 * w.n then r.n end as form_n
  from words w left join ranked r on r.word = w.word and r.place = 1
),
way as (
  select word, word as root, 0 as steps from judged
  union all select way.word, judged.form, steps + 1 from way join judged on judged.word = way.root where judged.form is not null
)
select j.word, j.form, w.root, j.n, cast(j.n_near as bigint) as n_near, j.form_n
from judged j join (select word, arg_max(root, steps) as root from way group by word) w on w.word = j.word
"""


OP12_SQL = f"""
with recursive {CRC_TABLE},
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, hex(encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))) as h
  from conversations
),
hurt as (select conv_id, turn, role, text, {CRC_OF_H} % 20 as k from keyed, crc_table),
damaged as (
  select conv_id, turn, case k when 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case k when 3 then 2 else 1 end)) as copy
  from hurt where k <> 0
),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
placed as (
  select *, row_number() over (partition by conv_id, role, text order by i) as seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as core from ordered
),
faults as materialized (
  select conv_id, turn, role, text, i, case when core = '' then 'blank' when seen > 1 then 'duplicate' when right(core, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    i > 1 and lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) not in ('su', 'ua', 'au') as illegal
  from placed
),
counts as (
  select conv_id, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal, count(*) as n
  from faults group by conv_id
),
inserts(state, becomes, price, letters, added) as (values
  (0, 0, 0, '', []::varchar[]), (1, 1, 0, '', []::varchar[]), (2, 2, 0, '', []::varchar[]), (3, 3, 0, '', []::varchar[]), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
  (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])
),
edits(state, letter, initial, role, becomes, price) as (values
  (0, 'K', 's', null, 1, 0), (0, 'K', 'u', null, 2, 0), (1, 'K', 'u', null, 2, 0), (2, 'K', 'a', null, 3, 0), (3, 'K', 'u', null, 2, 0),
  (0, 'R', null, 'user', 2, 2), (1, 'R', null, 'user', 2, 2), (2, 'R', null, 'assistant', 3, 2), (3, 'R', null, 'user', 2, 2),
  (0, 'D', null, null, 0, 3), (1, 'D', null, null, 1, 3), (2, 'D', null, null, 2, 3), (3, 'D', null, null, 3, 3)
),
way as (
  select conv_id, cast(0 as bigint) as i, 0 as state, 0 as cost, '' as audit, []::varchar[] as lines from counts
  union all
  select conv_id, i, state, best.cost, best.audit, best.lines from (
    select w.conv_id, r.i, e.becomes as state, min(struct_pack(
      cost := w.cost + x.price + e.price + case when fault = 'truncated' and letter <> 'D' then 1 else 0 end, audit := w.audit || x.letters || letter,
      lines := w.lines || x.added || case letter when 'D' then []::varchar[] else [coalesce(e.role, r.role) || ':' || text] end)) as best
    from way w join inserts x on x.state = w.state join faults r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1 join edits e on e.state = x.becomes
    where letter = 'D' or (fault not in ('blank', 'duplicate') and (letter = 'R' or left(r.role, 1) = initial))
    group by w.conv_id, r.i, e.becomes
  )
),
ended as (
  select w.conv_id, min(struct_pack(cost := w.cost + x.price, audit := w.audit || x.letters, lines := w.lines || x.added)) as best
  from way w join counts c on c.conv_id is not distinct from w.conv_id and c.n = w.i join inserts x on x.state = w.state
  where x.becomes in (0, 3) group by w.conv_id
)
select k.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(coalesce(best.cost, 0) as bigint) as cost, coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) k left join counts c on c.conv_id is not distinct from k.conv_id left join ended e on e.conv_id is not distinct from k.conv_id
"""


def _expression(items: licenses.Parsed) -> str:
    """Markup as a regular expression over words with a space after each."""
    told = {bytes: lambda x: x.decode() + " ", tuple: lambda x: "(?:[^ ]+ ){%d,%d}" % x, list: lambda x: f"(?:{_expression(x)})?"}
    return "".join(told[type(x)](x) for x in items)


def _phrase_sql(phrase: str) -> str:
    """Starts of the phrase, words from 0."""
    same = " and ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
    return f"list_filter(range(0, len(words)), lambda i: {same})"


OP13_SQL = f"""
with split as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents
),
lines as (select *, ' ' || array_to_string(words, ' ') || ' ' as line from split),
found as (
  select doc_id, cast(len(words) as bigint) as n_words, {", ".join(f"{_phrase_sql(phrase)} as at{k}" for k, (_, phrase) in enumerate(licenses.PHRASES))},
    list_filter([{", ".join(f"case when regexp_matches(line, ' {_expression(licenses.parsed(markup))}') then '{label}' end" for label, markup in licenses.TEMPLATES)}], lambda x: x is not null) as own
  from lines
),
told as (
  select *, {" || ".join(f"at{k}" for k in range(len(licenses.PHRASES)))} as places, list_filter([{", ".join(f"case when len(at{k}) > 0 then '{label}' end" for k, (label, _) in enumerate(licenses.PHRASES))}], lambda x: x is not null) as base
  from found
)
select doc_id, n_words, cast(len(places) as bigint) as n_base, cast(list_min(places) as bigint) as first_word, cast(list_max(places) as bigint) as last_word,
  array_to_string(list_sort(base), ',') as base_labels, array_to_string(list_sort(list_distinct(base || own)), ',') as labels, case when len(own) > 0 then 1.0 when len(base) > 0 then 0.5 else 0.0 end::double as score
from told
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_sharding": op2_sharding, "op3_simhash": op3_simhash, "op4_suffixes": op4_suffixes, "op5_token_store": op5_token_store, "op6_pii": op6_pii, "op7_decontamination": op7_decontamination, "op8_language": op8_language, "op9_topk": op9_topk, "op10_quality": op10_quality, "op11_spelling": op11_spelling, "op12_conversations": op12_conversations, "op13_licenses": op13_licenses}


def oracle_sql() -> dict[str, str]:
    """Queries missing here can't be said in SQL; tests/llm holds them against brute force."""
    return {"op9_topk": OP9_SQL, "op11_spelling": OP11_SQL, "op12_conversations": OP12_SQL, "op13_licenses": OP13_SQL}
