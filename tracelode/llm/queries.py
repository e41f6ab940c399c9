"""The queries of this subpackage: op1 to op13, by name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, periodic_runs, pii, quality, secrets, sentencepiece_codec, simhash, spelling, suffix_dedup, token_counts, token_files
from .common import table

#: Tokenizer files of the installed package; another deployment passes its own paths to the operators.
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def hex64(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels")).select(*base, F.round("p_good", 6).alias("p_good"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=1)
    return token_files.read(spark, folder)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with one code point deleted in every 31st (document, word), by a checksum, so that there are variants to find."""
    runs = spelling.letter_runs(table(spark, sf_dir, "documents"), least=7)
    h = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % 31 == 0, F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return spelling.group(spelling.vocabulary(runs.select(word.alias("word")), min_length=7, min_count=2), ratio=10)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text; in one document of ten, by a checksum of its id, the words from a place on repeat with a period."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("ws")
    docs = docs.withColumn("ws", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    docs = docs.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    planted = F.concat(F.slice("ws", 1, F.col("a")), F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("ws", F.col("a") + (i - F.col("a")) % F.col("p"))))
    docs = docs.select("doc_id", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.runs(docs)
    # exact order of length / period: both fit in 63 bits when multiplied by the other's period
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    written = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("best", best).withColumn("written", F.when(F.size("runs") > 0, F.concat(written, F.lit("\n"))).otherwise(F.lit("")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2("written", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts are control strings, formatted, written, read back and digested."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    folder = chat_format.write(rows.union(tricky))
    return chat_format.digests(chat_format.read(spark.read.parquet(folder)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scans, op2_suffix_dedup, op3_pii, op4_html_extraction, op5_quality_rules, op6_token_counts, op7_decontamination, op8_sentencepiece, op9_token_files, op10_simhash,
        op11_spelling_groups, op12_periodic_runs, op13_chat_formatting,
    )
}

#: SQL can't express XXH64 fingerprints, tokenizers, inferred automata, boosted trees, the posterior of votes or tree scoring, and finds runs only by
#: comparing all words with all periods.
ORACLES: dict[str, str] = {
    "op11_spelling_groups": r"""
with recursive steps as (select i, 0 k, i::bigint c from range(256) t(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
 tab as (select list(c order by i) t from steps where k = 8),
 r0 as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) r from documents),
 r1 as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') r, count(*) n from r0 where length(r) >= 7 group by 1, 2),
 b as (select doc_id, r, n, hex(encode(doc_id || ':' || r)) x from r1),
 h as (select doc_id, r, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, i * 2 + 1, 2))::bigint)), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295::bigint) h from b, tab),
 w0 as (select case when h % 31 = 0 then substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) else r end as word, n from h),
 w as (select word, sum(n)::bigint n from w0 where length(word) >= 7 group by 1 having sum(n) >= 2),
 p as (select word, n, unnest(range(1, length(word) + 1)) i from w),
 holes as (select word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) g from p),
 less as (select distinct word, n, substr(word, 1, i - 1) || substr(word, i + 1) s from p),
 near as (select a.word, b.word other, b.n m from holes a join holes b using (g) where a.word != b.word
  union select l.word, w.word, w.n from less l join w on l.s = w.word union select w.word, l.word, l.n from less l join w on l.s = w.word),
 best as (select word, count(*) n_near, max(m) m, arg_min(other, (-m, other)) form from near group by word),
 f as (select w.word, w.n, coalesce(n_near, 0) n_near, case when m >= 10 * w.n then form end as form, case when m >= 10 * w.n then m end as form_n from w left join best using (word)),
 up as (select word, word root, 0 depth from f union all select up.word, f.form, depth + 1 from up join f on up.root = f.word where f.form is not null)
select f.word, form, root, n, n_near, form_n from f join (select word, arg_max(root, depth) root from up group by word) using (word)""",
    "op13_chat_formatting": r"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 o as (select *, lag(r) over w last, row_number() over (w rows between unbounded preceding and unbounded following) k, lead(r) over w following from c window w as (partition by conv_id order by turn, r, t)),
 e as (select *, length(t) + len(regexp_extract_all(t, '\\')) + len(regexp_extract_all(t, '</?s>|\[/?INST\]|<</?SYS>>|\[/?TURN\]|\[END\]')) body,
   coalesce(last, 'start') = 'start' or (last = 'assistant' and r = 'user') opens,
   case when last is null then r in ('system', 'user') else (last, r) in (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) end in_order from o),
 m as (select *, body + case when r = 'system' then 19 when r = 'user' then 15 when r = 'assistant' then 6 else length(r) + 18 end + case when opens and in_order then 3 else 0 end chars from e)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by k)) turns_sha256, coalesce(sum(length(t)) filter (where r = 'assistant'), 0)::bigint loss_chars,
 sha256(coalesce(string_agg(t, '' order by k) filter (where r = 'assistant'), '')) loss_sha256, sum(chars)::bigint formatted_chars, bool_and(in_order) and bool_or(following is null and r = 'assistant') as valid from m group by conv_id""",
    "op2_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n from documents),
 s as (select doc_id, i, substr(h, i * 2 + 1, 100) w from (select doc_id, h, unnest(range(0, greatest(n - 49, 0))) i from d)),
 m as (select w, min(doc_id) f from s group by w having min(doc_id) < max(doc_id)),
 c as (select doc_id, i from s join m using (w) where f < doc_id),
 g as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) k from (select *, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end fresh from c)),
 r as (select doc_id, min(i) a, max(i) + 50 b from g group by doc_id, k),
 p as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) last from r),
 k as (select doc_id, sum(b - a) n_removed, count(*) n_spans, max(b) tail, string_agg(substr(h, last * 2 + 1, (a - last) * 2), '' order by a) head from p join d using (doc_id) group by doc_id)
select doc_id, n n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, coalesce(n_spans, 0) n_spans,
 sha256(unhex(coalesce(head, '') || substr(h, coalesce(tail, 0) * 2 + 1))) kept_sha256 from d left join k using (doc_id)""",
    "op7_decontamination": r"""
with dd as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
 bb as (select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
 iw as (select distinct item_id, n, array_to_string(ws[k : k + n - 1], ' ') w from (select item_id, ws, least(len(ws), 10) n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) k from bb where len(ws) > 0)),
 dw as (select doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') w from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) k from dd, (select distinct n from iw) where len(ws) >= n)),
 hit as (select doc_id, item_id, k, dw.n from dw join iw using (n, w)),
 hw as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(k, k + n)) place from hit) group by doc_id),
 hi as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from hit) group by doc_id)
select doc_id, len(ws) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dd left join hw using (doc_id) left join hi using (doc_id)""",
}
