"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .fill_middle import fill_in_middle, restore
from .langid import held_out as lang_held_out
from .langid import predict_languages, train_languages
from .licenses import license_scan, license_sql
from .line_dedup import line_decisions
from .mixing import mix_sources
from .near_dup import near_duplicates
from .quality import held_out, quality_scores, train_quality
from .repair import damage, repair_conversations
from .secrets import BASE, count_kind, joined, secret_scan
from .sharding import uniform_shards
from .token_store import write_tokens


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return write_tokens(docs, tokenizer_path(), 2).records(docs.select("doc_id"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_scores(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.transform("hits", lambda h: h["item_id"])
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["similarity"])), F.lit(0.0))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), items.alias("item_ids"), best.alias("similarity"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_decisions(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op8_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    out = uniform_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_pass", "mix_block", "mix_order")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    counts = [count_kind("spans", k).alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(joined("spans", BASE), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")), present_col="present")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fim = {k: F.col(f"fim.{k}") for k in ("n", "form", "prefix", "middle", "output")}
    digest = F.sha2(fim["output"].cast("binary"), 256)
    restored = F.sha2(restore(fim["output"], fim["form"]).cast("binary"), 256)
    return out.select("doc_id", "fim.n", "fim.form", fim["prefix"].alias("prefix_chars"), fim["middle"].alias("middle_chars"), digest.alias("output_sha256"), restored.alias("restored_sha256"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict_languages(docs.select("doc_id", "text"), train_languages(docs))
    return out.select("doc_id", lang_held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_license_scan": op2_license_scan,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_uniform_shards": op8_uniform_shards,
    "op9_mix_sources": op9_mix_sources,
    "op10_secret_scan": op10_secret_scan,
    "op11_repair_conversations": op11_repair_conversations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language_id": op13_language_id,
}



def repair_sql() -> str:
    """The repair as a recursion over turns: for each conversation the least (cost, audit, text) of the grammar's four states."""

    def way(state: str, cost: str, edit: str, line: str | None = None) -> str:
        text = f"{state}.x" if line is None else f"CASE WHEN {state}.x IS NULL THEN {line} ELSE {state}.x || chr(10) || {line} END"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'x': {text}}} END"

    def read(state: str, initial: str, role: str) -> str:
        keep, rerole = way(state, "f.cut", "K", "f.role || ':' || f.text"), way(state, "2 + f.cut", "R", f"'{role}:' || f.text")
        return f"CASE WHEN f.must THEN NULL WHEN left(f.role, 1) = '{initial}' THEN {keep} ELSE {rerole} END"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    user, assistant = "'user:'", "'assistant:'"
    system = f"CASE WHEN NOT f.must AND left(f.role, 1) = 's' THEN {way('r.q', 'f.cut', 'K', "f.role || ':' || f.text")} END"
    return f"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(list_reduce([4294967295::BIGINT] || list_transform(split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT),
                    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS k FROM conversations),
        d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
                regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM o),
        f AS (SELECT *, bare = '' AS blank, bare <> '' AND seen > 1 AS dup, bare <> '' AND seen = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS trunc, blank OR dup AS must, trunc::INT AS cut,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM n),
        e AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(trunc) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        r(conv_id, i, q, s, u, a) AS (
            SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 'x': NULL::VARCHAR}}, NULL::STRUCT(c BIGINT, a VARCHAR, x VARCHAR), {{'c': 2::BIGINT, 'a': 'I', 'x': {user}}}, {{'c': 4::BIGINT, 'a': 'II', 'x': {user} || chr(10) || {assistant}}} FROM conversations
            UNION ALL
            SELECT conv_id, i, q, s, u, {least("a", way("u", "2", "I", assistant))} FROM (
                SELECT conv_id, i, q, s, a, {least("u", way("q", "2", "I", user), way("s", "2", "I", user), way("a", "2", "I", user))} AS u FROM (
                    SELECT r.conv_id, f.i, {way("r.q", "3", "D")} AS q, {least(way("r.s", "3", "D"), system)} AS s,
                        {least(way("r.u", "3", "D"), read("r.q", "u", "user"), read("r.s", "u", "user"), read("r.a", "u", "user"))} AS u, {least(way("r.a", "3", "D"), read("r.u", "a", "assistant"))} AS a
                    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1))),
        z AS (SELECT conv_id, {least("q", "a")} AS v FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
        SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, v.c AS cost, v.a AS audit, sha256(coalesce(v.x, '')) AS repaired_sha256
        FROM z LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM z.conv_id
    """


ORACLE_SQL = {
    "op11_repair_conversations": repair_sql(),
    "op12_fill_in_middle": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        d AS (SELECT doc_id, x, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM t),
        f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, substr(x, 1, a) AS prefix, substr(x, a + 1, b - a) AS middle, substr(x, b + 1) AS suffix FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN x WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(x) AS restored_sha256
        FROM p
    """,
    "op2_license_scan": license_sql(),
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
        FROM t
    """,
}
