"""The registered queries of this subpackage, over whole tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codes, exact, jaccard, leaks, lines, pii, quality, runs, shards, tokens, urls

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = quality.fit(docs, labels.where(~held).select("doc_id", F.col("quality").alias("label")))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_turns(turns.unionByName(more)))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The list of this query: pages 0 to 999 in four languages of these sites, at three domains, in their usual spellings.
LISTED_SITES = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")
_SPELLINGS = {"lead": ("", "m.", "blog."), "site": LISTED_SITES, "domain": ("com", "net", "org"), "lang": ("en", "fr", "de", "es"), "end": ("", ".html")}
LISTED_PAGES = 1000


def listed_pages(spark: SparkSession) -> DataFrame:
    """(key) of all listed pages, made by counting; it does not depend on what is judged."""
    total, picked = LISTED_PAGES, {}
    for name, values in _SPELLINGS.items():
        at = F.pmod(F.floor(F.col("id") / total), F.lit(len(values))).cast("int") + 1
        picked[name] = F.element_at(F.array(*[F.lit(v) for v in values]), at)
        total *= len(values)
    number = F.pmod("id", F.lit(LISTED_PAGES)).cast("string")
    host = F.concat(picked["lead"], picked["site"], F.lit(".example."), picked["domain"])
    path = F.concat(F.lit("/"), picked["lang"], F.lit("/"), number, picked["end"])
    return spark.range(total).select(urls.canonical(host, path).alias("key"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.url_verdicts(table(spark, sf_dir, "pages"), rules, listed_pages(spark))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit(docs))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(spark, tokens.write_tokens(table(spark, sf_dir, "documents")))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text, where one document of ten by the CRC-32 of its id gets a tail of words that repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    picked = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).cast("long").alias("g"))
    at = picked.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    at = at.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    tail = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return at.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.word_runs(repeated_tails(table(spark, sf_dir, "documents")))
    lines_ = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines_, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", runs.greatest_exponent("runs"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_digests(spark, *codes.lloyd(table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_kd_shards, op2_nb_svm_quality, op3_exact_dedup, op4_chat_format, op5_url_filter, op6_line_dedup, op7_byte_bpe, op8_skip_chain_pii, op9_ngram_jaccard, op10_benchmark_leaks, op11_token_files, op12_word_runs, op13_lloyd_codes, pipeline)}

_RULE_SQL = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1])))
_VERDICT_SQL = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in URL_RULES)
_LISTED_SQL = rf"((m|blog)\.)?({'|'.join(LISTED_SITES)})\.example\.(com|net|org)\|/(en|fr|de|es)/(0|[1-9][0-9]{{0,2}})(\.html)?"



def _lloyd_sql(rounds: int = 2) -> str:
    """Codebooks of 64 entries for 16 parts, in two rounds, as common tables."""
    steps = [
        """kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS (SELECT vec_id, k AS part, q[k * (len(q) // 16) + 1:(k + 1) * (len(q) // 16)] AS v FROM kept, range(16) AS r(k))",
        "firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY row_number() OVER (ORDER BY vec_id) <= 64)",
        "book0 AS (SELECT part, entry, v AS c FROM parts JOIN firsts USING (vec_id))",
    ]
    far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (
            SELECT vec_id, part, any_value(v) AS v, min(CAST({far} AS BIGINT) * 64 + entry) AS best FROM parts JOIN book{k} USING (part) GROUP BY vec_id, part)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
                SELECT part, entry, list(m ORDER BY i) AS c FROM (
                    SELECT part, best % 64 AS entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m
                    FROM (SELECT part, best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{k}) GROUP BY part, best % 64, i) GROUP BY part, entry)""")
            steps.append(f"book{k + 1} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry)")
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})")
    return f"""
        WITH {', '.join(steps)}
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (vec_id), digest"""


ORACLE_SQL = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "op4_chat_format": """
        WITH turns AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        escaped AS (
            SELECT *, regexp_replace(regexp_replace(text, '(<)(\\\\*\\||\\\\*/?s>)', '\\1\\\\\\2', 'g'), '(\\[)(\\\\*/?INST\\])', '\\1\\\\\\2', 'g') AS safe FROM turns)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
               CAST(sum(length(safe) + length(role) + length('<|turn|>') + length('<|says|>') + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id""",
    "op5_url_filter": f"""
        WITH parts AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*(/[^?#]*)?', 1) AS path FROM pages),
        keyed AS (SELECT *, regexp_replace(host, '^www\\.', '') || '|' || regexp_replace(path, '/+$', '') AS key FROM parts),
        ruled AS (SELECT *, CASE {_RULE_SQL} END AS rule, regexp_full_match(key, '{_LISTED_SQL}') AS on_list FROM keyed)
        SELECT page_id, host, path, rule, CASE {_VERDICT_SQL} WHEN on_list THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op6_line_dedup": f"""
        WITH parts AS (SELECT doc_id, coalesce(source, '') AS site, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM parts),
        b AS (SELECT line, min(doc_id) AS first_doc FROM l WHERE NOT regexp_full_match(line, '[\\x20\\x09-\\x0D]*') GROUP BY line HAVING count(DISTINCT site) >= {lines.MIN_SITES}),
        marked AS (
            SELECT l.doc_id, l.line, l.pos, b.line IS NOT NULL AND NOT (l.doc_id = b.first_doc AND row_number() OVER (PARTITION BY l.doc_id, l.line ORDER BY l.pos) = 1) AS goes
            FROM l LEFT JOIN b ON l.line = b.line)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_removed,
               coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE goes), '') AS removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS text_sha256
        FROM marked GROUP BY doc_id""",
    "op13_lloyd_codes": _lloyd_sql(),
}
