"""Queries of the corpus operators over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratigraph.llm import licences, secrets
from stratigraph.llm.chat import chat_digest
from stratigraph.llm.codes import vector_codes
from stratigraph.llm.decontaminate import contaminated
from stratigraph.llm.divergence import source_divergence
from stratigraph.llm.language import identify
from stratigraph.llm.linededup import line_dedup
from stratigraph.llm.media import image_copies, rendered
from stratigraph.llm.packing import pack
from stratigraph.llm.quality import score_quality
from stratigraph.llm.simhash import simhash_components
from stratigraph.llm.topk import top_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")  # the tables hold no image; each vector is drawn as one
    return image_copies(vectors.select(F.col("vec_id").alias("image_id"), rendered("embedding").alias("image")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], rows.schema)
    return chat_digest(rows.union(added))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_vectors(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licences": op1_licences,
    "op2_media": op2_media,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_secrets": op7_secrets,
    "op8_chat": op8_chat,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_top_k": op12_top_k,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _lloyd_sql(rounds: int = 4) -> str:
    """The rounds of op11 as steps over tables of parts and of entries."""
    steps = [
        f"""good AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v,
            row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid FROM embeddings WHERE {FINITE})""",
        """piece AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM good, range(4) t(part))""",
        "book0 AS MATERIALIZED (SELECT part, rid AS entry, x AS c FROM piece WHERE rid < 256)",
    ]
    for at in range(rounds + 1):
        steps.append(f"""far{at} AS MATERIALIZED (SELECT rid, p.part, x, entry, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d
            FROM piece p JOIN book{at} b ON p.part = b.part)""")
        steps.append(f"own{at} AS MATERIALIZED (SELECT rid, part, any_value(x) AS x, arg_min(entry, d * 1024 + entry) AS entry, min(d) AS d FROM far{at} GROUP BY rid, part)")
        if at < rounds:
            steps.append(f"""mean{at} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY pos) AS m FROM (
                SELECT part, entry, pos, floor(sum(value) / count(*)) AS m FROM (SELECT part, entry, generate_subscripts(x, 1) AS pos, unnest(x) AS value FROM own{at}) GROUP BY part, entry, pos)
                GROUP BY part, entry)""")
            steps.append(f"book{at + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m, c) AS c FROM book{at} b LEFT JOIN mean{at} u ON u.part = b.part AND u.entry = b.entry)")
    return f"""WITH {", ".join(steps)},
        coded AS (SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM own{rounds} GROUP BY rid),
        told AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN good USING (rid), told"""


SQL: dict[str, str] = {
    "op11_vector_codes": _lloyd_sql(),
    "op12_top_k": f"""
        WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE {FINITE}),
        met AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.x, r.x) AS BIGINT) AS score FROM good q JOIN good r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM met)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        word AS (SELECT lang, source, doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
        held AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT coalesce(doc_id, -9223372036854775808)) AS df FROM word GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n) AS n FROM held GROUP BY ALL HAVING sum(df) >= 10),
        groups AS (SELECT DISTINCT lang, source FROM d),
        vocabulary AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
        counts AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
        totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
        share AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (t.total + 2 * v) AS p FROM counts JOIN totals t USING (lang, source) JOIN vocabulary USING (lang)),
        whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS q FROM kept JOIN vocabulary USING (lang)),
        apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM share JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",

    "op8_chat": r"""
        WITH all_rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
            SELECT *, 2 * length(role || text) - length(translate(role || text, chr(92) || '<[', '')) + 23 AS written FROM all_rows)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(written) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op10_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        repeated AS (
            SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (
            SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}
