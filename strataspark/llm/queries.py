"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, embed_dedup, lexical, mixing, ngram_join, periodic, pieces, quality, secret_scan, token_count, toxicity, warc
from .common import table

CONFLICT = "\\### Assistant: </turn> ok"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.coded(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grades(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"))
    return chat.digests(rows.unionByName(more))


def op10_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(table(spark, sf_dir, "documents"))


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_rotated_codes, op2_token_counts, op3_piece_lattice, op4_ngram_join, op5_source_mix, op6_quality_grades, op7_warc_index, op8_embedding_dedup, op9_chat_format, op10_secret_formats,
           op11_dual_tree_search, op12_toxicity, op13_periodic_runs)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def oracle_sql() -> dict[str, str]:
    reach = """reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.other = l.a)"""
    return {
        "op1_rotated_codes": """
            WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0
                       AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: c.e[i] * q.e[i]), lambda a, b: a + b) AS score
                  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
            r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
            SELECT * FROM r WHERE rank <= 20""",
        "op4_ngram_join": f"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
                  FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL) p
                      JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
            both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
            nodes AS (SELECT doc_id AS id FROM documents), {reach}
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM documents d LEFT JOIN n USING (doc_id)
            JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) r ON r.id = d.doc_id""",
        "op7_warc_index": """
            WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
            m AS (SELECT *, n >= 100 AND page_id <> min(page_id) OVER (PARTITION BY d) AS again, min(page_id) OVER (PARTITION BY d) AS f FROM p)
            SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN f END AS refers_to FROM m""",
        "op8_embedding_dedup": f"""
            WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
            links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.95),
            both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
            nodes AS (SELECT vec_id AS id FROM embeddings), {reach},
            c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
            SELECT id AS vec_id, (SELECT count(*) FROM both_ways l WHERE l.a = c.id) AS n_links, component_id, id = component_id AS kept FROM c""",
        "op9_chat_format": r"""
            WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
            e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>')) AS written FROM r)
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
              CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
              sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
              CAST(sum(6 + length(role) + 1 + written + 7 + 1) AS BIGINT) AS formatted_chars
            FROM e GROUP BY conv_id""",
        "op11_dual_tree_search": rf"""
            WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{lexical.PATTERN}')) AS t FROM documents),
            i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{lexical.PATTERN}')) AS t FROM benchmark),
            n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), a AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
            m AS (SELECT doc_id, 10 + (90 * n * nn) // ll AS m FROM n, a), tf AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM i) GROUP BY ALL),
            w AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, a GROUP BY t, nn),
            s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL),
            r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
            SELECT * FROM r WHERE rank <= 10""",
    }
