"""One query for each operator, with production parameters over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skarn.llm.packing import pack

    pieces = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.hamming import top_k

    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op3_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.lattice import links

    return links(read(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.substring import drop_repeated

    left = drop_repeated(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op5_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.lines import dedup

    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op6_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.secrets import KINDS, scan

    def said(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"].isin(*KINDS[:3]))

    def count(kind):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    return scan(read(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(spans).alias("spans"))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.quality import fold, scored, train

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "n_words", "epoch", "block", "order_key")


def op9_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skarn.llm.chat import digests, format_chats

    odd = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"))
    return digests(format_chats(rows, public_tokenizers.path("byte_bpe_50k.json")))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.jaccard import links

    return links(read(spark, sf_dir, "documents"))


def op11_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.sharding import assign

    return assign(read(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.infill import infill, restored

    x = infill(read(spark, sf_dir, "documents"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return x.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.negatives import mine

    vectors = read(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(vectors, vectors.filter("vec_id % 50 = 0"))


QUERIES = {
    "op1_retrieval_packing": op1_retrieval_packing,
    "op2_hamming_top_k": op2_hamming_top_k,
    "op3_lattice_near_dedup": op3_lattice_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_fuzzy_line_dedup": op5_fuzzy_line_dedup,
    "op6_credential_linking": op6_credential_linking,
    "op7_pu_quality": op7_pu_quality,
    "op8_temperature_mixing": op8_temperature_mixing,
    "op9_chat_masks": op9_chat_masks,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_label_propagation": op11_label_propagation,
    "op12_infill": op12_infill,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op2_hamming_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x < 0 THEN 1 ELSE 0 END) AS code FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
        d AS (
            SELECT q.vec_id AS query_id, o.vec_id, CAST(list_sum(list_transform(list_zip(q.code, o.code), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
            FROM v q JOIN v o ON q.vec_id <> o.vec_id AND len(q.code) = len(o.code) WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
        SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 10""",
    "op3_lattice_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
              AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
        c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a""",
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d),
        k AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS seq FROM s),
        m AS (SELECT seq, min(doc_id) AS first_id FROM k GROUP BY seq),
        c AS (SELECT DISTINCT k.doc_id, i + unnest(range(0, 13)) AS i FROM k JOIN m USING (seq) WHERE first_id < k.doc_id),
        w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
        g AS (SELECT w.doc_id, count(*) AS n_removed FROM w JOIN c USING (doc_id, i) GROUP BY 1),
        j AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN c USING (doc_id, i) GROUP BY 1)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id) LEFT JOIN j USING (doc_id)""",
    "op10_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh FROM i),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE k >= 0.8 * (x.n + y.n - k)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
        c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a), m AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT doc_id, class_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_links, doc_id = class_id AS is_kept
        FROM documents JOIN c ON doc_id = c.a LEFT JOIN m ON doc_id = m.a""",
    "op9_chat_masks": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(regexp_replace(text, '([<\[])(\x{2063}*)(\|turn\|>|\|says\|>|\|done\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])', '\1\2\3+', 'g')) AS n FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               CAST(sum(24 + length(role) + n) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op12_infill": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
        r AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y, CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d),
        f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100 THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
        p AS (SELECT *, array_to_string(u[1 : least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1 : greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1 :], '') AS s FROM f)
        SELECT doc_id, len(u) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM p""",
    "op13_hard_negatives": """
        WITH v AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
}
