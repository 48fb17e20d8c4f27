"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, licenses, linededup, merkle, packing, pieces, quality, sharding, suffixes, tokenstore, topk, toxicity, whitening


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every document, learnt from the labels outside the held-out quarter; see ``toxicity``."""
    documents, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    known = labels.filter(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = documents.filter(~held_out).select("doc_id", "text").join(known, "doc_id", "left")
    scored = toxicity.score(documents, "doc_id", "text", toxicity.train(seen, "toxic", "text"))
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of every document; see ``licenses``."""
    return licenses.document_labels(licenses.scan(_table(spark, sf, "documents"), "doc_id", "text"), "doc_id")


def op3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of ids and decoded text of every document; see ``pieces``."""
    return pieces.encode_digests(_table(spark, sf, "documents"), "doc_id", "text", _tokenizer("piece_bpe_32k.model"))


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens; see ``packing``."""
    cut = packing.token_pieces(_table(spark, sf, "documents"), "doc_id", "text", _tokenizer("word_bpe_49k.json"))
    return packing.pack(cut, "length")


def op5_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 best candidates of every hundredth vector; see ``topk``."""
    return topk.top_k(_table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("key") % 100 == 0, 10)


def op6_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Component of every document under 85 % of shared 4-word shingles; see ``jaccard``."""
    return jaccard.link(_table(spark, sf, "documents"), "doc_id", "text", 4, 85)


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Figures and verdict of every document; see ``quality``."""
    return quality.assess(_table(spark, sf, "documents"), "doc_id", "text", "lang")


def op8_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every document that repeat an earlier one but for two edits; see ``linededup``."""
    return linededup.count_lines(_table(spark, sf, "documents"), "doc_id", "text", least=1)


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Shard 0 to 7 of every document, its slot there, and its shard if there were one more; see ``sharding``."""
    documents = _table(spark, sf, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = sharding.assign_shards(documents, "doc_id", [1.0] * 8).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard"
    )
    slots = sharding.number_slots(rows, "shard", ["doc_id", "size", "text_crc32"])
    grown = sharding.shard_of(F.col("doc_id"), [1.0] * 9)
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def op10_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document without byte strings of 400 that occur twice; see ``suffixes``."""
    return suffixes.spans(_table(spark, sf, "documents"), "doc_id", "text")


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Every sound vector on the 8 leading components of all; see ``whitening``."""
    return whitening.whiten(_table(spark, sf, "embeddings"), "vec_id", "embedding", 8)


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, proof and root of every document, and whether rows that were tampered with still lead there; see ``merkle``."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    grown = [F.col("n_chars").cast("decimal(20,0)") + 1 if i == 3 else c for i, c in enumerate(columns)]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = merkle.leaves(_table(spark, sf, "documents"), "doc_id", "lang", columns, F.when(tampered, merkle.leaf_digest(grown)))
    return merkle.proofs(rows).withColumnRenamed("k", "doc_id").drop("g")


def op13_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Place and digest of every document's ids, read back from files of compressed ids; see ``tokenstore``."""
    store = tokenstore.write(_table(spark, sf, "documents"), "doc_id", "text", _tokenizer("byte_bpe_50k.json"))
    return tokenstore.read(store, with_ids=False)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_licenses, op3_pieces, op4_packing, op5_topk, op6_jaccard, op7_quality, op8_lines, op9_sharding, op10_suffixes,
        op11_whitening, op12_merkle, op13_token_files,
    )
}

# Levels are built by recursion, a proof is the siblings of a leaf's ancestors, and crc32 goes digit by digit.
_MERKLE_SQL = """
    WITH RECURSIVE steps AS (
        SELECT v, v::BIGINT AS c, 0 AS k FROM range(256) t(v)
        UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
    ), digits AS (SELECT v, c FROM steps WHERE k = 8
    ), ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL
    ), sums AS (
        SELECT doc_id, s, 4294967295::BIGINT AS c, 0 AS k FROM ids
        UNION ALL SELECT doc_id, s, xor(d.c, sums.c >> 8), k + 1 FROM sums JOIN digits d ON d.v = xor(sums.c & 255, ascii(substr(s, k + 1, 1))::BIGINT)
        WHERE k < length(s)
    ), chosen AS (SELECT doc_id AS id FROM sums WHERE k = length(s) AND xor(c, 4294967295) % 7 = 0
    ), said AS (
        SELECT doc_id, lang, n_chars IS NOT NULL AND doc_id IN (SELECT id FROM chosen) AS tampered,
          coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
          coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS told, length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) AS grown,
          coalesce(strlen(text) || ':' || text, '-') AS after FROM documents
    ), hashed AS (
        SELECT doc_id, lang, sha256(before || told || after) AS leaf, CASE WHEN tampered THEN sha256(before || grown || after) END AS claimed FROM said
    ), placed AS (
        SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS row, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp,
          row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed
    ), nodes AS (
        SELECT grp, 0 AS level, i, n, leaf AS h FROM placed
        UNION ALL SELECT grp, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY grp, level, i // 2, n
    ), tops AS (SELECT grp, level AS height, h FROM nodes WHERE n = 1
    ), upper_nodes AS (
        SELECT 0 AS level, grp AS i, count(*) OVER () AS n, h FROM tops
        UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper_nodes WHERE n > 1 GROUP BY level, i // 2, n
    ), summit AS (SELECT level AS height, h FROM upper_nodes WHERE n = 1
    ), way AS (
        SELECT row, a.level, i, beside FROM (
            SELECT row, g.level, p.i // (1 << g.level)::BIGINT AS i, grp FROM placed p JOIN tops t USING (grp), generate_series(0, t.height - 1) g(level)
        ) a LEFT JOIN (SELECT grp, level, i AS at, h AS beside FROM nodes) s ON s.grp = a.grp AND s.level = a.level AND s.at = xor(a.i, 1)
        UNION ALL
        SELECT row, t.height + a.level, a.i, beside FROM (
            SELECT row, grp, g.level, p.grp // (1 << g.level)::BIGINT AS i FROM placed p, summit, generate_series(0, summit.height - 1) g(level)
        ) a JOIN tops t ON t.grp = a.grp LEFT JOIN (SELECT level, i AS at, h AS beside FROM upper_nodes) s ON s.level = a.level AND s.at = xor(a.i, 1)
    ), folded AS (
        SELECT row, 0 AS level, coalesce(claimed, leaf) AS h FROM placed
        UNION ALL SELECT f.row, f.level + 1, sha256(CASE WHEN beside IS NULL THEN f.h WHEN i % 2 = 1 THEN beside || f.h ELSE f.h || beside END)
        FROM folded f JOIN way w ON w.row = f.row AND w.level = f.level
    ), ends AS (SELECT row, arg_max(h, level) AS h FROM folded GROUP BY row
    ), proven AS (SELECT row, sha256(coalesce(string_agg(beside, '' ORDER BY level), '')) AS proof FROM way GROUP BY row
    )
    SELECT doc_id, leaf, t.h AS subroot, summit.h AS root, coalesce(proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = summit.h AS verified
    FROM placed p JOIN tops t ON t.grp = p.grp JOIN ends e ON e.row = p.row LEFT JOIN proven v ON v.row = p.row, summit"""

ORACLES = {
    "op12_merkle": _MERKLE_SQL,
    "op5_topk": """
        WITH parts AS (
            SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM parts q JOIN parts c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
