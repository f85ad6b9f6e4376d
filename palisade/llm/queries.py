"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bpe, chat, exact_search, html, jaccard, lattice, lines, merkle, near_search, packing, secrets, toxicity, treap
from palisade.llm.vocabulary import public

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), public("byte_bpe_50k.tiktoken"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"), with_ids=False)


def op4_near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return near_search.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), public("byte_bpe_50k.tiktoken"))
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"), number("random"),
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_search.top_k(rows, rows.where("vec_id % 100 = 0"), k=10, scale=1024)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    return merkle.verified(table(spark, sf_dir, "documents"), columns, "lang", "doc_id", {"n_chars": tampered})


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=50)


def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


#: SQL for the same rows, where SQL can say them within reason.
ORACLES = {
    "op10_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op11_merkle_manifest": """
        WITH RECURSIVE docs AS (SELECT *, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree,
                list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
                            lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, CAST(4294967295 AS BIGINT)) AS inverted FROM documents),
        fields AS (SELECT *, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda x: CASE WHEN x IS NULL THEN '-' ELSE CAST(octet_length(encode(x)) AS VARCHAR) || ':' || x END) AS f,
                coalesce(CAST(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) AS VARCHAR) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') AS more,
                coalesce(xor(inverted, 4294967295) % 7 = 0, false) AS tampered FROM docs),
        hashed AS (SELECT doc_id, tree, sha256(f[1] || f[2] || f[3] || f[4] || f[5]) AS leaf, sha256(f[1] || f[2] || f[3] || CASE WHEN tampered THEN more ELSE f[4] END || f[5]) AS claimed FROM fields),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
        below AS (SELECT tree, 0 AS level, place, leaf AS h, n FROM leaves
                  UNION ALL SELECT tree, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2 FROM below WHERE n > 1 GROUP BY tree, level, place // 2, n),
        subroots AS (SELECT tree, h, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM below WHERE n = 1),
        above AS (SELECT 0 AS level, place, h, n FROM subroots
                  UNION ALL SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2 FROM above WHERE n > 1 GROUP BY level, place // 2, n),
        paths AS (SELECT l.tree, l.place AS leaf_place, b.level AS step, b.place & 1 AS side, b.h FROM leaves l JOIN below b ON l.tree = b.tree AND b.n > 1 AND b.place = xor(l.place >> b.level, 1)
                  UNION ALL SELECT l.tree, l.place, s.height + a.level, a.place & 1, a.h FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN above a ON a.n > 1 AND a.place = xor(s.place >> a.level, 1)),
        proofs AS (SELECT tree, leaf_place, sha256(string_agg(h, '' ORDER BY step)) AS proof_sha256 FROM paths GROUP BY 1, 2),
        steps AS (SELECT l.tree, l.place, s.height + coalesce((SELECT max(level) FROM above), 0) AS total FROM leaves l JOIN subroots s ON l.tree = s.tree),
        climb AS (SELECT l.tree, l.place, l.claimed AS h, 0 AS step, t.total FROM leaves l JOIN steps t ON l.tree = t.tree AND l.place = t.place
                  UNION ALL SELECT c.tree, c.place, sha256(CASE WHEN p.h IS NULL THEN c.h WHEN p.side = 1 THEN c.h || p.h ELSE p.h || c.h END), c.step + 1, c.total
                  FROM climb c LEFT JOIN paths p ON c.tree = p.tree AND c.place = p.leaf_place AND c.step = p.step WHERE c.step < c.total)
        SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
        FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN (SELECT h FROM above WHERE n = 1) r ON true JOIN climb c ON l.tree = c.tree AND l.place = c.place AND c.step = c.total
        LEFT JOIN proofs p ON l.tree = p.tree AND l.place = p.leaf_place""",
    "op12_ranked_search": r"""
        WITH words AS (SELECT row_number() OVER () AS n_row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        docs AS (SELECT n_row, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0),
        stats AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM docs),
        tfs AS (SELECT n_row, doc_id, n, term, count(*) AS tf FROM (SELECT n_row, doc_id, n, unnest(ws) AS term FROM docs) GROUP BY ALL),
        weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, stats GROUP BY term, n_docs),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
        scored AS (SELECT item_id, n_row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total)))) AS BIGINT) AS score
                   FROM asked JOIN weights USING (term) JOIN tfs USING (term), stats WHERE doc_id IS NOT NULL GROUP BY 1, 2, 3)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
    # All pairs: the lattice finds nearly all of what this finds, and nothing else.
    "op13_near_dedup": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL
                   AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.n AS a, b.n AS b, a.vec_id AS a_id, b.vec_id AS b_id FROM v a JOIN v b ON a.label = b.label AND a.n <> b.n AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach AS (SELECT n, vec_id AS low FROM v UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.n),
        lows AS (SELECT n, min(low) AS low FROM reach GROUP BY n)
        SELECT e.vec_id, coalesce(k.n_links, 0) AS n_links, coalesce(k.low, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(k.low, e.vec_id), false) AS kept
        FROM embeddings e LEFT JOIN (SELECT v.vec_id, max(c.n_links) AS n_links, max(lows.low) AS low FROM v LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) c ON v.n = c.a JOIN lows ON v.n = lows.n GROUP BY v.vec_id) k ON e.vec_id = k.vec_id""",
}


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
