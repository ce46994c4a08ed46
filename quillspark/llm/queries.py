"""Queries over the given tables that apply each training-data operator, as the contracts word them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_stream, chat_format, cminhash, decontaminate, fm_quality, lexical_search, line_quality, merkle_manifest, pii_sanitise
from . import secret_scan, toxicity_knn, url_filter, warc_zstd
from .common import crc_mod, digest_hex, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.filter_urls(spark, table(spark, sf_dir, "pages"), order=7, folded=False)
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge_lines(spark, table(spark, sf_dir, "documents"), copies=True).drop("text")


def op3_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = crc_mod(F.col("doc_id"), 3) != 1
    machine = fm_quality.fit(spark, docs, labels, learn)
    scored = fm_quality.score_documents(spark, docs, machine)
    held_out = F.coalesce(~learn, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat_format.digests(chat_format.format_chats(chats.unionByName(own)))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cminhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_zstd.write_archives(spark, table(spark, sf_dir, "pages"))
    return warc_zstd.read_archives(spark, archives).drop("payload", "url")


def op7_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = crc_mod(F.col("doc_id"), 5) != 0
    index = toxicity_knn.fit(spark, docs, labels, learn)
    scored = toxicity_knn.score_documents(spark, docs, index)
    held_out = F.coalesce(~learn, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents")).drop("masked")


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op11_document_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = crc_mod(F.col("doc_id"), 7) == 0
    return merkle_manifest.proofs(spark, merkle_manifest.document_leaves(table(spark, sf_dir, "documents"), tampered))


def op13_disclosure_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_sanitise.scan(spark, table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == pii_sanitise.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = digest_hex(pii_sanitise.listed(F.col("base"))).alias("base_sha256")
    return found.select("doc_id", *map(count, pii_sanitise.BASE), base, pii_sanitise.listed(F.col("spans")).alias("spans"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_markov_ratio, op2_line_frequency, op3_factorisation_machine, op4_chat_segments, op5_circulant_minhash,
        op6_warc_dictionary, op7_toxicity_neighbours, op8_simhash_windows, op9_entropy_secrets, op10_bpe_transducer,
        op11_document_trie, op12_merkle_climb, op13_disclosure_terms,
    )
}

_ESCAPED = r"regexp_replace({}, '([<\[\\])', '\1\\', 'g')"

ORACLE_SQL = {
    "op4_chat_segments": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), m AS (
  SELECT *, CASE WHEN role = 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                 WHEN role = 'assistant' THEN coalesce(before = 'user', false)
                 WHEN role = 'system' THEN before IS NULL ELSE false END AS ok
  FROM n
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>') + length(role) + 1 + length({_ESCAPED.format("text")}) + length('<|end|>') + 1)::BIGINT AS formatted_chars,
       bool_and(ok) AND max(CASE WHEN back = 1 THEN role END) = 'assistant' AS valid,
       CAST(min(i) FILTER (NOT ok) AS INTEGER) AS failed_at
FROM m GROUP BY conv_id
""",
    "op11_document_trie": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), sizes AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), asked AS (SELECT item_id, term, count(*) AS often FROM i GROUP BY ALL),
p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, sizes GROUP BY term, n_docs
), s AS (
  SELECT item_id, doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN p USING (term) JOIN w USING (term), sizes GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
""",
    "op12_merkle_climb": r"""
WITH RECURSIVE crc AS (
  SELECT DISTINCT doc_id, 4294967295::BIGINT AS c, doc_id::VARCHAR AS rest, 0 AS bits FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, CASE WHEN bits = 0 THEN xor(c, ascii(rest)::BIGINT) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END,
         CASE WHEN bits = 8 THEN rest[2:] ELSE rest END, CASE WHEN bits = 8 THEN 0 ELSE bits + 1 END
  FROM crc WHERE rest <> ''
), f AS (
  SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM crc WHERE rest = '' AND xor(c, 4294967295) % 7 = 0) AS tampered,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS own, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS other,
         coalesce(strlen(text) || ':' || text, '-') AS b
  FROM documents
), l AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, sha256(a || own || b) AS leaf,
         sha256(a || CASE WHEN tampered THEN other ELSE own END || b) AS shown
  FROM f
), placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS place FROM l),
nodes AS (
  SELECT tree, 0 AS level, place, leaf AS hash, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, up, sha256(hash || coalesce(mate, '')), (n + 1) // 2
  FROM (SELECT tree, level, place, place // 2 AS up, hash, n, lead(hash) OVER (PARTITION BY tree ORDER BY place) AS mate FROM nodes WHERE n > 1) WHERE place % 2 = 0
), roots AS (SELECT tree, hash, level FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS place, hash, count(*) OVER () AS n FROM roots
  UNION ALL
  SELECT level + 1, place // 2, sha256(hash || coalesce(mate, '')), (n + 1) // 2
  FROM (SELECT *, lead(hash) OVER (ORDER BY place) AS mate FROM tops WHERE n > 1) WHERE place % 2 = 0
), climb AS (
  SELECT doc_id, tree, leaf, place AS pos, 0 AS level, false AS top, tree AS own, place AS start, shown AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT doc_id, c.tree, leaf,
         CASE WHEN NOT top AND c.level = r.level THEN own ELSE pos // 2 END, CASE WHEN NOT top AND c.level = r.level THEN 0 ELSE c.level + 1 END,
         top OR c.level = r.level, own, start,
         CASE WHEN NOT top AND c.level = r.level THEN folded WHEN pos % 2 = 1 THEN sha256(coalesce(s.hash, t.hash, '') || folded) ELSE sha256(folded || coalesce(s.hash, t.hash, '')) END,
         CASE WHEN NOT top AND c.level = r.level THEN proof ELSE proof || coalesce(s.hash, t.hash, '') END
  FROM climb c JOIN roots r ON r.tree = c.own
  LEFT JOIN nodes s ON NOT top AND c.level < r.level AND s.tree = c.own AND s.level = c.level AND s.place = xor(pos, 1)
  LEFT JOIN tops t ON top AND t.level = c.level AND t.place = xor(pos, 1)
  WHERE NOT top OR c.level < (SELECT max(level) FROM tops)
)
SELECT doc_id, leaf, r.hash AS subroot, (SELECT hash FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = (SELECT hash FROM tops WHERE n = 1) AS verified
FROM climb c JOIN roots r ON r.tree = c.own WHERE top AND c.level = (SELECT max(level) FROM tops)
""",
}
