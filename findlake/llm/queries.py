"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.llm import bm25, bytebpe, htmltext, huffman, langid, manifest, mixing, multiindex, packing, periodic, quality, simhash, suffixes
from findlake.llm.storage import scratch_path

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "huffman")
    huffman.write_ids(huffman.encode_documents(read(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=2, id_bytes=2), path, id_bytes=2)
    return huffman.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = packing.Capacities(tokens=4096, documents=4096, attention=4096 * 4096)
    pieces = packing.cut_pieces(read(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=1, longest=caps.tokens)
    return packing.best_fit_pack(pieces, caps).select(*packing.PIECE_COLUMNS, "sequence_id", "offset")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(read(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of the documents that nothing is learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


QUALITY_THRESHOLD = 0.3


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = quality.fit(docs, read(spark, sf_dir, "labels"), ~held_out())
    scored = quality.score(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"), "n_lines", "good_lines")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    models = langid.fit(docs, ~held_out())
    found = langid.predict(docs.select("doc_id", "text"), models)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose doc_id is divisible by 50 as a query against all documents but those of its own doc_id."""
    docs = read(spark, sf_dir, "documents")
    asked = docs.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return bm25.top_k(docs, asked, k=10, without_own=True)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a passage: repeated = it has occurred before, else its first place."""
    found = suffixes.repeated_passages(read(spark, sf_dir, "documents"))

    def marked(column: str, repeated: bool) -> Column:
        return F.transform(column, lambda s: F.struct(F.lit(repeated).alias("repeated"), s["start"].alias("start_word"), s["end"].alias("end_word")))

    spans = F.concat(marked("repeats", True), marked("firsts", False))
    return found.select("doc_id", F.inline(spans))


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by source at weights 3, 1, 2 in turn, 150 % of all words, no source above twice its own."""
    return mixing.mix_documents(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


#: The letters that tampering lower-cases.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, folded from a tampered leaf where 3 divides the crc32 of the decimal id."""
    docs = read(spark, sf_dir, "documents")
    tampered = manifest.leaf_digest(*[F.translate(c, CAPITALS, CAPITALS.lower()) if c == "text" else F.col(c) for c in manifest.LEAF_COLUMNS])
    untouched = manifest.leaf_digest(*[F.col(c) for c in manifest.LEAF_COLUMNS])
    given = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered).otherwise(untouched)
    found = manifest.document_proofs(docs, given).withColumn("folded_root", manifest.fold(F.col("given"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", manifest.sibling_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which every tenth has a planted repetition."""
    docs = read(spark, sf_dir, "documents")
    return periodic.run_digests(periodic.periodic_runs(docs.select("doc_id", periodic.planted(F.col("text"), F.col("doc_id")).alias("text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_huffman_ids, op3_quality_crf, op4_html_text, op5_language_id, op6_best_fit_packing, op7_byte_bpe, op8_multi_index, op9_bm25_top_k, op10_suffix_dedup, op11_mix_sources, op12_merkle_manifest, op13_periodic_runs)
}

#: What Python takes for white space, and for letters, digits and the underscore.
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

ORACLE_SQL: dict[str, str] = {
    "op9_bm25_top_k": r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents WHERE doc_id IS NOT NULL),
counts AS (SELECT doc_id, term, count(*) AS n FROM words GROUP BY ALL),
lengths AS (SELECT d.doc_id, coalesce(sum(c.n), 0) AS len FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN counts c USING (doc_id) GROUP BY ALL),
whole AS (SELECT count(*) AS n, avg(len) AS mean FROM lengths),
idf AS (SELECT term, ln(1 + (any_value(w.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM counts, whole w GROUP BY term),
scored AS (
    SELECT q.doc_id AS query_id, c.doc_id, round(sum(q.n * idf * c.n * 2.2 / (c.n + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
    FROM counts q JOIN counts c USING (term) JOIN idf USING (term) JOIN lengths l ON l.doc_id = c.doc_id, whole
    WHERE q.doc_id % 50 = 0 AND q.doc_id <> c.doc_id GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT query_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op10_suffix_dedup": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(text, '[^SPACE]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS pos FROM docs WHERE len(w) >= 50),
hashed AS (SELECT doc_id, pos, md5(array_to_string(w[pos + 1 : pos + 50], ' ')) AS key FROM starts),
placed AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1 AS repeated, count(*) OVER (PARTITION BY key) AS n FROM hashed),
runs AS (SELECT *, CASE WHEN pos <= lag(pos) OVER s + 50 THEN 0 ELSE 1 END AS new FROM placed WHERE n > 1 WINDOW s AS (PARTITION BY doc_id, repeated ORDER BY pos)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, repeated ORDER BY pos) AS run FROM runs)
SELECT doc_id, repeated, min(pos)::INT AS start_word, (max(pos) + 50)::INT AS end_word FROM numbered GROUP BY doc_id, repeated, run""".replace("SPACE", _SPACE),
    "op11_mix_sources": r"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS t, text,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS shown, string_split(text, chr(10)) AS lines FROM documents),
weighed AS (
    SELECT doc_id, source, size, greatest(0.05::DOUBLE, coalesce(letters::DOUBLE / nullif(shown, 0) * len(list_distinct(lines)) / len(lines), 0)) AS weight, md5(text) AS tie FROM d),
keyed AS (
    SELECT *, -ln((('0x' || substr(md5('mix|=' || doc_id || '|' || coalesce('=' || tie, '-')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE) / weight AS key FROM weighed),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, CASE row_number() OVER (ORDER BY source NULLS LAST) % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS w FROM weighed GROUP BY source),
steep AS (
    SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER lower_ones, 0)) / sum(w) OVER rest AS level FROM sources
    WINDOW lower_ones AS (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
-- the first source in order of steepness that its share does not fill sets the level
settled AS (SELECT min_by(level, 2.0 * source_size / w) AS level FROM steep WHERE level * w <= 2 * source_size),
wanted AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT level FROM settled) * w)::DOUBLE AS target FROM sources),
placed AS (
    SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
        coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM keyed k JOIN wanted w ON k.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, source, size::BIGINT AS size, weight, source_size, target, epochs, (epochs * size + least(size, greatest(0, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken FROM placed""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE parts AS (
    SELECT doc_id, lang, text, unnest([false, true]) AS low, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
    FROM documents),
hashed AS (SELECT doc_id, lang, low, sha256(head || coalesce(strlen(text) || ':' || CASE WHEN low THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS leaf FROM parts),
bits AS (SELECT doc_id, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS inverted FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
leaves AS (
    SELECT h.doc_id, h.lang, h.leaf, CASE WHEN (4294967295 - inverted) % 3 = 0 THEN o.leaf ELSE h.leaf END AS given, row_number() OVER (PARTITION BY h.lang ORDER BY h.doc_id, h.leaf) - 1 AS pos
    FROM hashed h JOIN hashed o ON h.doc_id = o.doc_id AND h.lang IS NOT DISTINCT FROM o.lang AND o.low JOIN bits b ON b.doc_id = h.doc_id WHERE NOT h.low),
nodes AS (
    SELECT lang, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
    UNION ALL
    SELECT lang, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n),
subroots AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS level, pos, digest, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
runs AS (SELECT lang, level, pos // 8 AS run, list(digest ORDER BY pos) AS digests FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, pos // 8 AS run, list(digest ORDER BY pos) AS digests FROM tops WHERE n > 1 GROUP BY ALL),
climb AS (
    SELECT doc_id, lang, leaf, 0 AS level, pos, given AS digest, '' AS siblings FROM leaves
    UNION ALL
    SELECT doc_id, c.lang, leaf, c.level + 1, pos // 8, sha256(array_to_string(digests[:pos % 8], '') || digest || array_to_string(digests[pos % 8 + 2:], '')), siblings || array_to_string(digests[:pos % 8], '') || array_to_string(digests[pos % 8 + 2:], '')
    FROM climb c JOIN runs r ON c.lang IS NOT DISTINCT FROM r.lang AND c.level = r.level AND c.pos // 8 = r.run),
at_subroot AS (SELECT c.*, s.pos AS place, s.digest AS subroot FROM climb c JOIN subroots s ON c.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT lang, max(level) AS level FROM nodes GROUP BY lang) m ON c.lang IS NOT DISTINCT FROM m.lang AND c.level = m.level),
up AS (
    SELECT doc_id, lang, leaf, subroot, 0 AS level, place AS pos, digest, siblings FROM at_subroot
    UNION ALL
    SELECT doc_id, lang, leaf, subroot, u.level + 1, pos // 8, sha256(array_to_string(digests[:pos % 8], '') || digest || array_to_string(digests[pos % 8 + 2:], '')), siblings || array_to_string(digests[:pos % 8], '') || array_to_string(digests[pos % 8 + 2:], '')
    FROM up u JOIN top_runs r ON u.level = r.level AND u.pos // 8 = r.run),
whole AS (SELECT max(level) AS level, arg_max(digest, level) AS root FROM tops)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, digest AS folded_root, digest = root AS verified FROM up, whole WHERE up.level = whole.level""",
}
