"""One registered query per operator, with the SQL that must give its rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.llm import (
    cap_filters, decontaminate, filter_audit, fim_frames, html_text, lattice_lm, line_dedup, packing, sentencepiece_codec, simhash,
    substring_dedup, token_counts, toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = sentencepiece_codec.load_vocabulary(pieces_file())
    return lattice_lm.lattice_scores(table(spark, sf_dir, "documents"), vocabulary, lambda i: held_out(i, 1))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left without the 13-word windows of earlier documents, and how far those windows double."""
    out = substring_dedup.repeated_words(table(spark, sf_dir, "documents"), min_words=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "longest")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = html_text.main_text(pages, html_text.fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def pieces_file() -> str:
    """The public model that the encoding and counting queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, decoded again."""
    return sentencepiece_codec.encode_texts(table(spark, sf_dir, "documents"), sentencepiece_codec.load_vocabulary(pieces_file()))


def held_out(doc_id, remainder: int):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == remainder


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), lambda i: held_out(i, 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = sentencepiece_codec.load_vocabulary(pieces_file())
    return token_counts.length_histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents"), vocabulary))


def op7_cap_filter_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"), min_cosine=0.95)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers (from zero) of the lines of each document that an earlier line repeats up to two edits."""
    out = line_dedup.removed_lines(table(spark, sf_dir, "documents"), edits=2, min_chars=20)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def tokenizer_json() -> str:
    """The public byte-level tokenizer that the packing query uses."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def op11_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    out = packing.checksums(packing.pack(table(spark, sf_dir, "documents"), tokenizer_json(), end_id=1, capacity=2048))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all their orders, for every source."""
    out = filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_fim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the fill-in-the-middle outputs and of the texts restored from them."""
    outputs = fim_frames.fill_in_middle(fim_frames.store_frames(table(spark, sf_dir, "documents")))
    return fim_frames.digests(outputs).withColumnRenamed("units", "n")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION_SQL = f"""WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
starts AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, list_slice(ws, i, i + 9) AS win FROM starts),
sizes AS (SELECT DISTINCT len(win) AS m FROM windows),
cut AS (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, sizes),
hits AS (SELECT r, i, m, item FROM (SELECT r, i, m, list_slice(ws, i, i + m - 1) AS win FROM cut) JOIN windows USING (win)),
cells AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN cells USING (r) LEFT JOIN found USING (r)"""


AUDIT_SQL = """WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(first < doc_id, false)::INT AS mask
  FROM docs JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM letters v, letters w, letters x, letters y, letters z WHERE v.b | w.b | x.b | y.b | z.b = 31),
steps AS (
  SELECT filter_order, s::INT AS step, bits[s] AS own, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS earlier
  FROM orders, range(1, 6) AS t(s)),
cells AS (
  SELECT part, filter_order, step, own, count(*) FILTER (mask & (earlier | own) = 0) AS kept,
         count(*) FILTER (mask & earlier = 0 AND mask & own > 0) AS removed,
         count(*) FILTER (mask & earlier > 0 AND mask & own > 0) AS redundant,
         count(*) FILTER (mask = own) AS unique_fails,
         count(*) FILTER (mask & earlier = 0 AND mask & own > 0 AND good = 1) AS good_lost,
         count(*) FILTER (mask & earlier = 0 AND mask & own > 0 AND toxic = 1) AS toxic_lost
  FROM failed, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM cells"""

FIM_SQL = """WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
hashes AS (
  SELECT *, ('0x' || substr(h, 1, 8))::UBIGINT % (n + 1)::UBIGINT AS c1, ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1)::UBIGINT AS c2,
         ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS c3, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS c4
  FROM docs),
cuts AS (
  SELECT doc_id, t, n, least(c1, c2)::BIGINT AS a, greatest(c1, c2)::BIGINT AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain'
              WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashes),
parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
         AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""


QUERIES = {
    "op1_lattice_scoring": (op1_lattice_scoring, None),
    "op2_substring_dedup": (op2_substring_dedup, None),
    "op3_html_extraction": (op3_html_extraction, None),
    "op4_sentencepiece": (op4_sentencepiece, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_token_counts": (op6_token_counts, None),
    "op7_cap_filter_near_dedup": (op7_cap_filter_near_dedup, None),
    "op8_simhash_near_dedup": (op8_simhash_near_dedup, None),
    "op9_line_dedup": (op9_line_dedup, None),
    "op10_benchmark_decontamination": (op10_benchmark_decontamination, DECONTAMINATION_SQL),
    "op11_cutting_stock_packing": (op11_cutting_stock_packing, None),
    "op12_filter_audit": (op12_filter_audit, AUDIT_SQL),
    "op13_fim_frames": (op13_fim_frames, FIM_SQL),
}


def queries() -> dict:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
