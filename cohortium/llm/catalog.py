"""The registered queries of the text operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (context_trees, exact_dedup, filter_audit, licenses, packing, periodic_runs, secrets, sentencepiece, sharding, simhash,
               token_counts, topk, toxicity)

SHARDS = 40
TOXIC = 0.7


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark, sf_dir):
    """Ids of every text and the text they decode to, as digests."""
    path = vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece.encode_and_decode(docs, path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_license_scan(spark, sf_dir):
    """Licence paragraphs of every document, by the trained classifier and template comparison."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.licence_scan(docs, licenses.fit(docs))


def op3_best_fit_packing(spark, sf_dir):
    """Every document's pieces and their places in sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = packing.pieces(docs, vocabulary("byte_bpe_50k.json"), keep_ids=False)
    return packing.pack(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_secret_scan(spark, sf_dir):
    """Base secrets and linked parts of credentials of every document."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", number("assign"), number("access"), number("hex"),
                        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))


def op5_token_counts(spark, sf_dir):
    """Bytes and tokens of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json"))
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > 1024).alias("over_limit"))


def op6_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, limit=4)


def op7_hilbert_sharding(spark, sf_dir):
    """Shard and slot of every document along the Hilbert curve of language, source, length and id."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    ids = sharding.quantised_ranges(docs, "doc_id")
    cells = [sharding.quantised_text("lang"), sharding.quantised_text("source"), sharding.quantised_size(F.col("size")), ids]
    placed = sharding.hilbert_shards(docs, SHARDS, cells, carry=["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op8_exact_top_k(spark, sf_dir):
    """The five best rows for every fiftieth row, by inner product of the quantised vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole_vector("embedding").alias("vector"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op9_toxicity(spark, sf_dir):
    """Toxicity score of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op10_exact_dedup(spark, sf_dir):
    """Group of equal texts of every document, and which of them stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_context_tree_scores(spark, sf_dir):
    """Probability of every text under the context trees of those that are not held out, beside add-one word shares."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = context_trees.language_scores(docs, learns=~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op12_filter_audit(spark, sf_dir):
    """What each of five filters removes in every part, for each order and step, by retraction over micro-batches."""
    counted = filter_audit.part_counters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))
    return filter_audit.interactions(counted)


def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of every text, some of which are made periodic first, and digests of all runs and of the collapsed text."""
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    none = "CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>)"
    # runs come by start, then period, so that the first of equal exponents stays
    best = F.expr(f"""aggregate(runs, {none}, (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)""")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_license_scan, op3_best_fit_packing, op4_secret_scan, op5_token_counts, op6_simhash_near_dedup,
    op7_hilbert_sharding, op8_exact_top_k, op9_toxicity, op10_exact_dedup,
    op11_context_tree_scores, op12_filter_audit, op13_periodic_runs)}

_SCORES = """SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * v.x[i])) AS BIGINT) AS score
  FROM (SELECT * FROM w WHERE vec_id % 50 = 0) q JOIN w v ON q.vec_id <> v.vec_id"""
ORACLES = {
    "op8_exact_top_k": f"""WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS ({_SCORES})
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op10_exact_dedup": """WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t""",
    "op12_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
    f AS (SELECT doc_id, part, (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask FROM w),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
    m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS n_good, sum(coalesce(toxic, 0)) AS n_toxic
      FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, mask),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
    s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, CAST(1 << (instr('ABCDE', filter_order[step]) - 1) AS INTEGER) AS bit,
        CAST(list_sum(list_transform(range(0, step), lambda i: CASE WHEN i = 0 THEN 0 ELSE 1 << (instr('ABCDE', filter_order[i]) - 1) END)) AS INTEGER) AS prior
      FROM o, (SELECT unnest(range(1, 6)) AS step))
  SELECT part, filter_order, step, CAST(sum(CASE WHEN mask & (prior | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & prior = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & prior > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & prior = 0 THEN n_good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & prior = 0 THEN n_toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
    CAST(sum(CASE WHEN mask & bit > 0 THEN n * 120 // bit_count(mask) ELSE 0 END) AS BIGINT) AS shapley
  FROM m, s GROUP BY part, filter_order, step""",
}
