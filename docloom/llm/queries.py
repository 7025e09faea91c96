"""Registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import binary, bpe, exact, filter_audit, html_extract, html_pages, infill, jaccard, packing, quality, quality_rules, secrets, substrings, topk
from docloom.plans.base import Registry, Tables

R = Registry()

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@R.query("op6_exact_dedup", oracle=f"""
    WITH d AS (SELECT doc_id, {LOWERED} AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""")
def op6(t: Tables) -> DataFrame:
    return exact.exact_groups(t.documents)


@R.query("op2_secret_scan")
def op2(t: Tables) -> DataFrame:
    found = secrets.scan(t.documents, secrets.train(secrets.samples_from(t.documents)))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), count(3), F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


@R.query("op9_byte_bpe")
def op9(t: Tables) -> DataFrame:
    return bpe.round_trip(t.documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


@R.query("op10_id_planes")
def op10(t: Tables) -> DataFrame:
    folder = binary.write_ids(t.documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2, added=True)
    return binary.read_ids(t.spark, folder, digests=True)


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.PATTERN, added=True))


@R.query("op5_best_fit_packing")
def op5(t: Tables) -> DataFrame:
    return packed(t.documents)


@R.query("op3_quality")
def op3(t: Tables) -> DataFrame:
    scored = quality.score(t.documents, quality.fit(t.documents, t.labels))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@R.query("op8_jaccard_join")
def op8(t: Tables) -> DataFrame:
    return jaccard.similar_groups(t.documents)


@R.query("op7_exact_top_k", oracle="""
    WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op7(t: Tables) -> DataFrame:
    return topk.search(t.embeddings, t.embeddings.where("vec_id % 50 = 0"))


@R.query("op4_substring_dedup")
def op4(t: Tables) -> DataFrame:
    return substrings.without_repeats(t.documents, digests=True)


TRAINING_PAGES = 600


@functools.cache
def html_model() -> dict:
    """The model of the registered query, trained once per driver."""
    return html_extract.train(html_pages.training_pages(TRAINING_PAGES))


@R.query("op1_html_extract")
def op1(t: Tables) -> DataFrame:
    texts = html_extract.extract(t.pages, html_model())
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@R.query("op11_quality_rules")
def op11(t: Tables) -> DataFrame:
    judged = quality_rules.judge(t.documents, quality_rules.fit(t.documents, t.labels, every=True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@R.query("op12_filter_audit", oracle=r"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    f AS (SELECT doc_id, part, CAST(len(ws) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INTEGER)
          + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INTEGER)
          + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INTEGER) AS sig FROM w),
    l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
    cells AS (SELECT part, sig, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, sig),
    letters(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    orders AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits
               FROM letters p JOIN letters q ON q.b <> p.b JOIN letters r ON r.b NOT IN (p.b, q.b) JOIN letters s ON s.b NOT IN (p.b, q.b, r.b)
               JOIN letters u ON u.b NOT IN (p.b, q.b, r.b, s.b)),
    steps AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INTEGER) AS before FROM orders, unnest(range(1, 6)) AS k(i)),
    found AS (SELECT part, filter_order, step, bit, sum(CASE WHEN sig & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
              sum(CASE WHEN sig & bit <> 0 AND sig & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN sig & bit <> 0 AND sig & before <> 0 THEN n ELSE 0 END) AS redundant,
              sum(CASE WHEN sig = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN sig & bit <> 0 AND sig & before = 0 THEN good ELSE 0 END) AS good_lost,
              sum(CASE WHEN sig & bit <> 0 AND sig & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM cells, steps GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM found""")
def op12(t: Tables) -> DataFrame:
    return filter_audit.audit(t.documents, t.labels)


@R.query("op13_fill_in_middle", oracle="""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
    e AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
          CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
    c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
          CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
    p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(t) AS restored_sha256 FROM p""")
def op13(t: Tables) -> DataFrame:
    cut = infill.transform(t.documents)
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
