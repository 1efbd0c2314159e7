"""Registered queries of this subpackage, each applied to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..plans.registry import Query
from ..plans.standins import table
from . import audit, byte_bpe, decontaminate, extract, ngram_lm, pii, quality, sentence_piece, simhash, token_counts, topk, url_filter, vector_codes

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
COUNT_MODEL = "byte_bpe_50k.json"
TOKEN_LIMIT = 512

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"),
             ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_simhash(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


def _listed(spans):
    """Spans as kind:start:end, by start and then by the order of kinds."""
    order = F.array(*(F.lit(k) for k in pii.KINDS))
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"),
        s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark, d):
    """Counts and digest are of the fixed patterns; ``spans`` has what the field adds too."""
    found = pii.find(table(spark, d, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == kind)).cast("long").alias(f"n_{kind}")
              for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))


def op3_byte_bpe(spark, d):
    path = public_tokenizers.path(BYTE_RANKS)
    rows = byte_bpe.encode(table(spark, d, "documents"), path, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(rows, path, public_tokenizers.PATTERN)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
                       .alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_url_filter(spark, d):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, d, "pages"), rules)


def op5_topk(spark, d):
    return topk.top_k(table(spark, d, "embeddings"))


def op6_ngram_lm(spark, d):
    return ngram_lm.score_texts(table(spark, d, "documents"))


def op7_main_text(spark, d):
    return extract.main_text(table(spark, d, "pages"))


def op8_decontaminate(spark, d):
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op9_quality(spark, d):
    return quality.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_token_counts(spark, d):
    return token_counts.count_tokens(table(spark, d, "documents"),
                                     public_tokenizers.path(COUNT_MODEL), TOKEN_LIMIT)


def op11_filter_audit(spark, d):
    return audit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


def op12_sentence_piece(spark, d):
    path = public_tokenizers.path(PIECES)
    rows = sentence_piece.decode(sentence_piece.encode(table(spark, d, "documents"), path), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
                       .alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_vector_codes(spark, d):
    return vector_codes.compress(table(spark, d, "embeddings"))


def _codes_sql() -> str:
    """The six rounds unrolled: distances of all parts to all entries, then sums."""
    steps, near = [], """SELECT p.vec_id, p.part, arg_min(b.entry, struct_pack(d := list_sum(
                [(p.x[i] - b.x[i]) * (p.x[i] - b.x[i]) FOR i IN range(1, len(p.x) + 1)]), e := b.entry)) AS entry,
              min(list_sum([(p.x[i] - b.x[i]) * (p.x[i] - b.x[i]) FOR i IN range(1, len(p.x) + 1)])) AS d
            FROM p JOIN {0} b USING (part) GROUP BY p.vec_id, p.part"""
    for n in range(6):
        steps.append(f"""n{n} AS MATERIALIZED ({near.format(f"b{n}")}),
            s{n} AS (SELECT part, entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS v
                     FROM n{n} JOIN p USING (vec_id, part), range(1, 9) r(i) GROUP BY ALL),
            b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b{n}.x) AS x FROM b{n} LEFT JOIN
              (SELECT part, entry, list(v ORDER BY i) AS x FROM s{n} GROUP BY ALL) m USING (part, entry))""")
    return f"""WITH v AS (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)
                FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL
                  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
            p AS MATERIALIZED (SELECT vec_id, CAST(part AS INTEGER) AS part, e[part * 8 + 1:part * 8 + 8] AS x
                  FROM v, range(0, 8) r(part)),
            o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v),
            b0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN o USING (vec_id) WHERE entry < 16),
            {", ".join(steps)},
            f AS MATERIALIZED ({near.format("b6")}),
            c AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code,
                    CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY vec_id),
            h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM b6)
            SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
              h AS codebooks_sha256 FROM c JOIN v USING (vec_id), h"""


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

QUERIES = {
    "op1_simhash": Query(op1_simhash),
    "op2_pii": Query(op2_pii),
    "op3_byte_bpe": Query(op3_byte_bpe),
    "op4_url_filter": Query(
        op4_url_filter,
        f"""WITH r(h, p, v) AS (VALUES {_RULES}),
              s AS (SELECT page_id, CASE WHEN contains(url, '://')
                      THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
              u AS (SELECT page_id,
                      translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path,
                      row_number() OVER () AS n FROM s),
              f AS (SELECT n, h || p AS rule, v,
                      row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC) AS k
                    FROM u JOIN r ON (host = h OR ends_with(host, '.' || h))
                                 AND starts_with(path, p))
            SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
            FROM u LEFT JOIN f ON f.n = u.n AND k = 1"""),
    "op5_topk": Query(
        op5_topk,
        """WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)
                  FOR x IN embedding] AS e FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
              s AS (SELECT q.vec_id AS query_id, c.vec_id,
                  CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT)
                    AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
              r AS (SELECT *, row_number() OVER (
                  PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
            SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10"""),
    "op6_ngram_lm": Query(op6_ngram_lm),
    "op7_main_text": Query(op7_main_text),
    "op8_decontaminate": Query(op8_decontaminate),
    "op9_quality": Query(op9_quality),
    "op10_token_counts": Query(op10_token_counts),
    "op11_filter_audit": Query(
        op11_filter_audit,
        r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
              w AS (SELECT *, [x FOR x IN string_split_regex(t, '[ \t-\r]+') IF x <> ''] AS ws FROM d),
              e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
              l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic
                    FROM labels GROUP BY doc_id),
              m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                      CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
                      + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
                      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)
                             THEN 4 ELSE 0 END
                      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                      + CASE WHEN least < w.doc_id THEN 16 ELSE 0 END AS mask
                    FROM w JOIN e USING (t) LEFT JOIN l ON l.doc_id = w.doc_id),
              f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
              o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order,
                      [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
                    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
                      AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
              s AS (SELECT filter_order, k AS step, bits[k] AS bit,
                      CAST(list_sum([0] || bits[1:k - 1]) AS INTEGER) AS before
                    FROM o, range(1, 6) r(k)),
              g AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
              r AS (SELECT part, filter_order, step, bit,
                      sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                      sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
                      sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
                      sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                      sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND good THEN n ELSE 0 END)
                        AS good_lost,
                      sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND toxic THEN n ELSE 0 END)
                        AS toxic_lost
                    FROM g, s GROUP BY ALL)
            SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
              CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
              CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
              CAST(toxic_lost AS BIGINT) AS toxic_lost,
              CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""),
    "op12_sentence_piece": Query(op12_sentence_piece),
    "op13_vector_codes": Query(op13_vector_codes, _codes_sql()),
}
