"""Queries over the corpus tables: one for each operator, with its production parameters, over whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, line_dedup, matroska, minhash, mixing, ngram_join, packing, quality_gam, substring_dedup, token_alignment, topk, vector_codes, warc
from .common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_table(spark, sf_dir, "pages"), with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.predict(docs.select("doc_id", "text"), language_id.learn(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(matroska.media_column(_table(spark, sf_dir, "documents")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("spans", "factors")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("th")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents"))


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = quality_gam.score(docs, quality_gam.learn(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines, lines deleted (repeated runs of three lines, repeated lines of 20 words), and the SHA-256 of the text that is left."""
    out = line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_line_dedup_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op8_line_dedup, but every repeated line goes, however short its run or its document."""
    out = line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=1, width=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_files())


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(_table(spark, sf_dir, "documents"), (*tokenizer_files(), public_tokenizers.path("piece_bpe_32k.model")))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def tokenizer_files() -> tuple[str, str, str]:
    """The tokenizer, and the same vocabulary as ranks with its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


#: DuckDB's word pattern of the corpus contracts.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _components(percent: int, columns: str) -> str:
    """Documents, their shingles and the smallest id that links of Jaccard similarity reach; columns: what is made of it."""
    return rf"""
        WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT doc_id, {_WORDS} AS ws FROM d),
        sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) t(i) WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY x, y),
        link AS (SELECT x, y FROM both_ JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= {percent} * (p.n + q.n - c)),
        reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.m AS {columns}
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON r.x = d.doc_id"""


def _codes(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    """Codes of vectors: a table of the codebooks (p, e, d, x) and one of the assignments for each round."""
    nearest = """a{0} AS (SELECT i, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
            SELECT i, part.p, e, list_sum(list_transform(range(1, {1} + 1), lambda j: (v[j] - x[j]) * (v[j] - x[j])))::BIGINT AS dist FROM part JOIN b{0} b ON b.p = part.p) GROUP BY i, p)"""
    update = ", ".join(f"floor_div(sum(v[{j}])::BIGINT, count(*))" for j in range(1, width + 1))
    steps = []
    for r in range(rounds):
        steps.append(nearest.format(r, width))
        steps.append(f"b{r + 1} AS (SELECT b.p, b.e, coalesce(m, x) AS x FROM b{r} b LEFT JOIN (SELECT p, e, [{update}] AS m FROM a{r} JOIN part USING (i, p) GROUP BY p, e) USING (p, e))")
    steps.append(nearest.format(rounds, width))
    floor_div = "CASE WHEN {0} % {1} < 0 THEN {0} // {1} - 1 ELSE {0} // {1} END"
    text = re.sub(r"floor_div\((sum\(v\[\d+\]\)::BIGINT), (count\(\*\))\)", lambda m: floor_div.format(m[1], m[2]), ",\n        ".join(steps))
    return f"""
        WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        part AS MATERIALIZED (SELECT i, p, v[p * {width} + 1:p * {width} + {width}] AS v FROM kept, unnest(range(0, {parts})) t(p)),
        b0 AS (SELECT p, i AS e, v AS x FROM part WHERE i < {entries}),
        {text},
        book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
        coded AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a{rounds} GROUP BY i)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (i), book"""


ORACLE = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        g AS (SELECT h, max(page_id) AS response FROM p WHERE strlen(h) >= 1000 GROUP BY h)
        SELECT p.page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
               CASE WHEN response > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN response > p.page_id THEN response END AS refers_to
        FROM p LEFT JOIN g ON p.h = g.h""",
    "op9_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM
          (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op5_mixing": rf"""
        WITH sized AS (SELECT doc_id, source, coalesce('=' || source, '-') AS name, len({_WORDS}) AS size, md5(concat_ws(':', 'mix-1', doc_id, md5(text))) AS u FROM documents),
        src AS (SELECT name, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM sized GROUP BY name, source),
        ranked AS (SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, name) AS k FROM src),
        level AS (SELECT k, cap / w AS own, (1.5::DOUBLE * (SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                         / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM ranked),
        final AS (SELECT rate FROM level WHERE own > rate ORDER BY k LIMIT 1),
        tgt AS (SELECT *, least(cap, coalesce((SELECT rate FROM final), 0) * w) AS target FROM ranked),
        dealt AS (SELECT s.*, t.source_size, t.target, ('0x' || u[1:12])::BIGINT % (SELECT greatest(1, ceil(count(*) / 512.0)::BIGINT) FROM sized) AS shard FROM sized s JOIN tgt t USING (name)),
        party AS (SELECT name, shard, sum(size)::BIGINT AS stream, sum(size)::BIGINT * (any_value(target) / greatest(any_value(source_size), 1)) AS claim FROM dealt GROUP BY name, shard),
        quota AS (SELECT *, floor(claim / 8 + 0.5)::BIGINT AS q FROM party),
        gap AS (SELECT *, floor(sum(claim) OVER (PARTITION BY shard) / 8 + 0.5)::BIGINT - (sum(q) OVER (PARTITION BY shard))::BIGINT AS missing, sum(claim) OVER (PARTITION BY shard) AS total FROM quota),
        turn AS (SELECT name, shard, CASE WHEN missing > 0 THEN -claim / (2 * (q + j) + 1) ELSE claim / (2 * (q - j) - 1) END AS o, j, missing FROM gap, unnest(range(0, 2 + ceil(abs(missing) * claim / greatest(total, 1))::BIGINT)) t(j) WHERE missing <> 0 AND claim > 0 AND (missing > 0 OR q > j)),
        change AS (SELECT name, shard, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY o, CASE WHEN missing > 0 THEN name END, name DESC, j) AS r FROM turn) WHERE r <= abs(missing) GROUP BY name, shard),
        given AS (SELECT q.name, q.shard, q.stream, 8 * (q + sign(missing) * coalesce(c, 0))::BIGINT AS words FROM gap q LEFT JOIN change USING (name, shard)),
        placed AS (SELECT d.*, g.stream, words, words // greatest(g.stream, 1) AS around, coalesce(sum(size) OVER (PARTITION BY d.name, d.shard ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
                   FROM dealt d JOIN given g ON d.name = g.name AND d.shard = g.shard)
        SELECT doc_id, size, source_size, target, least(size * around + greatest(0, least(size, words - around * stream - before)), 2 * size)::BIGINT AS taken FROM placed""",
    "op13_vector_codes": _codes(),
    "op8_line_dedup": r"""
        WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        line AS (SELECT doc_id, pos, ls[pos + 1] AS line FROM raw, unnest(range(0, len(ls))) t(pos)),
        full_line AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM line WHERE trim(line) <> ''),
        win AS (SELECT doc_id, i, 3 AS n, pos AS s, lead(pos, 2) OVER w AS e, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS run
                FROM full_line WINDOW w AS (PARTITION BY doc_id ORDER BY i)
                UNION ALL SELECT doc_id, i, 1, pos, pos, line FROM full_line WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 20),
        later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, i) AS r FROM win WHERE e IS NOT NULL) WHERE r > 1),
        island AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id ORDER BY i, n ROWS UNBOUNDED PRECEDING) AS isle FROM
                   (SELECT *, CASE WHEN i <= max(i + n) OVER (PARTITION BY doc_id ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS apart FROM later)),
        span AS (SELECT doc_id, isle, min(s) AS s, max(e) AS e FROM island GROUP BY doc_id, isle),
        gone AS (SELECT DISTINCT doc_id, pos FROM span, unnest(range(s, e + 1)) u(pos)),
        kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
                        coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS t
                 FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
        SELECT raw.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(t) END AS kept_sha256
        FROM raw LEFT JOIN kept USING (doc_id)""",
    "op8_line_dedup_single": r"""
        WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        line AS (SELECT doc_id, pos, ls[pos + 1] AS line FROM raw, unnest(range(0, len(ls))) t(pos)),
        full_line AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM line WHERE trim(line) <> ''),
        later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS r FROM full_line) WHERE r > 1),
        island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS isle FROM later),
        span AS (SELECT doc_id, isle, min(pos) AS s, max(pos) AS e FROM island GROUP BY doc_id, isle),
        gone AS (SELECT DISTINCT doc_id, pos FROM span, unnest(range(s, e + 1)) u(pos)),
        kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
                        coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS t
                 FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
        SELECT raw.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(t) END AS kept_sha256
        FROM raw LEFT JOIN kept USING (doc_id)""",
    "op6_ngram_jaccard_join": _components(90, "component_id"),
    "op12_minhash_dedup": _components(85, "component_id, d.doc_id = r.m AS kept"),
    "op4_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM d, unnest(range(1, len(ws) - 18)) t(i)),
        ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM win),
        gone AS (SELECT DISTINCT doc_id, j FROM ranked, unnest(range(i, i + 20)) u(j) WHERE r > 1),
        word AS (SELECT doc_id, j, ws[j] AS word FROM d, unnest(range(1, len(ws) + 1)) v(j)),
        flag AS (SELECT w.doc_id, w.j, w.word, g.j IS NOT NULL AS removed FROM word w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.j = g.j),
        kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed,
                        coalesce(string_agg(CASE WHEN removed THEN NULL ELSE word END, ' ' ORDER BY j), '') AS t FROM flag GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
}
