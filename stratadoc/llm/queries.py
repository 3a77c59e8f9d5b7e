"""The registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratadoc.llm.knn_perm import most_similar, neighbour_pairs
from stratadoc.llm.leak_search import leaks
from stratadoc.llm.neardup import LOOSE, THRESHOLD, NearDuplicates
from stratadoc.llm.packing import pack
from stratadoc.llm.page_repair import PageRepair
from stratadoc.llm.pair_defects import defective_pairs
from stratadoc.llm.reading_level import reading_bands, train
from stratadoc.llm.segment import split_oversized
from stratadoc.session import table


def p1_found(spark, sf_dir):
    return NearDuplicates(table(spark, sf_dir, "chunks"), threshold=LOOSE, exact=THRESHOLD).pairs().select("id_a", "id_b")


def p1_groups(spark, sf_dir):
    return NearDuplicates(table(spark, sf_dir, "chunks")).groups()


def p2_nearest(spark, sf_dir):
    return most_similar(table(spark, sf_dir, "chunks"))


def p2_found(spark, sf_dir):
    return neighbour_pairs(p2_nearest(spark, sf_dir))


def p3_split(spark, sf_dir):
    return split_oversized(table(spark, sf_dir, "blocks"))


def p3_found(spark, sf_dir):
    return p3_split(spark, sf_dir).filter(F.col("piece_index") == 1).select("block_id")


def p4_found(spark, sf_dir):
    return defective_pairs(table(spark, sf_dir, "query_log"))


def p5_found(spark, sf_dir):
    return PageRepair(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "chunks")).noise()


def p5_paragraphs(spark, sf_dir):
    return PageRepair(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "chunks")).continuous()


def p5_labels(spark, sf_dir):
    return PageRepair(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "chunks")).labels()


def p6_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def p7_found(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_prompts"))


def p8_found(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return reading_bands(documents, train(documents, table(spark, sf_dir, "level_labels")))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_nearest, p3_found, p3_split, p4_found, p5_found, p5_labels, p5_paragraphs, p6_pack, p7_found, p8_found)}

ORACLES = {
    "p1_found": r"""
        WITH t AS (SELECT id, min(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY id),
        w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t),
        s AS (SELECT DISTINCT id, array_to_string(w[k : k + 2], ' ') AS s
              FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM w WHERE len(w) >= 3)),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c
              FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
        SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.5 * (x.n + y.n - c)
    """,
    "p3_found": r"""
        SELECT block_id FROM blocks
        WHERE lower(regexp_replace(kind, '^\s+|\s+$', '', 'g')) = 'body'
          AND len(regexp_extract_all(text, '[^ \t\r\n]+')) > 220
    """,
    "p7_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents),
        i AS (SELECT n, regexp_extract_all(lower(part), '[\p{L}\p{Nd}]+') AS w
              FROM (SELECT n, unnest([prompt, reference_answer]) AS part FROM eval_prompts)),
        dr AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS run
               FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
        ir AS (SELECT DISTINCT n, array_to_string(w[k : k + 11], ' ') AS run
               FROM (SELECT n, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
        SELECT DISTINCT doc_id, n FROM dr JOIN ir USING (run)
    """,
}
