"""Registry of the queries over the engine's own operators, with the SQL they must agree with.

Every query reads its whole tables. Search queries take as their queries every row whose key is divisible
by 50, against all rows; ``knn_topk``, ``knn_filtered``, ``knn_cutoff`` and ``rrf_fuse`` take the one or two
vectors their SQL names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.functions import sections, text
from stratadoc.operators import answers, catalogue_views, cells, context, evaluation, extract, ordered, search, upkeep, usage
from stratadoc.plans import section_sql as sql
from stratadoc.session import Packed, cut, release, squeezed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: White space of a text's words, for SQL.
BLANKS = r"[\s\x{85}\x{1c}-\x{1f}\p{Z}]+"
#: Chunks with each id once.
ONE_CHUNK = "(SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS n FROM chunks) WHERE n = 1)"


def query(text_of: str | None = None):
    """Register a query, and the SQL for it if there is any."""
    def register(f):
        QUERIES[f.__name__] = f
        if text_of:
            ORACLES[f.__name__] = text_of
        return f

    return register


def chunks_once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The chunk table with each id once, the first loaded."""
    rows = table(spark, sf_dir, "chunks").select("id", *columns, "ingested_at")
    return ordered.first_rows(rows, ["id"], ["ingested_at"]).drop("ingested_at")


# Vector search


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


def _distance_to(vec_id: int) -> str:
    return f"list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec_id})) ** 2"


@query(f"SELECT vec_id, round({_distance_to(0)}, 6) AS distance FROM embeddings ORDER BY {_distance_to(0)}, vec_id LIMIT 10")
def knn_topk(spark, sf_dir):
    near = search.nearest(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 10)
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round({_distance_to(0)}, 6) AS distance FROM embeddings WHERE label = 3 ORDER BY {_distance_to(0)}, vec_id LIMIT 10")
def knn_filtered(spark, sf_dir):
    rows = search.facet_filter(table(spark, sf_dir, "embeddings"), label=3)
    return search.nearest(rows, _vector(spark, sf_dir, 0), 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT * FROM (SELECT vec_id, round({_distance_to(0)}, 6) AS distance FROM embeddings ORDER BY {_distance_to(0)}, vec_id LIMIT 30) WHERE distance <= 1.45")
def knn_cutoff(spark, sf_dir):
    near = search.nearest(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 30, most=1.45)
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


@query("""
    SELECT query_id, vec_id, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (
            SELECT q.vec_id AS query_id, e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2 AS d
            FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 5
""")
def knn_batch_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    near = search.nearest_to_each(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)
    return near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query()
def knn_cells_topk(spark, sf_dir):
    """The same by the approximate index, over the chunks' vectors."""
    rows = chunks_once(spark, sf_dir, "vector", "chunk_index")
    index = cells.CellIndex(rows)
    return index.search(rows.filter(F.col("chunk_index") % 50 == 0), 5).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


# Full text


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_POSTINGS = f"""
    w AS (SELECT id, {_WORDS} AS w FROM {ONE_CHUNK} WHERE text IS NOT NULL),
    p AS (SELECT term, id, any_value(length) AS length, count(*) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS term FROM w) GROUP BY term, id)
"""


@query(f"WITH {_POSTINGS} SELECT term, count(*) AS texts, CAST(sum(tf) AS BIGINT) AS times FROM p GROUP BY term")
def text_index(spark, sf_dir):
    index = search.postings(chunks_once(spark, sf_dir, "text"), "id", "text")
    return index.groupBy("term").agg(F.count("*").alias("texts"), F.sum("tf").alias("times"))


@query(f"""
    WITH {_POSTINGS},
    s AS (SELECT count(*) AS texts, avg(length) AS mean FROM (SELECT DISTINCT id, length FROM p)),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT DISTINCT n AS query_id, unnest(regexp_extract_all(lower(prompt), '[a-z0-9]+')) AS term FROM eval_prompts WHERE n % 50 = 0),
    r AS (SELECT query_id, id, round(sum(ln(1 + (texts - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
          FROM q JOIN p USING (term) JOIN d USING (term) CROSS JOIN s GROUP BY query_id, id)
    SELECT query_id, id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 10
""")
def bm25_topk(spark, sf_dir):
    index = search.postings(chunks_once(spark, sf_dir, "text"), "id", "text")
    asked = table(spark, sf_dir, "eval_prompts").filter(F.col("n") % 50 == 0)
    found = search.bm25(index, asked, "id", 10, "n", "prompt")
    return found.select("query_id", "id", F.round("score", 4).alias("score"), "rank")


# Fusion


def _list(spark, sf_dir, list_id: int, vec_id: int, weight: float, **wanted) -> DataFrame:
    rows = search.facet_filter(table(spark, sf_dir, "embeddings"), **wanted)
    near = search.nearest(rows, _vector(spark, sf_dir, vec_id), 90)
    numbered = near.groupBy().agg(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))).alias("l")).select(F.posexplode("l").alias("rank", "x"))
    return numbered.select("rank", F.col("x.vec_id").alias("vec_id"), F.round("x.distance", 6).alias("distance"), F.lit(list_id).alias("list_id"), F.lit(weight).alias("weight"))


def _list_sql(list_id: int, vec_id: int, weight: float, where: str = "TRUE") -> str:
    d = _distance_to(vec_id)
    return f"SELECT {list_id} AS list_id, CAST({weight} AS DOUBLE) AS weight, vec_id, round({d}, 6) AS distance, row_number() OVER (ORDER BY {d}, vec_id) - 1 AS rank FROM embeddings WHERE {where} QUALIFY rank < 90"


@query(f"""
    WITH l AS ({_list_sql(0, 0, 1.0)} UNION ALL {_list_sql(1, 1, 1.0)} UNION ALL {_list_sql(2, 0, 0.5, "label = 3")}),
    m AS (SELECT vec_id, round(sum(weight / (rank + 60)), 12) AS score, arg_max(distance, list_id) AS distance,
                 min(list_id * 1000 + rank) AS first FROM l GROUP BY vec_id)
    SELECT vec_id, round(score, 9) AS score, distance FROM m ORDER BY m.score DESC, first, vec_id LIMIT 30
""")
def rrf_fuse(spark, sf_dir):
    lists = _list(spark, sf_dir, 0, 0, 1.0).unionByName(_list(spark, sf_dir, 1, 1, 1.0)).unionByName(_list(spark, sf_dir, 2, 0, 0.5, label=3))
    return search.fused(lists, "vec_id", 30).select("vec_id", F.round("score", 9).alias("score"), "distance")


_ASKED = f"""
    c AS {ONE_CHUNK},
    q AS (SELECT id AS query_id, vector, 'What does ' || coalesce(agency, '') || ' say of 1926.5' || page || ' ' || coalesce(array_to_string(regexp_split_to_array(text, ' ')[1:6], ' '), '') AS query,
                 CASE WHEN chunk_index % 100 = 0 THEN coalesce(agency, '') ELSE '' END AS filter_agency, CASE WHEN chunk_index % 150 = 0 THEN coalesce(state, '') ELSE '' END AS filter_state
          FROM c WHERE chunk_index % 50 = 0)"""
_WITHIN = "(filter_agency = '' OR filter_agency = agency) AND (filter_state = '' OR filter_state = state)"


@query(f"""
    WITH {_ASKED}, {_POSTINGS},
    s AS (SELECT count(*) AS texts, avg(length) AS mean FROM (SELECT DISTINCT id, length FROM p)),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    a AS (SELECT DISTINCT query_id, filter_agency, filter_state, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM q WHERE regexp_matches(query, '{text.SECTION_IN_QUERY}')),
    t AS (SELECT query_id, id, round(sum(ln(1 + (texts - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
          FROM a JOIN p USING (term) JOIN d USING (term) CROSS JOIN s JOIN c USING (id) WHERE {_WITHIN} GROUP BY query_id, id),
    b AS (SELECT * FROM (SELECT query_id, vector, CASE {" ".join(f"WHEN contains(upper(query), '{t}') THEN '{a}'" for t, a in text.AGENCY_TERMS.items())} END AS filter_agency, filter_state FROM q WHERE filter_agency = '' AND filter_state = '') WHERE filter_agency IS NOT NULL),
    v AS (SELECT 0 AS list_id, 1.0::DOUBLE AS weight, query_id, vector, filter_agency, filter_state FROM q UNION ALL SELECT 2, 0.5, query_id, vector, filter_agency, filter_state FROM b),
    n AS (SELECT list_id, weight, query_id, id, list_distance(v.vector::DOUBLE[], c.vector::DOUBLE[]) ** 2 AS distance FROM v JOIN c ON len(v.vector) = len(c.vector) AND {_WITHIN}),
    l AS (SELECT list_id, weight, query_id, id, distance, row_number() OVER (PARTITION BY query_id, list_id ORDER BY distance, id) - 1 AS rank FROM n QUALIFY rank < 90
          UNION ALL SELECT 1, 1.0, query_id, id, -1.0, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM t QUALIFY rank < 90),
    m AS (SELECT query_id, id, round(sum(weight / (rank + 60)), 12) AS score, arg_max(distance, list_id) AS distance, min(list_id * 1000 + rank) AS first FROM l GROUP BY query_id, id)
    SELECT query_id, id, round(score, 9) AS score, round(distance, 4) AS distance, CAST(place AS INTEGER) AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m.score DESC, first, id) - 1 AS place FROM m) WHERE place < 30
""")
def hybrid_lists(spark, sf_dir):
    """The three lists and their fusion for every chunk whose index is divisible by 50, some within facets, by the vectors of the table."""
    rows = table(spark, sf_dir, "chunks").select("id", "text", "vector", *search.FACETS, "page", "chunk_index", "ingested_at")
    once = ordered.first_rows(squeezed(rows, "vector"), ["id"], ["ingested_at"]).drop("ingested_at")
    packed = Packed(once, vector="vector", number=rows.schema["vector"].dataType.elementType)
    release(packed.batches)
    chunks = packed.rows()
    begin = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    said = F.concat(F.lit("What does "), F.coalesce("agency", F.lit("")), F.lit(" say of 1926.5"), F.col("page").cast("string"), F.lit(" "), F.coalesce(begin, F.lit("")))
    facet = {"agency": F.when(F.col("chunk_index") % 100 == 0, F.coalesce("agency", F.lit(""))).otherwise(""), "state": F.when(F.col("chunk_index") % 150 == 0, F.coalesce("state", F.lit(""))).otherwise("")}
    asked = chunks.filter(F.col("chunk_index") % 50 == 0).select(F.col("id").alias("query_id"), said.alias("query"), "vector", *(facet.get(f, F.lit("")).alias(f"filter_{f}") for f in search.FACETS))
    best = search.fused(search.ranked_lists(packed, cut(asked), search.POOL * search.OVERFETCH), "id", search.POOL, ["query_id"])
    return best.select("query_id", "id", F.round("score", 9).alias("score"), F.round("distance", 4).alias("distance"), "place")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of queries through the whole of retrieval."""
    return hybrid_context(spark, sf_dir)


def _batch(spark, sf_dir) -> tuple[Packed, DataFrame]:
    chunks = chunks_once(spark, sf_dir, "text", "source_file", "agency", "jurisdiction", "state", "locality", "section", "llm_corrected_section", "doc_page", "page", "chunk_index", "file_link")
    asked = table(spark, sf_dir, "query_log").filter(F.col("log_id") % 50 == 0).select(F.col("log_id").alias("query_id"), "query", *(F.lit("").alias(f"filter_{f}") for f in search.FACETS))
    packed = Packed(search.embedded(chunks, "text"))
    release(packed.batches)
    return packed, cut(search.embedded(asked, "query"))


@query()
def hybrid_context(spark, sf_dir):
    """Retrieval, expansion, grouping and the stand-in answer of every fiftieth logged query."""
    chunks, asked = _batch(spark, sf_dir)
    hits = cut(search.retrieve(chunks, asked, most=2.0).withColumn("place", F.col("rerank_place")))
    sources = cut(context.grouped(context.expanded(hits, chunks.rows("source_file", "section", "chunk_index", "text"))))
    line = search.extractive_answer(F.col("context"), F.col("idx"))
    answer = sources.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"))
    return context.prompts(sources).join(answer, "query_id")


# Text


_STRIP = rf"^{BLANKS}|{BLANKS}$"


@query("""
    SELECT block_id, round_even(coalesce((len(text) - len(replace(replace(text, '.', ''), '…', ''))) / nullif(len(text), 0), 0), 3) AS ratio,
           coalesce((len(text) - len(replace(replace(text, '.', ''), '…', ''))) / nullif(len(text), 0), 0) > 0.15 AS toc FROM blocks
""")
def toc_ratio(spark, sf_dir):
    ratio = text.toc_ratio(F.col("text"))
    return table(spark, sf_dir, "blocks").select("block_id", F.bround(ratio, 3).alias("ratio"), (ratio > text.TOC_SHARE).alias("toc"))


@query(rf"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\f', '', 'g'), '\r\n?', chr(10), 'g'),
        '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '{_STRIP}', '', 'g') AS text FROM documents
""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_page_text(F.col("text")).alias("text"))


@query(rf"SELECT log_id, regexp_replace(regexp_replace(response, '(?s)<think>.*?</think>', '', 'g'), '{_STRIP}', '', 'g') AS response FROM query_log")
def strip_think(spark, sf_dir):
    return table(spark, sf_dir, "query_log").select("log_id", text.strip_thinking(F.col("response")).alias("response"))


@query(rf"""
    SELECT log_id, CASE WHEN regexp_matches(response, '\^\^\^[0-9]+\^\^\^') AND contains(response, '^^^FAIL^^^') THEN
        regexp_replace(replace(regexp_replace(regexp_replace(response, '(?s)\n*The provided standards do not address[^\n]*\n?.*?\^\^\^FAIL\^\^\^', '', 'g'), '{_STRIP}', '', 'g'), '^^^FAIL^^^', ''), '{_STRIP}', '', 'g')
        ELSE response END AS response FROM query_log
""")
def strip_fail(spark, sf_dir):
    return table(spark, sf_dir, "query_log").select("log_id", text.strip_spurious_fail(F.col("response")).alias("response"))


_AGENCY_CASE = " ".join(f"WHEN contains(upper(query), '{t}') THEN '{a}'" for t, a in text.AGENCY_TERMS.items())


@query(rf"SELECT log_id, regexp_matches(query, '{text.SECTION_IN_QUERY}') AS has_section, CASE {_AGENCY_CASE} END AS agency FROM query_log")
def query_intent(spark, sf_dir):
    asked = F.col("query")
    return table(spark, sf_dir, "query_log").select("log_id", text.has_section_number(asked).alias("has_section"), text.agency_of_query(asked).alias("agency"))


@query(r"""
    SELECT block_id, coalesce(nullif(regexp_extract(t, '(?i)page\s+([ivxlcdm]+|\d{1,4}(?:-\d{1,4})?)', 1), ''),
        CASE WHEN p <> '' AND CAST(split_part(p, '-', 1) AS INT) < 5000 AND CAST(split_part(p, '-', 2) AS INT) < 5000 THEN p END,
        CASE WHEN regexp_full_match(t, '\d{1,4}') AND NOT coalesce(TRY_CAST(t AS INT), 0) BETWEEN 1900 AND 2099 THEN t END, '') AS doc_page
    FROM (SELECT block_id, trim(text) AS t, regexp_extract(trim(text), '\b(\d{1,4}-\d{1,4})\b', 1) AS p FROM blocks WHERE lower(trim(kind)) IN ('header', 'footer'))
""")
def printed_pages(spark, sf_dir):
    furniture = table(spark, sf_dir, "blocks").filter(F.lower(F.trim("kind")).isin("header", "footer"))
    return furniture.select("block_id", text.printed_page(F.col("text")).alias("doc_page"))


@query(rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    f AS (SELECT doc_id, min(pos) AS pos, arg_min(line, pos) AS line FROM l GROUP BY doc_id, regexp_replace(line, '{_STRIP}', '', 'g'))
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM f GROUP BY doc_id
""")
def line_dedupe(spark, sf_dir):
    return ordered.distinct_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(rf"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{BLANKS}'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, CAST(k AS INTEGER) AS "window", array_to_string(w[170 * k + 1 : 170 * k + 220], ' ') AS piece
    FROM (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil((len(w) - 50) / 170.0) AS BIGINT), 1))) AS k FROM w WHERE len(w) > 0)
""")
def word_windows(spark, sf_dir):
    return ordered.word_windows(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
    SELECT id, regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(regexp_split_to_array(text, '{BLANKS}'), lambda x: x <> '')[1:250], ' '),
        '[.…]{{3,}}', ' ', 'g'), '[ \t]+', ' ', 'g'), '{_STRIP}', '', 'g') AS input FROM {ONE_CHUNK}
""")
def embedding_inputs(spark, sf_dir):
    return chunks_once(spark, sf_dir, "text").select("id", text.embedding_input(F.col("text")).alias("input"))


@query(f"SELECT id, source_file || '__p' || page || '__c' || chunk_index AS made FROM {ONE_CHUNK}")
def chunk_ids(spark, sf_dir):
    rows = chunks_once(spark, sf_dir, "source_file", "page", "chunk_index")
    return rows.select("id", text.chunk_id(F.col("source_file"), F.col("page").cast("string"), F.col("chunk_index").cast("string")).alias("made"))


# Sections


@query(f"""
    WITH c AS {ONE_CHUNK}, f AS (SELECT id, n AS section, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM ({sql.numbers('c', 'text')}) WHERE {sql.STRICT})
    SELECT id, section, string_agg({sql.kind('x')} || ' ' || {sql.value('x')} || ' ' || x, ';' ORDER BY i) AS segments FROM f GROUP BY id, section
""")
def section_candidates(spark, sf_dir):
    rows = chunks_once(spark, sf_dir, "text")
    found = rows.select("id", sections.candidate(F.col("text")).alias("section")).filter("section is not null")
    shown = F.transform(sections.segments_of(F.col("section")), lambda x: F.concat_ws(" ", x["type"], x["int_val"].cast("string"), x["raw"]))
    return found.withColumn("segments", F.array_join(shown, ";"))


_HEADS = f"""
    h AS (SELECT block_id, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: {sql.strip('x')}), lambda x: x <> '') AS l FROM blocks WHERE lower(trim(kind)) = 'heading'),
    u AS (SELECT block_id, unnest(l[1:5]) AS line, generate_subscripts(l[1:5], 1) AS i FROM h),
    m AS (SELECT block_id, min_by(n, i) AS n FROM ({sql.numbers('u', 'line')}) WHERE n <> '' AND {sql.COMMON} GROUP BY block_id),
    k AS (SELECT block_id, min_by(k, i) AS k FROM (SELECT block_id, i, regexp_extract(line, '{sql.KEYWORD}', 1) AS k FROM u) WHERE k <> '' GROUP BY block_id),
    heads AS (SELECT block_id, CASE WHEN l IS NOT NULL THEN coalesce(n, k, nullif(regexp_replace(l[1][1:50], '[.:;,\\- ]+$', ''), ''), 'UNKNOWN') END AS label FROM h LEFT JOIN m USING (block_id) LEFT JOIN k USING (block_id))"""


@query(f"WITH {_HEADS} SELECT * FROM heads")
def heading_labels(spark, sf_dir):
    heads = table(spark, sf_dir, "blocks").filter(F.lower(F.trim("kind")) == "heading")
    return heads.select("block_id", sections.heading_label(F.col("text")).alias("label"))


_NEW = f"list_transform(s, lambda x: struct_pack(v := lower(regexp_replace(x, '[()\\[\\].-]', '', 'g')), n := {sql.value('x')}, plain := x[1:1] NOT IN ('(', '[', '-'), raw := x))"
_COMMON_PART = "coalesce(list_min(list_filter(range(1, least(len(now), len(o.s)) + 1), lambda i: now[i].v <> o.s[i].v)) - 1, least(len(now), len(o.s)))"
_RISES = "o.s[{0}].n - now[{0}].n BETWEEN 1 AND 20"
_FOLLOWS = f"""CASE WHEN now IS NULL THEN NOT (len(o.s) = 2 AND o.s[1].n < 100 AND len(list_filter(o.s, lambda x: NOT x.plain)) = 0)
    WHEN len(o.s) > len(now) THEN {_COMMON_PART} = len(now) AND o.s[len(now) + 1].n <= 5
    WHEN len(o.s) = len(now) AND len(now) > 1 AND {_COMMON_PART} = len(now) - 2 THEN {_RISES.format('len(now) - 1')}
    ELSE {_COMMON_PART} >= len(o.s) - 1 AND {_RISES.format('len(o.s)')} END"""


@query(f"""
    WITH RECURSIVE c AS {ONE_CHUNK},
    l AS (SELECT id, regexp_split_to_array({sql.strip('text')}, '\\r\\n|\\r|\\n')[1:10] AS l FROM c),
    u AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM l),
    o AS (SELECT id, list(struct_pack(line := i, s := {_NEW}) ORDER BY i) AS options FROM ({sql.numbers('u', 'line')}) WHERE {sql.STRICT} GROUP BY id),
    r AS (SELECT source_file, chunk_index, options, row_number() OVER (PARTITION BY source_file ORDER BY chunk_index) AS r FROM c LEFT JOIN o USING (id)),
    t AS (SELECT source_file, chunk_index, r, list_filter(options, lambda o: o.line < 2 OR NOT (len(o.s) = 2 AND o.s[1].n < 100 AND len(list_filter(o.s, lambda x: NOT x.plain)) = 0))[1].s AS now FROM r WHERE r = 1
          UNION ALL SELECT r.source_file, r.chunk_index, r.r, coalesce(list_filter(r.options, lambda o: o.line < 2 OR {_FOLLOWS})[1].s, t.now) FROM t JOIN r ON r.source_file = t.source_file AND r.r = t.r + 1)
    SELECT source_file, chunk_index, coalesce(array_to_string(list_transform(now, lambda x: x.raw), ''), 'UNKNOWN') AS section FROM t
""")
def section_tracker(spark, sf_dir):
    return ordered.tracked_sections(chunks_once(spark, sf_dir, "source_file", "chunk_index", "text"), "source_file", "chunk_index", "text")


_FILL = "coalesce(last_value(nullif({0}, 'UNKNOWN') IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY chunk_index, id ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS {0}"


@query(f"SELECT id, {_FILL.format('section')}, {_FILL.format('doc_page')} FROM {ONE_CHUNK}")
def forward_fill(spark, sf_dir):
    rows = chunks_once(spark, sf_dir, "source_file", "chunk_index", "section", "doc_page")
    return ordered.forward_fill(rows, "source_file", "chunk_index", ["section", "doc_page"], ["id"]).select("id", "section", "doc_page")


# Extraction and chunking


@query(r"""
    WITH s AS (SELECT source_file, page, quantile_cont(font_size, 0.5) AS page_size FROM blocks WHERE font_size > 0 GROUP BY ALL),
    b AS (SELECT b.*, coalesce(page_size, 12.0) AS page_size, regexp_matches(text, '\.\s+[A-Z]') OR regexp_matches(text, '^[•–—▪◦]\s')
            OR regexp_matches(text, '(?i)^(?:Exhibit|Figure|Table|Fig\.?)\s+\d') OR regexp_matches(text, '(?i)(?:www\.|https?://|\.gov|\.org|\.com)') AS prose
          FROM blocks b LEFT JOIN s USING (source_file, page))
    SELECT block_id, CASE WHEN bbox[4] <= 792 * 0.08 THEN 'header' WHEN bbox[2] >= 792 * 0.92 THEN 'footer'
        WHEN font_size >= page_size * 1.15 AND NOT prose THEN 'heading'
        WHEN bold AND len(text) < 200 AND NOT prose AND (bbox[3] - bbox[1]) / 612 >= 0.4 THEN 'heading' ELSE 'body' END AS kind FROM b
""")
def block_classify(spark, sf_dir):
    blocks = table(spark, sf_dir, "blocks")
    size = blocks.filter("font_size > 0").groupBy("source_file", "page").agg(F.percentile("font_size", F.lit(0.5)).alias("page_size"))
    joined = blocks.join(size, ["source_file", "page"], "left").withColumns({"page_size": F.coalesce("page_size", F.lit(12.0)), "width": F.lit(612.0), "height": F.lit(792.0)})
    return extract.classified(joined).select("block_id", "kind")


@query("""
    WITH h AS (SELECT source_file, font_name, font_size FROM blocks WHERE kind = 'heading'),
    m AS (SELECT source_file, quantile_cont(font_size, 0.5) AS middle FROM h GROUP BY 1),
    c AS (SELECT source_file, font_name, count(*) AS n FROM h JOIN m USING (source_file) WHERE font_size >= 0.85 * middle AND font_name <> '' GROUP BY ALL)
    SELECT source_file, string_agg(font_name, ',' ORDER BY font_name) AS fonts
    FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, font_name) AS r FROM c) WHERE r <= 2 GROUP BY source_file
""")
def heading_fonts(spark, sf_dir):
    return extract.heading_fonts(table(spark, sf_dir, "blocks"), "source_file").select("source_file", F.array_join("fonts", ",").alias("fonts"))


@query("""
    SELECT source_file, round(avg(CASE WHEN len(trim(text)) < 50 THEN 1.0 ELSE 0.0 END), 6) AS low_share, avg(CASE WHEN len(trim(text)) < 50 THEN 1.0 ELSE 0.0 END) >= 0.9 AS scanned
    FROM (SELECT source_file, page, max(text) AS text FROM blocks GROUP BY ALL) WHERE page <= 30 GROUP BY source_file
""")
def scanned_files(spark, sf_dir):
    pages = table(spark, sf_dir, "blocks").groupBy("source_file", F.col("page").alias("page_no")).agg(F.max("text").alias("text"))
    return extract.scanned_files(pages).select("source_file", F.round("low_share", 6).alias("low_share"), "scanned")


@query(f"""
    WITH {_HEADS}, q AS ({ORACLES['printed_pages']}),
    a AS (SELECT source_file, b.block_id, text, page, lower(trim(kind)) AS kind, nullif(q.doc_page, '') AS shown, label, contains(lower(text), 'intentionally left blank') AS blank,
                 coalesce((len(text) - len(replace(replace(text, '.', ''), '…', ''))) / nullif(len(text), 0), 0) <= 0.15 AND lower(trim(kind)) NOT IN ('header', 'footer') AS running
          FROM blocks b LEFT JOIN q USING (block_id) LEFT JOIN heads USING (block_id)),
    d AS (SELECT *, CASE WHEN running AND kind = 'heading' AND NOT blank THEN label END AS name FROM a),
    f AS (SELECT *, coalesce(last_value(shown IGNORE NULLS) OVER w, 'UNKNOWN') AS doc_page, coalesce(last_value(CASE WHEN regexp_matches({sql.strip('name')}, '^\\d') OR regexp_matches({sql.strip('name')}, '{sql.KEYWORD}') THEN name END IGNORE NULLS) OVER w,
                 last_value(name IGNORE NULLS) OVER w, 'UNKNOWN') AS section FROM d WINDOW w AS (PARTITION BY source_file ORDER BY block_id ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT source_file, block_id, page, doc_page, section, kind = 'heading' AS head, list_filter(regexp_split_to_array(text, '{BLANKS}'), lambda x: x <> '') AS w FROM f WHERE running AND NOT (kind = 'heading' AND blank)),
    n AS (SELECT *, CASE WHEN head OR lag(section) OVER o IS NULL OR (section <> lag(section) OVER o AND section <> 'UNKNOWN' AND lag(section) OVER o <> 'UNKNOWN') THEN 1 ELSE 0 END AS new
          FROM r WHERE len(w) > 0 WINDOW o AS (PARTITION BY source_file ORDER BY block_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY source_file ORDER BY block_id) AS seg FROM n),
    p AS (SELECT *, sum(len(w)) OVER (PARTITION BY source_file, seg ORDER BY block_id) AS upto FROM g),
    e AS (SELECT source_file, seg, CAST(max(upto) AS BIGINT) AS n, count(*) = 1 AND bool_and(head) AS alone, arg_min(head, block_id) AS opens, arg_max(struct_pack(page := page, doc_page := doc_page, section := section), block_id) AS tail FROM p GROUP BY ALL),
    z AS (SELECT *, CASE WHEN n < 220 OR alone THEN 0 ELSE (n - 220) // 170 + 1 END AS whole, CASE WHEN lead(opens) OVER (PARTITION BY source_file ORDER BY seg) THEN 10 ELSE 30 END AS least FROM e),
    j AS (SELECT *, unnest(range(0, whole + CASE WHEN n - whole * 170 >= least THEN 1 ELSE 0 END)) AS k FROM z),
    v AS (SELECT source_file, seg, unnest(w) AS word, upto - len(w) + generate_subscripts(w, 1) - 1 AS pos FROM p),
    x AS (SELECT source_file, seg, k, string_agg(word, ' ' ORDER BY pos) AS text FROM j JOIN v USING (source_file, seg) WHERE pos >= k * 170 AND pos < CASE WHEN k < whole THEN k * 170 + 220 ELSE n END GROUP BY ALL),
    y AS (SELECT j.source_file, j.seg, j.k, arg_min(struct_pack(page := p.page, doc_page := p.doc_page, section := p.section), block_id) AS done FROM j JOIN p ON p.source_file = j.source_file AND p.seg = j.seg AND NOT head AND upto >= k * 170 + 220 WHERE k < whole GROUP BY ALL)
    SELECT source_file, CAST(row_number() OVER (PARTITION BY source_file ORDER BY seg, k) - 1 AS INTEGER) AS chunk_index, text, l.page AS page, l.doc_page AS doc_page, l.section AS section
    FROM (SELECT source_file, seg, k, text, coalesce(done, tail) AS l FROM x JOIN j USING (source_file, seg, k) LEFT JOIN y USING (source_file, seg, k))
""")
def chunk_blocks(spark, sf_dir):
    return extract.chunked(extract.with_running_labels(table(spark, sf_dir, "blocks"), "source_file", "block_id"))


# Context


@query(f"""
    WITH c AS (SELECT DISTINCT source_file, section, chunk_index FROM chunks)
    SELECT h.id, c.chunk_index FROM {ONE_CHUNK} h JOIN c ON c.source_file = h.source_file AND c.section = h.section
    AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 2 AND c.chunk_index <> h.chunk_index WHERE h.chunk_index % 50 = 0
""")
def neighbor_expand(spark, sf_dir):
    chunks = chunks_once(spark, sf_dir, "source_file", "section", "chunk_index", "text")
    hits = chunks.filter(F.col("chunk_index") % 50 == 0).withColumns({"query_id": F.col("id"), "place": F.lit(0)})
    return context.neighbours(hits, chunks).select(F.col("query_id").alias("id"), "chunk_index")


@query(f"""
    SELECT source_file, CASE WHEN coalesce(section, '') IN ('', 'UNKNOWN') THEN '' ELSE section END AS section, count(*) AS hits
    FROM {ONE_CHUNK} GROUP BY source_file, CASE WHEN coalesce(section, '') IN ('', 'UNKNOWN') THEN id ELSE '=' || section END, 2
""")
def group_sections(spark, sf_dir):
    hits = chunks_once(spark, sf_dir, "source_file", "section").withColumns({"query_id": F.col("source_file"), "place": F.col("id"), "context": F.lit("")})
    sources = context.grouped(hits)
    known = F.when(F.coalesce("section", F.lit("")).isin("", "UNKNOWN"), F.lit("")).otherwise(F.col("section"))
    return sources.select("source_file", known.alias("section"), F.size("places").cast("long").alias("hits"))


_LINES = "list_filter(string_split({0}, chr(10)), lambda x, i: list_position(list_transform(string_split({0}, chr(10)), lambda y: {1}), {2}) = i)"


@query(f"""
    WITH c AS {ONE_CHUNK},
    h AS (SELECT *, CASE WHEN coalesce(section, '') IN ('', 'UNKNOWN') THEN '#' || chunk_index ELSE '=' || section END AS source FROM c WHERE chunk_index % 50 = 0),
    n AS (SELECT h.id, c.chunk_index, min(c.text) AS text FROM h JOIN c ON c.source_file = h.source_file AND c.section = h.section AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 2 AND c.chunk_index <> h.chunk_index GROUP BY ALL
          UNION ALL SELECT id, chunk_index, text FROM h),
    x AS (SELECT id, list(text ORDER BY chunk_index, text) AS parts FROM n GROUP BY id),
    e AS (SELECT h.*, {sql.without_overlap('parts')} AS context FROM h JOIN x USING (id)),
    g AS (SELECT source_file, source, list(context ORDER BY chunk_index, context) AS contexts, min(chunk_index) AS start, min_by(section, chunk_index) AS section,
                 min_by(coalesce(llm_corrected_section, FALSE), chunk_index) AS marked, min_by(coalesce(doc_page, 'UNKNOWN'), chunk_index) AS doc_page FROM e GROUP BY ALL),
    m AS (SELECT *, {sql.without_overlap('contexts')} AS whole, row_number() OVER (PARTITION BY source_file ORDER BY start) AS idx FROM g),
    u AS (SELECT *, array_to_string({_LINES.format('whole', sql.strip('y'), sql.strip('x'))}, chr(10)) AS context FROM m)
    SELECT source_file AS query_id, string_agg('--- SOURCE ' || idx || ' ---' || chr(10) || CASE WHEN len(context) > 1000 THEN context[1:1000] || '...' ELSE context END || chr(10) || chr(10) || '[SRC_' || idx || '] Document: '
        || source_file || ' ' || section || CASE WHEN marked THEN ' [llm corrected]' ELSE '' END || ', page ' || doc_page || chr(10) || '---', chr(10) || chr(10) ORDER BY idx) AS prompt FROM u GROUP BY source_file
""")
def context_blocks(spark, sf_dir):
    chunks = chunks_once(spark, sf_dir, "source_file", "section", "chunk_index", "text", "doc_page", "llm_corrected_section")
    hits = chunks.filter(F.col("chunk_index") % 50 == 0).withColumns({"query_id": F.col("source_file"), "place": F.col("chunk_index")})
    return context.prompts(context.grouped(context.expanded(hits, chunks)))


# Catalogue and facets


_FIRST = f"SELECT *, row_number() OVER (PARTITION BY {{0}} ORDER BY id) AS r FROM {ONE_CHUNK} WHERE {{1}}"
_NAMED = "{0} <> ''"


@query(f"SELECT source_file, coalesce(agency, '') AS agency, coalesce(jurisdiction, '') AS jurisdiction, coalesce(state, '') AS state, coalesce(locality, '') AS locality, coalesce(file_link, '') AS file_link FROM ({_FIRST.format('source_file', _NAMED.format('source_file'))}) WHERE r = 1")
def catalog_dedupe(spark, sf_dir):
    return catalogue_views.catalogue(chunks_once(spark, sf_dir, "source_file", "agency", "jurisdiction", "state", "locality", "file_link"))


@query(f"SELECT agency, coalesce(jurisdiction, '') AS jurisdiction, coalesce(state, '') AS state, coalesce(locality, '') AS locality FROM ({_FIRST.format('agency', _NAMED.format('agency'))}) WHERE r = 1")
def facet_agencies(spark, sf_dir):
    return catalogue_views.agencies(chunks_once(spark, sf_dir, "agency", "jurisdiction", "state", "locality"))


@query("SELECT DISTINCT state FROM chunks WHERE state <> ''")
def facet_states(spark, sf_dir):
    return catalogue_views.states(table(spark, sf_dir, "chunks"))


@query(f"SELECT state, locality, coalesce(agency, '') AS display FROM ({_FIRST.format('state, locality', _NAMED.format('state') + ' AND ' + _NAMED.format('locality'))}) WHERE r = 1")
def facet_localities(spark, sf_dir):
    return catalogue_views.localities(chunks_once(spark, sf_dir, "agency", "state", "locality"))


@query("SELECT DISTINCT jurisdiction, coalesce(state, '') AS state, coalesce(locality, '') AS locality FROM chunks WHERE jurisdiction <> ''")
def facet_scopes(spark, sf_dir):
    return catalogue_views.scopes(table(spark, sf_dir, "chunks"))


@query(r"""
    SELECT coalesce(jurisdiction, '') AS jurisdiction, coalesce(state, '') AS state, coalesce(locality, '') AS locality, coalesce(agency, '') AS agency,
        string_agg(regexp_replace(source_file, '(?i)\.pdf$', ''), '; ' ORDER BY regexp_replace(source_file, '(?i)\.pdf$', '')) AS documents,
        CAST(coalesce(list_position(['FEDERAL', 'STATE', 'LOCAL'], any_value(jurisdiction)) - 1, 3) AS INTEGER) AS position
    FROM standards_catalog GROUP BY 1, 2, 3, 4
""")
def nested_catalog(spark, sf_dir):
    return catalogue_views.nested(table(spark, sf_dir, "standards_catalog"))


@query("""
    WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY file_link NULLS FIRST) AS r FROM standards_catalog WHERE source_file <> '') WHERE r = 1)
    SELECT to_json(list(struct_pack(agency := coalesce(agency, ''), source_file := source_file, jurisdiction := coalesce(jurisdiction, ''), state := coalesce(state, ''), locality := coalesce(locality, ''),
                                    file_link := coalesce(file_link, '')) ORDER BY coalesce(agency, ''), source_file))::VARCHAR AS catalogue FROM f
""")
def catalog_json(spark, sf_dir):
    return catalogue_views.catalogue_json(catalogue_views.catalogue(table(spark, sf_dir, "standards_catalog"), "file_link"))


def _paths(catalog: DataFrame) -> DataFrame:
    """Paths as the files of the catalogue would have, one for each row."""
    local = F.concat_ws("/", F.lit("local"), "state", F.regexp_replace("locality", "^$", "nowhere"), "agency", "source_file")
    other = F.concat_ws("/", F.lower("jurisdiction"), "state", "agency", "source_file")
    return catalog.select(F.when(F.col("jurisdiction") == "LOCAL", local).otherwise(other).alias("path"), F.coalesce("file_link", F.lit("")).alias("file_link"))


_PATHS = """p AS (SELECT CASE WHEN jurisdiction = 'LOCAL' THEN concat_ws('/', 'local', state, regexp_replace(locality, '^$', 'nowhere'), agency, source_file)
    ELSE concat_ws('/', lower(jurisdiction), state, agency, source_file) END AS path, coalesce(file_link, '') AS file_link FROM standards_catalog)"""
_TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), '')"
_PLACE = f"""h AS (SELECT path, file_link, s[-1] AS source_file, CASE WHEN deep THEN upper(s[1]) ELSE 'UNKNOWN' END AS jurisdiction,
    CASE WHEN deep THEN upper(s[2]) ELSE {{0}} END AS state, CASE WHEN deep AND upper(s[1]) = 'LOCAL' THEN {_TITLE.format('s[3]')} ELSE '' END AS locality,
    CASE WHEN NOT deep THEN 'UNKNOWN' WHEN upper(s[1]) <> 'LOCAL' THEN upper(s[3]) WHEN len(s) >= 5 THEN upper(s[4]) ELSE upper({_TITLE.format('s[3]')}) END AS agency
    FROM (SELECT *, string_split(path, '/') AS s, len(string_split(path, '/')) >= 4 AND upper(string_split(path, '/')[1]) IN ('FEDERAL', 'STATE', 'LOCAL') AS deep FROM p))"""


@query(f"WITH {_PATHS}, {_PLACE.format(repr(''))} SELECT path, source_file, jurisdiction, state, locality, agency FROM h")
def path_hierarchy(spark, sf_dir):
    paths = _paths(table(spark, sf_dir, "standards_catalog"))
    return paths.select("path", *(c.alias(k) for k, c in text.path_metadata(F.col("path")).items()))


# Upkeep


@query(f"""
    WITH {_PATHS}, {_PLACE.format(repr('UNKNOWN'))}, l AS (SELECT source_file, arg_max(h, path) AS h FROM h GROUP BY source_file)
    SELECT id, c.source_file, CASE WHEN h IS NULL THEN c.jurisdiction ELSE h.jurisdiction END AS jurisdiction, CASE WHEN h IS NULL THEN c.agency ELSE h.agency END AS agency,
        CASE WHEN h IS NULL THEN c.state ELSE h.state END AS state, CASE WHEN h IS NULL THEN c.locality ELSE h.locality END AS locality
    FROM {ONE_CHUNK} c LEFT JOIN l ON c.source_file = l.source_file
""")
def retag_refresh(spark, sf_dir):
    chunks = chunks_once(spark, sf_dir, "source_file", "jurisdiction", "agency", "state", "locality", "file_link")
    return upkeep.refreshed(chunks, _paths(table(spark, sf_dir, "standards_catalog"))).select("id", "source_file", "jurisdiction", "agency", "state", "locality")


@query("SELECT DISTINCT source_file FROM blocks WHERE source_file NOT IN (SELECT source_file FROM standards_catalog WHERE jurisdiction <> 'LOCAL')")
def stale_files(spark, sf_dir):
    """As if the folder of local files were gone."""
    there = _paths(table(spark, sf_dir, "standards_catalog").filter(F.col("jurisdiction") != "LOCAL"))
    return upkeep.stale_files(table(spark, sf_dir, "blocks"), there)


_ENTRIES = """e AS (SELECT 1 AS priority, regexp_replace(path, '/[^/]*$', '') AS folder, string_split(path, '/')[-1] AS name, file_link AS url FROM p WHERE len(file_link) % 2 = 0
    UNION ALL SELECT 4, NULL, path, 'registry:' || path FROM p WHERE len(path) % 3 <> 0)"""


@query(f"""
    WITH {_PATHS}, {_ENTRIES}, m AS (SELECT DISTINCT path FROM p),
    c AS (SELECT path, priority, url FROM m JOIN e ON (folder IS NULL AND name = path) OR (folder = regexp_replace(path, '/[^/]*$', '') AND name = string_split(path, '/')[-1]) WHERE url <> '')
    SELECT path, coalesce(min_by(url, struct_pack(p := priority, u := url)), '') AS file_link FROM m LEFT JOIN c USING (path) GROUP BY path
""")
def link_priority(spark, sf_dir):
    paths = _paths(table(spark, sf_dir, "standards_catalog"))
    folder, name = F.regexp_replace("path", "/[^/]*$", ""), F.element_at(F.split("path", "/"), -1)
    sidecar = paths.filter(F.length("file_link") % 2 == 0).select(F.lit(1).alias("priority"), folder.alias("folder"), name.alias("name"), F.col("file_link").alias("url"))
    registry = paths.filter(F.length("path") % 3 != 0).select(F.lit(4).alias("priority"), F.lit(None).cast("string").alias("folder"), F.col("path").alias("name"), F.concat(F.lit("registry:"), "path").alias("url"))
    return upkeep.links(paths, sidecar.unionByName(registry))


_CORRECTIONS = """v AS (SELECT source_file || '__p' || page || '__c' || chunk_index AS id, coalesce(field, 'section') AS field, trim(coalesce(nullif(correct_value, ''), correct_section)) AS value, logged_at FROM correction_log),
    l AS (SELECT id, field, arg_max(value, struct_pack(t := logged_at, v := value)) AS value FROM v WHERE field IN ('section', 'doc_page') AND value <> '' AND value <> 'UNKNOWN' GROUP BY id, field)"""


@query(f"WITH {_CORRECTIONS} SELECT * FROM l")
def corrections_lww(spark, sf_dir):
    return upkeep.current_corrections(table(spark, sf_dir, "correction_log"))


@query(f"""
    WITH {_CORRECTIONS} SELECT c.id, coalesce(s.value, c.section) AS section, coalesce(d.value, c.doc_page) AS doc_page,
        s.value IS NOT NULL OR coalesce(llm_corrected_section, FALSE) AS llm_corrected_section, d.value IS NOT NULL OR coalesce(llm_corrected_doc_page, FALSE) AS llm_corrected_doc_page
    FROM {ONE_CHUNK} c LEFT JOIN l s ON s.id = c.id AND s.field = 'section' LEFT JOIN l d ON d.id = c.id AND d.field = 'doc_page'
""")
def corrections_applied(spark, sf_dir):
    chunks = chunks_once(spark, sf_dir, "section", "doc_page", "llm_corrected_section", "llm_corrected_doc_page")
    return upkeep.corrected(chunks, table(spark, sf_dir, "correction_log")).select("id", "section", "doc_page", "llm_corrected_section", "llm_corrected_doc_page")


@query("SELECT id, source_file FROM chunks WHERE source_file NOT IN (SELECT DISTINCT source_file FROM chunks WHERE ingested_at < (SELECT min(ingested_at) + (max(ingested_at) - min(ingested_at)) / 2 FROM chunks))")
def incremental_load(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").select("id", "source_file", "ingested_at")
    ends = chunks.agg(F.min("ingested_at").alias("a"), F.max("ingested_at").alias("b")).first()
    old = chunks.filter(F.col("ingested_at") < F.lit(ends.a + (ends.b - ends.a) / 2))
    return upkeep.not_yet_ingested(chunks, old).select("id", "source_file")


@query(f"SELECT source_file, page, string_agg(text, chr(10) ORDER BY chunk_index, text) AS text FROM {ONE_CHUNK} GROUP BY ALL")
def page_texts(spark, sf_dir):
    return upkeep.page_texts(chunks_once(spark, sf_dir, "source_file", "page", "chunk_index", "text"))


_PAGE_OF = r"""coalesce(nullif(regexp_extract({0}, '(?:Page|PAGE)\s+(\d+)$', 1), ''), nullif(regexp_extract({0}, '(\d{{1,4}}-\d{{1,4}})$', 1), ''), nullif(regexp_extract({0}, '(?:^|\D)(\d{{1,4}})$', 1), ''))"""


@query(f"""
    WITH c AS {ONE_CHUNK},
    p AS (SELECT source_file, page, string_agg(text, chr(10) ORDER BY chunk_index, text) AS text, CASE WHEN min(section) = max(section) THEN min(section) END AS section FROM c GROUP BY ALL),
    l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: {sql.strip('x')}), lambda x: x <> '')[-1] AS line FROM p),
    s AS (SELECT *, {_PAGE_OF.format('line')} AS shown, nullif(regexp_extract(text[1:500], '(?:^|\\D)(\\d{{1,4}}-\\d{{1,4}})(?:\\D|$)', 1), '') AS pair FROM l)
    SELECT source_file, page, coalesce(CASE WHEN shown <> coalesce(section, '') AND NOT regexp_full_match(shown, '\\d{{4}}') AND CAST(string_split(shown, '-')[-1] AS BIGINT) < 2000 THEN shown END, pair, 'UNKNOWN') AS doc_page FROM s
""")
def redetected_pages(spark, sf_dir):
    return upkeep.redetected_pages(chunks_once(spark, sf_dir, "source_file", "page", "chunk_index", "text", "section"))


@query("SELECT source_file, count(*) AS chunks FROM chunks GROUP BY source_file")
def file_counts(spark, sf_dir):
    return table(spark, sf_dir, "chunks").groupBy("source_file").agg(F.count("*").alias("chunks"))


# Usage


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM query_log WHERE ts IS NOT NULL GROUP BY 1")
def usage_by_day(spark, sf_dir):
    return usage.by_day(table(spark, sf_dir, "query_log"))


@query("SELECT strftime(ts, '%H') AS hour, count(*) AS n FROM query_log WHERE ts IS NOT NULL GROUP BY 1")
def usage_by_hour(spark, sf_dir):
    return usage.by_hour(table(spark, sf_dir, "query_log"))


@query("""
    SELECT f AS filter, count(*) AS n FROM (SELECT unnest(CASE WHEN len(f) > 0 THEN f ELSE ['unfiltered'] END) AS f FROM (SELECT list_filter([CASE WHEN agency <> 'UNKNOWN' THEN 'agency' END,
        CASE WHEN jurisdiction = 'LOCAL' THEN 'jurisdiction' END, CASE WHEN locality <> '' THEN 'locality' END], lambda x: x IS NOT NULL) AS f FROM standards_catalog)) GROUP BY f
""")
def filter_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "standards_catalog")
    asked = rows.select(
        F.nullif(F.col("agency"), F.lit("UNKNOWN")).alias("filter_agency"), F.when(F.col("jurisdiction") == "LOCAL", "LOCAL").alias("filter_jurisdiction"), F.lit("").alias("filter_state"), F.col("locality").alias("filter_locality")
    )
    return usage.filter_use(asked)


@query("""
    WITH c AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(CAST(ts AS DATE)) AS last FROM events)
    SELECT strftime(s.d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(last - INTERVAL 29 DAY, last, INTERVAL 1 DAY)) AS DATE) AS d FROM m) s LEFT JOIN c ON c.d = s.d
""")
def dashboard_series(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = events.agg(F.to_date(F.max("ts")).alias("d")).first().d
    return usage.series(usage.by_day(events), F.lit(last))


@query("""
    WITH m AS (SELECT max(CAST(ts AS DATE)) AS last FROM events)
    SELECT CAST(count(*) FILTER (WHERE CAST(ts AS DATE) > last - 7) AS BIGINT) AS week, count(*) AS total FROM events, m
""")
def dashboard_totals(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = events.agg(F.to_date(F.max("ts")).alias("d")).first().d
    return usage.totals(usage.by_day(events), F.lit(last))


@query("SELECT user_id, CAST(greatest(sum(CASE WHEN event_type = 'error' THEN -4 ELSE 1 END), 0) AS BIGINT) AS n FROM events GROUP BY user_id")
def undo_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("delta", F.when(F.col("event_type") == "error", -4).otherwise(1))
    return usage.net_counts(events, ["user_id"])


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 OR user_id IN (1, 2) AS allowed FROM events")
def daily_quota(spark, sf_dir):
    return usage.within_quota(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2, (1, 2)).select("event_id", "allowed")


# Evaluation


def _run(spark, sf_dir, every: int) -> DataFrame:
    """A run over the labelled prompts as made up from their own columns: one in ``every`` fails, and every
    third finds another agency."""
    rows = table(spark, sf_dir, "eval_prompts")
    status = F.when(F.col("n") % every == 0, "FAIL").otherwise("OK")
    found = F.when(F.col("n") % 3 == 0, F.array(F.lit("NONE"))).otherwise(F.slice("expected_agencies", 1, 1))
    response = F.when(F.col("n") % 11 == 0, "- x\n^^^1^^^\n^^^FAIL^^^").otherwise(F.when(status == "FAIL", "^^^FAIL^^^").otherwise("- x\n^^^1^^^"))
    run = rows.select("n", status.alias("status"), found.alias("agencies"), response.alias("response"), (F.length("prompt") / 8.0).alias("time_s"), (F.length("prompt") / 64.0).alias("ttfl_s"))
    return evaluation.judged(run, rows)


_JUDGED = """{0} AS (SELECT n, prompt, coalesce(expected_status, 'OK') AS w, CASE WHEN n % {1} = 0 THEN 'FAIL' ELSE 'OK' END AS status, n % 3 <> 0 AND len(expected_agencies) > 0 AS hit,
    status = w AS status_correct, w = 'FAIL' OR hit AS agency_correct, status_correct AND agency_correct AS correct, n % 11 = 0 AS spurious_fail, len(prompt) / 8.0 AS time_s, len(prompt) / 64.0 AS ttfl_s FROM eval_prompts)"""


@query(f"WITH {_JUDGED.format('j', 7)} SELECT n, status_correct, agency_correct, correct, spurious_fail FROM j")
def eval_rule(spark, sf_dir):
    return _run(spark, sf_dir, 7).select("n", "status_correct", "agency_correct", "correct", "spurious_fail")


@query(f"""
    WITH {_JUDGED.format('j', 7)}
    SELECT count(*) AS items, count(*) FILTER (WHERE correct) AS correct, CAST(floor(count(*) FILTER (WHERE correct) * 100 / count(*)) AS INTEGER) AS percent, round_even(avg(time_s), 1) AS mean_time, round_even(avg(ttfl_s), 2) AS mean_ttfl,
        coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (WHERE NOT correct), '') AS failed, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (WHERE spurious_fail), '') AS spurious,
        coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (WHERE status_correct AND NOT agency_correct), '') AS wrong_agency FROM j
""")
def eval_summary(spark, sf_dir):
    return evaluation.summary(_run(spark, sf_dir, 7))


@query(f"WITH {_JUDGED.format('j', 7)} SELECT n, time_s FROM j ORDER BY time_s DESC, n LIMIT 5")
def eval_slowest(spark, sf_dir):
    return evaluation.slowest(_run(spark, sf_dir, 7))


@query(f"WITH {_JUDGED.format('a', 7)}, {_JUDGED.format('b', 5)} SELECT a.n, CASE WHEN a.correct THEN 'improved' ELSE 'regressed' END AS change FROM a JOIN b USING (n) WHERE a.correct <> b.correct")
def eval_compare(spark, sf_dir):
    return evaluation.compared(_run(spark, sf_dir, 7), _run(spark, sf_dir, 5))


# Answers




def _shown(c: str) -> str:
    return sql.strip(f"regexp_replace({c}, '(?s)<think>.*?</think>', '', 'g')")


_MARKER = r"\^\^\^(?:[0-9]+|FAIL)\^\^\^"
# token by token: each step takes a token, or goes on with what waits after a line was sent
_STREAM = f"""
    WITH RECURSIVE r AS (SELECT log_id, coalesce(response, '') AS a FROM query_log),
    t AS (SELECT log_id, a, 0 AS step, 0 AS upto, '' AS waiting, FALSE AS cited, '' AS kind, '' AS part, '' AS mark FROM r
        UNION ALL SELECT log_id, a, step + 1, upto, substr(w, used + 1), cited OR kind = 'source', kind, CASE WHEN mark <> '' THEN w[1:used - len(mark)] ELSE w[1:used] END, mark
        FROM (SELECT *, CASE WHEN mark LIKE '%FAIL%' THEN 'fail' WHEN mark <> '' THEN 'source' WHEN line > 0 AND len(w) - line >= 11 THEN 'line' WHEN len(w) - 11 > 80 THEN 'run' ELSE '' END AS kind,
                CASE WHEN mark <> '' THEN strpos(w, mark) + len(mark) - 1 WHEN line > 0 AND len(w) - line >= 11 THEN line WHEN len(w) - 11 > 80 THEN len(w) - 11 ELSE 0 END AS used
            FROM (SELECT *, strpos(w, chr(10)) AS line, CASE WHEN again THEN '' ELSE regexp_extract(w, '{_MARKER}') END AS mark
                FROM (SELECT log_id, a, step, cited, kind = 'line' AS again, CASE WHEN kind = 'line' THEN upto ELSE upto + 4 END AS upto, CASE WHEN kind = 'line' THEN waiting ELSE waiting || a[upto + 1:upto + 4] END AS w
                    FROM t WHERE kind = 'line' OR upto < len(a))))),
    p AS (SELECT log_id, step, kind, part, mark, cited FROM t WHERE kind <> ''
        UNION ALL SELECT log_id, 1000000000, 'run', arg_max(waiting, step), '', FALSE FROM t GROUP BY log_id),
    e AS (SELECT log_id, step, 0 AS sub, 'text' AS type, {_shown('part')} || CASE WHEN kind = 'line' THEN chr(10) ELSE '' END AS text, NULL::INTEGER AS n, NULL::VARCHAR AS raw FROM p WHERE kind <> 'fail' AND {_shown('part')} <> ''
        UNION ALL SELECT log_id, step, 1, 'source_block', NULL, CAST(regexp_extract(mark, '[0-9]+') AS INTEGER), NULL FROM p WHERE kind = 'source'
        UNION ALL SELECT log_id, step, 1, 'fail', '{answers.DECLINED}', NULL, NULL FROM p WHERE kind = 'fail' AND NOT cited
        UNION ALL SELECT log_id, 1000000001, 0, 'done', NULL, NULL, {_shown('a')} FROM r),
    s AS (SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY step, sub) - 1 AS INTEGER) AS seq, type, text, n, raw FROM e)"""


@query(f"{_STREAM} SELECT * FROM s")
def stream_parse(spark, sf_dir):
    return answers.parsed(table(spark, sf_dir, "query_log"), "log_id", "response")


@query(f"""{_STREAM} SELECT log_id, {sql.strip("coalesce(string_agg(CASE type WHEN 'text' THEN text WHEN 'source_block' THEN chr(10) || '^^^' || n || '^^^' || chr(10) WHEN 'fail' THEN '^^^FAIL^^^' END, '' ORDER BY seq), '')")} AS response,
    min(seq) FILTER (WHERE type = 'text') AS first_text FROM s GROUP BY log_id""")
def answer_rebuilt(spark, sf_dir):
    return answers.rebuilt(stream_parse(spark, sf_dir), "log_id")


@query("SELECT count(*) AS chunks, count(DISTINCT source_file) AS files FROM chunks")
def table_health(spark, sf_dir):
    return table(spark, sf_dir, "chunks").agg(F.count("*").alias("chunks"), F.count_distinct("source_file").alias("files"))
