"""The engine's operators applied to relational tables, each with its SQL counterpart.

Tables of games are played by tables of orders: an order's status stands for a
move's, ``o_orderkey div 2`` for its parent, and notation is composed from order
numbers. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import chess, geometry, text
from ..kernels.constants import ALPHABETS, FIGURINES, FIXES, MOVE_NUMBER
from ..operators import diagnosis, glyphs, patches, pictures, relations, trees
from ..sinks.archives import content_hash
from ..sources import pages as page_sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- scans, projections, geometry ---


@query("SELECT doc_id, source FROM documents WHERE doc_id BETWEEN 10 AND 5000")
def s2_page_range(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "source")
    return page_sources.page_range(d, 10, 5000).withColumnRenamed("page", "doc_id")


@query("SELECT source AS book_id, max(doc_id) AS page_count FROM documents GROUP BY 1")
def s4_page_count(spark, sf_dir):
    return page_sources.page_count(t(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page")))


@query("""
WITH f AS (SELECT p_partkey, p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' (' || (p_partkey % 5) || ')' ELSE '' END || '.pdf' AS name FROM part),
g AS (SELECT p_partkey, name, regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), ' \\(\\d+\\)$', '') AS stem, '/in/' || p_partkey || '/' || name AS path FROM f)
SELECT stem, path FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY length(name), path) AS k FROM g) WHERE k = 1
""")
def s12_discover(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    copy = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" ("), (F.col("p_partkey") % 5).cast("string"), F.lit(")"))).otherwise("")
    files = p.select(F.concat(F.lit("/in/"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("p_brand"), copy, F.lit(".pdf")).alias("path"))
    return page_sources.discover(files).select("stem", "path")


BOXES_SQL = "SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_partkey % 400 AS DOUBLE) AS x, CAST(l_suppkey % 700 AS DOUBLE) AS y, CAST(1 + l_orderkey % 50 AS DOUBLE) AS w, CAST(l_linenumber AS DOUBLE) AS h FROM lineitem"


def boxes(spark, sf_dir) -> DataFrame:
    li = t(spark, sf_dir, "lineitem")
    d = lambda c: c.cast("double")
    return li.select("l_orderkey", "l_partkey", "l_linenumber", geometry.box(d(F.col("l_partkey") % 400), d(F.col("l_suppkey") % 700), d(1 + F.col("l_orderkey") % 50), d(F.col("l_linenumber"))).alias("box"))


@query(f"WITH b AS ({BOXES_SQL}) SELECT l_orderkey, l_partkey, l_linenumber, x AS left, 842 - y - h AS top, w AS width, h AS height, x - 2 AS ix, y - 2 AS iy, w + 4 AS iw, h + 4 AS ih FROM b")
def p1_p5_p6_flip_rect_inflate(spark, sf_dir):
    b = boxes(spark, sf_dir)
    top = F.lit(842.0) - F.col("box.y") - F.col("box.h")
    b = b.withColumn("again", geometry.flipped(F.col("box.x"), top, F.col("box.x") + F.col("box.w"), top + F.col("box.h"), F.lit(842.0)))
    rect = geometry.page_rect("again", F.lit(595.0), F.lit(842.0), F.lit(595.0), F.lit(842.0))
    i = geometry.inflated("again", 2.0)
    return b.select("l_orderkey", "l_partkey", "l_linenumber", rect["left"].alias("left"), rect["top"].alias("top"), rect["width"].alias("width"), rect["height"].alias("height"), i["x"].alias("ix"), i["y"].alias("iy"), i["w"].alias("iw"), i["h"].alias("ih"))


@query(f"WITH b AS ({BOXES_SQL}) SELECT l_orderkey, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM b GROUP BY 1")
def p2_p3_a13_union_box(spark, sf_dir):
    u = geometry.union_agg("box")
    return boxes(spark, sf_dir).groupBy("l_orderkey").agg(u.alias("u")).select("l_orderkey", "u.x", "u.y", "u.w", "u.h")


@query(f"""
WITH b AS ({BOXES_SQL}), m AS (SELECT l_orderkey, median(w) AS median FROM b GROUP BY 1)
SELECT l_orderkey, l_partkey, l_linenumber, median, w FROM b JOIN m USING (l_orderkey) WHERE w / median BETWEEN 0.5 AND 2.6 AND w / h <= 11.0
""")
def p12_a10_glyph_candidates(spark, sf_dir):
    b = boxes(spark, sf_dir).select("l_orderkey", "l_partkey", "l_linenumber", "box.w", "box.h")
    return glyphs.candidates(b, ["l_orderkey"], (0.5, 2.6), 11.0).select("l_orderkey", "l_partkey", "l_linenumber", "median", "w")


@query("SELECT o_orderkey, CAST((o_orderkey + 1) // 2 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 1 THEN '. ' ELSE '… ' END || o_orderpriority AS label FROM orders")
def p7_move_label(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", chess.move_label("o_orderkey", F.col("o_orderpriority")).alias("label"))


# --- text ---


def _fixed_sql(column: str) -> str:
    table = FIGURINES | FIXES
    quoted = lambda s: s.replace("'", "''")
    return f"translate({column}, '{quoted(''.join(table))}', '{quoted(''.join(table.values()))}')"


@query(f"SELECT doc_id, md5({_fixed_sql('text')}) AS fixed, length(text) = length({_fixed_sql('text')}) AS same_length FROM documents")
def f1_f2_normalise(spark, sf_dir):
    fixed = text.normalise("text")
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(fixed).alias("fixed"), (F.length("text") == F.length(fixed)).alias("same_length"))


@query("SELECT doc_id, md5(translate(text, 'RDTFC', 'KQRBN')) AS san FROM documents")
def f3_translate_alphabet(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.to_san("text", ALPHABETS["fr"])).alias("san"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS collapsed, md5(regexp_replace(text, '[ \t\n\r\f\v]+', '', 'g')) AS squeezed FROM documents")
def f5_whitespace(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse("text")).alias("collapsed"), F.md5(text.squeeze("text")).alias("squeezed"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
o AS (SELECT doc_id, k, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
SELECT doc_id, CAST(k AS BIGINT) AS line_no, CAST(s AS BIGINT) AS start, CAST(s + length(line) AS BIGINT) AS "end" FROM o
""")
def f6_f7_line_offsets(spark, sf_dir):
    lines = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.offsets_of_lines("text")).alias("k", "l"))
    return longs(lines.select("doc_id", (F.col("k") + 1).alias("line_no"), "l.start", "l.end"), "line_no", "start", "end")


@query("SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9._-]', '_', 'g') AS safe, left(concat_ws(' ', p_name, p_type, p_brand), 600) AS comment, left(p_name, 120) AS title FROM part")
def f13_f14_titles_and_names(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.sanitise("p_name").alias("safe"), text.comment("p_name", "p_type", "p_brand").alias("comment"), text.title("p_name").alias("title"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def k4_f24_content_hash(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("digest"))


# Notation composed from orders, one book per customer.
MOVE_SQL = "CAST(o_orderkey % 90 + 1 AS VARCHAR) || '. ' || substr('KQRBN', CAST(o_custkey % 5 AS INT) + 1, 1) || substr('abcdefgh', CAST(o_orderkey % 8 AS INT) + 1, 1) || CAST(o_custkey % 8 + 1 AS VARCHAR) || ' ' || substr('abcdefgh', CAST(o_custkey % 8 AS INT) + 1, 1) || CAST(o_orderkey % 8 + 1 AS VARCHAR)"
BOOK_SQL = f"SELECT o_custkey % 97 AS book, string_agg({MOVE_SQL}, ' ' ORDER BY o_orderkey) AS text FROM orders GROUP BY 1"


def notation_lines(spark, sf_dir) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    s = lambda letters, k: F.substr(F.lit(letters), k.cast("int") + 1, F.lit(1))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    move = F.concat((k % 90 + 1).cast("string"), F.lit(". "), s("KQRBN", c % 5), s("abcdefgh", k % 8), (c % 8 + 1).cast("string"), F.lit(" "), s("abcdefgh", c % 8), (k % 8 + 1).cast("string"))
    return o.select((c % 97).alias("book"), k.alias("page"), move.alias("text"))


@query(f"""
WITH m AS (SELECT o_custkey % 97 AS book, {MOVE_SQL} AS text FROM orders),
l AS (SELECT book, substr(unnest(regexp_extract_all(text, '[KQRBN][a-h][1-8]')), 1, 1) AS letter FROM m)
SELECT book AS book_id, letter, count(*) AS hits FROM l GROUP BY 1, 2
""")
def a5_letter_hits(spark, sf_dir):
    from ..operators.notation import letter_hits

    return letter_hits(notation_lines(spark, sf_dir).withColumnRenamed("book", "book_id"))


NOTATION_SQL = f"""
WITH m AS (SELECT o_custkey % 97 AS book, {MOVE_SQL} AS text FROM orders),
l AS (SELECT book, substr(unnest(regexp_extract_all(text, '[KQRBN][a-h][1-8]')), 1, 1) AS letter FROM m),
h AS (SELECT book, letter, count(*) AS hits FROM l GROUP BY 1, 2),
a(o, language, alphabet) AS (VALUES (0, 'en', 'KQRBN'), (1, 'fr', 'RDTFC'), (2, 'de', 'KDTLS'), (3, 'es', 'RDTAC'), (4, 'it', 'RDTAC'), (5, 'nl', 'KDTLP')),
s AS (SELECT book, o, language, alphabet, sum(hits) AS score FROM h JOIN a ON contains(alphabet, letter) GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY score DESC, o) AS k FROM s) WHERE k = 1),
r AS (SELECT k.book, k.language, CAST(k.score AS BIGINT) AS best, CAST(coalesce(max(CASE WHEN s.alphabet <> k.alphabet THEN s.score END), 0) AS BIGINT) AS runner FROM k JOIN s ON s.book = k.book GROUP BY k.book, k.language, k.score)
"""


@query(NOTATION_SQL + "SELECT book AS book_id, language, best, runner FROM r")
def i1_i2_best_language(spark, sf_dir):
    from ..operators.notation import best_language, language_scores, letter_hits

    return best_language(language_scores(letter_hits(notation_lines(spark, sf_dir).withColumnRenamed("book", "book_id"))))


@query(f"""
WITH p AS (SELECT o_custkey % 97 AS book_id, {MOVE_SQL} AS text FROM orders)
SELECT book_id, count(*) AS pages, count(CASE WHEN starts_with(text, '1. ') THEN 1 END) AS starts, CAST(sum(length(regexp_replace(text, '[^.]', '', 'g'))) AS BIGINT) AS numbers FROM p GROUP BY 1
""")
def a22_o8_survey(spark, sf_dir):
    """Pages, game starts and move numbers per book; a line with the number 1 begins a game."""
    from ..operators.survey import survey

    return longs(survey(notation_lines(spark, sf_dir).withColumnRenamed("book", "book_id")), "starts", "numbers")


@query(f"""
WITH m AS (SELECT o_custkey % 97 AS book, translate({MOVE_SQL}, 'KQRBN', '♔♕♖♗♘') AS text FROM orders)
SELECT CAST(book AS VARCHAR) AS book_id, CAST(sum(len(regexp_extract_all(text, '[♔♕♖♗♘][a-h1-8]?x?[a-h][1-8]'))) AS BIGINT) AS placed, CAST(sum(len(regexp_extract_all(text, '[♔♕♖♗♘]'))) AS BIGINT) AS total FROM m GROUP BY 1
""")
def a9_placement_score(spark, sf_dir):
    lines = notation_lines(spark, sf_dir).select(F.col("book").cast("string").alias("book_id"), F.translate("text", "KQRBN", "♔♕♖♗♘").alias("text"))
    return longs(glyphs.placement_score(lines), "placed", "total")


@query(f"""
WITH m AS (SELECT CAST(o_custkey % 97 AS VARCHAR) AS book_id, {MOVE_SQL} AS text FROM orders),
w AS (SELECT book_id, 'move_number' AS kind, string_split(text, ' ')[1] AS text FROM m UNION ALL SELECT book_id, 'move', unnest(string_split(text, ' ')[2:]) FROM m)
SELECT book_id, kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM w GROUP BY 1, 2
""")
def t1_tokens(spark, sf_dir):
    """Tokens of composed notation; counts per kind of every book."""
    from ..operators.books import tokenize

    pages = page_sources.of_texts(notation_lines(spark, sf_dir).select(F.col("book").cast("string").alias("book_id"), "page", "text"))
    return tokenize(pages).groupBy("book_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# --- aggregates ---


@query("SELECT lang AS book_id, 'Serif' AS font, CAST(sum(length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))) AS BIGINT) AS n, min(doc_id) AS first_page FROM documents GROUP BY 1")
def a1_font_inventory(spark, sf_dir):
    """Printed characters per font of every book; a language's documents are a book's pages."""
    from ..operators.notation import font_inventory

    pages = page_sources.of_texts(t(spark, sf_dir, "documents").select(F.col("lang").alias("book_id"), F.col("doc_id").alias("page"), "text"))
    return longs(font_inventory(pages).select("book_id", "font", "n", F.col("first.page").alias("first_page")), "first_page")


@query("SELECT o_orderpriority, count(*) AS moves, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS ok, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS uncertain, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS broken FROM orders GROUP BY 1")
def a2_status_counts(spark, sf_dir):
    return diagnosis.status_counts(t(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus"), {"F": "ok", "O": "uncertain", "P": "broken"})


TREE_SQL = """
WITH RECURSIVE n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 2 END AS up, o_orderstatus = 'P' AND o_orderkey % 11 = 5 AS broken, o_orderstatus = 'O' AS repaired FROM orders),
w AS (SELECT id, broken, repaired, false AS tainted, CAST(NULL AS INTEGER) AS distance FROM n WHERE up IS NULL
  UNION ALL SELECT n.id, n.broken, n.repaired, w.tainted OR w.broken, CASE WHEN w.repaired THEN 1 ELSE w.distance + 1 END FROM n JOIN w ON n.up = w.id)
"""


def tree(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return t(spark, sf_dir, "orders").select(k.alias("id"), F.when(k > 0, F.expr("o_orderkey div 2")).alias("up"), ((F.col("o_orderstatus") == "P") & (k % 11 == 5)).alias("broken"), (F.col("o_orderstatus") == "O").alias("repaired"), "o_orderstatus", "o_custkey", "o_totalprice")


@query(TREE_SQL + "SELECT id, tainted, CAST(distance AS BIGINT) AS distance FROM w")
def t2_t3_ancestors(spark, sf_dir):
    return longs(trees.ancestors(tree(spark, sf_dir), "id", "up", F.col("broken"), F.col("repaired")), "distance")


@query(TREE_SQL + """
SELECT o_orderpriority, count(CASE WHEN w.broken AND NOT tainted THEN 1 END) AS first_breaks, count(CASE WHEN w.broken AND tainted THEN 1 END) AS cascade,
  count(CASE WHEN o_orderstatus = 'F' AND NOT tainted AND id % 13 <> 0 THEN 1 END) AS clean, count(CASE WHEN o_orderstatus = 'F' AND tainted THEN 1 END) AS below_break,
  count(CASE WHEN o_orderstatus = 'F' AND NOT tainted AND id % 13 = 0 THEN 1 END) AS contradicted, 0::BIGINT AS unscored
FROM w JOIN orders ON id = o_orderkey GROUP BY 1
""")
def a4_break_diagnosis(spark, sf_dir):
    nodes = tree(spark, sf_dir).join(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority"), "id")
    return diagnosis.break_diagnosis(nodes, ["o_orderpriority"], "id", "up", F.col("broken"), F.col("o_orderstatus") == "F", F.col("id") % 13 == 0, F.lit(False))


@query(TREE_SQL + """
SELECT o_orderpriority, count(*) AS total, count(CASE WHEN distance IS NOT NULL THEN 1 END) AS downstream_of_repair, count(CASE WHEN distance IS NULL THEN 1 END) AS clean_line,
  count(CASE WHEN o_custkey % 2 = 0 THEN 1 END) AS settled_from_consumed, CAST(sum(distance) AS BIGINT) AS plies
FROM w JOIN orders ON id = o_orderkey WHERE w.broken GROUP BY 1
""")
def a3_ambiguity_diagnosis(spark, sf_dir):
    up = trees.ancestors(tree(spark, sf_dir), "id", "up", F.col("broken"), F.col("repaired"))
    o = t(spark, sf_dir, "orders").join(up, F.col("o_orderkey") == F.col("id")).where((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 11 == 5))
    rows = o.select("o_orderpriority", F.col("distance").alias("upstream_repair_distance"), F.when(F.col("o_custkey") % 2 == 0, "consumed").alias("settled_by"))
    out = diagnosis.ambiguity_diagnosis(rows, ["o_orderpriority"])
    total = F.aggregate("nearest_repair_plies", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("o_orderpriority", "total", "downstream_of_repair", "clean_line", "settled_from_consumed", F.when(F.size("nearest_repair_plies") > 0, total).alias("plies"))


@query("SELECT source AS book, lang AS verdict, count(*) AS n FROM documents GROUP BY 1, 2")
def a20_verdicts(spark, sf_dir):
    return diagnosis.verdicts(t(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("lang").alias("verdict")), ["book"])


@query("""
WITH i AS (SELECT l_suppkey, l_orderkey % 1000 AS s, l_orderkey % 1000 + 1 + l_partkey % 40 AS e FROM lineitem),
x AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i)
SELECT l_suppkey, CAST(sum(greatest(0, e - greatest(s, coalesce(r, s)))) AS BIGINT) AS covered FROM x GROUP BY 1
""")
def a11_covered_width(spark, sf_dir):
    i = t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 1000).alias("s"), (F.col("l_orderkey") % 1000 + 1 + F.col("l_partkey") % 40).alias("e"))
    return relations.covered_width(i, ["l_suppkey"], "s", "e")


@query("""
WITH b AS (SELECT l_suppkey AS g, CAST((CASE WHEN l_orderkey % 2 = 0 THEN 20 ELSE 240 END) + l_partkey % 7 AS DOUBLE) AS x, CAST(150 + l_linenumber * 9 AS DOUBLE) AS w FROM lineitem),
n AS (SELECT g, count(*) AS n FROM b GROUP BY 1), c AS (SELECT g, n, unnest(range(118, 354)) AS cut FROM n WHERE n >= 8),
s AS (SELECT c.g, c.n, c.cut, (SELECT count(*) FROM b WHERE b.g = c.g AND b.x < c.cut AND c.cut < b.x + b.w) AS crossing FROM c),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY crossing, abs(cut - 236.0), cut) AS k FROM s) WHERE k = 1),
r AS (SELECT k.g, CASE WHEN k.crossing <= greatest(3, 0.05 * k.n) AND least(count(CASE WHEN b.x + b.w <= k.cut THEN 1 END), count(CASE WHEN b.x >= k.cut THEN 1 END)) >= 0.2 * k.n THEN k.cut END AS cut FROM k JOIN b ON b.g = k.g GROUP BY k.g, k.n, k.crossing, k.cut)
SELECT n.g, CAST(r.cut AS BIGINT) AS cut FROM n LEFT JOIN r USING (g)
""")
def a12_column_cut(spark, sf_dir):
    x = F.when(F.col("l_orderkey") % 2 == 0, 20).otherwise(240) + F.col("l_partkey") % 7
    b = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), x.cast("double").alias("x"), (150 + F.col("l_linenumber") * 9).cast("double").alias("w"))
    return longs(relations.column_cut(b, ["g"], F.lit(472.0), F.lit(236.0)), "cut")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1 AS variation_index FROM orders")
def a14_variation_index(spark, sf_dir):
    return longs(trees.variation_index(t(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderkey"]).select("o_orderkey", "variation_index"), "variation_index")


@query("""
WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)
SELECT label, CAST(k AS BIGINT) AS k, round(avg(CAST(v AS DOUBLE)), 6) AS centre FROM e GROUP BY 1, 2
""")
def a15_centroids(spark, sf_dir):
    return longs(pictures.centroids(t(spark, sf_dir, "embeddings"), ["label"], "embedding").withColumn("centre", F.round("centre", 6)), "k")


@query("""
WITH c AS (SELECT l_suppkey AS g, l_linenumber AS row, l_orderkey % 8 AS col, l_returnflag || l_partkey % 9 AS char FROM lineitem),
s AS (SELECT g, char, count(DISTINCT row) AS r, count(DISTINCT col) AS c, count(*) AS n FROM c GROUP BY 1, 2)
SELECT g, CAST(coalesce(sum(CASE WHEN r > 1 AND c > 1 THEN n END), 0) AS BIGINT) AS spread FROM s GROUP BY 1
""")
def a18_spread(spark, sf_dir):
    c = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("row"), (F.col("l_orderkey") % 8).alias("col"), F.concat("l_returnflag", (F.col("l_partkey") % 9).cast("string")).alias("char"))
    return relations.spread(c, ["g"])


CANDIDATES_SQL = "SELECT o_custkey % 50 AS board, k AS candidate, count(CASE WHEN (o_orderkey * (k + 3)) % 7 < 3 THEN 1 END) AS score FROM orders, (SELECT unnest(range(12)) AS k) GROUP BY 1, 2"


def candidate_scores(spark, sf_dir) -> DataFrame:
    """Every candidate's score on every board from one pass over the rows."""
    c = range(12)
    sums = F.array(*(F.struct(F.lit(k).cast("long").alias("candidate"), F.count_if((F.col("o_orderkey") * (k + 3)) % 7 < 3).alias("score")) for k in c))
    return t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("board")).agg(sums.alias("s")).select("board", F.explode("s").alias("s")).select("board", "s.*")


@query(f"WITH s AS ({CANDIDATES_SQL}), r AS (SELECT *, rank() OVER (PARTITION BY board ORDER BY score DESC) AS r FROM s) SELECT board, candidate, score FROM r WHERE r = 1 AND score > 0")
def a19_j14_all_best_candidates(spark, sf_dir):
    return relations.all_best(candidate_scores(spark, sf_dir), ["board"], "score")


@query(f"WITH s AS ({CANDIDATES_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY score DESC, candidate) AS r FROM s) SELECT board, candidate, score FROM r WHERE r = 1")
def a23_j13_first_best_candidate(spark, sf_dir):
    return relations.first_best(candidate_scores(spark, sf_dir), ["board"], ["score"], "candidate")


@query("SELECT o_custkey AS book_id, count(DISTINCT o_orderdate) AS pages, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS broken, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS uncertain FROM orders GROUP BY 1")
def a25_annotated_pages(spark, sf_dir):
    from ..operators.reader import annotated_pages

    status = F.when(F.col("o_orderstatus") == "P", "broken").when(F.col("o_orderstatus") == "O", "uncertain").otherwise("ok")
    moves = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderdate").alias("page"), status.alias("status"))
    return annotated_pages(moves).groupBy("book_id").agg(F.count("*").alias("pages"), F.sum("broken").alias("broken"), F.sum("uncertain").alias("uncertain"))


@query("SELECT o_custkey, o_orderdate AS page, moves FROM (SELECT o_custkey, o_orderdate, count(*) AS moves, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderdate) AS k FROM orders GROUP BY 1, 2) WHERE k = 1")
def a26_fullest_page(spark, sf_dir):
    per = t(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderdate").alias("page")).agg(F.count("*").alias("moves"))
    return relations.first_best(per, ["o_custkey"], ["moves"], "page")


@query("SELECT o_orderkey // 2 AS parent, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS children FROM orders WHERE o_orderkey > 0 GROUP BY 1")
def a27_t12_o10_children(spark, sf_dir):
    n = tree(spark, sf_dir).where("up is not null").withColumn("variation_index", F.col("id"))
    return trees.children(n, "up").select("parent", F.array_join("children", ",").alias("children"))


# --- joins ---


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j3_anti(spark, sf_dir):
    return relations.without(t(spark, sf_dir, "customer").select("c_custkey"), t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""
SELECT c_custkey, 'order' AS kind FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
""")
def j4_u2_fallback(spark, sf_dir):
    first = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit("order").alias("kind")).distinct()
    return relations.unless_found(first, t(spark, sf_dir, "customer").select("c_custkey", F.lit("none").alias("kind")), ["c_custkey"])


@query("SELECT c.o_orderkey, c.o_orderkey // 2 AS up, p.o_totalprice AS parent_price FROM orders c LEFT JOIN orders p ON c.o_orderkey > 0 AND p.o_orderkey = c.o_orderkey // 2")
def j5_parent_lookup(spark, sf_dir):
    n = trees.with_parent(tree(spark, sf_dir), ["o_totalprice"], "id", "up", "parent_")
    return n.select(F.col("id").alias("o_orderkey"), F.expr("id div 2").alias("up"), F.col("parent_o_totalprice").alias("parent_price"))


@query("SELECT c_custkey, string_agg(CAST(o_orderkey AS VARCHAR) || o_orderstatus, ',' ORDER BY o_orderkey) AS held FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j1_j2_attach(spark, sf_dir):
    """All items of a page, in order, beside it."""
    o = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    a = relations.attached(t(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], "held", "o_orderkey", "o_orderstatus")
    return a.select("c_custkey", F.array_join(F.transform("held", lambda x: F.concat(x.o_orderkey.cast("string"), x.o_orderstatus)), ",").alias("held"))


PLACES_SQL = """
WITH a AS (SELECT o_orderkey AS id, o_custkey % 20 AS page, o_orderkey * 7 % 5000 AS x, o_custkey * 13 % 5000 AS y, 5 + o_orderkey % 9 AS w, 4 + o_custkey % 5 AS h FROM orders),
b AS (SELECT c_custkey AS id, c_custkey % 20 AS page, c_custkey * 11 % 5000 AS x, c_custkey * 17 % 5000 AS y, 40 AS w, 30 AS h FROM customer)
"""


def places(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = t(spark, sf_dir, "orders").select(k.alias("id"), (c % 20).alias("page"), (k * 7 % 5000).alias("x"), (c * 13 % 5000).alias("y"), (5 + k % 9).alias("w"), (4 + c % 5).alias("h"))
    c = F.col("c_custkey")
    b = t(spark, sf_dir, "customer").select(c.alias("id"), (c % 20).alias("page"), (c * 11 % 5000).alias("x"), (c * 17 % 5000).alias("y"), F.lit(40).cast("long").alias("w"), F.lit(30).cast("long").alias("h"))
    return a, b


@query(PLACES_SQL + "SELECT a.page, a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.page = b.page AND least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y)")
def j6_j7_boxes_overlap(spark, sf_dir):
    return relations.boxes_overlap(*places(spark, sf_dir), ["page"], 40.0)


@query("""
WITH p AS (SELECT event_id, user_id % 25 AS page, event_id * 37 % 4000 AS pos FROM events), i AS (SELECT p_partkey AS token, p_partkey % 25 AS page, p_partkey * 3 % 4000 AS s, p_partkey * 3 % 4000 + 1 + p_size % 6 AS e FROM part)
SELECT event_id, min(token) AS token FROM p LEFT JOIN i ON p.page = i.page AND s <= pos AND pos < e GROUP BY 1
""")
def j8_point_in_interval(spark, sf_dir):
    p = t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).alias("page"), (F.col("event_id") * 37 % 4000).alias("at"))
    k = F.col("p_partkey")
    i = t(spark, sf_dir, "part").select(k.alias("token"), (k % 25).alias("page"), (k * 3 % 4000).alias("s"), (k * 3 % 4000 + 1 + F.col("p_size") % 6).alias("e"))
    return relations.point_in_interval(p, i, ["page"], "event_id", "at", "token", "s", "e", 16)


@query("""
WITH l AS (SELECT event_id, user_id % 25 AS page, event_id * 37 % 40000 AS y FROM events), r AS (SELECT p_partkey, p_partkey % 25 AS page, p_partkey * 31 % 40000 AS ry FROM part)
SELECT l.event_id, first(p_partkey ORDER BY abs(y - ry), p_partkey) FILTER (WHERE p_partkey IS NOT NULL) AS p_partkey, min(abs(y - ry)) AS distance FROM l LEFT JOIN r ON l.page = r.page AND abs(y - ry) <= 30 GROUP BY 1
""")
def j9_nearest_within(spark, sf_dir):
    l = t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).alias("page"), (F.col("event_id") * 37 % 40000).alias("y"))  # noqa: E741
    r = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 25).alias("page"), (F.col("p_partkey") * 31 % 40000).alias("ry"))
    return relations.nearest_within(l, r, ["page"], "event_id", "y", "p_partkey", "ry", 30)


@query("""
WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), b AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT event_id, a.user_id, a.k AS occurrence, o_orderkey FROM a LEFT JOIN b ON a.user_id = b.o_custkey AND a.k = b.k
""")
def j10_w11_by_occurrence(spark, sf_dir):
    e, o = t(spark, sf_dir, "events").select("event_id", "user_id"), t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return longs(relations.by_occurrence(e, o, ["user_id"], ["event_id"], ["o_orderkey"]).select("event_id", "user_id", "occurrence", "o_orderkey"), "occurrence")


@query("""
WITH r AS (SELECT p_partkey AS id, p_partkey % 40 AS page, p_partkey * 7 % 3000 AS y, p_size AS x0, p_size + 30 + p_partkey % 50 AS x1 FROM part)
SELECT a.page, a.id AS a_id, b.id AS b_id FROM r a JOIN r b ON a.page = b.page AND b.y - a.y BETWEEN 20 AND 60 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 20
""")
def j11_rule_pairs(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    r = t(spark, sf_dir, "part").select(k.alias("id"), (k % 40).alias("page"), (k * 7 % 3000).alias("y"), s.alias("x0"), (s + 30 + k % 50).alias("x1"))
    return relations.rule_pairs(r, ["page"], 20, 60)


@query("SELECT p_partkey, CAST(i AS BIGINT) AS pos, string_split(p_name, ' ')[i] AS a, string_split(p_type, ' ')[i] AS b FROM (SELECT *, unnest(range(1, 1 + greatest(len(string_split(p_name, ' ')), len(string_split(p_type, ' '))))) AS i FROM part)")
def j16_f21_zip(spark, sf_dir):
    return longs(relations.zipped(t(spark, sf_dir, "part"), ["p_partkey"], a=F.split("p_name", " "), b=F.split("p_type", " ")), "pos")


@query("""
WITH x AS (SELECT p_partkey, list_distinct(list_intersect(string_split(p_name, ''), string_split(p_brand, ''))) AS s FROM part)
SELECT p_partkey, CASE WHEN len(s) = 1 THEN s[1] END AS settled FROM x
""")
def j18_u3_hints(spark, sf_dir):
    """The one candidate that the hints name, if it is the only one."""
    return t(spark, sf_dir, "part").select("p_partkey", chess.settled(F.split("p_name", ""), F.split("p_brand", "")).alias("settled"))


@query("""
WITH a AS (SELECT conv_id AS k, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1), b AS (SELECT conv_id AS k, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.n AS want, b.n AS got FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n
""")
def j21_misaligned(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "k")
    n = lambda role: c.where(F.col("role") == role).groupBy("k").agg(F.count("*").alias("n"))
    return relations.misaligned(n("user"), n("assistant"), ["k"], "n")


# --- windows, order, sets ---


@query("""
WITH p AS (SELECT source AS book, doc_id AS page, length(text) - length(replace(text, '.', '')) AS numbers, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS starts FROM documents),
w AS (SELECT book, page AS first_page, sum(starts) OVER f AS starts, sum(numbers) OVER f AS numbers, max(page) OVER f AS last_page, count(*) OVER f AS k, row_number() OVER (PARTITION BY book ORDER BY page) AS r FROM p WINDOW f AS (PARTITION BY book ORDER BY page ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
b AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY CASE WHEN k = 12 THEN 0 ELSE 1 END, starts DESC, numbers DESC, first_page) AS z FROM w WHERE k = 12 OR r = 1)
SELECT book, first_page, last_page, CAST(starts AS BIGINT) AS starts, CAST(numbers AS BIGINT) AS numbers FROM b WHERE z = 1
""")
def w1_best_window(spark, sf_dir):
    d = t(spark, sf_dir, "documents").withColumnRenamed("source", "book")
    return longs(relations.best_window(d, "book", "doc_id", (F.col("n_chars") > 2000).cast("int"), F.length("text") - F.length(F.replace("text", F.lit("."))), 12), "starts", "numbers")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN length(text) > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS k FROM conversations) WHERE k = 1")
def w2_context(spark, sf_dir):
    return relations.with_context(t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.length("text") > 150).select("conv_id", "turn")


@query("WITH b AS (SELECT conv_id, turn, 1000 - 12 * turn AS y, 10 + length(text) % 9 AS h FROM conversations) SELECT conv_id, turn, CASE WHEN y + h > lag(y) OVER w THEN h - (y + h - lag(y) OVER w) ELSE h END AS h FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w4_separate(spark, sf_dir):
    b = t(spark, sf_dir, "conversations").select("conv_id", "turn", (1000 - 12 * F.col("turn")).alias("y"), (10 + F.length("text") % 9).alias("h"))
    return longs(relations.separated(b, ["conv_id"], ["turn"]).select("conv_id", "turn", "h"), "h")


@query("""
WITH c AS (SELECT conv_id, turn, length(text) // 100 AS v FROM conversations), d AS (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER w AND turn > min(turn) OVER w THEN 0 ELSE 1 END AS c FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM d)
SELECT conv_id, CAST(run AS BIGINT) AS run, CAST(v AS BIGINT) AS v, count(*) AS length, min(turn) AS first FROM e GROUP BY 1, 2, 3
""")
def w6_w9_runs(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("length(text) div 100").alias("v"))
    return longs(relations.runs(c, ["conv_id"], ["turn"], "v"), "run", "v")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM conversations")
def w12_carried_forward(spark, sf_dir):
    return trees.carried_forward(t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn"))).select("conv_id", "turn", "carried")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END, o_totalprice, o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F') WHERE k <= 3
""")
def o3_p21_problems(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "broken").when(F.col("o_orderstatus") == "O", "uncertain").otherwise("ok")
    m = t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), status.alias("status"), F.col("o_totalprice").alias("confidence"))
    return diagnosis.problems(m, ["o_custkey"], 3).select("o_custkey", F.col("ord").alias("o_orderkey"), "confidence")


@query("SELECT source AS book, coalesce(min(CASE WHEN doc_id > 500 THEN doc_id END), min(doc_id)) AS next_page FROM documents GROUP BY 1")
def o11_next_page(spark, sf_dir):
    return relations.next_page(t(spark, sf_dir, "documents").withColumnRenamed("source", "book"), ["book"], "doc_id", F.lit(500))


@query("SELECT threshold, event_type, count(CASE WHEN value >= threshold THEN 1 END) AS accepted, count(CASE WHEN value >= threshold AND user_id % 3 = 0 THEN 1 END) AS hits FROM events, (VALUES (10.0::DOUBLE), (30.0), (50.0), (70.0)) v(threshold) GROUP BY 1, 2")
def l9_threshold_sweep(spark, sf_dir):
    return relations.sweep(t(spark, sf_dir, "events"), [10.0, 30.0, 50.0, 70.0], ["event_type"], "value", F.col("user_id") % 3 == 0)


@query("SELECT user_id AS move_id, event_type AS type, event_id AS ord, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def l1_latest_patch(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("move_id"), F.col("event_type").alias("type"), F.col("event_id").alias("ord"), "value")
    return patches.latest(e, ["move_id", "type"], ["ord"])


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = o_orderkey % 25)")
def l2_edition_guard(spark, sf_dir):
    p = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("book_id"), (F.col("o_orderkey") % 25).cast("string").alias("sha256"))
    a = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_nationkey").cast("string").alias("sha256"))
    return patches.of_edition(p, a).select("o_orderkey")


@query("""
WITH RECURSIVE w AS (SELECT o_orderkey AS target, o_orderkey AS id, 0 AS up FROM orders UNION ALL SELECT target, id // 2, up + 1 FROM w WHERE id > 0)
SELECT target, CAST(max(up) OVER (PARTITION BY target) - up AS BIGINT) AS depth, id FROM w
""")
def t11_line_to(spark, sf_dir):
    n = tree(spark, sf_dir)
    return longs(trees.line_to(n, n, "id", "up"), "depth")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'nation', n_nationkey, n_nationkey FROM nation")
def u1_union_all(spark, sf_dir):
    kinds = (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey"), ("nation", "n_nationkey", "n_nationkey"))
    return relations.together(*(t(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.col(k).cast("long").alias("id"), F.col(n).alias("nation")) for name, k, n in kinds))


@query("""
WITH p AS (SELECT p_partkey, p_brand, p_type, translate(p_brand, '0Oo1lI8B5S2Z6b9g', '') AS a, translate(p_type, '0Oo1lI8B5S2Z6b9g', '') AS b FROM part)
SELECT p_partkey, CAST(levenshtein(a, b) AS DOUBLE) AS cost, 0.5 * (length(p_brand) - length(translate(p_brand, '0158', '')))::DOUBLE AS alike, CAST(length(regexp_replace(p_type, '[aeiouAEIOU ]', '', 'g')) AS BIGINT) AS common FROM p
""")
def f9_f10_distances(spark, sf_dir):
    """Edit distance of words without look-alikes, half its cost for look-alikes alone, and the common part of a word and its consonants."""
    bare = lambda c: F.translate(c, "0Oo1lI8B5S2Z6b9g", "")
    seen = F.translate("p_brand", "0158", "OlSB")
    consonants = F.regexp_replace("p_type", "[aeiouAEIOU ]", "")
    p = t(spark, sf_dir, "part")
    return longs(p.select("p_partkey", chess.confusable_distance(bare("p_brand"), bare("p_type")).alias("cost"), chess.confusable_distance("p_brand", seen).alias("alike"), chess.common_subsequence("p_type", consonants).alias("common")), "common")


@query("SELECT p_partkey, CAST(length(p_brand) - 1 AS BIGINT) AS common FROM part")
def l6_functions_by_name(spark, sf_dir):
    """A function of rows, called by its name from SQL."""
    chess.register(spark, "book_")
    t(spark, sf_dir, "part").createOrReplaceTempView("book_parts")
    return longs(spark.sql("SELECT p_partkey, book_common_subsequence(p_brand, substring(p_brand, 2)) AS common FROM book_parts"), "common")


@query("""
SELECT o_orderkey, 'rnbqkbnr/8/8/8/8/8/8/R3K2' || CASE WHEN o_orderkey % 2 = 0 THEN 'R' ELSE 'N' END || CASE WHEN o_orderkey % 3 = 0 THEN ' b ' ELSE ' w ' END ||
  CASE WHEN o_orderkey % 2 = 0 THEN 'KQkq' ELSE 'Qkq' END || ' - 0 ' || (o_orderkey + 1) AS fen FROM orders
""")
def f27_full_fen(spark, sf_dir):
    k = F.col("o_orderkey")
    placement = F.concat(F.lit("rnbqkbnr/8/8/8/8/8/8/R3K2"), F.when(k % 2 == 0, "R").otherwise("N"))
    n = t(spark, sf_dir, "orders").withColumn("placement", placement)
    return n.select("o_orderkey", chess.full_fen("placement", k + 1, k % 3 == 0).alias("fen"))


@query("""
WITH g AS (SELECT label, vec_id, vec_id % 7 AS kind, count(*) OVER (PARTITION BY label, vec_id % 7) AS n, min(vec_id) OVER (PARTITION BY label, vec_id % 7) AS first FROM embeddings),
r AS (SELECT label, first, row_number() OVER (PARTITION BY label ORDER BY first) - 1 AS k FROM (SELECT DISTINCT label, first FROM g WHERE n > 1)),
c AS (SELECT label, count(*) AS kinds FROM r GROUP BY 1),
f AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM g WHERE n = 1)
SELECT g.vec_id, g.label, CAST(coalesce(r.k, coalesce(c.kinds, 0) + f.k) AS INTEGER) AS cluster FROM g LEFT JOIN r ON g.label = r.label AND g.first = r.first LEFT JOIN c ON c.label = g.label LEFT JOIN f ON f.label = g.label AND f.vec_id = g.vec_id
""")
def i8_o9_cluster(spark, sf_dir):
    """Ordered clustering of signatures: seven kinds of squares, told apart by one coordinate and blurred by embeddings; a label is a book."""
    import numpy as np
    import pandas as pd

    from ..kernels import images

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("vec_id")
        squares = [np.asarray(v[:20], dtype=float) * 1e-4 + 4.0 * (np.arange(20) == k % 7) for k, v in zip(f["vec_id"], f["embedding"])]
        return pd.DataFrame({"vec_id": f["vec_id"], "label": f["label"], "cluster": images.cluster(squares)})

    return t(spark, sf_dir, "embeddings").groupBy("label").applyInPandas(solve, "vec_id bigint, label int, cluster int")


@query(f"SELECT CAST(o_custkey % 97 AS VARCHAR) AS book_id, o_orderkey AS page, 0 AS idx, {MOVE_SQL} AS text, 0 AS column, true AS has_notation FROM orders")
def i18_segment_lines(spark, sf_dir):
    """Composed notation set in pages and cut into printed lines."""
    from ..operators.books import segment_lines

    pages = page_sources.of_texts(notation_lines(spark, sf_dir).select(F.col("book").cast("string").alias("book_id"), "page", "text"))
    return segment_lines(pages).select("book_id", F.col("page").cast("bigint").alias("page"), "idx", "text", "column", "has_notation")


# --- more geometry and predicates ---


@query(f"WITH b AS ({BOXES_SQL}) SELECT l_orderkey, l_partkey, l_linenumber, 100 + x / 4 AS px, 50 + 700 - (y + h) / 4 AS py, w / 4 AS pw, h / 4 AS ph FROM b")
def p4_crop_to_page(spark, sf_dir):
    clip = geometry.box(F.lit(100.0), F.lit(50.0), F.lit(200.0), F.lit(700.0))
    b = boxes(spark, sf_dir).withColumn("clip", clip)
    r = geometry.crop_to_page("clip", F.lit(4.0), F.col("box.x"), F.col("box.y"), F.col("box.w"), F.col("box.h"))
    return b.select("l_orderkey", "l_partkey", "l_linenumber", r["x"].alias("px"), r["y"].alias("py"), r["w"].alias("pw"), r["h"].alias("ph"))


@query("""
WITH c AS (SELECT o_orderkey, unnest(range(0, 6)) AS k FROM orders), b AS (SELECT o_orderkey, k, (o_orderkey * (k + 2)) % 90 AS x, (o_orderkey * 3 + k) % 40 AS y, (o_orderkey + k) % 4 AS w, 1 + k AS h FROM c)
SELECT o_orderkey, CAST(min(x) AS DOUBLE) AS x, CAST(min(y) AS DOUBLE) AS y, CAST(max(x + w) - min(x) AS DOUBLE) AS w, CAST(max(y + h) - min(y) AS DOUBLE) AS h FROM b WHERE k BETWEEN 1 AND 4 AND w > 0 GROUP BY 1
""")
def p3_box_of_slice(spark, sf_dir):
    k = F.col("o_orderkey")
    char = lambda i: F.struct(geometry.box((k * (i + 2)) % 90, (k * 3 + i) % 40, (k + i) % 4, 1 + i).alias("bbox"))
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.transform(F.sequence(F.lit(0), F.lit(5)), char).alias("chars"))
    return o.select("o_orderkey", geometry.of_slice("chars", F.lit(1), F.lit(5)).alias("u")).where("u is not null").select("o_orderkey", "u.*")


@query(f"""
WITH b AS ({BOXES_SQL}), p AS (SELECT a.l_orderkey, a.l_partkey AS a, b.l_partkey AS b, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS shared, least(a.h, b.h) AS low, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS across, a.w AS w
FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT l_orderkey, a, b, shared >= 0.5 * low AS same_row, across >= 0.8 * w AS inside FROM p
""")
def p15_p16_overlaps(spark, sf_dir):
    b = boxes(spark, sf_dir)
    one, two = (b.select("l_orderkey", F.col("l_partkey").alias(n), F.col("l_linenumber").alias(n + "_line"), F.col("box").alias(n + "_box")) for n in "ab")
    j = one.join(two, "l_orderkey").where("a_line < b_line")
    return j.select("l_orderkey", "a", "b", geometry.rows_overlap("a_box", "b_box").alias("same_row"), geometry.mostly_inside("a_box", "b_box").alias("inside"))


@query(r"""SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9])[0-9]{1,3}[ \t\n\r\f\v]*\.') AS numbered, coalesce(regexp_matches(regexp_extract(trim(text), '([^ \t\n\r\f\v]+)$', 1), '^[A-Za-z][a-z]*[.,;:!?)"”»]*$'), false) AS prose FROM documents""")
def p11_p20_text_predicates(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(MOVE_NUMBER).alias("numbered"), text.ends_in_word("text").alias("prose"))


@query("SELECT event_type, least(1.0, count(*) / 200.0) AS confidence, CAST(sum(CASE WHEN value >= 0.45 THEN 1 ELSE 0 END) AS BIGINT) AS confident FROM events GROUP BY 1")
def a7_f18_p13_saturating(spark, sf_dir):
    g = t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= glyphs.MIN_CONFIDENCE).alias("confident"))
    return g.select("event_type", text.saturating(F.col("n"), 200).alias("confidence"), "confident")


@query("""
SELECT o_orderkey, CAST(length(p) - length(replace(p, 'P', '')) AS BIGINT) AS white_pawns, CAST(length(p) - length(replace(p, 'r', '')) AS BIGINT) AS black_rooks
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR' ELSE '8/5pk1/6p1/8/8/6P1/5PK1/r7' END AS p FROM orders)
""")
def a17_piece_counts(spark, sf_dir):
    p = F.when(F.col("o_orderkey") % 2 == 0, "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR").otherwise("8/5pk1/6p1/8/8/6P1/5PK1/r7")
    n = t(spark, sf_dir, "orders").select("o_orderkey", p.alias("p"))
    return longs(n.select("o_orderkey", chess.piece_count("p", "P").alias("white_pawns"), chess.piece_count("p", "r").alias("black_rooks")), "white_pawns", "black_rooks")


@query("""
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
m AS (SELECT vec_id, avg(CASE WHEN (k // 8 + k % 8) % 2 = 0 THEN v END) AS light, avg(CASE WHEN (k // 8 + k % 8) % 2 = 1 THEN v END) AS dark FROM e GROUP BY 1)
SELECT vec_id, round(light, 6) AS light, round(dark, 6) AS dark, abs(light - dark) >= 0.04 AS is_board FROM m
""")
def a16_ground_shades(spark, sf_dir):
    """Shades of the two parities of an 8 x 8 board, and whether they are far enough apart."""
    g = pictures.ground_shades(t(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")
    return g.select("vec_id", F.round("light", 6).alias("light"), F.round("dark", 6).alias("dark"), "is_board")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'O-O-O' WHEN o_orderkey % 3 = 1 THEN 'O-O' ELSE 'Nf3+' END AS plain, CASE WHEN o_orderkey % 3 = 2 THEN 'Nf3' WHEN o_orderkey % 3 = 0 THEN 'O-O-O' ELSE 'O-O' END AS bare,
  2 * (o_orderkey % 60) + CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS ply FROM orders
""")
def f12_f19_moves_and_plies(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, " 0-0-0!?").when(k % 3 == 1, "0-0!").otherwise("Nf3+")
    o = t(spark, sf_dir, "orders").withColumn("plain", text.bare_move(raw))
    return o.select("o_orderkey", "plain", text.without_check("plain").alias("bare"), chess.ply_of(k % 60 + 1, F.col("o_custkey") % 2 == 0).alias("ply"))


@query("SELECT source, array_to_string(list_sort(list(doc_id))[greatest(1, 15 - 12):15 + 12], ',') AS around FROM documents GROUP BY 1")
def w5_around(spark, sf_dir):
    near = relations.around(t(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], F.lit(14), 12)
    return near.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("around"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def s1_s3_s5_blocks(spark, sf_dir):
    letters = F.transform(F.split("text", ""), lambda c: F.struct(c.alias("char"), geometry.filler().alias("bbox"), F.lit("").alias("font"), F.lit(1.0).alias("size"), F.lit("").alias("consumed")))
    c = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.lit(1).alias("page"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), F.lit(0).alias("block"), F.col("turn").cast("double").alias("y0"), F.lit(0.0).alias("x0"), F.array(letters).alias("lines"))
    return page_sources.of_blocks(c, sort_blocks=True).select(F.col("book_id").alias("conv_id"), "text")


# --- symbols ---


@query("SELECT CAST(o_custkey % 97 AS VARCHAR) AS book_id, count(*) AS placed, count(*) AS total FROM orders GROUP BY 1")
def i17_j6_j19_repair(spark, sf_dir):
    """Recovered symbols written into composed notation, and how many landed in moves."""
    from ..operators.books import repair_pages

    lines = notation_lines(spark, sf_dir).select(F.col("book").cast("string").alias("book_id"), "page", F.regexp_replace("text", "[KQRBN]", "t").alias("text"))
    pages = page_sources.of_texts(lines)
    at = F.expr("instr(text, 't') - 1").cast("double")
    found = lines.select("book_id", F.lit("N").alias("piece"), F.lit(0.9).alias("confidence"), "page", geometry.box(at, F.lit(700.0), F.lit(1.0), F.lit(10.0)).alias("bbox"), F.lit(1.6).alias("width_ratio"))
    return longs(glyphs.placement_score(repair_pages(pages, found.withColumn("page", F.col("page").cast("int")))), "placed", "total")


FOUND_SQL = "WITH f AS (SELECT user_id % 50 AS page, user_id AS line_no, event_id AS ord, substr('KQRBN', CAST(event_id % 5 AS INT) + 1, 1) AS piece, value / 100 AS confidence FROM events) "
THRESHOLD_SQL = "(VALUES " + ", ".join(f"({x}::DOUBLE)" for x in glyphs.THRESHOLDS) + ") v(threshold)"


def found_symbols(spark, sf_dir) -> DataFrame:
    piece = F.substr(F.lit("KQRBN"), (F.col("event_id") % 5).cast("int") + 1, F.lit(1))
    return t(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("page"), F.col("user_id").alias("line_no"), F.col("event_id").cast("int").alias("ord"), piece.alias("piece"), (F.col("value") / 100).alias("confidence"))


def true_symbols(found: DataFrame) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("ord", "piece")))
    return found.groupBy("page", "line_no").agg(F.array_join(F.transform(held, lambda x: x.piece), "").alias("pieces"))


@query(FOUND_SQL + f"SELECT threshold, count(CASE WHEN confidence >= threshold THEN 1 END) AS recovered, count(*) AS total, 0::BIGINT AS invented FROM f, {THRESHOLD_SQL} GROUP BY 1")
def a21_glyph_scores(spark, sf_dir):
    """Threshold sweep of symbols against a transcript of all of them, by common subsequence of each line."""
    found = found_symbols(spark, sf_dir)
    return longs(glyphs.scores(found, true_symbols(found), ["page", "line_no"]), "recovered", "total", "invented")


@query(FOUND_SQL + "SELECT piece, count(*) AS n FROM f WHERE confidence >= 0.45 GROUP BY 1")
def a29_piece_counts(spark, sf_dir):
    return glyphs.piece_counts(found_symbols(spark, sf_dir))


@query(FOUND_SQL + """
, l AS (SELECT page, line_no, string_agg(piece, '' ORDER BY ord) AS want, coalesce(string_agg(CASE WHEN confidence >= 0.45 THEN piece END, '' ORDER BY ord), '') AS got FROM f GROUP BY 1, 2)
SELECT * FROM l WHERE want <> got
""")
def l11_mismatches(spark, sf_dir):
    """Lines of a transcript that the sure symbols do not spell."""
    found = found_symbols(spark, sf_dir)
    return glyphs.mismatches(found, true_symbols(found), ["page", "line_no"]).drop("candidates")


@query(f"""
WITH p AS (SELECT o_custkey % 97 AS book_id, o_orderkey AS page, {MOVE_SQL} AS text, o_orderkey % 12 AS x FROM orders)
SELECT CAST(book_id AS VARCHAR) AS book_id, page, CAST(CASE WHEN page % 5 = 0 OR x >= length(text) THEN length(text) ELSE x - length(regexp_extract(left(text, CAST(x AS INT)), '([^ ]*)$', 1)) END AS BIGINT) AS start FROM p
""")
def j20_picture_places(spark, sf_dir):
    """Where pictures stand in their pages' texts; every fifth hangs too low to have text below."""
    lines = notation_lines(spark, sf_dir).select(F.col("book").cast("string").alias("book_id"), F.col("page").cast("int").alias("page"), "text")
    low = F.when(F.col("page") % 5 == 0, 709.0).otherwise(710.0)
    boards = lines.select("book_id", "page", F.lit(0).alias("ord"), geometry.box((F.col("page") % 12).cast("double"), low, F.lit(30.0), F.lit(30.0)).alias("bbox"))
    return longs(pictures.place(boards, page_sources.of_texts(lines)).drop("ord"), "page", "start")


@query(f"WITH b AS ({BOXES_SQL}) SELECT l_orderkey, l_partkey, l_linenumber FROM b WHERE w * 3 >= 60 AND (w * 3) / (h * 20) BETWEEN 0.85 AND 1.18 AND (w * 3) * (h * 20) <= 0.5 * 12000 AND l_partkey % 100 >= 64")
def s7_pictures_like_boards(spark, sf_dir):
    """Pictures wide enough, square enough, not most of their page and with pixels enough."""
    b = boxes(spark, sf_dir).select("l_orderkey", "l_partkey", "l_linenumber", geometry.box(F.col("box.x"), F.col("box.y"), F.col("box.w") * 3, F.col("box.h") * 20).alias("bbox"), F.lit(12000.0).alias("page_area"), (F.col("l_partkey") % 100).alias("width"), F.lit(200).alias("height"))
    return pictures.shaped_like_boards(b).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def l4_windowed_events(spark, sf_dir):
    """Events per hour and type, run as a stream to its end; nothing is late as the stream reads all files at once."""
    from ..streaming.books import event_counts
    from .checkpoints import stream_to_end

    events = spark.readStream.schema(t(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream_to_end(event_counts(events, "1 hour", "1000 days"), "complete")
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books composed from orders, read whole and diagnosed."""
    from .run import run

    lines = notation_lines(spark, sf_dir).select(F.concat(F.lit("book "), F.col("book").cast("string")).alias("book_id"), "page", "text")
    return run(page_sources.of_texts(lines))["counts"]


from . import book_queries  # noqa: E402  (registers its queries)

__all__ = ["ORACLES", "QUERIES", "W", "book_queries", "flagship"]
