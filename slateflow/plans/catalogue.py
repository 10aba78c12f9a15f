"""The registered queries of the layout operators, with SQL that computes the same.

The given tables hold no slides, so boxes, sizes and colours are derived from their columns by the same
arithmetic on both sides; every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import color, layout, matching, typography

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark, sf_dir: str) -> DataFrame:
    d = lambda c: c.cast("double")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("slide"),
        (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("ord"),
        d((F.col("l_partkey") * 7) % 600).alias("x"),
        d((F.col("l_suppkey") * 13 + F.col("l_linenumber") * 17) % 160).alias("y"),
        d(F.col("l_quantity").cast("int") % 60 + 20).alias("width"),
        d(F.col("l_partkey") % 9 + 10).alias("height"),
    )


BOXES = """b AS (SELECT l_orderkey AS slide, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord, CAST((l_partkey * 7) % 600 AS DOUBLE) AS x,
  CAST((l_suppkey * 13 + l_linenumber * 17) % 160 AS DOUBLE) AS y, CAST(CAST(l_quantity AS INT) % 60 + 20 AS DOUBLE) AS width,
  CAST(l_partkey % 9 + 10 AS DOUBLE) AS height FROM lineitem)"""
SQL_CLEAN = r"trim(regexp_replace({}, '[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x0b]+', ' ', 'g'), ' ')"


def sql_key(c: str) -> str:
    return SQL_CLEAN.format(r"regexp_replace(replace(lower(" + SQL_CLEAN.format(c) + r"), 'ß', 'ss'), '[^\p{L}\p{N}_\s%./:+-]', '', 'g')")


@query(f"SELECT doc_id, {SQL_CLEAN.format('text')} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, md5(k) AS key_md5, CAST(len(list_distinct(list_filter(string_split(k, ' '), lambda t: t <> ''))) AS INT) AS n_tokens FROM (SELECT doc_id, {sql_key('text')} AS k FROM documents)")
def match_normalize_tokens(spark, sf_dir):
    k = T.match_key(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", k.alias("k")).select("doc_id", F.md5("k").alias("key_md5"), F.size(T.tokens(F.col("k"))).alias("n_tokens"))


@query("SELECT min(doc_id) AS doc_id, md5(replace(lower(text), 'ß', 'ss')) AS key_md5 FROM documents WHERE text IS NOT NULL GROUP BY replace(lower(text), 'ß', 'ss')")
def stable_dedupe_casefold(spark, sf_dir):
    """The first document of each folded text; null texts have no key and go."""
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss"))).alias("key_md5"))
    # the first of each key is a minimum, which is combined before the shuffle
    return rows.groupBy("key_md5").agg(F.min("doc_id").alias("doc_id"))


_SCRIPTS = ["한글 title", "English title", "日本語", "カナ", "x", "\u31c0", "\u2f00", "\u2e80", "· a", "▪ b", "‣ c", "● d", "12) e", "F. g", "•h"]


@query(
    f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT * FROM (VALUES {', '.join(f"('s{i}', '{s}')" for i, s in enumerate(_SCRIPTS))}))
SELECT id, regexp_matches(text, '{T.KOREAN}') AS korean, regexp_matches(text, '{T.CJK}') AS cjk, regexp_matches(text, '{T.BULLET}') AS bullet, CASE WHEN regexp_matches(text, '{T.KOREAN}') THEN 'ko' ELSE 'en' END AS language FROM t"""
)
def script_language_tag(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    rows = rows.unionByName(read(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit("-"), "turn").alias("id"), "text"))
    rows = rows.unionByName(spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(_SCRIPTS)], "id string, text string"))
    t = F.col("text")
    return rows.select("id", T.has_korean(t).alias("korean"), T.has_cjk(t).alias("cjk"), T.starts_bullet(t).alias("bullet"), T.language(t).alias("language"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?'), ';') AS digits FROM documents")
def digit_lists(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.digit_list(F.col("text")), ";").alias("digits"))


def _matches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every turn, and its matches among all expected texts (items): conv_id, turn, item_id, score above 0; null texts are empty."""
    key = T.match_key(F.col("text")).alias("key")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", key)
    return turns, matching.token_matches(turns, read(spark, sf_dir, "benchmark").select("item_id", key), ["conv_id", "turn"], ["item_id"])


_SQL_SCORED = f"""c AS (SELECT conv_id, turn, coalesce({sql_key('text')}, '') AS said FROM conversations), w AS (SELECT item_id, coalesce({sql_key('text')}, '') AS expected FROM benchmark),
k AS (SELECT conv_id, turn, item_id, said, expected, list_distinct(list_filter(string_split(said, ' '), lambda t: t <> '')) AS a, list_distinct(list_filter(string_split(expected, ' '), lambda t: t <> '')) AS b FROM c, w),
s AS (SELECT conv_id, turn, item_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)) END
  + CASE WHEN said <> '' AND expected <> '' AND (contains(said, expected) OR contains(expected, said)) THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS score FROM k)"""


@query(f"WITH {_SQL_SCORED} SELECT conv_id, turn, item_id, round(score, 9) AS score FROM s WHERE score > 0")
def token_overlap_join(spark, sf_dir):
    """Every turn with every item that it matches at all."""
    return _matches(spark, sf_dir)[1].withColumn("score", F.round("score", 9))


@query(
    f"""WITH RECURSIVE {_SQL_SCORED},
o AS (SELECT conv_id, turn, list({{loss: -score, item: item_id}} ORDER BY -score, item_id) FILTER (score > 0) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM s GROUP BY conv_id, turn),
r(conv_id, n, turn, best, used) AS (
  SELECT conv_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS STRUCT(loss DOUBLE, item BIGINT)), CAST([] AS BIGINT[]) FROM o GROUP BY conv_id
  UNION ALL
  SELECT conv_id, n, turn, best, CASE WHEN -best.loss >= 0.1 THEN list_append(used, best.item) ELSE used END
  FROM (SELECT o.conv_id, o.n, o.turn, r.used, list_filter(o.l, lambda x: NOT list_contains(r.used, x.item))[1] AS best FROM r JOIN o ON o.conv_id = r.conv_id AND o.n = r.n + 1))
SELECT conv_id, turn, best.item AS item_id, round(coalesce(-best.loss, 0.0), 9) AS score, coalesce(-best.loss >= 0.1, FALSE) AS applied FROM r WHERE n > 0"""
)
def exclusive_assignment(spark, sf_dir):
    turns, scored = _matches(spark, sf_dir)
    # a turn that nothing matches is reported without a candidate
    unmatched = turns.select("conv_id", "turn", F.lit(None).cast(scored.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("score"))
    out = matching.assign_exclusively(scored.unionByName(unmatched), ["conv_id"], "turn", "item_id", "score", 0.1)
    return out.withColumn("score", F.round("score", 9))


@query()
def fuzzy_candidates(spark, sf_dir):
    """Every turn with every item; null texts are empty. Pairs without a common token have a similarity too, so no pair is left out."""
    key = F.coalesce(T.match_key(F.col("text")), F.lit(""))
    # spread out, as a pair costs far more than a turn
    turns = read(spark, sf_dir, "conversations").repartition(4 * spark.sparkContext.defaultParallelism).select("conv_id", "turn", key.alias("said"))
    items = read(spark, sf_dir, "benchmark").select("item_id", key.alias("expected"))
    pairs = turns.withColumn("a", T.parts(F.col("said"))).crossJoin(items.withColumn("b", T.parts(F.col("expected"))))
    return pairs.select("conv_id", "turn", "item_id", F.round(T.similarity(F.col("said"), F.col("expected"), F.col("a"), F.col("b")), 9).alias("score"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS joined, count(*) AS n_lines FROM conversations WHERE text <> '' GROUP BY conv_id")
def ordered_concat(spark, sf_dir):
    lines = F.sort_array(F.collect_list(F.struct("turn", "text")))
    rows = read(spark, sf_dir, "conversations").where("text <> ''").groupBy("conv_id").agg(lines.alias("l"), F.count("*").alias("n_lines"))
    return rows.select("conv_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("joined"), "n_lines")


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 96 * 914400, 0) AS BIGINT) AS emu, l_quantity / 96 * 72.0 AS pt, floor(l_quantity / 7 / 0.5::DOUBLE + 0.5::DOUBLE) * 0.5::DOUBLE AS step FROM lineitem")
def px_to_emu_pt(spark, sf_dir):
    q = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.px_to_emu(q).alias("emu"), G.px_to_pt(q).alias("pt"), G.font_step(q / 7).alias("step"))


@query(f"WITH {BOXES} SELECT slide, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM b GROUP BY slide")
def rect_union(spark, sf_dir):
    return layout.union_rect(boxes(spark, sf_dir), ["slide"])


_SQL_ROWS = f"""{BOXES}, e AS (SELECT *, min(y) OVER w AS top, max(y + height) OVER w AS bottom, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY slide)),
k AS (SELECT slide, any_value(top) AS top, unnest(generate_series(0, CAST(max(round_even(bottom - top, 0)) AS INT))) AS k FROM e GROUP BY slide),
empty AS (SELECT k.slide, k.top, k.k, k.k - row_number() OVER (PARTITION BY k.slide ORDER BY k.k) AS run FROM k
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.slide = k.slide AND k.top + k.k >= b.y AND k.top + k.k <= b.y + b.height)),
seps AS (SELECT slide, (min(top + k) + max(top + k)) / 2 AS sep FROM empty GROUP BY slide, run),
p AS (SELECT e.slide, e.ord, e.x, e.y, e.width, e.height, CASE WHEN n <= 1 OR bottom - top < 5 THEN 0 ELSE (SELECT count(*) FROM seps s WHERE s.slide = e.slide AND s.sep < e.y + e.height / 2) END AS passed FROM e),
r AS (SELECT *, dense_rank() OVER (PARTITION BY slide ORDER BY passed) AS row_no FROM p)"""


@query(f"WITH {_SQL_ROWS} SELECT slide, ord, CAST(row_no AS INT) AS row_no FROM r")
def row_split_gaps(spark, sf_dir):
    return layout.split_rows(boxes(spark, sf_dir), ["slide"], "ord").select("slide", "ord", "row_no")


@query(f"WITH {_SQL_ROWS} SELECT slide, ord, CAST(row_number() OVER (PARTITION BY slide ORDER BY row_no, x, ord) AS INT) AS read_no FROM r")
def reading_order(spark, sf_dir):
    return layout.reading_order(boxes(spark, sf_dir), ["slide"], "ord").select("slide", "ord", "read_no")


@query(
    f"""WITH {BOXES}, l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(width) OVER w AS pw, lag(height) OVER w AS ph FROM b WINDOW w AS (PARTITION BY slide ORDER BY x, ord)),
n AS (SELECT *, CASE WHEN px IS NULL OR height > width * 1.4 OR ph > pw * 1.4
  OR (greatest(0, least(px + pw, x + width) - greatest(px, x)) >= least(width, pw) * 0.25 AND abs((y + height / 2) - (py + ph / 2)) >= least(height, ph) * 0.35)
  OR greatest(height, ph) / greatest(1, least(height, ph)) > 1.15 OR x - (px + pw) > greatest(24, least(height, ph) * 0.8) THEN 1 ELSE 0 END AS new FROM l)
SELECT slide, ord, CAST(sum(new) OVER (PARTITION BY slide ORDER BY x, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_no FROM n"""
)
def line_cluster_sessions(spark, sf_dir):
    return layout.cluster_lines(boxes(spark, sf_dir), ["slide"], "ord").select("slide", "ord", "cluster_no")


@query(f"SELECT doc_id, source || ':' || CASE WHEN length({SQL_CLEAN.format('text')}) >= 24 THEN 'body' ELSE 'label' END AS family FROM documents")
def font_family_label(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", typography.family_label(F.col("source"), F.col("text"), F.lit(1)).alias("family"))


@query("SELECT p_brand, floor(median(CAST(p_size AS DOUBLE)) / 0.5::DOUBLE + 0.5::DOUBLE) * 0.5::DOUBLE AS token FROM part GROUP BY p_brand")
def font_token_median(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(G.font_step(F.median(F.col("p_size").cast("double"))).alias("token"))


@query()
def font_token_partition(spark, sf_dir):
    return typography.font_tokens(read(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_size").cast("double").alias("size")), ["p_brand", "p_type"], "size")


@query("SELECT p_partkey, (SELECT arg_min(t, [abs(t - p_size), t]) FROM (VALUES (8.0::DOUBLE), (12.0), (16.5), (24.0), (36.0)) v(t)) AS token FROM part")
def nearest_token(spark, sf_dir):
    tokens = F.array(*(F.lit(float(t)) for t in (8, 12, 16.5, 24, 36)))
    return read(spark, sf_dir, "part").select("p_partkey", typography.nearest_token(F.col("p_size").cast("double"), tokens).alias("token"))


@query(
    """WITH p AS (SELECT l_orderkey AS deck, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS slide, 800 + l_partkey % 5 * 100 AS w, 600 + l_suppkey % 3 * 100 AS h, CAST(l_quantity AS DOUBLE) AS q FROM lineitem),
f AS (SELECT *, first_value(w) OVER v / greatest(1, w)::DOUBLE AS sx, first_value(h) OVER v / greatest(1, h)::DOUBLE AS sy FROM p WINDOW v AS (PARTITION BY deck ORDER BY slide))
SELECT deck, slide, round(q * 3 * sx, 6) AS x, round(q * 2 * sy, 6) AS y, round((q + 7) * sx, 6) AS width, round((q + 5) * sy, 6) AS height, round(q * least(sx, sy), 6) AS font_size FROM f"""
)
def scale_to_first(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("deck"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("slide"), (F.col("l_partkey") % 5 * 100 + 800).alias("slide_width"),
        (F.col("l_suppkey") % 3 * 100 + 600).alias("slide_height"), (q * 3).alias("x"), (q * 2).alias("y"), (q + 7).alias("width"), (q + 5).alias("height"), q.alias("font_size"),
    )
    out = typography.scale_to_first(rows, "deck", "slide")
    return out.select("deck", "slide", *(F.round(c, 6).alias(c) for c in ("x", "y", "width", "height", "font_size")))


@query("SELECT c_custkey, arg_max(o_orderkey, o_orderkey) AS result, c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment")
def detection_ocr_join(spark, sf_dir):
    results = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("result"))
    return matching.last_result_join(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), results, ["c_custkey"], "result")


@query("SELECT l_orderkey, round(avg(CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END), 9) AS confidence FROM lineitem GROUP BY l_orderkey")
def mean_confidence(spark, sf_dir):
    some = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount"))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(some), 9).alias("confidence"))


@query("SELECT o_orderkey AS box_id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' WHEN o_orderkey % 7 % 3 <= 1 THEN 'kept' ELSE 'moved' END AS change FROM orders")
def baseline_change(spark, sf_dir):
    k = F.col("o_orderkey")
    base = read(spark, sf_dir, "orders").select(k.alias("box_id"), *(((k * m) % 500).cast("double").alias(c) for c, m in (("x", 3), ("y", 5), ("width", 7), ("height", 11))))
    edited = base.withColumn("x", F.col("x") + (F.col("box_id") % 7 % 3).cast("double"))
    return matching.changed_boxes(edited, base.where("box_id % 4 <> 0"), "box_id").select("box_id", "change")


@query(
    """WITH a AS (SELECT c_custkey AS patch, c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
b AS (SELECT s_suppkey AS shape, s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)
SELECT nation, CAST(k AS INT) AS k, patch, shape FROM a JOIN b USING (nation, k)"""
)
def patch_kth_match(spark, sf_dir):
    patches = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("patch"))
    shapes = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("shape"))
    return matching.kth_match(patches, shapes, ["nation"], "patch", "shape")


_RGB = "SELECT vec_id, label, floor(abs(embedding[1]::DOUBLE) * 1000) % 256 AS r, floor(abs(embedding[2]::DOUBLE) * 1000) % 256 AS g, floor(abs(embedding[3]::DOUBLE) * 1000) % 256 AS b FROM embeddings"


def rgb(spark, sf_dir) -> DataFrame:
    c = lambda i: (F.floor(F.abs(F.get("embedding", F.lit(i)).cast("double")) * 1000) % 256).cast("double")
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", c(0).alias("r"), c(1).alias("g"), c(2).alias("b"))


@query(f"SELECT vec_id, round(sqrt((r - 128) * (r - 128) + (g - 128) * (g - 128) + (b - 128) * (b - 128)), 6) AS distance, round(r * 0.299 + g * 0.587 + b * 0.114, 6) AS luminance FROM ({_RGB})")
def rgb_distance_luminance(spark, sf_dir):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    grey = (F.lit(128.0),) * 3
    return rgb(spark, sf_dir).select("vec_id", F.round(G.rgb_distance((r, g, b), grey), 6).alias("distance"), F.round(G.luminance(r, g, b), 6).alias("luminance"))


@query(
    f"""WITH p AS (SELECT *, r * r + g * g + b * b AS d FROM ({_RGB})), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM p)
SELECT label, median(r) AS r, median(g) AS g, median(b) AS b, count(*) AS support FROM k WHERE k <= greatest(24, ceil(n * 0.35)) GROUP BY label"""
)
def strongest_pixels_median(spark, sf_dir):
    rows = rgb(spark, sf_dir).withColumn("d", F.col("r") * F.col("r") + F.col("g") * F.col("g") + F.col("b") * F.col("b"))
    return color.strongest_median(rows, ["label"], "d", "vec_id")


@query(
    f"""WITH c AS (SELECT *, vec_id % 16 AS slide FROM ({_RGB}) x), p AS (SELECT slide, label AS token, floor(avg(r)) AS pr, floor(avg(g)) AS pg, floor(avg(b)) AS pb FROM c GROUP BY slide, label),
d AS (SELECT vec_id, token, sqrt((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) AS d FROM c JOIN p USING (slide)),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, token) AS k FROM d)
SELECT vec_id, token AS nearest, CASE WHEN d <= 18 THEN token END AS snapped FROM k WHERE k = 1"""
)
def palette_snap(spark, sf_dir):
    """Each slide's colours to its own palette: the mean colours of its labels."""
    pixels = rgb(spark, sf_dir).withColumn("slide", F.col("vec_id") % 16)
    palette = pixels.groupBy("slide", F.col("label").alias("token")).agg(*(F.floor(F.avg(c)).cast("double").alias(f"p{c}") for c in "rgb"))
    return color.snap_to_palette(pixels, palette, ["slide"]).select("vec_id", "nearest", "snapped")


@query(
    r"""SELECT page_id, CASE WHEN regexp_matches(lower(url), '\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(url), '\.(png|jpe?g|webp|bmp|tiff?)$') THEN 'image' ELSE 'unknown' END AS kind,
  CASE WHEN trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '.-') = '' THEN 'upload' ELSE trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '.-') END AS stem FROM pages"""
)
def upload_kind_filename(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", T.upload_kind(u).alias("kind"), T.file_stem(u).alias("stem"))


@query("SELECT doc_id, 'slide-' || lpad(CAST(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS VARCHAR), 8, '0') AS label FROM documents")
def deck_numbering(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return matching.number_in_ranges(rows, ["source", "lang"], "doc_id").select("doc_id", F.concat(F.lit("slide-"), F.lpad(F.col("number").cast("string"), 8, "0")).alias("label"))


@query("SELECT user_id, arg_max(event_type, event_id) AS status, count(*) AS n_events FROM events GROUP BY user_id")
def job_status_latest(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.count("*").alias("n_events"))


@query("SELECT page_id, sha256(html) AS sha FROM pages")
def content_sha(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
