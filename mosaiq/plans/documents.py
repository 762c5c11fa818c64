"""Text runs, styles, chains and video sample tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.functions import text
from mosaiq.operators import intervals, samples, trees
from mosaiq.plans.registry import query
from mosaiq.session import table

# A track for each user: run-length times, sync samples, chunks and sample sizes from the events.
_TRACK = """
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS i, (event_id % 4 + 1)::INT AS n, (event_id * 7 % 50 + 1)::INT AS d FROM events),
tot AS (SELECT user_id, floor(sum(n * d) * 0.1::DOUBLE)::BIGINT AS goal, sum(n)::BIGINT AS total FROM e GROUP BY 1),
walk AS (
  SELECT user_id, 0 AS i, 0::BIGINT AS t, 0::BIGINT AS s, false AS stop FROM tot
  UNION ALL SELECT w.user_id, e.i, w.t + k.k * e.d, w.s + k.k, w.t + k.k * e.d >= tot.goal
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1 JOIN tot ON tot.user_id = w.user_id, LATERAL (SELECT least(e.n, greatest(0, (tot.goal - w.t) // e.d)) AS k) k WHERE NOT w.stop
), target AS (SELECT user_id, least(max(s) + 1, any_value(total)) AS target FROM walk JOIN tot USING (user_id) GROUP BY user_id)
"""


def _stts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("user_id", i.alias("i"), (e % 4 + 1).cast("int").alias("count"), (e * 7 % 50 + 1).cast("int").alias("delta"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.target_sample(_stts(spark, sf_dir), ["user_id"]).select("user_id", F.col("target").cast("long").alias("target"))


@query("mp4_target", _TRACK + "SELECT user_id, target::BIGINT AS target FROM target")
def mp4_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir)


@query(
    "mp4_sync_asof",
    _TRACK + """, stss AS (SELECT DISTINCT user_id, (event_id % 40 + 1)::BIGINT AS sample FROM events WHERE user_id % 3 > 0 AND event_id % 5 = 0)
SELECT user_id, target, CASE WHEN user_id IN (SELECT user_id FROM stss) THEN coalesce((SELECT max(sample) FROM stss WHERE stss.user_id = target.user_id AND sample <= target), 1) ELSE target END::BIGINT AS sync FROM target
""",
)
def mp4_sync_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    stss = table(spark, sf_dir, "events").where("user_id % 3 > 0 AND event_id % 5 = 0").select("user_id", (F.col("event_id") % 40 + 1).alias("sample")).distinct()
    return samples.sync_sample(_targets(spark, sf_dir), stss, ["user_id"])


_CHUNKS = """
WITH c AS (SELECT user_id, k.range::BIGINT AS chunk, user_id * 1000000 + k.range * 5000 AS "offset" FROM (SELECT DISTINCT user_id FROM events), range(1, 13) k),
stsc AS (SELECT user_id, k AS chunk, 1 + (user_id + k) % 4 AS per FROM (SELECT DISTINCT user_id FROM events), (VALUES (1), (4), (9)) t(k)),
n AS (SELECT c.user_id, c.chunk, "offset", (SELECT arg_max(per, s.chunk) FROM stsc s WHERE s.user_id = c.user_id AND s.chunk <= c.chunk)::BIGINT AS per FROM c)
"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    chunks = users.withColumn("chunk", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("chunk", F.col("chunk").cast("long")).withColumn("offset", F.col("user_id") * 1000000 + F.col("chunk") * 5000)
    stsc = users.withColumn("chunk", F.explode(F.array(F.lit(1), F.lit(4), F.lit(9)))).withColumn("chunk", F.col("chunk").cast("long")).withColumn("per", (F.col("user_id") + F.col("chunk")) % 4 + 1)
    return samples.chunk_sizes(chunks, stsc, ["user_id"])


@query("mp4_chunk_asof", _CHUNKS + 'SELECT user_id, chunk, "offset", per FROM n')
def mp4_chunk_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@query(
    "mp4_offset",
    _CHUNKS + """, f AS (SELECT *, coalesce(sum(per) OVER (PARTITION BY user_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first FROM n),
s AS (SELECT user_id, chunk, "offset", unnest(range(first::BIGINT, (first + per)::BIGINT)) AS sample FROM f), z AS (SELECT *, (user_id * 31 + sample * 17) % 300 + 1 AS size FROM s)
SELECT user_id, sample, ("offset" + coalesce(sum(size) OVER (PARTITION BY user_id, chunk ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", size FROM z WHERE sample <= 30
""",
)
def mp4_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    sizes = chunks.select("user_id").distinct().withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn("sample", F.col("sample").cast("long"))
    sizes = sizes.withColumn("size", (F.col("user_id") * 31 + F.col("sample") * 17) % 300 + 1)
    return samples.sample_offsets(chunks, sizes, ["user_id"])


_PIECES = """
WITH d AS (SELECT doc_id, length(text) AS n FROM documents), p AS (
  SELECT doc_id, k.range AS seq, n * k.range // 5 AS cp0, n * (k.range + 1) // 5 AS cp1, 2048 + 9000 * ((k.range * 3 + doc_id) % 5) AS fc, 1 + (doc_id + k.range) % 2 AS width FROM d, range(5) k)
"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    rows = docs.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(4))))
    n, k = F.col("n"), F.col("seq")
    whole = lambda x: F.floor(x / 5)
    rows = rows.select("doc_id", "seq", whole(n * k).alias("cp0"), whole(n * (k + 1)).alias("cp1"), (2048 + 9000 * ((k * 3 + F.col("doc_id")) % 5)).alias("fc"), (1 + (F.col("doc_id") + k) % 2).alias("width"))
    return rows.withColumn("fc_end", F.col("fc") + (F.col("cp1") - F.col("cp0")) * F.col("width"))


@query(
    "doc_fc_to_cp",
    _PIECES + """, q AS (SELECT doc_id, 2048 + i.range * 1777 AS "at" FROM d, range(25) i),
j AS (SELECT q.doc_id, "at", arg_min({'cp0': cp0, 'fc': fc, 'width': width}, seq) AS h FROM q LEFT JOIN p ON p.doc_id = q.doc_id AND "at" >= fc AND "at" < fc + (cp1 - cp0) * width GROUP BY ALL)
SELECT doc_id, "at"::INT AS "at", CASE WHEN h IS NULL THEN -1.0::DOUBLE ELSE h.cp0 + ("at" - h.fc) / h.width::DOUBLE END AS cp FROM j
""",
)
def doc_fc_to_cp(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(2048), F.lit(2048 + 24 * 1777), F.lit(1777))).alias("at"))
    found = intervals.interval_join(points, _pieces(spark, sf_dir), ["doc_id"], "at", "fc", "fc_end", "seq", bucket=8192)
    cp = F.when(F.col("cp0").isNull(), -1.0).otherwise(F.col("cp0") + (F.col("at") - F.col("fc")) / F.col("width"))
    return found.select("doc_id", "at", cp.alias("cp"))


@query(
    "doc_char_props",
    """
WITH c AS (SELECT doc_id, unnest(range(0, coalesce(length(text), 0) + 1, 40)) AS cp FROM documents), k AS (SELECT doc_id, unnest(range(0, coalesce(length(text), 0) // 97 + 1)) AS seq FROM documents),
r AS (SELECT doc_id, seq, seq * 97 + doc_id % 50 AS s, seq * 97 + doc_id % 50 + 40 + seq % 9 * 11 AS e, seq % 2 = 0 AS bold FROM k)
SELECT c.doc_id, cp::INT AS cp, arg_min(seq, seq)::INT AS seq, coalesce(arg_min(bold, seq), false) AS bold FROM c LEFT JOIN r ON r.doc_id = c.doc_id AND cp >= s AND cp < e GROUP BY c.doc_id, cp
""",
)
def doc_char_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    points = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n"), F.lit(40))).alias("cp"))
    props = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 97).cast("int"))).alias("seq"))
    s = F.col("seq") * 97 + F.col("doc_id") % 50
    props = props.select("doc_id", "seq", s.alias("s"), (s + 40 + F.col("seq") % 9 * 11).alias("e"), (F.col("seq") % 2 == 0).alias("bold"))
    found = intervals.interval_join(points, props, ["doc_id"], "cp", "s", "e", "seq", bucket=128)
    return found.select("doc_id", "cp", "seq", F.coalesce("bold", F.lit(False)).alias("bold"))


@query(
    "doc_runs",
    """
WITH t AS (SELECT conv_id, turn, (turn // 2 + conv_id) % 3 = 0 AS bold, text FROM conversations),
l AS (SELECT *, CASE WHEN lag(bold) OVER w IS NOT DISTINCT FROM bold AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM l)
SELECT conv_id, run::BIGINT AS run, bold, string_agg(text, '' ORDER BY turn) AS text, count(*) AS n, min(turn) AS start FROM r GROUP BY conv_id, run, bold
""",
)
def doc_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.floor(F.col("turn") / 2) + F.col("conv_id")) % 3 == 0).alias("bold"), "text")
    return intervals.runs(rows, ["conv_id"], "turn", ["bold"], "text")


@query(
    "para_split",
    """
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS f FROM documents), u AS (SELECT doc_id, (generate_subscripts(f, 1) - 1)::INT AS para, unnest(f) AS t FROM p)
SELECT doc_id, para, length(t)::INT AS length, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM u
""",
)
def para_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para", "t")).select("doc_id", "para", F.length("t").alias("length"))
    return intervals.prefix_positions(rows.withColumn("_n", F.col("length") + 1), ["doc_id"], "para", "_n").drop("_n")


@query(
    "run_line_overlap",
    """
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS f FROM documents), u AS (SELECT doc_id, generate_subscripts(f, 1) - 1 AS line, length(unnest(f)) AS n FROM p),
l AS (SELECT doc_id, line, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, n FROM u),
k AS (SELECT doc_id, unnest(range(greatest(1, (length(text) + doc_id % 50 + 29) // (doc_id % 50 + 30)))) AS run FROM documents),
r AS (SELECT doc_id, run, (doc_id % 50 + 30) * run AS s, (doc_id % 50 + 30) * (run + 1) AS e FROM k)
SELECT l.doc_id, line::INT AS line, run::INT AS run, greatest(l.s, r.s)::BIGINT AS "from", least(l.s + n, r.e)::BIGINT AS "to" FROM l JOIN r ON l.doc_id = r.doc_id AND greatest(l.s, r.s) < least(l.s + n, r.e)
""",
)
def run_line_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = para_split(spark, sf_dir).select("doc_id", F.col("para").alias("line"), F.col("start").alias("l_start"), (F.col("start") + F.col("length")).alias("l_end"))
    n = F.col("doc_id") % 50 + 30
    last = F.greatest(F.ceil(F.length("text") / n), F.lit(1)).cast("int") - 1
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("run"))
    runs = runs.select("doc_id", "run", (n * F.col("run")).alias("r_start"), (n * (F.col("run") + 1)).alias("r_end"))
    return intervals.overlaps(lines, runs, ["doc_id"]).select("doc_id", "line", "run", "from", "to")


@query(
    "placeholder_resolve",
    """
WITH s AS (SELECT p_partkey AS shape, (p_partkey % 7)::INT AS type, (p_size % 9)::INT AS idx FROM part), l AS (SELECT range AS k, range * 10 AS pos FROM range(3)), li AS (SELECT range AS k, range * 100 AS pos FROM range(2, 5)),
m AS (SELECT range AS k, range * 1000 AS pos FROM range(4, 6)), mi AS (SELECT range AS k, range * 10000 AS pos FROM range(5, 8))
SELECT shape, coalesce(l.pos, li.pos, m.pos, mi.pos) AS pos FROM s LEFT JOIN l ON type = l.k LEFT JOIN li ON idx = li.k LEFT JOIN m ON type = m.k LEFT JOIN mi ON idx = mi.k WHERE coalesce(l.pos, li.pos, m.pos, mi.pos) IS NOT NULL
""",
)
def placeholder_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("shape"), (F.col("p_partkey") % 7).alias("type"), (F.col("p_size") % 9).alias("idx"))
    found = shapes
    for n, (key, lo, hi, scale) in enumerate((("type", 0, 3, 10), ("idx", 2, 5, 100), ("type", 4, 6, 1000), ("idx", 5, 8, 10000))):
        found = found.join(spark.range(lo, hi).select(F.col("id").alias(key), (F.col("id") * scale).alias(f"p{n}")), key, "left")
    return found.select("shape", F.coalesce(*(f"p{n}" for n in range(4))).alias("pos")).where("pos is not null")


@query(
    "style_chain",
    """
WITH RECURSIVE s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 > 0 THEN p_partkey // 2 END AS parent, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS value FROM part),
c AS (SELECT id, 0 AS level, parent, value FROM s UNION ALL SELECT c.id, c.level + 1, s.parent, s.value FROM c JOIN s ON s.id = c.parent WHERE c.level < 10)
SELECT id, arg_min(value, level) FILTER (value IS NOT NULL) AS value, (max(level) + 1)::INT AS length FROM c GROUP BY id
""",
)
def style_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    styles = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 11 > 0, F.floor(key / 2)).alias("parent"), F.when(key % 5 == 0, F.col("p_size")).alias("value"))
    return trees.inherited(trees.style_chain(styles, []), [])


@query(
    "fat_chain",
    """
WITH RECURSIVE f AS (SELECT c_custkey AS sector, CASE WHEN c_custkey % 13 = 0 THEN -2 ELSE c_custkey * 7 % 149 + 1 END AS next FROM customer),
c AS (SELECT s_suppkey AS chain, 0 AS step, (s_suppkey * 3 % 150 + 1)::BIGINT AS sector, [(s_suppkey * 3 % 150 + 1)::BIGINT] AS seen FROM supplier
  UNION ALL SELECT chain, step + 1, next, list_append(seen, next) FROM c JOIN f ON f.sector = c.sector WHERE next <> -2 AND NOT list_contains(seen, next))
SELECT chain, step, sector FROM c
""",
)
def fat_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    links = table(spark, sf_dir, "customer").select(key.alias("sector"), F.when(key % 13 == 0, -2).otherwise(key * 7 % 149 + 1).alias("next"))
    starts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chain"), (F.col("s_suppkey") * 3 % 150 + 1).alias("sector"))
    return trees.chain_order(links, starts)


@query("xref_first_wins", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY o_custkey")
def xref_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return intervals.first_wins(rows, ["o_custkey"], "at").drop("at")


@query("last_wins", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return intervals.last_wins(rows, ["o_custkey"], "at").drop("at")


@query(
    "norm_path",
    """
WITH RECURSIVE p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/xl/' || page_id WHEN 1 THEN 'xl/worksheets/../media/./image' || page_id WHEN 2 THEN '../a/../../b' || page_id ELSE 'ppt/slides/' || page_id END AS path FROM pages),
f AS (SELECT page_id, path, string_split(path, '/') AS parts, 1 AS i, []::VARCHAR[] AS done FROM p UNION ALL
  SELECT page_id, path, parts, i + 1, CASE parts[i] WHEN '.' THEN done WHEN '..' THEN done[1:greatest(len(done) - 1, 0)] ELSE list_append(done, parts[i]) END FROM f WHERE i <= len(parts))
SELECT page_id, path, CASE WHEN starts_with(path, '/') THEN substr(path, 2) ELSE array_to_string(done, '/') END AS target FROM f WHERE i = len(parts) + 1
""",
)
def norm_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("page_id"), F.col("page_id").cast("string")
    path = F.when(key % 4 == 0, F.concat(F.lit("/xl/"), name)).when(key % 4 == 1, F.concat(F.lit("xl/worksheets/../media/./image"), name)).when(key % 4 == 2, F.concat(F.lit("../a/../../b"), name)).otherwise(F.concat(F.lit("ppt/slides/"), name))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), text.normalize_path(path).alias("target"))


@query("xml_entities", "SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&')) AS digest, length(html)::INT AS n FROM pages")
def xml_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.decode_entities(F.col("html")), 256).alias("digest"), F.length("html").alias("n"))


@query(
    "cmap_ranges",
    "WITH r AS (SELECT n_nationkey AS font, k.range AS seq, (k.range * 300 + n_nationkey * 7)::BIGINT AS lo, (k.range * 300 + n_nationkey * 7 + k.range % 40)::BIGINT AS hi, (k.range * 1000)::BIGINT AS dst FROM nation, range(20) k) SELECT font, unnest(range(lo, hi + 1)) AS code, dst + unnest(range(lo, hi + 1)) - lo AS unicode FROM r",
)
def cmap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("font"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("seq"))
    low = (F.col("seq") * 300 + F.col("font") * 7).cast("long")
    rows = rows.select("font", low.alias("lo"), (low + F.col("seq") % 40).alias("hi"), (F.col("seq") * 1000).cast("long").alias("dst"))
    return rows.select("font", "lo", "dst", F.explode(F.sequence("lo", "hi")).alias("code")).select("font", "code", (F.col("dst") + F.col("code") - F.col("lo")).alias("unicode"))


@query(
    "greedy_wrap",
    """
WITH RECURSIVE w AS (SELECT page_id, regexp_extract_all(html, '[a-z]+') AS words FROM pages),
f AS (SELECT page_id, words, 1 AS i, 0 AS line, length(words[1]) AS used FROM w WHERE len(words) > 0
  UNION ALL SELECT page_id, words, i + 1, CASE WHEN used + 1 + length(words[i + 1]) <= 40 THEN line ELSE line + 1 END, CASE WHEN used + 1 + length(words[i + 1]) <= 40 THEN used + 1 + length(words[i + 1]) ELSE length(words[i + 1]) END FROM f WHERE i < len(words))
SELECT page_id, line::INT AS line, count(*) AS words, string_agg(words[i], ' ' ORDER BY i) AS text FROM f GROUP BY page_id, line
""",
)
def greedy_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit("[a-z]+"), F.lit(0)).alias("words"))
    lines = words.select("page_id", F.posexplode(text.wrap(F.col("words"), F.lit(40), F.lit(1))).alias("line", "x"))
    return lines.select("page_id", "line", F.size("x").cast("long").alias("words"), F.array_join("x", " ").alias("text"))


@query(
    "unit_points",
    """
WITH l AS (SELECT p_partkey, p_size / 4.0::DOUBLE AS n, ['cm', 'mm', 'in', 'pt', 'px', 'pc', '']::VARCHAR[] AS u, (p_partkey % 7 + 1)::INT AS k FROM part)
SELECT p_partkey, floor(n * [72 / 2.54::DOUBLE, 72 / 25.4::DOUBLE, 72.0::DOUBLE, 1.0::DOUBLE, 0.75::DOUBLE, 12.0::DOUBLE, 1.0::DOUBLE][k] * 1e6 + 0.5) / 1e6 AS points FROM l
""",
)
def unit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("cm", "mm", "in", "pt", "px", "pc", ""))), (F.col("p_partkey") % 7 + 1).cast("int"))
    length = F.concat((F.col("p_size") / 4.0).cast("string"), unit)
    return table(spark, sf_dir, "part").select("p_partkey", (F.floor(text.to_points(length) * 1e6 + 0.5) / 1e6).alias("points"))


@query(
    "best_icon",
    """
WITH i AS (SELECT p_brand AS file, p_partkey AS ord, CASE WHEN p_size % 16 = 0 THEN 256 ELSE p_size % 16 * 16 END AS side, (p_partkey % 4 + 1) * 8 AS bpp FROM part)
SELECT file, arg_max(ord, side * side * 10000000000 + bpp * 100000000 - ord) AS ord, max(side)::INT AS side FROM i GROUP BY file
""",
)
def best_icon(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("p_size") % 16 == 0, 256).otherwise(F.col("p_size") % 16 * 16)
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("ord"), side.alias("side"), ((F.col("p_partkey") % 4 + 1) * 8).alias("bpp"))
    best = F.max_by(F.struct("ord", "side"), F.struct(F.col("side") * F.col("side"), "bpp", -F.col("ord")))
    return rows.groupBy("file").agg(best.alias("b")).select("file", "b.ord", "b.side")
