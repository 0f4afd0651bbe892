"""Queries over routes, stages, device plans, viewports and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import pixels as P
from .operators import reports, routing, viewport
from .plans import tiles as T
from .registry import query

_REQUESTS = ["Auto", "Cpu", "Metal", "Cuda"]
_FORMATS = list(P.FORMATS)


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


# ------------------------------------------------------------------ backends and routes


@query(f"""WITH p AS (SELECT p_partkey AS idx, {_REQUESTS}[p_partkey % 4 + 1] AS request, p_partkey % 3 = 0 AS metal, p_partkey % 5 < 2 AS cuda FROM part)
SELECT idx, CASE request WHEN 'Auto' THEN CASE WHEN metal THEN 'Metal' WHEN cuda THEN 'Cuda' ELSE 'Cpu' END WHEN 'Cpu' THEN 'Cpu' WHEN 'Metal' THEN CASE WHEN metal THEN 'Metal' END ELSE CASE WHEN cuda THEN 'Cuda' END END AS backend,
CASE request WHEN 'Metal' THEN metal WHEN 'Cuda' THEN cuda ELSE true END AS supported FROM p""")
def backend_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    request, metal, cuda = _pick(_REQUESTS, k % 4), k % 3 == 0, k % 5 < 2
    return T.table(spark, sf_dir, "part").select(k.alias("idx"), routing.resolve(request, metal, cuda).alias("backend"), routing.supports(request, metal, cuda).alias("supported"))


@query(f"""WITH p AS (SELECT p_partkey AS idx, {_REQUESTS}[p_partkey % 4 + 1] AS request, {_FORMATS}[p_partkey % 6 + 1] AS fmt, p_partkey % 5 <> 0 AS fast, p_partkey % 7 = 0 AS there, p_partkey % 256 AS marker FROM part)
SELECT idx, CASE WHEN request IN ('Cpu', 'Auto') THEN 'CpuHost' WHEN request = 'Cuda' THEN 'RejectUnsupportedBackend' WHEN NOT fast OR fmt NOT IN ('Gray8', 'Rgb8', 'Rgba8') THEN 'RejectExplicitMetal' WHEN there THEN 'MetalKernel' ELSE 'MetalUnavailable' END AS jpeg_route,
CASE WHEN request = 'Metal' THEN CASE WHEN NOT fast THEN 'no_fast_packet' WHEN fmt NOT IN ('Gray8', 'Rgb8', 'Rgba8') THEN 'output_format' END END AS jpeg_reason,
CASE WHEN request IN ('Cpu', 'Auto') THEN 'CpuHost' WHEN request = 'Cuda' THEN 'RejectUnsupportedBackend' WHEN fmt = 'Rgba16' THEN 'RejectExplicitMetal' WHEN there THEN 'MetalKernel' ELSE 'MetalUnavailable' END AS j2k_route,
fmt <> 'Rgba16' AS format_supported, marker IN (80, 83, 85, 87, 88, 89, 92, 93, 94, 95, 96, 97, 99, 100, 145, 146) AS retries FROM p""")
def device_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    request, fmt, fast, there = _pick(_REQUESTS, k % 4), _pick(_FORMATS, k % 6), k % 5 != 0, k % 7 == 0
    return T.table(spark, sf_dir, "part").select(
        k.alias("idx"),
        routing.jpeg_route(request, fast, fmt, there).alias("jpeg_route"),
        routing.jpeg_reject_reason(request, fast, fmt).alias("jpeg_reason"),
        routing.j2k_route(request, fmt, there).alias("j2k_route"),
        routing.supported_format(fmt).alias("format_supported"),
        routing.retries(k % 256).alias("retries"),
    )


@query(f"""WITH {T.HEADERS_SQL}, s AS (SELECT tile, 16 + CASE WHEN components >= 3 AND tile % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN tile % 3 > 0 THEN 2 ELSE 0 END + CASE WHEN tile % 5 = 0 THEN 8 ELSE 4 END AS bits,
greatest(tile % 7 - tile % 4, 0) AS rct, greatest(tile % 6 - tile % 5, 0) AS dwt, greatest(tile % 5 - tile % 3, 0) AS tier1, greatest(tile % 9 - tile % 2, 0) AS ht, greatest(tile % 8 - tile % 3, 0) AS pack, {_REQUESTS}[tile % 2 + 1] AS request FROM headers)
SELECT tile, bits, CASE WHEN bits & 1 <> 0 AND rct = 0 THEN 'forward_rct' WHEN bits & 2 <> 0 AND dwt = 0 THEN 'forward_dwt53' WHEN bits & 4 <> 0 AND tier1 = 0 THEN 'tier1_code_block' WHEN bits & 8 <> 0 AND ht = 0 THEN 'ht_code_block' WHEN pack = 0 THEN 'packetization' END AS missing,
rct + dwt + tier1 + ht + pack AS total, tile % 4 = 1 OR (request = 'Auto' AND rct + dwt + tier1 + ht + pack > 0) AS kept FROM s""")
def encode_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needed stages, what was dispatched between two readings, the first stage missing, and whether the result is kept."""
    k = F.col("tile")
    names = dict(zip(routing.STAGES, ((7, 4), (6, 5), (5, 3), (9, 2), (8, 3)), strict=True))
    done = {n: routing.delta(k % a, k % b) for n, (a, b) in names.items()}
    total = sum(done.values(), F.lit(0))
    bits = routing.required_stages(F.col("components"), k % 2 == 0, k % 3, k % 5 == 0)
    kept = routing.keeps_device_result(_pick(_REQUESTS, k % 2), F.lit("Metal"), F.when(k % 4 == 1, "Metal").otherwise("Cpu"), total)
    return T.headers(spark, sf_dir).select("tile", bits.alias("bits"), routing.missing_stage(bits, done).alias("missing"), total.alias("total"), kept.alias("kept"))


@query(f"""WITH {T.HEADERS_SQL}, m AS (SELECT tile, ((width + 8 * max_h - 1) // (8 * max_h)) * ((height + 8 * max_v - 1) // (8 * max_v)) AS mcus, tile % 6 AS restart, tile % 40 AS cadence FROM headers)
SELECT tile, 1 + greatest(mcus - 1, 0) // CASE WHEN restart > 0 THEN restart ELSE greatest(cadence, 1) END AS checkpoints FROM m""")
def device_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("tile")
    mcus = G.ceil_div(F.col("width"), F.col("max_h") * 8) * G.ceil_div(F.col("height"), F.col("max_v") * 8)
    return T.headers(spark, sf_dir).select("tile", routing.checkpoints(mcus, k % 6, k % 40).alias("checkpoints"))


@query("""WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, doc_id % 6 AS kind FROM documents)
SELECT doc_id, CASE kind WHEN 0 THEN 2 * n + 4 WHEN 1 THEN n WHEN 2 THEN n + 4 WHEN 4 THEN n + 1 WHEN 5 THEN 2 END AS n_bytes, CASE WHEN kind <> 3 THEN kind IN (1, 4) END AS missing_eoi,
CASE WHEN kind = 3 THEN 'unexpected_marker' END AS error, CASE WHEN kind = 3 THEN n END AS at FROM d""")
def scan_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as entropy-coded bytes, with stuffed, restart, end and other markers behind or between."""
    k, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary")
    tails = ["FF00", "", "FFD3FFD9", "FFD3FFD9", "FF", "FFD9"]
    mark = F.unhex(_pick(tails, k % 6))
    scan = F.when(k % 6 == 0, F.concat(text, mark, text, F.unhex(F.lit("FFD9")), text)).when(k % 6 == 5, F.concat(mark, text)).otherwise(F.concat(text, mark))
    out = routing.scan_payload(scan, k % 6 == 2)
    return T.table(spark, sf_dir, "documents").select("doc_id", out.alias("x")).select("doc_id", "x.*")


# ------------------------------------------------------------------ viewports

_GRID = """g AS (SELECT o_orderkey AS viewport, CAST(1 << (o_orderkey % 3) AS BIGINT) AS denom FROM orders),
t AS (SELECT viewport, denom, viewport * 8 + i AS idx, 128 + (i % 3) * 64 AS x, 64 + (i // 3) * 64 AS y, 64 AS w, 64 AS h, (i % 3) * 64 // denom + CASE WHEN viewport % 5 = 0 AND i = 4 THEN 1 ELSE 0 END AS dx, (i // 3) * 64 // denom AS dy, 64 // denom AS dw, 64 // denom AS dh FROM g, range(6) r(i) WHERE NOT (viewport % 7 = 0 AND i = 5))"""


def _viewports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Six tiles an order, a fifth with a tile out of place, a seventh with one missing."""
    k, i, d = F.col("viewport"), F.col("i"), F.col("denom")
    v = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("viewport"), F.pow(F.lit(2), F.col("o_orderkey") % 3).cast("long").alias("denom"))
    v = v.withColumn("width", F.floor(F.lit(192) / d)).withColumn("height", F.floor(F.lit(128) / d))
    t = v.select("viewport", "denom", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("i")).filter(~((k % 7 == 0) & (i == 5)))
    side = F.floor(F.lit(64) / d)
    t = t.select("viewport", (k * 8 + i).alias("idx"), (i % 3 * 64 + 128).alias("x"), (F.floor(i / 3) * 64 + 64).alias("y"), F.lit(64).cast("long").alias("w"), F.lit(64).cast("long").alias("h"), (i % 3 * side + F.when((k % 5 == 0) & (i == 4), 1).otherwise(0)).alias("dx"), (F.floor(i / 3) * side).alias("dy"), side.alias("dw"), side.alias("dh"))
    return v, t


@query(f"""WITH {_GRID}, c AS (SELECT viewport, viewport % 5 <> 0 AND viewport % 7 <> 0 AS contiguous FROM g)
SELECT viewport, contiguous, CASE viewport % 4 WHEN 0 THEN CASE WHEN viewport % 3 = 0 THEN 'Hybrid' ELSE 'Cpu' END || shape WHEN 1 THEN 'Cpu' || shape WHEN 2 THEN CASE WHEN viewport % 3 = 0 THEN 'Hybrid' || shape END END AS strategy
FROM (SELECT *, CASE WHEN contiguous THEN 'Contiguous' ELSE 'Composite' END AS shape FROM c)""")
def viewport_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, t = _viewports(spark, sf_dir)
    k = F.col("viewport")
    return viewport.contiguous(v, t).withColumn("strategy", viewport.strategy(_pick(_REQUESTS, k % 4), F.col("contiguous"), k % 3 == 0))


@query(f"""WITH {T.HEADERS_SQL}, s AS (SELECT tile, width, height, CASE WHEN width >= 4608 AND height >= 1536 THEN 8 WHEN width >= 2304 AND height >= 768 THEN 4 WHEN width >= 1152 AND height >= 384 THEN 2 WHEN width >= 576 AND height >= 192 THEN 1 END AS denom FROM headers),
o AS (SELECT tile, denom, (width - 576 * denom) // 2 AS cx, (height - 192 * denom) // 2 AS cy FROM s WHERE denom IS NOT NULL)
SELECT tile, CAST(denom AS BIGINT) AS denom, cx - cx % denom + c * 96 * denom AS x, cy - cy % denom + r * 96 * denom AS y, 96 * denom AS side, c * 96 AS dx, r * 96 AS dy FROM o, range(2) a(r), range(6) b(c)""")
def viewport_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewport.suggest(T.headers(spark, sf_dir), "tile")


@query("""WITH b AS (SELECT l_orderkey * 8 + l_linenumber AS idx, l_orderkey % 1024 AS x, l_partkey % 1024 AS y, 64 AS side, l_suppkey % 3 AS band FROM lineitem),
w AS (SELECT * FROM (VALUES (0, 100, 100, 500, 400), (1, 0, 700, 1024, 900)) t(band, x0, y0, x1, y1))
SELECT idx, coalesce(b.x < x1 AND x0 < b.x + side AND b.y < y1 AND y0 < b.y + side, false) AS required FROM b LEFT JOIN w USING (band)""")
def code_blocks_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code blocks that meet their band's window; a band without a window needs none."""
    li = T.table(spark, sf_dir, "lineitem")
    b = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), (F.col("l_orderkey") % 1024).alias("x"), (F.col("l_partkey") % 1024).alias("y"), (F.col("l_suppkey") % 3).alias("band"))
    w = F.when(F.col("band") == 0, F.array(*map(F.lit, (100, 100, 500, 400)))).when(F.col("band") == 1, F.array(*map(F.lit, (0, 700, 1024, 900))))
    hit = G.intersects(F.col("x"), F.col("y"), F.col("x") + 64, F.col("y") + 64, w[0], w[1], w[2], w[3])
    return b.select("idx", F.coalesce(hit, F.lit(False)).alias("required"))


# ------------------------------------------------------------------ settings and reports


@query("""WITH s AS (SELECT p_partkey AS idx, [' Summary ', 'aggregates', 'ON', 'yes', '0', 'off', '', 'Enabled', 'rows'][p_partkey % 10 + 1] AS v FROM part)
SELECT idx, CASE WHEN lower(trim(v)) IN ('summary', 'aggregates') THEN 'Summary' WHEN lower(trim(v)) IN ('on', 'yes', 'enabled') THEN 'Rows' ELSE 'Disabled' END AS mode FROM s""")
def profile_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine texts and null."""
    k = F.col("p_partkey")
    texts = F.array(*map(F.lit, (" Summary ", "aggregates", "ON", "yes", "0", "off", "", "Enabled", "rows")))
    return T.table(spark, sf_dir, "part").select(k.alias("idx"), P.profile_mode(F.get(texts, (k % 10).cast("int"))).alias("mode"))


@query("WITH c AS (SELECT event_type AS op, user_id % 3 AS path, count(*) AS n FROM events GROUP BY ALL) SELECT row_number() OVER (ORDER BY op, path) - 1 AS n, 'op=' || op || ' path=' || path || ' count=' || n AS line FROM c")
def count_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), (F.col("user_id") % 3).alias("path"))
    return reports.rendered(reports.counts(rows, ["op", "path"]), ["op", "path"], ["count"])


_ROWS = """rows AS (SELECT l_orderkey * 8 + l_linenumber AS input, l_returnflag AS operation, CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_quantity * 100 AS BIGINT) END AS own, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_quantity * 100 AS BIGINT) + l_suppkey % 50 - 20 END AS a,
CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_quantity * 100 AS BIGINT) + l_orderkey % 90 - 40 END AS b, CASE WHEN l_partkey % 55 = 0 THEN 'bad "scan"' END AS error FROM lineitem),
f AS (SELECT *, CASE WHEN own IS NOT NULL AND greatest(own, best) > 0 AND abs(own - best) * 100 <= greatest(own, best) THEN 'own' WHEN a = best THEN 'a' WHEN b = best THEN 'b' END AS fastest FROM (SELECT *, least(own, a, b) AS best FROM rows))"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = (F.col("l_quantity") * 100).cast("long")
    k = F.col("l_partkey")
    return T.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("input"),
        F.col("l_returnflag").alias("operation"),
        F.when(k % 11 != 0, q).alias("own"),
        F.when(k % 5 != 0, q + F.col("l_suppkey") % 50 - 20).alias("a"),
        F.when(k % 3 != 0, q + F.col("l_orderkey") % 90 - 40).alias("b"),
        F.when(k % 55 == 0, 'bad "scan"').alias("error"),
    )


@query(f"""WITH {_ROWS} SELECT input, fastest, concat_ws(',', '"' || input || '"', operation, coalesce(CAST(own AS VARCHAR), ''), coalesce(CAST(a AS VARCHAR), ''), coalesce(CAST(b AS VARCHAR), ''), '"' || replace(coalesce(error, ''), '"', '""') || '"', coalesce(fastest, 'n/a')) AS line FROM f""")
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("fastest", reports.fastest(F.col("own"), {"a": F.col("a"), "b": F.col("b")}))
    shown = rows.withColumn("label", F.coalesce("fastest", F.lit("n/a")))
    return reports.csv_lines(shown, ["input", "operation", "own", "a", "b", "error", "label"], ("input", "error")).select("input", "fastest", "line")


@query(f"""WITH {_ROWS}, l AS (SELECT operation, fastest, error, own, a, b, CASE WHEN abs(own - a) * 100 <= greatest(own, a) THEN 0 WHEN own < a THEN 1 WHEN own > a THEN 2 END AS va, CASE WHEN abs(own - b) * 100 <= greatest(own, b) THEN 0 WHEN own < b THEN 1 WHEN own > b THEN 2 END AS vb FROM f WHERE operation IS NOT NULL),
s AS (SELECT operation, count(*) FILTER (WHERE fastest = 'own') AS n, count(*) FILTER (WHERE va = 1 AND own IS NOT NULL AND a IS NOT NULL) AS aw, count(*) FILTER (WHERE va = 2 AND own IS NOT NULL AND a IS NOT NULL) AS al, count(*) FILTER (WHERE vb = 1 AND own IS NOT NULL AND b IS NOT NULL) AS bw, count(*) FILTER (WHERE vb = 2 AND own IS NOT NULL AND b IS NOT NULL) AS bl, count(error) AS e FROM l GROUP BY operation)
SELECT 0 AS n, '| operation | fastest | a_wins | a_losses | b_wins | b_losses | failures |' AS line UNION ALL SELECT 1, '|---|---:|---:|---:|---:|---:|---:|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY operation), '| ' || concat_ws(' | ', operation, n, aw, al, bw, bl, e) || ' |' FROM s""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.markdown(_rows(spark, sf_dir), {"a": "a", "b": "b"})


_IDS = ["htj2k_cleanup_decode/", "htj2k_metal_route/x_htj2k_", "j2k_public_decode/htj2k_", "plain/", "wsi/htj2k_", "htj2k_cleanup_encode_parallel_4/htj2k_"]


@query(f"""WITH p AS (SELECT p_partkey % 6 AS k, {_IDS}[p_partkey % 6 + 1] || p_partkey AS id FROM part) SELECT id, k IN (0, 2, 4) AS enforced FROM p""")
def enforced_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    out = T.table(spark, sf_dir, "part").select(F.concat(_pick(_IDS, k % 6), k.cast("string")).alias("id"))
    return out.withColumn("enforced", reports.is_enforced(F.col("id")))


@query(f"""WITH {T.HEADERS_SQL} SELECT tile, components = 3 AND width * height * components * 1000 > 536870912 AND tile % 4 <> 1 AS rows_bench FROM headers""")
def rows_bench_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are measured for very large colour inputs, unless whole frames are forced."""
    large = F.col("width") * F.col("height") * F.col("components") * 1000 > 512 << 20
    return T.headers(spark, sf_dir).select("tile", ((F.col("components") == 3) & large & (F.col("tile") % 4 != 1)).alias("rows_bench"))
