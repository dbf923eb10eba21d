"""Queries of tissue detection, texture, components and models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.scores import rounded
from ..operators import blocks, embedding, grid, models, strata, tissue
from ..operators.shared import shared_path
from ..sources import part_source, results
from ..sources.tables import SPX_SQL, cells, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_PATCH = "p AS (SELECT l_suppkey AS patch, l_quantity AS a, l_extendedprice / 1000 AS b, l_discount * 100 AS c FROM lineitem)"
_MEANS = f"{_PATCH}, u AS (SELECT patch, unnest([a, b, c]) AS x FROM p), d AS (SELECT patch, stddev_pop(x) AS deviation FROM u GROUP BY 1), m AS (SELECT patch, avg(a) AS mean_a, avg(b) AS mean_b, avg(c) AS mean_c FROM p GROUP BY 1)"
_Z = f"{_MEANS}, v AS (SELECT var_pop(mean_a) AS va, var_pop(mean_b) AS vb, var_pop(mean_c) AS vc FROM m), z AS (SELECT patch, (mean_a * va + mean_b * vb + mean_c * vc) / (va + vb + vc) AS z, deviation FROM m JOIN d USING (patch), v)"


def patches(spark, sf_dir):
    px = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("patch"), F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_discount") * 100).alias("c"))
    return tissue.patch_statistics(px, "patch", ["a", "b", "c"])


def weighted(spark, sf_dir):
    return tissue.variance_weighted_mean(patches(spark, sf_dir), ["mean_a", "mean_b", "mean_c"])


@query(f"WITH {_MEANS} SELECT patch, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_c, 6) AS mean_c, round(deviation, 6) AS deviation FROM m JOIN d USING (patch)")
def patch_stats(spark, sf_dir):
    return patches(spark, sf_dir).select("patch", *(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "mean_c", "deviation")))


@query(f"WITH {_Z} SELECT patch, round(z, 6) AS z FROM z")
def variance_weighted_mean(spark, sf_dir):
    return weighted(spark, sf_dir).select("patch", F.round("z", 6).alias("z"))


@query(f"WITH {_Z}, n AS (SELECT patch, (deviation - min(deviation) OVER ()) / (max(deviation) OVER () - min(deviation) OVER ()) + 1 AS d, (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) + 1 AS z FROM z) SELECT patch, round((d / z - min(d / z) OVER ()) / (max(d / z) OVER () - min(d / z) OVER ()), 6) AS ratio FROM n")
def minmax_ratio(spark, sf_dir):
    return tissue.deviation_ratio(weighted(spark, sf_dir)).select("patch", F.round("ratio", 6).alias("ratio"))


BINS = 8
_H = f"{SPX_SQL}, m AS (SELECT min(value) AS x0, max(value) AS x1, min(cluster) AS y0, max(cluster) AS y1 FROM spx), h AS (SELECT least({BINS - 1}, floor((value - x0) / (x1 - x0) * {BINS})::INTEGER) AS x_bin, least({BINS - 1}, floor((cluster - y0) / (y1 - y0) * {BINS})::INTEGER) AS y_bin, count(*) AS n FROM spx, m GROUP BY ALL)"


@query(f"WITH {_H} SELECT x_bin, y_bin, n FROM h")
def histogram2d(spark, sf_dir):
    return tissue.histogram2d(cells(spark, sf_dir), "value", "cluster", BINS)


_KERNEL = "k AS (SELECT d, exp(-0.5 * d * d) AS w FROM (SELECT unnest(range(-4, 5)) AS d)), kn AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k)"
_MIRROR = lambda x: f"(CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} >= {BINS} THEN {2 * BINS - 1} - ({x}) ELSE {x} END)"
_SMOOTH = f"{_H}, {_KERNEL}, g AS (SELECT a.i AS x_bin, b.i AS y_bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, {BINS}))::INTEGER AS i) a CROSS JOIN (SELECT unnest(range(0, {BINS}))::INTEGER AS i) b LEFT JOIN h ON h.x_bin = a.i AND h.y_bin = b.i), g1 AS (SELECT o.x_bin, o.y_bin, sum(g.n * w) AS n FROM g o CROSS JOIN kn JOIN g ON g.x_bin = {_MIRROR('o.x_bin + kn.d')} AND g.y_bin = o.y_bin GROUP BY ALL), g2 AS (SELECT o.x_bin, o.y_bin, sum(g.n * w) AS density FROM g1 o CROSS JOIN kn JOIN g1 g ON g.y_bin = {_MIRROR('o.y_bin + kn.d')} AND g.x_bin = o.x_bin GROUP BY ALL)"


@query(f"WITH {_SMOOTH} SELECT event_id, round(coalesce(density, 0), 4) AS density FROM spx CROSS JOIN m LEFT JOIN g2 ON g2.x_bin = ceil((value - x0) / (x1 - x0) * {BINS})::INTEGER - 1 AND g2.y_bin = ceil((cluster - y0) / (y1 - y0) * {BINS})::INTEGER - 1")
def density_lookup(spark, sf_dir):
    c = cells(spark, sf_dir)
    smoothed = tissue.smooth(tissue.histogram2d(c, "value", "cluster", BINS), BINS, 1.0)
    return tissue.density_lookup(c, smoothed, "value", "cluster", BINS).select("event_id", F.round("density", 4).alias("density"))


_OTSU = f"{SPX_SQL}, cut AS (SELECT quantile_cont(value, 0.9) AS cut FROM spx), x AS (SELECT value FROM spx, cut WHERE value < cut), m AS (SELECT min(value) AS lo, max(value) AS hi FROM x), h AS (SELECT least(255, floor((value - lo) / (hi - lo) * 256)::INTEGER) AS bin, lo + (least(255, floor((value - lo) / (hi - lo) * 256)::INTEGER) + 0.5) * (hi - lo) / 256 AS centre, count(*) AS n FROM x, m GROUP BY ALL), s AS (SELECT bin, centre, sum(n) OVER o AS n1, sum(n * centre) OVER o AS s1, sum(n) OVER () AS n, sum(n * centre) OVER () AS s FROM h WINDOW o AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)), t AS (SELECT centre AS threshold FROM s WHERE n > n1 ORDER BY n1::DOUBLE * (n - n1) * pow(s1 / n1 - (s - s1) / (n - n1), 2) DESC, bin LIMIT 1)"


@query(f"WITH {_OTSU} SELECT round(threshold, 6) AS threshold, (SELECT count(*) FROM spx, t WHERE value < threshold) AS n_low FROM t")
def otsu_threshold(spark, sf_dir):
    c = cells(spark, sf_dir).select("event_id", "value")
    cut = c.agg(F.percentile("value", F.lit(0.9)).alias("cut"))
    t = tissue.otsu(c.crossJoin(F.broadcast(cut)).where("value < cut"), "value")
    return c.crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.count_if(F.col("value") < F.col("threshold")).alias("n_low")).withColumn("threshold", F.round("threshold", 6))


@query("SELECT l_suppkey AS patch, count(*) AS n, count(*) FILTER (WHERE sqrt(((r - m) * (r - m) + (g - m) * (g - m) + (b - m) * (b - m)) / 3) < 10 OR (g > r + 20 AND g > b + 20) OR (r > 230 AND g > 230 AND b > 230)) AS rejected FROM (SELECT *, (r + g + b) / 3 AS m FROM (SELECT l_suppkey, (l_quantity * 5)::DOUBLE AS r, floor(l_extendedprice / 410)::DOUBLE AS g, round(l_discount * 2500)::DOUBLE AS b FROM lineitem)) GROUP BY 1")
def colour_reject(spark, sf_dir):
    """Colours made of a row's quantity, price and discount, rejected ones counted by patch."""
    from ..functions.scores import rejected_colour

    r, g, b = (F.col("l_quantity") * 5).cast("double"), F.floor(F.col("l_extendedprice") / 410).cast("double"), F.round(F.col("l_discount") * 2500).cast("double")
    px = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("patch"), rejected_colour(r, g, b).alias("rejected"))
    return px.groupBy("patch").agg(F.count(F.lit(1)).alias("n"), F.count_if("rejected").alias("rejected"))


@query(f"WITH {SPX_SQL} SELECT cluster, round(avg(value), 6) AS value, round(avg(y), 6) AS y, count(*) AS size FROM spx GROUP BY 1")
def group_means(spark, sf_dir):
    m = tissue.group_means(cells(spark, sf_dir), "cluster", ["value", "y"])
    return m.withColumns({"value": F.round("value", 6), "y": F.round("y", 6)})


@query(f"WITH {SPX_SQL} SELECT cluster, count(*) AS size FROM spx GROUP BY 1 ORDER BY sum(y) / count(*), cluster LIMIT 2")
def lowest_two_groups(spark, sf_dir):
    m = cells(spark, sf_dir).groupBy("cluster").agg((F.sum("y") / F.count(F.lit(1))).alias("mean_y"), F.count(F.lit(1)).alias("size"))
    return tissue.lowest_groups(m, "cluster", F.col("mean_y")).select("cluster", "size")


@query(f"WITH {SPX_SQL}, g AS (SELECT grid_row, grid_col, cluster, least(15, floor(value / 4)::INTEGER) AS q FROM spx), a AS (SELECT l.cluster, l.q AS a, r.q AS b FROM g l JOIN g r ON l.grid_row = r.grid_row AND l.grid_col + 1 = r.grid_col), s AS (SELECT cluster, a, b FROM a UNION ALL SELECT cluster, b, a FROM a), n AS (SELECT cluster, a, b, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS q FROM n) SELECT cluster, round(sqrt(sum(q * q)), 6) AS energy, round(sum(q / (1 + (a - b) * (a - b))), 6) AS homogeneity, round(-sum(q * log2(q)), 6) AS entropy FROM p GROUP BY 1")
def glcm_features(spark, sf_dir):
    g = cells(spark, sf_dir).select("grid_row", "grid_col", "cluster", F.least(F.lit(15), F.floor(F.col("value") / 4)).alias("q"))
    right = g.select("grid_row", (F.col("grid_col") - 1).alias("grid_col"), F.col("q").alias("b"))
    out = tissue.glcm_features(g.withColumnRenamed("q", "a").join(right, ["grid_row", "grid_col"]), "cluster", "a", "b")
    return out.select("cluster", *(F.round(c, 6).alias(c) for c in ("energy", "homogeneity", "entropy")))


_GRAPH = f"RECURSIVE {SPX_SQL}, on_ AS (SELECT grid_row, grid_col, grid_row * 2147483648 + grid_col AS v FROM spx WHERE value > 30), e AS (SELECT a.v AS v, b.v AS u FROM on_ a JOIN on_ b ON abs(a.grid_row - b.grid_row) <= 1 AND abs(a.grid_col - b.grid_col) <= 1), reach AS (SELECT v, u FROM e UNION SELECT r.v, e.u FROM reach r JOIN e ON r.u = e.v), comp AS (SELECT v, min(u) AS component FROM reach GROUP BY 1)"


def _bright(spark, sf_dir):
    return cells(spark, sf_dir).where("value > 30").select("grid_row", "grid_col")


@query(f"WITH {_GRAPH} SELECT grid_row, grid_col, component FROM on_ JOIN comp USING (v)")
def connected_components(spark, sf_dir):
    return tissue.connected_components(_bright(spark, sf_dir))


@query(f"WITH {_GRAPH} SELECT grid_row, grid_col FROM on_ JOIN comp USING (v) WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 3)")
def remove_small_objects(spark, sf_dir):
    return tissue.without_small(_bright(spark, sf_dir), 3).select("grid_row", "grid_col")


@query(f"WITH {SPX_SQL} SELECT grid_row // 4 AS grid_row, grid_col // 4 AS grid_col, avg((value > 8)::INTEGER) > 0.5 AS bright FROM spx GROUP BY ALL")
def mask_majority(spark, sf_dir):
    return tissue.majority_mask(cells(spark, sf_dir).withColumn("bright", F.col("value") > 8), "bright", 4)


@query(f"WITH {SPX_SQL}, o AS (SELECT unnest(range(-1, 2)) AS k), n AS (SELECT s.grid_row + a.k AS grid_row, s.grid_col + b.k AS grid_col, avg(s.y) AS m FROM spx s, o a, o b WHERE tissue AND (a.k <> 0 OR b.k <> 0) GROUP BY ALL) SELECT s.grid_row, s.grid_col, round(CASE WHEN tissue THEN y ELSE m END, 4) AS y FROM spx s LEFT JOIN n ON n.grid_row = s.grid_row AND n.grid_col = s.grid_col")
def impute_missing(spark, sf_dir):
    c = cells(spark, sf_dir).select("grid_row", "grid_col", F.when(F.col("tissue"), F.col("y")).cast("double").alias("y"))
    return tissue.neighbour_fill(c, "y").withColumn("y", F.round("y", 4))


@query(f"WITH {SPX_SQL}, t AS (SELECT grid_row, grid_col FROM spx WHERE tissue), o AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(a, b)) SELECT t.grid_row - a AS grid_row, t.grid_col - b AS grid_col FROM t, o GROUP BY ALL HAVING count(*) = 5")
def erode_mask(spark, sf_dir):
    return tissue.erode(cells(spark, sf_dir).where("tissue"), 1)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("vector", array_to_vector(F.col("embedding").cast("array<double>")))


@query()
def pca_halves(spark, sf_dir):
    _, out = embedding.reduce_halves(table(spark, sf_dir, "embeddings"), "embedding", 64, 8)
    return embedding.component_facts(out, "reduced").withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 6)})


@query()
def kmeans_clusters(spark, sf_dir):
    _, out = embedding.stratify(_vectors(spark, sf_dir), "vector", 64)
    return out.select("vec_id", "cluster")


@query()
def gmm_groups(spark, sf_dir):
    m = patches(spark, sf_dir)
    return embedding.mixture(m, ["mean_a", "mean_b", "mean_c"]).select("patch", "label")


@query()
def mlp_classifier(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    out = models.type_classifier(v.select(F.col("vector").alias("features"), "label"), 64, epochs=60).transform(v.withColumnRenamed("vector", "features"))
    return out.select("vec_id", F.array_max(vector_to_array("probability")).alias("top_probability"), F.col("prediction").cast("int").alias("prediction"))


#: Facts of fitted models that hold whatever the fit: SQL can state these, not the fits.
_HALF_VARIANCE = "SELECT half, round(sum(v), 6) AS variance, round(sum(m), 6) + 0.0 AS mean FROM (SELECT half, var_pop(x) AS v, 0.0::DOUBLE AS m FROM (SELECT CASE WHEN i <= 32 THEN 'global' ELSE 'local' END AS half, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) GROUP BY half, i) GROUP BY half"


@query(_HALF_VARIANCE)
def pca_keeps_variance(spark, sf_dir):
    """All components of a half are centred and hold the half's whole variance."""
    _, out = embedding.reduce_halves(table(spark, sf_dir, "embeddings"), "embedding", 64, 32)
    facts = embedding.component_facts(out, "reduced")
    half = F.when(F.col("place") < 32, "global").otherwise("local").alias("half")
    return facts.groupBy(half).agg(F.round(F.sum("variance"), 6).alias("variance"), (F.round(F.sum("mean"), 6) + 0.0).alias("mean"))


@query("SELECT count(*) AS n, true AS in_range, true AS nearest FROM embeddings")
def kmeans_assigns_all(spark, sf_dir):
    """Every row has one of the k labels, that of the nearest centre."""
    model, out = embedding.stratify(_vectors(spark, sf_dir), "vector", 64)
    centres = F.array(*(F.array(*map(F.lit, map(float, c))) for c in model.stages[-1].clusterCenters()))
    x = vector_to_array("vector")
    far = F.transform(centres, lambda c: F.aggregate(F.zip_with(c, x, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    near = F.get(far, F.col("cluster")) <= F.array_min(far) + 1e-9
    return out.select("cluster", near.alias("near")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("cluster").between(0, embedding.K - 1)).alias("in_range"), F.bool_and("near").alias("nearest"))


@query(f"WITH {_MEANS} SELECT count(*) AS n, true AS in_range, true AS likelier, true AS told_apart FROM m")
def gmm_labels_all(spark, sf_dir):
    """Every patch has a label, three components are likelier than one, and labels differ in their means by more than patches within one."""
    m = patches(spark, sf_dir)
    means = ["mean_a", "mean_b", "mean_c"]
    out = embedding.mixture(m, means)
    spread = out.groupBy("label").agg(F.count(F.lit(1)).alias("k"), *(F.var_pop(c).alias(c) for c in means)).agg(*((F.sum(F.col("k") * F.col(c)) / F.sum("k")).alias(c) for c in means)).collect()[0]
    whole = m.agg(*(F.var_pop(c).alias(c) for c in means)).collect()[0]
    apart = any(spread[c] < 0.9 * whole[c] for c in means)
    likelier = embedding.mixture_likelihood(m, means, 3) >= embedding.mixture_likelihood(m, means, 1)
    return out.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("label").between(0, 2)).alias("in_range")).withColumns({"likelier": F.lit(likelier), "told_apart": F.lit(apart)})


@query("SELECT count(*) AS n, true AS sums_to_one, true AS takes_the_top, true AS beats_majority FROM embeddings")
def mlp_gives_distributions(spark, sf_dir):
    """Probabilities of every row sum to 1, the prediction is the likeliest type, and is right more often than the most frequent type."""
    v = _vectors(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    out = models.type_classifier(v.select(F.col("vector").alias("features"), "label"), 64).transform(v.withColumnRenamed("vector", "features"))
    p = vector_to_array("probability")
    one = F.abs(F.aggregate(p, F.lit(0.0), lambda s, x: s + x) - 1) < 1e-9
    top = F.get(p, F.col("prediction").cast("int")) == F.array_max(p)
    most = out.groupBy("label_index").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k").alias("most"))
    facts = out.agg(F.count(F.lit(1)).alias("n"), F.bool_and(one).alias("sums_to_one"), F.bool_and(top).alias("takes_the_top"), F.count_if(F.col("prediction") == F.col("label_index")).alias("right"))
    return facts.crossJoin(most).select("n", "sums_to_one", "takes_the_top", (F.col("right") > F.col("most")).alias("beats_majority"))


def _smooth_sql(axis: str, other: str, n: str, rows: str) -> str:
    at = f"o.{axis} + kn.d"
    mirrored = f"(CASE WHEN {at} < 0 THEN -1 - ({at}) WHEN {at} >= {n} THEN 2 * {n} - 1 - ({at}) ELSE {at} END)"
    return f"SELECT o.grid_row, o.grid_col, sum(g.y * w) AS y FROM {rows} o CROSS JOIN kn CROSS JOIN ext JOIN {rows} g ON g.{axis} = {mirrored} AND g.{other} = o.{other} GROUP BY ALL"


@query(f"WITH {SPX_SQL}, {_KERNEL}, ext AS (SELECT max(grid_row) + 1 AS n_rows, max(grid_col) + 1 AS n_cols FROM spx), s1 AS ({_smooth_sql('grid_row', 'grid_col', 'n_rows', 'spx')}), s2 AS ({_smooth_sql('grid_col', 'grid_row', 'n_cols', 's1')}) SELECT grid_row, grid_col, round(y, 4) AS y FROM s2")
def smoothen(spark, sf_dir):
    return tissue.smoothen(cells(spark, sf_dir), "y", 4).withColumn("y", F.round("y", 4))


@query(f"WITH {SPX_SQL}, o AS (SELECT unnest(range(-2, 3)) AS d), n AS (SELECT c.grid_row, c.grid_col, a.d AS dr, b.d AS dc, coalesce(g.y, 0) AS y FROM spx c CROSS JOIN o a CROSS JOIN o b LEFT JOIN spx g ON g.grid_row = c.grid_row + a.d AND g.grid_col = c.grid_col + b.d) SELECT grid_row, grid_col, string_agg(y::BIGINT::VARCHAR, ',' ORDER BY dr, dc) AS patch FROM n GROUP BY ALL")
def context_patches(spark, sf_dir):
    """The 5 x 5 cells around each cell, zeros beyond the border, by blocks."""
    out = blocks.context(cells(spark, sf_dir), "y", 2)
    return out.select("grid_row", "grid_col", F.array_join(F.transform("patch", lambda v: v.cast("long").cast("string")), ",").alias("patch"))


_RESCALE = """i AS (SELECT max(grid_row) + 1 AS h, max(grid_col) + 1 AS w FROM spx),
tr AS (SELECT r, least(greatest((r + 0.5) / 1.3 - 0.5, 0), h - 1) AS y, h FROM i, unnest(range(CAST(round_even(h * 1.3, 0) AS BIGINT))) u(r)), tc AS (SELECT c, least(greatest((c + 0.5) / 1.3 - 0.5, 0), w - 1) AS x, w FROM i, unnest(range(CAST(round_even(w * 1.3, 0) AS BIGINT))) u(c)),
t AS (SELECT r, c, floor(y)::BIGINT AS y0, least(floor(y)::BIGINT + 1, h - 1) AS y1, y - floor(y) AS fy, floor(x)::BIGINT AS x0, least(floor(x)::BIGINT + 1, w - 1) AS x1, x - floor(x) AS fx FROM tr, tc)"""


@query(f"WITH {SPX_SQL}, {_RESCALE} SELECT r AS grid_row, c AS grid_col, round((a.y * (1 - fx) + b.y * fx) * (1 - fy) + (d.y * (1 - fx) + e.y * fx) * fy, 3) AS y FROM t JOIN spx a ON a.grid_row = y0 AND a.grid_col = x0 JOIN spx b ON b.grid_row = y0 AND b.grid_col = x1 JOIN spx d ON d.grid_row = y1 AND d.grid_col = x0 JOIN spx e ON e.grid_row = y1 AND e.grid_col = x1")
def rescale_grid(spark, sf_dir):
    """The grid at 1.3 times its size."""
    return blocks.rescale(cells(spark, sf_dir), "y", 1.3).select("grid_row", "grid_col", F.round("y", 3).alias("y"))


@query("SELECT vec_id // 20 AS grid_row, vec_id % 20 AS grid_col, list_transform(list_slice(embedding, 33, 64), lambda x: round(x::DOUBLE, 4)) AS emb FROM embeddings WHERE label <> 3")
def parts_round_trip(spark, sf_dir):
    """Embeddings written as part files of 128 rows and read back by ranges of 50: the local half of the cells in the mask."""
    path = shared_path(spark, "embedding-parts")
    e = table(spark, sf_dir, "embeddings")
    part_source.write_parts(e, path, "vec_id", "embedding", 128)
    mask = grid.to_grid(e.where("label <> 3"), "vec_id", 20).select("grid_row", "grid_col")
    got = part_source.read_parts(spark, path, 20, rows_per_range=50, halves="local").join(mask, ["grid_row", "grid_col"], "left_semi")
    return got.select("grid_row", "grid_col", F.transform("emb_local", lambda x: rounded(x.cast("double"), 4)).alias("emb"))


@query("WITH l AS (SELECT UNNEST([1, 2]) AS scale) SELECT scale, count(DISTINCT (vec_id // 20 // scale, vec_id % 20 // scale)) AS windows, true AS in_range, true AS nearest, true AS tighter FROM embeddings, l GROUP BY 1")
def strata_by_scale(spark, sf_dir):
    """Each scale's windows have the stratum of the nearest centre of the scale's own model; strata are tighter than one cluster."""
    e = grid.to_grid(table(spark, sf_dir, "embeddings"), "vec_id", 20).select(F.lit("s").alias("slide_id"), "grid_row", "grid_col", F.col("embedding").alias("emb"))
    store = strata.StrataStore(spark, shared_path(spark, "strata"))
    labels = strata.strata(store, e, e.limit(0).withColumn("roi_idx", F.lit(0)), "emb", 64, [1, 2], k=4).where("roi_idx IS NULL")
    out = None
    for scale in (1, 2):
        centres = store.model(scale, 4, lambda: None).stages[-1].clusterCenters()
        v = embedding.pooled_vectors(e, "emb", scale).join(labels.where(F.col("scale") == scale), ["grid_row", "grid_col"])
        far = F.transform(F.array(*(F.array(*map(F.lit, map(float, c))) for c in centres)), lambda c: F.aggregate(F.zip_with(c, F.col("emb"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        mean = v.select(F.posexplode("emb").alias("place", "x")).groupBy("place").agg(F.var_pop("x").alias("v")).agg(F.sum("v").alias("all_v"))
        facts = v.withColumn("_far", far).agg(F.count(F.lit(1)).alias("windows"), F.bool_and(F.col("cluster").between(0, 3)).alias("in_range"), F.bool_and(F.get("_far", F.col("cluster")) <= F.array_min("_far") + 1e-9).alias("nearest"), F.avg(F.get("_far", F.col("cluster"))).alias("within"))
        one = facts.crossJoin(mean).select(F.lit(scale).alias("scale"), "windows", "in_range", "nearest", (F.col("within") < F.col("all_v")).alias("tighter"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {SPX_SQL}, c AS (SELECT 'a' AS target, grid_row, grid_col, (event_id % 101) / 100.0 AS x FROM spx), r AS (SELECT *, " + ", ".join(f"round(255 * least(1, greatest(0, (x - {a}) / {b - a}))) AS {n}" for n, a, b in (("r", 0.0, 0.375), ("g", 0.375, 0.75), ("b", 0.75, 1.0))) + " FROM c) SELECT grid_row // 64 AS tile_row, grid_col // 64 AS tile_col, count(*) AS n_cells, CAST(sum(r) + sum(g) + sum(b) + 3 * 255 * (64 * 64 - count(*)) AS BIGINT) AS light FROM r GROUP BY ALL")
def confidence_map_tiles(spark, sf_dir):
    """A stand-in confidence as map tiles, committed and read back: cells of each tile and the sum of its bytes."""
    c = cells(spark, sf_dir).select(F.lit("a").alias("target"), F.lit(1).alias("scale"), "grid_row", "grid_col", ((F.col("event_id") % 101) / 100).alias("confidence"))
    path = shared_path(spark, "confidence-maps")
    results.save(results.map_tiles(c, side=64), path)
    pairs = F.filter(F.split(F.hex("rgb"), r"(?<=\G..)"), lambda x: x != "")
    light = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + F.conv(x, 16, 10).cast("long"))
    return results.load(spark, path).select("tile_row", "tile_col", "n_cells", light.alias("light"))
