"""Queries of the grid, join and target operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import inside
from ..operators import embedding, folds, grid, members, models, stats
from ..sources.tables import ROI_SQL, ROIS, SPX_SQL, cells, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


IN_ROI = " OR ".join(f"(grid_row >= {r} AND grid_row < {r + h} AND grid_col >= {c} AND grid_col < {c + w})" for _, r, c, h, w in ROIS)
AT = ["grid_row", "grid_col"]
EXT_SQL = "ext AS (SELECT max(grid_row) + 1 AS n_rows, max(grid_col) + 1 AS n_cols FROM spx)"
#: Fold geometry of the ROIs: constants, so both engines see the same rectangles.
FOLDS = {i: folds.split(folds.whole(r, c, h, w), 24, 2) for i, r, c, h, w in ROIS}
FOLD_SQL = "fold(roi_idx, fold_id, f_top, f_bottom, f_left, f_right, c_top, c_bottom, c_left, c_right) AS (VALUES " + ", ".join(str(f.row(i, k)) for i, fs in FOLDS.items() for k, f in enumerate(fs)) + ")"


def within(kind: str, cell: str = "s", fold: str = "f") -> str:
    return f"{cell}.grid_row >= {fold}.{kind}_top AND {cell}.grid_row < {fold}.{kind}_bottom AND {cell}.grid_col >= {fold}.{kind}_left AND {cell}.grid_col < {fold}.{kind}_right"


ROI_CELLS = f"{SPX_SQL}, {ROI_SQL}, rc AS (SELECT s.*, roi_idx FROM spx s JOIN roi r ON grid_row >= row0 AND grid_row < row0 + height AND grid_col >= col0 AND grid_col < col0 + width)"


def roi_cells(spark, sf_dir):
    return grid.in_rects(cells(spark, sf_dir), ROIS)


@query(f"WITH {SPX_SQL} SELECT grid_row, grid_col, cluster, y FROM spx WHERE tissue")
def mask_filter(spark, sf_dir):
    return cells(spark, sf_dir).where("tissue").select(*AT, "cluster", "y")


@query(f"WITH {SPX_SQL} SELECT grid_row, grid_col, cluster FROM spx WHERE tissue AND NOT ({IN_ROI})")
def test_predicate(spark, sf_dir):
    return cells(spark, sf_dir).where(F.col("tissue") & ~inside(F.col("grid_row"), F.col("grid_col"), ROIS)).select(*AT, "cluster")


@query(f"WITH {SPX_SQL} SELECT grid_row, grid_col, cluster, ct FROM spx WHERE tissue AND ct <> 'error' AND ({IN_ROI})")
def calib_predicate(spark, sf_dir):
    return cells(spark, sf_dir).where(F.col("tissue") & (F.col("ct") != "error") & inside(F.col("grid_row"), F.col("grid_col"), ROIS)).select(*AT, "cluster", "ct")


@query("SELECT event_id, event_id // 100 AS grid_row, event_id % 100 AS grid_col FROM events")
def linear_index_to_grid(spark, sf_dir):
    return grid.to_grid(table(spark, sf_dir, "events").select("event_id"), "event_id", 100)


@query(f"WITH {ROI_CELLS} SELECT DISTINCT roi_idx FROM rc")
def roi_discovery(spark, sf_dir):
    return roi_cells(spark, sf_dir).select("roi_idx").distinct()


@query(f"WITH {SPX_SQL}, {ROI_SQL} SELECT roi_idx, grid_row - row0 AS grid_row, grid_col - col0 AS grid_col, tissue, ct, y FROM spx JOIN roi ON grid_row >= row0 AND grid_row < row0 + height AND grid_col >= col0 AND grid_col < col0 + width")
def roi_crop(spark, sf_dir):
    return grid.crop(cells(spark, sf_dir), ROIS).select("roi_idx", *AT, "tissue", "ct", "y")


@query(f"WITH {SPX_SQL} SELECT grid_row, grid_col, ({IN_ROI}) AS in_roi FROM spx")
def roi_membership(spark, sf_dir):
    return grid.with_membership(cells(spark, sf_dir).select(*AT), ROIS)


@query(f"WITH {SPX_SQL} SELECT grid_row // 4 AS grid_row, grid_col // 4 AS grid_col, bool_or({IN_ROI}) AS in_roi, bool_or(NOT ({IN_ROI})) AS out_roi FROM spx GROUP BY ALL")
def roi_complement(spark, sf_dir):
    c = grid.with_membership(cells(spark, sf_dir).select(*AT), ROIS)
    return grid.pool(c, 4, [F.bool_or("in_roi").alias("in_roi"), F.bool_or(~F.col("in_roi")).alias("out_roi")])


def _pool_sql(scale: int, what: str) -> str:
    return f"WITH {SPX_SQL}, {EXT_SQL} SELECT grid_row // {scale} AS grid_row, grid_col // {scale} AS grid_col, {what} FROM spx, ext WHERE grid_row < n_rows // {scale} * {scale} AND grid_col < n_cols // {scale} * {scale} GROUP BY ALL"


def _whole(c, scale):
    return grid.whole_windows(c.crossJoin(F.broadcast(grid.extents(c))), F.lit(scale), F.col("n_rows"), F.col("n_cols"))


@query(_pool_sql(3, "CAST(sum(y) AS BIGINT) AS total"))
def pool_sum(spark, sf_dir):
    return grid.pool(_whole(cells(spark, sf_dir), 3), 3, [F.sum("y").alias("total")])


@query(_pool_sql(3, "sum(y) / count(*) AS mean"))
def pool_mean(spark, sf_dir):
    return grid.pool(_whole(cells(spark, sf_dir), 3), 3, [(F.sum("y") / F.count(F.lit(1))).alias("mean")])


@query(_pool_sql(2, "bool_or(cluster = 3) AS hit"))
def pool_any(spark, sf_dir):
    return grid.pool(_whole(cells(spark, sf_dir), 2), 2, [F.bool_or(F.col("cluster") == 3).alias("hit")])


@query(f"WITH {SPX_SQL}, {EXT_SQL}, r AS (SELECT unnest(range(0, 4)) AS k), w AS (SELECT s.y, (grid_row - a.k) // 2 AS grid_row, (grid_col - b.k) // 2 AS grid_col FROM spx s, ext, r a, r b WHERE grid_row >= a.k AND grid_col >= b.k AND (grid_row - a.k) % 2 = 0 AND (grid_col - b.k) % 2 = 0 AND grid_row - a.k + 4 <= n_rows AND grid_col - b.k + 4 <= n_cols) SELECT grid_row, grid_col, CAST(sum(y) AS BIGINT) AS total FROM w GROUP BY ALL")
def pool_strided_overlap(spark, sf_dir):
    c = cells(spark, sf_dir)
    sized = c.crossJoin(F.broadcast(grid.extents(c)))
    return grid.pool_strided(sized, 4, 2, F.col("n_rows"), F.col("n_cols"), [F.sum("y").alias("total")])


@query(f"WITH {SPX_SQL}, k AS (SELECT grid_row // 4 AS grid_row, grid_col // 4 AS grid_col, y, row_number() OVER (PARTITION BY grid_row // 4, grid_col // 4 ORDER BY y DESC) AS k FROM spx) SELECT grid_row, grid_col, avg(y) AS top_mean FROM k WHERE k <= 5 GROUP BY ALL")
def pool_top_n_mean(spark, sf_dir):
    return grid.pool(cells(spark, sf_dir), 4, [grid.top_n_mean(F.col("y").cast("double"), 5).alias("top_mean")])


@query(f"WITH {SPX_SQL}, c AS (SELECT grid_row // 4 AS r, grid_col // 4 AS c, bool_or(cluster = 3) AS hit FROM spx GROUP BY ALL), o AS (SELECT unnest(range(0, 4)) AS k) SELECT r * 4 + a.k AS grid_row, c * 4 + b.k AS grid_col, hit FROM c, o a, o b")
def mask_upsample(spark, sf_dir):
    coarse = grid.pool(cells(spark, sf_dir), 4, [F.bool_or(F.col("cluster") == 3).alias("hit")])
    return grid.upsample(coarse, 4)


@query(f"WITH {SPX_SQL}, {EXT_SQL}, sc AS (SELECT unnest([1, 2, 4])::INTEGER AS scale) SELECT scale, grid_row // scale AS grid_row, grid_col // scale AS grid_col, CAST(sum(y) AS BIGINT) AS y, bool_or(tissue) AS tissue FROM spx, ext, sc WHERE grid_row < n_rows // scale * scale AND grid_col < n_cols // scale * scale GROUP BY ALL")
def scale_pyramid_1_2_4(spark, sf_dir):
    return grid.pyramid(cells(spark, sf_dir), [1, 2, 4], [F.sum("y").alias("y"), F.bool_or("tissue").alias("tissue")], merge=[F.sum("y").alias("y"), F.bool_or("tissue").alias("tissue")])


_EMB = "e AS (SELECT vec_id // 20 AS grid_row, vec_id % 20 AS grid_col, embedding FROM embeddings)"


def _vectors(spark, sf_dir):
    return grid.to_grid(table(spark, sf_dir, "embeddings"), "vec_id", 20)


@query(f"WITH {_EMB}, u AS (SELECT grid_row // 2 AS grid_row, grid_col // 2 AS grid_col, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INTEGER AS place FROM e) SELECT grid_row, grid_col, place, round(avg(x), 6) AS value FROM u GROUP BY ALL")
def embedding_pool_mean(spark, sf_dir):
    return embedding.pool_mean(_vectors(spark, sf_dir), "embedding", 2).withColumn("value", F.round("value", 6))


@query("SELECT vec_id, embedding[1:32] AS emb_global, embedding[33:64] AS emb_local FROM embeddings")
def embedding_halves(spark, sf_dir):
    return embedding.halves(table(spark, sf_dir, "embeddings"), "embedding", 64).select("vec_id", "emb_global", "emb_local")


@query(f"WITH {SPX_SQL} SELECT grid_row, grid_col, CASE WHEN tissue THEN cluster END AS cluster FROM spx")
def label_scatter(spark, sf_dir):
    c = cells(spark, sf_dir)
    return grid.scatter(c.select(*AT), c.where("tissue").select(*AT, "cluster"), AT)


@query(f"WITH {SPX_SQL} SELECT grid_row, grid_col, CASE WHEN tissue THEN y ELSE 0 END AS yhat FROM spx")
def prediction_scatter(spark, sf_dir):
    c = cells(spark, sf_dir)
    return grid.scatter(c.select(*AT), c.where("tissue").select(*AT, F.col("y").alias("yhat")), AT, {"yhat": 0})


TARGETS = [("click", 0.0, ["click"]), ("click or purchase", 0.0, ["click", "purchase"]), ("any but error", 1.0, ["click", "purchase", "view", "signup"])]
_TARGET_SQL = "t AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {c}::DOUBLE, [{', '.join(repr(m) for m in ms)}])" for n, c, ms in TARGETS) + ") v(target, null_number, members))"


def targets(spark):
    return spark.createDataFrame(TARGETS, "target string, null_number double, members array<string>")


@query("WITH t AS (SELECT 'users ' || (user_id % 5)::VARCHAR AS target, round(min(value), 6) AS null_number, list(DISTINCT event_type) AS members FROM events WHERE value > 10 GROUP BY 1) SELECT target, null_number, unnest(members) AS member FROM t")
def target_flatten(spark, sf_dir):
    """Targets made of the event types that a fifth of the users have."""
    e = table(spark, sf_dir, "events").where("value > 10")
    t = e.groupBy(F.concat(F.lit("users "), F.col("user_id") % 5).alias("target")).agg(F.round(F.min("value"), 6).alias("null_number"), F.collect_set("event_type").alias("members"))
    return members.target_members(t)


@query(f"WITH {_TARGET_SQL}, m AS (SELECT target, unnest(members) AS member FROM t) SELECT event_id, target FROM events JOIN m ON event_type = member")
def member_lookup(spark, sf_dir):
    m = members.target_members(targets(spark))
    return table(spark, sf_dir, "events").join(F.broadcast(m), F.col("event_type") == F.col("member")).select("event_id", "target")


@query("WITH g AS (SELECT l_suppkey % 20 AS gene_idx, l_quantity AS count FROM lineitem), q AS (SELECT gene_idx, min(count)::DOUBLE AS lo, quantile_cont(count, 0.9999) AS hi FROM g GROUP BY 1) SELECT gene_idx, count(*) AS n, round(min(lo), 4) AS lo, round(min(hi), 4) AS hi, round(sum(CASE WHEN hi > lo THEN (least(greatest(count, lo), hi) - lo) / (hi - lo) ELSE 0 END), 4) AS total FROM g JOIN q USING (gene_idx) GROUP BY 1")
def gene_standardise(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("gene_idx"), F.col("l_quantity").alias("count"))
    s = members.standardise(g, "gene_idx", "count", members.thresholds(g, "gene_idx", "count"))
    return s.groupBy("gene_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("lo"), 4).alias("lo"), F.round(F.min("hi"), 4).alias("hi"), F.round(F.sum("scaled"), 4).alias("total"))


GENE_TARGETS = [("one gene", 0.05, ["3"]), ("five genes", 0.05, ["1", "3", "5", "7", "9"])]
_GENES = "g AS (SELECT l_orderkey AS cell, l_suppkey % 20 AS gene_idx, l_quantity AS count FROM lineitem), q AS (SELECT gene_idx, quantile_cont(count, 0.9999) AS hi FROM g GROUP BY 1), m AS (SELECT * FROM (VALUES ('one gene', 3), ('five genes', 1), ('five genes', 3), ('five genes', 5), ('five genes', 7), ('five genes', 9)) v(target, gene_idx))"


@query(f"WITH {_GENES} SELECT target, cell, round(sum(count * hi), 4) AS yhat FROM g JOIN q USING (gene_idx) JOIN m USING (gene_idx) GROUP BY ALL")
def meta_gene_weighted_sum(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), (F.col("l_suppkey") % 20).alias("gene_idx"), F.col("l_quantity").alias("yhat"))
    limits = members.thresholds(g, "gene_idx", "yhat").select("gene_idx", "hi")
    m = members.target_members(spark.createDataFrame(GENE_TARGETS, "target string, null_number double, members array<string>")).withColumn("member", F.col("member").cast("long"))
    out = members.weighted_sum(g.join(F.broadcast(limits), "gene_idx"), F.broadcast(m), ["cell"], "gene_idx")
    return out.withColumn("yhat", F.round("yhat", 4))


@query(f"WITH {ROI_CELLS}, q AS (SELECT cluster, roi_idx, quantile_cont(y, 0.9999) AS q FROM rc WHERE tissue GROUP BY ALL) SELECT cluster, roi_idx, round(greatest(1.0, max(q) OVER (PARTITION BY cluster ORDER BY roi_idx ROWS UNBOUNDED PRECEDING)), 4) AS norm FROM q")
def running_norm(spark, sf_dir):
    return members.running_norm(roi_cells(spark, sf_dir).where("tissue"), ["cluster"], "roi_idx", "y").withColumn("norm", F.round("norm", 4))


@query(f"WITH {SPX_SQL} SELECT grid_row // 2 AS grid_row, grid_col // 2 AS grid_col, CAST(sum((ct IN ('click', 'purchase'))::INTEGER) AS BIGINT) AS truth, avg((ct IN ('click', 'purchase'))::INTEGER) AS share FROM spx GROUP BY ALL")
def composite_cell_type(spark, sf_dir):
    one = members.composite(F.col("ct"), ["click", "purchase"])
    return grid.pool(cells(spark, sf_dir), 2, [F.sum(one).alias("truth"), F.avg(one).alias("share")])


@query(f"WITH {ROI_CELLS}, {FOLD_SQL} SELECT s.roi_idx, fold_id, grid_row, grid_col FROM rc s JOIN fold f ON s.roi_idx = f.roi_idx AND {within('c')}")
def fold_assignment(spark, sf_dir):
    return folds.assign(roi_cells(spark, sf_dir), folds.fold_table(spark, FOLDS)).select("roi_idx", "fold_id", *AT)


@query(f"WITH {ROI_CELLS}, {FOLD_SQL} SELECT f.roi_idx AS fold_roi, fold_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS total FROM rc s, fold f WHERE tissue AND (s.roi_idx <> f.roi_idx OR NOT ({within('f')})) GROUP BY ALL")
def fold_training_complement(spark, sf_dir):
    return folds.training_sums(roi_cells(spark, sf_dir).where("tissue"), folds.fold_table(spark, FOLDS), "y")


@query(f"WITH {ROI_CELLS}, {FOLD_SQL} SELECT s.roi_idx, fold_id, cluster, count(*) AS n_total, count(*) FILTER (WHERE NOT ({within('f')})) AS n_outside FROM rc s JOIN fold f ON s.roi_idx = f.roi_idx WHERE tissue GROUP BY ALL")
def cluster_retention(spark, sf_dir):
    return folds.retention(roi_cells(spark, sf_dir).where("tissue"), folds.fold_table(spark, FOLDS))


@query(f"WITH {ROI_CELLS} SELECT roi_idx, min(grid_row) AS top, min(grid_col) AS left, max(grid_row) - min(grid_row) + 1 AS height, max(grid_col) - min(grid_col) + 1 AS width, count(*) = (max(grid_row) - min(grid_row) + 1) * (max(grid_col) - min(grid_col) + 1) AS solid FROM rc GROUP BY 1".replace(" AS left", ' AS "left"'))
def bounding_box(spark, sf_dir):
    return folds.bounding_box(roi_cells(spark, sf_dir), "roi_idx")


@query(f"WITH {SPX_SQL}, d AS (SELECT unnest(range(0, 17)) AS cluster) SELECT cluster, coalesce(n, 0) AS n FROM d LEFT JOIN (SELECT cluster, count(*) AS n FROM spx WHERE tissue GROUP BY 1) USING (cluster)")
def cluster_counts(spark, sf_dir):
    domain = spark.range(17).select(F.col("id").alias("cluster"))
    return stats.counts_over_domain(cells(spark, sf_dir).where("tissue"), "cluster", domain)


CROSS_SQL = f"""{ROI_CELLS}, {FOLD_SQL}, k AS (SELECT * FROM rc WHERE tissue), every AS (SELECT ct, sum(y) AS s, count(*) AS n FROM k GROUP BY 1),
held AS (SELECT s.roi_idx, fold_id, ct, sum(y) AS s, count(*) AS n FROM k s JOIN fold f ON s.roi_idx = f.roi_idx AND {within('f')} GROUP BY ALL),
model AS (SELECT f.roi_idx, f.fold_id, e.ct, CASE WHEN e.n > coalesce(h.n, 0) THEN (e.s - coalesce(h.s, 0)) / (e.n - coalesce(h.n, 0)) ELSE 0 END AS yhat FROM every e CROSS JOIN fold f LEFT JOIN held h ON h.roi_idx = f.roi_idx AND h.fold_id = f.fold_id AND h.ct = e.ct)"""


@query(f"WITH {CROSS_SQL} SELECT s.roi_idx, f.fold_id, grid_row, grid_col, round(yhat, 6) AS yhat FROM k s JOIN fold f ON s.roi_idx = f.roi_idx AND {within('c')} JOIN model m ON m.roi_idx = f.roi_idx AND m.fold_id = f.fold_id AND m.ct = s.ct")
def crossfit_mean_predictor(spark, sf_dir):
    fitted = models.crossfit_mean(roi_cells(spark, sf_dir).where("tissue"), folds.fold_table(spark, FOLDS), "ct", "y")
    return fitted.select("roi_idx", "fold_id", *AT, F.round("yhat", 6).alias("yhat"))


@query(f"WITH {SPX_SQL}, n AS (SELECT cluster, ct, count(*) AS n FROM spx GROUP BY ALL) SELECT cluster, ct AS mode, n FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, ct) = 1")
def label_mode(spark, sf_dir):
    return stats.mode_by(cells(spark, sf_dir), ["cluster"], "ct")


@query(f"WITH {SPX_SQL}, n AS (SELECT cluster, count(*) AS n FROM spx GROUP BY 1) SELECT cluster, n, (row_number() OVER (ORDER BY n DESC, cluster) - 1)::INTEGER AS rank FROM n")
def rank_by_frequency(spark, sf_dir):
    return stats.rank_by_frequency(cells(spark, sf_dir), "cluster")
