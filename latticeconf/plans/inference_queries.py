"""Queries of the conformal method, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import LEVELS, clipped_score, confidence
from ..operators import audit, conformal, folds, grid, linear, models
from ..operators.quantiles import quantiles
from ..operators.shared import shared_path, written
from ..sources.tables import ROI_SQL, ROIS, SPX_SQL, as_cells, cells
from ..streaming import scoring
from . import inference
from .grid_queries import FOLD_SQL, FOLDS, IN_ROI, within

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


NULL_NUMBER = 1500
#: Single-scale set-up: calibration is a third of the rows, a stand-in prediction of whole numbers.
BASE = f"{SPX_SQL}, b AS (SELECT event_id, cluster, y, CASE WHEN event_id % 7 = 0 THEN 700 + event_id % 11 * 60 ELSE y + (event_id * 37) % 901 - 450 END AS yhat, event_id % 3 = 0 AS calib FROM spx WHERE tissue), s AS (SELECT *, CASE WHEN calib AND y > {NULL_NUMBER} THEN 'infinity'::DOUBLE ELSE -yhat::DOUBLE END AS score FROM b)"
RANKED = f"{BASE}, u AS (SELECT *, sum(calib::INTEGER) OVER (PARTITION BY cluster ORDER BY score RANGE UNBOUNDED PRECEDING) - sum(calib::INTEGER) OVER (PARTITION BY cluster, score) AS smaller, sum(calib::INTEGER) OVER (PARTITION BY cluster) AS n FROM s), p AS (SELECT event_id, cluster, y, (smaller + 1) / (n + 1) AS p FROM u WHERE NOT calib)"
ADJUSTED = f"{RANKED}, r AS (SELECT *, count(*) OVER (PARTITION BY cluster) * p / count(*) OVER (PARTITION BY cluster ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM p), a AS (SELECT event_id, cluster, y, p, least(1, min(raw) OVER (PARTITION BY cluster ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS p_adj FROM r)"
CONFIDENCE_SQL = "greatest(0, least(1, ln(0.5 / p_adj) / ln(50)))"


def base(spark, sf_dir):
    return predicted(cells(spark, sf_dir))


def predicted(c):
    """Tissue cells with the stand-in prediction and their part."""
    c = c.where("tissue")
    e = F.col("event_id")
    yhat = F.when(e % 7 == 0, 700 + e % 11 * 60).otherwise(F.col("y") + (e * 37) % 901 - 450)
    return c.select("event_id", "cluster", "y", yhat.alias("yhat"), (e % 3 == 0).alias("calib"), F.lit(NULL_NUMBER).alias("null_number"))


def _sides(spark, sf_dir):
    b = base(spark, sf_dir)
    return b.where("calib"), b.where("NOT calib")


@query(f"WITH {BASE} SELECT event_id, score FROM s")
def nonconformity(spark, sf_dir):
    b = base(spark, sf_dir)
    yhat = F.col("yhat").cast("double")  # before the sign, which whole numbers lack at zero
    return b.select("event_id", F.when(F.col("calib"), clipped_score(F.col("y"), yhat, F.col("null_number"))).otherwise(-yhat).alias("score"))


@query(f"WITH {RANKED} SELECT event_id, p FROM p")
def conformal_rank_p(spark, sf_dir):
    return conformal.adjusted(*_sides(spark, sf_dir), ["cluster"]).select("event_id", "p")


@query(f"WITH {ADJUSTED} SELECT event_id, round(p_adj, 9) AS p_adj FROM a")
def bh_adjust(spark, sf_dir):
    return conformal.adjusted(*_sides(spark, sf_dir), ["cluster"]).select("event_id", F.round("p_adj", 9).alias("p_adj"))


@query(f"WITH {ADJUSTED} SELECT event_id, round(p_adj, 9) AS p_adj FROM a")
def bh_adjust_by_ranges(spark, sf_dir):
    """The same with every stratum's scores dealt to 8 ranges, as for strata too large for a task."""
    return conformal.adjusted(*_sides(spark, sf_dir), ["cluster"], ranges=8).select("event_id", F.round("p_adj", 9).alias("p_adj"))


@query(f"WITH {ADJUSTED} SELECT event_id, round({CONFIDENCE_SQL}, 6) AS confidence FROM a")
def confidence_score(spark, sf_dir):
    return conformal.adjusted(*_sides(spark, sf_dir), ["cluster"]).select("event_id", F.round("confidence", 6).alias("confidence"))


def _quantile(side: str, rows: str, keys: str = "cluster") -> str:
    """Quantiles of a side's predictions up to its own quantile at the share of nulls; side: c or t, rows: its table."""
    return f"""{side}k AS (SELECT {keys}, yhat::DOUBLE AS v, share, row_number() OVER (PARTITION BY {keys} ORDER BY yhat) - 1 AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM {rows} JOIN wide USING ({keys})),
{side}h AS (SELECT *, floor((n - 1) * share) AS lo, (n - 1) * share - floor((n - 1) * share) AS f FROM {side}k),
{side}q AS (SELECT {keys}, max(v) FILTER (WHERE k = lo) + (max(v) FILTER (WHERE k = least(lo + 1, n - 1)) - max(v) FILTER (WHERE k = lo)) * max(f) AS cut FROM {side}h GROUP BY ALL),
{side}l AS (SELECT {keys}, quantile_cont(v, [{', '.join(map(str, LEVELS['medium']))}]) AS q FROM {side}h JOIN {side}q USING ({keys}) WHERE v <= cut GROUP BY ALL)"""


def _tolerance(calib: str, test: str, null: str, keys: str = "cluster") -> str:
    return f"sh AS (SELECT {keys}, avg((y <= {null})::INTEGER) AS share FROM {calib} GROUP BY ALL), wide AS (SELECT * FROM sh WHERE share > 0.1), {_quantile('c', calib, keys)}, {_quantile('t', test, keys)}, shift AS (SELECT {keys}, -list_max(list_transform(list_zip(cl.q, tl.q), lambda x: greatest(0, x[2] - x[1]))) AS shift FROM cl JOIN tl USING ({keys})), tol AS (SELECT {keys}, round(coalesce(shift, 0), 9) + 0.0 AS tolerance FROM sh LEFT JOIN shift USING ({keys}))"


TOLERANCE = f"{BASE}, bc AS (SELECT * FROM b WHERE calib), bt AS (SELECT * FROM b WHERE NOT calib), {_tolerance('bc', 'bt', str(NULL_NUMBER))}"


@query(f"WITH {TOLERANCE} SELECT cluster, round(tolerance, 6) AS tolerance FROM tol")
def batch_tolerance(spark, sf_dir):
    calib, test = _sides(spark, sf_dir)
    t = conformal.tolerance(calib.withColumn("is_null", F.col("y") <= F.col("null_number")), test, ["cluster"])
    return t.withColumn("tolerance", F.round("tolerance", 6) + 0.0)


@query(f"WITH {ADJUSTED}, f AS (SELECT unnest(range(1, 100)) AS k), c AS (SELECT cluster, k, count(a.p_adj) FILTER (WHERE p_adj <= k / 100.0) AS n, count(*) FILTER (WHERE p_adj <= k / 100.0 AND y > {NULL_NUMBER}) AS t FROM a, f GROUP BY ALL) SELECT cluster, k / 100.0 AS fdr, CASE WHEN n > 0 THEN 1 - t / n ELSE 0 END AS fdp, n AS n_discover FROM c")
def fdp_curve(spark, sf_dir):
    return audit.fdp_curve(conformal.adjusted(*_sides(spark, sf_dir), ["cluster"]), ["cluster"])


@query(f"WITH {ADJUSTED}, b3 AS (SELECT *, (CASE cluster % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END) AS scale FROM a), f AS (SELECT unnest(range(1, 100)) AS k), c AS (SELECT scale, k, count(*) FILTER (WHERE p_adj <= k / 100.0) AS n, count(*) FILTER (WHERE p_adj <= k / 100.0 AND y > {NULL_NUMBER}) AS t FROM b3, f GROUP BY ALL), d AS (SELECT scale, k / 100.0 AS fdr, CASE WHEN n > 0 THEN 1 - t / n ELSE 0 END AS fdp, n FROM c) SELECT fdr, " + ", ".join(f"max(fdp) FILTER (WHERE scale = {s}) AS fdp_{s}, max(n) FILTER (WHERE scale = {s}) AS n_discover_{s}" for s in (1, 2, 4)) + " FROM d GROUP BY 1")
def fdp_pivot(spark, sf_dir):
    t = conformal.adjusted(*_sides(spark, sf_dir), ["cluster"])
    t = t.withColumn("scale", F.when(F.col("cluster") % 3 == 0, 1).when(F.col("cluster") % 3 == 1, 2).otherwise(4))
    return audit.fdp_pivot(audit.fdp_curve(t, ["scale"]), [], [1, 2, 4])


MEMBERS = {"click": ("click",), "click or purchase": ("click", "purchase")}
SCALES = (1, 2, 4)


def target_cells(spark, sf_dir, also=()):
    """Cells by target, with the columns in also: expression in cents, and types as millionths."""
    c = cells(spark, sf_dir).select("event_id", "grid_row", "grid_col", "tissue", "cluster", "ct", "y")
    known = (F.col("event_id") % 13).cast("string")
    one = lambda t, kind, null, category, y: F.struct(F.lit(t).alias("target"), F.lit(kind).alias("kind"), F.lit(null).alias("null_number"), F.concat_ws(":", F.lit(t), category).alias("category"), y.alias("y"))
    rows = [one("value", "expression", 0.05, F.col("ct"), F.col("y")), *(one(t, "type", 0.0, known, F.col("ct").isin(*m).cast("long") * 1_000_000) for t, m in MEMBERS.items())]
    return c.withColumn("t", F.explode(F.array(*rows))).select("grid_row", "grid_col", "tissue", "cluster", *also, "t.*")


_CELLS = f"""{SPX_SQL}, {ROI_SQL}, {FOLD_SQL},
tc AS (SELECT grid_row, grid_col, tissue, cluster, 'value' AS target, 'expression' AS kind, 0.05::DOUBLE AS null_number, 'value:' || ct AS category, y FROM spx
""" + "".join(f"UNION ALL SELECT grid_row, grid_col, tissue, cluster, '{t}', 'type', 0.0::DOUBLE, '{t}:' || (event_id % 13)::VARCHAR, (ct IN ({', '.join(map(repr, m))}))::BIGINT * 1000000 FROM spx\n" for t, m in MEMBERS.items()) + ")"
_POOL = "CAST(sum(y) AS BIGINT) AS y, CAST(sum(CASE WHEN tissue THEN yhat ELSE 0 END) AS BIGINT) AS yhat, bool_or(tissue) AS tissue, min(CASE WHEN tissue THEN cluster END) AS cluster"
_MEAN = "CASE WHEN kind = 'type' THEN yhat / (scale * scale) ELSE yhat::DOUBLE END AS yhat"
END_TO_END = f"""WITH {_CELLS},
rc AS (SELECT s.*, roi_idx, row0, col0, height, width FROM tc s JOIN roi ON grid_row >= row0 AND grid_row < row0 + height AND grid_col >= col0 AND grid_col < col0 + width),
k AS (SELECT * FROM rc WHERE tissue), every AS (SELECT category, sum(y) AS s, count(*) AS n FROM k GROUP BY 1),
held AS (SELECT s.roi_idx, fold_id, category, sum(y) AS s, count(*) AS n FROM k s JOIN fold f ON s.roi_idx = f.roi_idx AND {within('f')} GROUP BY ALL),
model AS (SELECT f.roi_idx, f.fold_id, e.category, CASE WHEN e.n > coalesce(h.n, 0) THEN floor((e.s - coalesce(h.s, 0)) / (e.n - coalesce(h.n, 0))) ELSE 0 END AS yhat FROM every e CROSS JOIN fold f LEFT JOIN held h ON h.roi_idx = f.roi_idx AND h.fold_id = f.fold_id AND h.category = e.category),
fitted AS (SELECT s.roi_idx, s.target, s.grid_row, s.grid_col, yhat FROM k s JOIN fold f ON s.roi_idx = f.roi_idx AND {within('c')} JOIN model m ON m.roi_idx = f.roi_idx AND m.fold_id = f.fold_id AND m.category = s.category),
sc AS (SELECT unnest([1, 2, 4]) AS scale),
c0 AS (SELECT r.*, coalesce(f.yhat, 0) AS yhat, scale, r.grid_row - row0 AS gr, r.grid_col - col0 AS gc FROM rc r LEFT JOIN fitted f ON f.roi_idx = r.roi_idx AND f.target = r.target AND f.grid_row = r.grid_row AND f.grid_col = r.grid_col CROSS JOIN sc),
c1 AS (SELECT roi_idx, target, kind, null_number, scale, gr // scale AS gr, gc // scale AS gc, {_POOL} FROM c0 WHERE gr < height // scale * scale AND gc < width // scale * scale GROUP BY ALL),
c2 AS (SELECT * REPLACE ({_MEAN}) FROM c1 WHERE tissue),
q AS (SELECT target, scale, roi_idx, quantile_cont(y, 0.9999) AS q FROM c2 WHERE kind = 'expression' GROUP BY ALL),
norm AS (SELECT target, scale, roi_idx, greatest(1.0, max(q) OVER (PARTITION BY target, scale ORDER BY roi_idx ROWS UNBOUNDED PRECEDING)) AS norm FROM q),
cal AS (SELECT c.target, c.scale, cluster, null_number, c.y / coalesce(norm, 1) AS y, c.yhat / coalesce(norm, 1) AS yhat FROM c2 c LEFT JOIN norm n ON n.target = c.target AND n.scale = c.scale AND n.roi_idx = c.roi_idx),
full_model AS (SELECT category, floor(sum(y) / count(*)) AS yhat FROM k GROUP BY 1),
ext AS (SELECT max(grid_row) + 1 AS n_rows, max(grid_col) + 1 AS n_cols FROM spx),
t0 AS (SELECT s.*, coalesce(m.yhat, 0) AS yhat, scale, n_rows, n_cols, NOT ({IN_ROI}) AS outside FROM tc s LEFT JOIN full_model m USING (category), ext, sc),
t1 AS (SELECT target, kind, null_number, scale, grid_row // scale AS grid_row, grid_col // scale AS grid_col, bool_or(outside) AS out_roi, {_POOL} FROM t0 WHERE grid_row < n_rows // scale * scale AND grid_col < n_cols // scale * scale GROUP BY ALL),
t2 AS (SELECT * REPLACE ({_MEAN}) FROM t1 WHERE tissue AND out_roi),
last AS (SELECT target, scale, max(norm) AS norm FROM norm GROUP BY ALL),
tes AS (SELECT t.target, t.scale, grid_row, grid_col, cluster, null_number, t.y / coalesce(norm, 1) AS y, t.yhat / coalesce(norm, 1) AS yhat FROM t2 t LEFT JOIN last l ON l.target = t.target AND l.scale = t.scale),
{_tolerance('cal', 'tes', 'null_number', 'target, scale, cluster')},
u AS (SELECT target, scale, cluster, 1 AS c, NULL AS grid_row, NULL AS grid_col, NULL AS y, null_number, CASE WHEN y <= null_number THEN -yhat + tolerance ELSE 'infinity'::DOUBLE END AS score FROM cal JOIN tol USING (target, scale, cluster) UNION ALL SELECT target, scale, cluster, 0, grid_row, grid_col, y, null_number, -yhat FROM tes),
v AS (SELECT *, (sum(c) OVER (PARTITION BY target, scale, cluster ORDER BY score RANGE UNBOUNDED PRECEDING) - sum(c) OVER (PARTITION BY target, scale, cluster, score) + 1) / (sum(c) OVER (PARTITION BY target, scale, cluster) + 1) AS p FROM u),
w AS (SELECT *, count(*) OVER (PARTITION BY target, scale, cluster) * p / count(*) OVER (PARTITION BY target, scale, cluster ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM v WHERE c = 0),
a AS (SELECT *, least(1, min(raw) OVER (PARTITION BY target, scale, cluster ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS p_adj FROM w)
SELECT target, scale::INTEGER AS scale, grid_row, grid_col, cluster, round(p_adj, 9) AS p_adj, round({CONFIDENCE_SQL}, 6) AS confidence FROM a"""


@query(END_TO_END)
def confidence_end_to_end(spark, sf_dir):
    out = inference.confidence(target_cells(spark, sf_dir), ROIS, folds.fold_table(spark, FOLDS), SCALES)
    return out.select("target", "scale", "grid_row", "grid_col", "cluster", F.round("p_adj", 9).alias("p_adj"), F.round(confidence(F.col("p_adj")), 6).alias("confidence"))


STRATA = 7
_ST = f"""st AS (SELECT NULL::INTEGER AS roi_idx, scale, grid_row // scale AS gr, grid_col // scale AS gc, sum(cluster) % {STRATA} AS cluster FROM spx, sc GROUP BY ALL
UNION ALL SELECT roi_idx, scale, (grid_row - row0) // scale AS gr, (grid_col - col0) // scale AS gc, sum(cluster) % {STRATA} AS cluster FROM spx JOIN roi ON grid_row >= row0 AND grid_row < row0 + height AND grid_col >= col0 AND grid_col < col0 + width, sc GROUP BY ALL)"""
#: As END_TO_END, with strata of each scale's own, and windows off the test mask at 1.
STRATIFIED = (
    END_TO_END.replace("sc AS (SELECT unnest([1, 2, 4]) AS scale),", f"sc AS (SELECT unnest([1, 2, 4]) AS scale),\n{_ST},")
    .replace("FROM c1 WHERE tissue),", "FROM c1s WHERE tissue),").replace("c2 AS (SELECT", "c1s AS (SELECT c1.* EXCLUDE (cluster), st.cluster FROM c1 LEFT JOIN st ON st.roi_idx = c1.roi_idx AND st.scale = c1.scale AND st.gr = c1.gr AND st.gc = c1.gc),\nc2 AS (SELECT")
    .replace("FROM t1 WHERE tissue AND out_roi),", "FROM t1s WHERE tissue AND out_roi),").replace("t2 AS (SELECT *", "t1s AS (SELECT t1.* EXCLUDE (cluster), st.cluster FROM t1 LEFT JOIN st ON st.roi_idx IS NULL AND st.scale = t1.scale AND st.gr = t1.grid_row AND st.gc = t1.grid_col),\nt2 AS (SELECT *")
    + " UNION ALL SELECT target, scale::INTEGER, grid_row, grid_col, cluster, 1.0, 0.0 FROM t1s WHERE NOT (tissue AND out_roi)"
)


def scale_strata(spark, sf_dir):
    """Stand-in strata of each scale: the windows' clusters, added up, modulo STRATA."""
    c = cells(spark, sf_dir).select("grid_row", "grid_col", "cluster")
    total = [F.sum("cluster").alias("cluster")]
    slide = grid.pyramid(c, SCALES, total, merge=total).withColumn("roi_idx", F.lit(None).cast("int"))
    own = grid.pyramid(grid.crop(c, ROIS).select("roi_idx", "grid_row", "grid_col", "cluster"), SCALES, total, ["roi_idx"], merge=total)
    return slide.unionByName(own).withColumn("cluster", F.col("cluster") % STRATA)


@query(STRATIFIED)
def confidence_stratified(spark, sf_dir):
    """Confidence of every window of the slide, by strata that each scale has of its own."""
    out = inference.confidence(target_cells(spark, sf_dir), ROIS, folds.fold_table(spark, FOLDS), SCALES, strata=scale_strata(spark, sf_dir), everywhere=True)
    return out.select("target", "scale", "grid_row", "grid_col", "cluster", F.round("p_adj", 9).alias("p_adj"), F.round(confidence(F.col("p_adj")), 6).alias("confidence"))


_X = "s.grid_col % 10"
#: As END_TO_END, with a regression on one feature in place of the means.
LEARNED = END_TO_END[: END_TO_END.index("every AS (SELECT category")] + f"""
model AS (SELECT f.roi_idx, f.fold_id, s.target, regr_slope(s.y, {_X}) AS b, regr_intercept(s.y, {_X}) AS a FROM fold f JOIN k s ON s.roi_idx <> f.roi_idx OR NOT ({within('f')}) GROUP BY ALL),
fitted AS (SELECT s.roi_idx, s.target, s.grid_row, s.grid_col, floor(a + b * ({_X})) AS yhat FROM k s JOIN fold f ON s.roi_idx = f.roi_idx AND {within('c')} JOIN model m ON m.roi_idx = f.roi_idx AND m.fold_id = f.fold_id AND m.target = s.target),
""" + END_TO_END[END_TO_END.index("sc AS (SELECT unnest") :].replace("full_model AS (SELECT category, floor(sum(y) / count(*)) AS yhat FROM k GROUP BY 1)", f"full_model AS (SELECT target, regr_slope(s.y, {_X}) AS b, regr_intercept(s.y, {_X}) AS a FROM k s GROUP BY 1)").replace("coalesce(m.yhat, 0) AS yhat", f"coalesce(floor(m.a + m.b * ({_X})), 0) AS yhat").replace("LEFT JOIN full_model m USING (category)", "LEFT JOIN full_model m ON m.target = s.target")


@query(LEARNED)
def confidence_learned(spark, sf_dir):
    """Confidence of regressions that are cross-fitted in the ROIs and applied outside them."""
    c = target_cells(spark, sf_dir).withColumn("x", F.col("grid_col") % 10)
    out = inference.confidence(c, ROIS, folds.fold_table(spark, FOLDS), SCALES, predictor=linear.Linear(("x",), under=1.0, penalty=0.0))
    return out.select("target", "scale", "grid_row", "grid_col", "cluster", F.round("p_adj", 9).alias("p_adj"), F.round(confidence(F.col("p_adj")), 6).alias("confidence"))


CLASSES = ("click", "error", "purchase", "signup", "view")
_HEAT_ROUNDS, _HEAT_STEPS = 4, 24


def _heat_sql() -> str:
    """The search for the temperature: tables h0 .. with the ends of each round's grid."""
    out = ["h0 AS (SELECT ln(0.05) AS lo, ln(20.0) AS hi, NULL::DOUBLE AS best)"]
    for r in range(1, _HEAT_ROUNDS + 1):
        out.append(f"g{r} AS (SELECT i, lo + (hi - lo) * i / {_HEAT_STEPS - 1} AS g FROM h{r - 1}, range({_HEAT_STEPS}) u(i))")
        out.append(f"l{r} AS (SELECT i, g, avg(ln(list_sum(list_transform(zs, lambda z: exp((z - top) / exp(g))))) - (own - top) / exp(g)) AS loss FROM zt CROSS JOIN g{r} GROUP BY ALL)")
        out.append(f"h{r} AS (SELECT (SELECT g FROM l{r} WHERE i = greatest(0, m - 1)) AS lo, (SELECT g FROM l{r} WHERE i = least({_HEAT_STEPS - 1}, m + 1)) AS hi, (SELECT g FROM l{r} WHERE i = m) AS best FROM (SELECT arg_min(i, loss) AS m FROM l{r}))")
    return ",\n".join([*out, f"heat AS (SELECT coalesce(exp(best), 1) AS t FROM h{_HEAT_ROUNDS})"])


_SHARES = ", ".join(f"floor(1000000 * sum(exp((z - top) / t)) FILTER (WHERE cls IN ({', '.join(map(repr, m))})) / sum(exp((z - top) / t))) AS \"{t}\"" for t, m in MEMBERS.items())
_UNPIVOT = "UNPIVOT {0} ON " + ", ".join(f'"{t}"' for t in MEMBERS) + " INTO NAME target VALUE yhat"
#: Scores of classes by a regression on one feature, as shares of the targets: shr in the ROIs, shf by x elsewhere.
_CLASS_SQL = f"""cls AS (SELECT unnest([{', '.join(map(repr, CLASSES))}]) AS cls),
kc AS (SELECT s.*, s.grid_col % 10 AS x, roi_idx FROM spx s JOIN roi ON grid_row >= row0 AND grid_row < row0 + height AND grid_col >= col0 AND grid_col < col0 + width WHERE tissue),
cm AS (SELECT f.roi_idx, f.fold_id, cls, regr_slope((ct = cls)::INTEGER, x) AS b, regr_intercept((ct = cls)::INTEGER, x) AS a FROM fold f JOIN kc s ON s.roi_idx <> f.roi_idx OR NOT ({within('f')}) CROSS JOIN cls GROUP BY ALL),
zr AS (SELECT s.roi_idx, s.grid_row, s.grid_col, m.cls, a + b * x AS z, ct = m.cls AS is_own, max(a + b * x) OVER (PARTITION BY s.roi_idx, s.grid_row, s.grid_col) AS top FROM kc s JOIN fold f ON s.roi_idx = f.roi_idx AND {within('c')} JOIN cm m ON m.roi_idx = f.roi_idx AND m.fold_id = f.fold_id),
zt AS (SELECT list(z) AS zs, max(top) AS top, max(z) FILTER (WHERE is_own) AS own FROM zr GROUP BY roi_idx, grid_row, grid_col),
{_heat_sql()},
sr AS (SELECT roi_idx, grid_row, grid_col, {_SHARES} FROM zr, heat GROUP BY ALL), shr AS ({_UNPIVOT.format('sr')}),
zf AS (SELECT x, cls, a + b * x AS z, max(a + b * x) OVER (PARTITION BY x) AS top FROM (SELECT cls, regr_slope((ct = cls)::INTEGER, x) AS b, regr_intercept((ct = cls)::INTEGER, x) AS a FROM kc CROSS JOIN cls GROUP BY 1), range(10) u(x)),
sf AS (SELECT x, {_SHARES} FROM zf, heat GROUP BY ALL), shf AS ({_UNPIVOT.format('sf')})"""
#: As END_TO_END, with shares of classes for types.
CLASSED = (
    END_TO_END.replace("JOIN model m ON m.roi_idx = f.roi_idx AND m.fold_id = f.fold_id AND m.category = s.category),", f"JOIN model m ON m.roi_idx = f.roi_idx AND m.fold_id = f.fold_id AND m.category = s.category WHERE s.kind = 'expression' UNION ALL SELECT roi_idx, target, grid_row, grid_col, yhat FROM shr),")
    .replace("fitted AS (", f"{_CLASS_SQL},\nfitted AS (")
    .replace("coalesce(m.yhat, 0) AS yhat, scale", "coalesce(CASE WHEN kind = 'type' THEN shf.yhat ELSE m.yhat END, 0) AS yhat, scale")
    .replace("LEFT JOIN full_model m USING (category), ext", "LEFT JOIN full_model m USING (category) LEFT JOIN shf ON shf.target = s.target AND shf.x = s.grid_col % 10, ext")
)


def class_predictor():
    shares = models.ClassScores(("x",), CLASSES, MEMBERS, "ct", 1e6, 0.0)
    return models.ByKind({"expression": models.CategoryMeans("category", "y"), "type": shares})


@query(CLASSED)
def confidence_classes(spark, sf_dir):
    """Confidence of means for expression and of class probabilities, with a fitted temperature, for types."""
    c = target_cells(spark, sf_dir, ["ct"]).withColumn("x", F.col("grid_col") % 10)
    out = inference.confidence(c, ROIS, folds.fold_table(spark, FOLDS), SCALES, predictor=class_predictor())
    return out.select("target", "scale", "grid_row", "grid_col", "cluster", F.round("p_adj", 9).alias("p_adj"), F.round(confidence(F.col("p_adj")), 6).alias("confidence"))


@query(END_TO_END)
def confidence_stored(spark, sf_dir):
    """The same with both sides stored in buckets by (target, scale, cluster), and ranked bucket by bucket."""
    out = inference.confidence(target_cells(spark, sf_dir), ROIS, folds.fold_table(spark, FOLDS), SCALES, store="")
    return out.select("target", "scale", "grid_row", "grid_col", "cluster", F.round("p_adj", 9).alias("p_adj"), F.round(confidence(F.col("p_adj")), 6).alias("confidence"))


@query(f"WITH {TOLERANCE} SELECT cluster, round(tolerance, 6) AS tolerance FROM tol")
def batch_tolerance_by_ranges(spark, sf_dir):
    """The same with every stratum's values dealt to 8 ranges, as for strata too large for a task."""
    calib, test = _sides(spark, sf_dir)
    t = conformal.tolerance(calib.withColumn("is_null", F.col("y") <= F.col("null_number")), test, ["cluster"], ranges=8)
    return t.withColumn("tolerance", F.round("tolerance", 6) + 0.0)


@query(f"WITH {SPX_SQL} SELECT cluster, place, round(quantile, 6) AS quantile FROM (SELECT cluster, unnest([0, 1, 2])::INTEGER AS place, unnest(q) AS quantile FROM (SELECT cluster, quantile_cont(y, [0.001, 0.5, 0.9999]) AS q FROM spx GROUP BY 1))")
def quantiles_by_ranges(spark, sf_dir):
    return quantiles(cells(spark, sf_dir), ["cluster"], "y", [0.001, 0.5, 0.9999], ranges=8).select("cluster", "place", F.round("quantile", 6).alias("quantile"))


@query(f"WITH {SPX_SQL}, {ROI_SQL}, {FOLD_SQL}, rc AS (SELECT s.*, roi_idx FROM spx s JOIN roi ON grid_row >= row0 AND grid_row < row0 + height AND grid_col >= col0 AND grid_col < col0 + width WHERE tissue) SELECT f.roi_idx, f.fold_id, round(regr_slope(s.y, s.cluster), 6) AS slope, round(regr_intercept(s.y, s.cluster), 5) AS intercept FROM fold f JOIN rc s ON s.roi_idx <> f.roi_idx OR NOT ({within('f')}) GROUP BY ALL")
def crossfit_slopes(spark, sf_dir):
    """Regressions on one feature that leave each fold out, from sums less the fold's own."""
    rows, table = grid.in_rects(cells(spark, sf_dir), ROIS).where("tissue"), folds.fold_table(spark, FOLDS)
    held, _ = linear.model_table(rows, linear.ridge_models(rows, table, ["cluster"], ["y"], penalty=0.0), table, [])
    return held.select("roi_idx", "fold_id", F.round(F.expr("model[0][1]"), 6).alias("slope"), F.round(F.expr("model[0][0]"), 5).alias("intercept"))


@query(f"WITH {RANKED} SELECT event_id, p, round(greatest(0, least(1, ln(0.5 / p) / ln(50))), 6) AS confidence FROM p")
def stream_scores(spark, sf_dir):
    """Test cells as a stream of files, ranked in micro-batches against the calibration cells."""
    calib, _ = _sides(spark, sf_dir)
    table = written(scoring.calibration_table(calib, ["cluster"]), "stream-calibration")
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parquet*")
    scored = scoring.score_stream(predicted(as_cells(events)).where("NOT calib"), table, ["cluster"]).select("event_id", "p", F.round("confidence", 6).alias("confidence"))
    out = shared_path(spark, "stream-scores")
    scored.writeStream.format("parquet").option("checkpointLocation", f"{out}-log").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(scored.schema).parquet(out)
