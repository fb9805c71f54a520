"""Queries on distances and links between profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from typeweave.operators import distance as D
from typeweave.operators import partition as P
from typeweave.sources.tables import table

MOST, LOCI = 40, ["p_name", "p_brand", "p_type", "p_size"]


def _calls(spark, sf_dir):
    """Vectors as calls of 64 loci; code 0 is a missing call."""
    code = F.transform("embedding", lambda x: F.nullif(F.floor(x * 4), F.lit(0)))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", code.alias("profile"))


def _distances(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    anchor = calls.agg(F.min_by("profile", "vec_id").alias("profile"))
    return D.distance_to_anchor(calls, anchor, "vec_id", "profile", MOST)


def q_hamming_anchor(spark, sf_dir):
    return _distances(spark, sf_dir)


def q_next_closest(spark, sf_dir):
    """The least distance of a vector outside, and the largest inside."""
    d = _distances(spark, sf_dir)
    return d.agg(F.min(F.when(~F.col("member"), F.col("distance"))).alias("next_closest"), F.max(F.when(F.col("member"), F.col("distance"))).alias("farthest_member"), F.count_if("member").alias("members"))


def q_panel_anchor(spark, sf_dir):
    """Predictors of membership in the anchor's neighbourhood: its label, and its value at one locus; whether the label names the same set, and the gap beyond it."""
    calls = _calls(spark, sf_dir)
    d = _distances(spark, sf_dir).join(calls, "vec_id")
    anchor = calls.agg(F.min_by("label", "vec_id").alias("anchor_label"), F.min_by(F.get("profile", 0), "vec_id").alias("anchor_call"))  # one row
    rows = d.crossJoin(F.broadcast(anchor)).withColumns({
        "same_label": F.col("label") == F.col("anchor_label"), "same_call": F.coalesce(F.get("profile", 0) == F.col("anchor_call"), F.lit(False)),
    })
    panel = P.classifier_panel(rows, {"label": F.col("same_label"), "locus": F.col("same_call")}, F.col("member"))
    sets = rows.agg(
        F.min(F.when(~F.col("member"), F.col("distance"))).alias("next_closest"), F.count_if("same_label").alias("published"),
        F.count_if("member").alias("operational"), F.count_if(F.col("same_label") & F.col("member")).alias("shared"),
    )
    same = (F.col("published") == F.col("shared")) & (F.col("operational") == F.col("shared"))
    return panel.crossJoin(F.broadcast(sets)).withColumn("identical", same)


def _profiles(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(*LOCI).agg(F.min("p_partkey").alias("profile_id"))


def q_slv_edges(spark, sf_dir):
    return D.link_counts(_profiles(spark, sf_dir), "profile_id", LOCI)


def q_slv_components(spark, sf_dir):
    return D.complexes(_profiles(spark, sf_dir), "profile_id", LOCI)


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_D = f"""e AS (SELECT vec_id, label, list_transform(embedding, lambda x: nullif(floor(x::float*4)::bigint, 0)) p FROM embeddings), a AS (SELECT p ap, label al FROM e ORDER BY vec_id LIMIT 1),
u AS (SELECT vec_id, label, al, unnest(p) x, unnest(ap) y FROM e, a),
d AS (SELECT vec_id, label, al, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND x <> y) distance, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) compared FROM u GROUP BY ALL)"""
_PR = "p AS (SELECT min(p_partkey) id, p_name a, p_brand b, p_type c, p_size d FROM part GROUP BY ALL)"
_SAME = "(x.a IS NOT DISTINCT FROM y.a)::int"
_EDGE = "coalesce((x.a = y.a)::int, 0) + coalesce((x.b = y.b)::int, 0) + coalesce((x.c = y.c)::int, 0) + coalesce((x.d = y.d)::int, 0) >= 3"
from typeweave.jobs.concordance import _CONF, _CONF_COLS, _COUNTS  # noqa: E402

ORACLE_SQL = {
    "q_hamming_anchor": f"WITH {_D} SELECT vec_id, distance, compared, distance <= {MOST} AS member FROM d",
    "q_next_closest": f"WITH {_D} SELECT min(distance) FILTER (distance > {MOST}) AS next_closest, max(distance) FILTER (distance <= {MOST}) AS farthest_member, count(*) FILTER (distance <= {MOST}) AS members FROM d",
    "q_panel_anchor": f"""WITH {_D}, l AS (SELECT 'label' predictor, label = al p, distance <= {MOST} t FROM d UNION ALL SELECT 'locus', coalesce(e.p[1] = a.ap[1], false), distance <= {MOST} FROM d JOIN e USING (vec_id), a),
f AS (SELECT predictor, {_COUNTS} FROM l WHERE p IS NOT NULL AND t IS NOT NULL GROUP BY predictor), {_CONF},
g AS (SELECT min(distance) FILTER (distance > {MOST}) next_closest, count(*) FILTER (label = al) published, count(*) FILTER (distance <= {MOST}) operational, count(*) FILTER (label = al AND distance <= {MOST}) shared FROM d)
SELECT predictor, {_CONF_COLS}, next_closest, published, operational, shared, published = shared AND operational = shared AS identical FROM x, g""",
    "q_slv_edges": f"WITH {_PR} SELECT x.id AS profile_id, count(y.id) AS links FROM p x LEFT JOIN p y ON x.id <> y.id AND {_EDGE} GROUP BY x.id",
    "q_slv_components": f"""WITH RECURSIVE {_PR}, e AS (SELECT x.id s, y.id t FROM p x, p y WHERE x.id <> y.id AND {_EDGE}),
r AS (SELECT id s, id t FROM p UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t),
m AS (SELECT s, min(t) c FROM r GROUP BY s) SELECT s AS profile_id, dense_rank() OVER (ORDER BY c) AS complex FROM m""",
}
