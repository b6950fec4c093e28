"""User behaviour over the stand-in tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classify import ARCHETYPES_2, archetype
from ..operators import density, neighbours, tables
from ..plans import behaviour, etl
from ..sources import proxy
from ..sources.proxy import with_views
from .etl_queries import _SURVEY
from .kpi_queries import SCALE, USER_LABELS_SQL, rounded, user_labels
from .spatial_queries import ZONE, utm_sql

EPS, MIN_SAMPLES = 100, 5
CAMPAIGNS = {"ASIA": "1997-06-23", "EUROPE": "1996-06-01"}
START = "1996-01-01"


def _features(spark, d):
    f = behaviour.user_features(proxy.points(spark, d), None, MIN_SAMPLES, EPS)
    return f.select("user_id", "n_points", "n_invalid_points",
                    F.col("mean_latlon")[0].alias("mean_lon"), F.col("mean_latlon")[1].alias("mean_lat"),
                    F.round("std_utm", 3).alias("std_utm"), F.round("msd_utm", 3).alias("msd_utm"),
                    "n_random_points", "n_clusters")


def _dispersion(spark, d):
    m = behaviour.projected(proxy.points(spark, d))
    return m.groupBy("user_id").agg(F.round(behaviour.dispersion(F.col("x"), F.col("y")), 3).alias("std_utm"))


def _clusters(spark, d):
    m = behaviour.projected(proxy.points(spark, d)).select("user_id", "x", "y")
    return density.cluster_counts(density.density_clusters(m, ["user_id"], EPS, MIN_SAMPLES), ["user_id"])


def _quality(spark, d):
    return rounded(behaviour.user_quality(proxy.reports(spark, d, False), proxy.reports_codes(spark, d)))


def _home(spark, d):
    located = tables.with_scale(proxy.reports(spark, d, False), proxy.reports_codes(spark, d), SCALE)
    return tables.top_one(tables.counts_by(located, "user_id", SCALE), ["user_id"], [("ct", True)], [SCALE])


def _profiles_frame(spark, d):
    r = proxy.reports(spark, d, False)
    return behaviour.user_profiles(behaviour.user_quality(r, proxy.reports_codes(spark, d)),
                                   behaviour.user_features(r, None, MIN_SAMPLES, EPS))


def _profiles(spark, d):
    p = _profiles_frame(spark, d)
    return rounded(p.select("user_id", SCALE, "n_reports", "quality_target", "quality_reports", "n_points",
                            F.round("std_utm", 3).alias("std_utm")), 3)


def _judged_frame(spark, d):
    return behaviour.judged_answers(etl.survey_labels(proxy.reports_response(spark, d)), proxy.reports(spark, d, False))


def _simple_profiles(spark, d):
    """Profiles from cheap stand-in features, so that the label rules see every case."""
    c = proxy.table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("user_id"), (k % 40 + 1).alias("n_points"), (k % 23).alias("n_reports"),
        ((k % 10) / F.lit(10.0)).alias("quality_target"),
        F.when(k % 7 != 0, k % 4).alias("n_clusters"), F.when(k % 5 != 0, F.abs("c_acctbal") / 4).alias("std_utm"),
        (F.col("c_nationkey") % 5).alias("home"))


def _accuracy_frame(spark, d):
    return behaviour.user_accuracy(_judged_frame(spark, d))


def _labelled_frame(spark, d):
    return behaviour.with_archetypes(behaviour.quality_features(_simple_profiles(spark, d), _accuracy_frame(spark, d)))


def _labelled(spark, d):
    return rounded(_labelled_frame(spark, d).select(
        "user_id", "adults_ratio", "accuracy", "accuracy_chance_adj_pos", "quality", "custom_labels_1",
        "custom_labels_2", "custom_labels_3"))


def _quality_plain(spark, d):
    return rounded(behaviour.quality_features(_simple_profiles(spark, d), _accuracy_frame(spark, d), False).select(
        "user_id", "quality"))


def _rule(spark, d):
    p = _simple_profiles(spark, d)
    return p.select("user_id", archetype(F.col("n_clusters"), F.col("std_utm"), F.col("quality_target")).alias("label"))


def _covariates(transform):
    def run(spark, d):
        return rounded(behaviour.campaign_covariates(
            proxy.reports(spark, d, False), user_labels(spark, d), CAMPAIGNS, START, transform))
    return run


def _distance_inputs(spark, d):
    return behaviour.distance_features(_labelled_frame(spark, d))


def _knn_frame(spark, d):
    return _simple_profiles(spark, d).withColumn("kind", F.col("n_clusters").cast("string")).select(
        "user_id", F.coalesce("std_utm", F.lit(0.0)).alias("std_utm"), "quality_target", F.coalesce("kind", F.lit("none")).alias("kind"))


def _knn(spark, d):
    out = neighbours.nearest_users(_knn_frame(spark, d), "user_id", ["std_utm", "quality_target"], ["kind"], k=5)
    return rounded(out.select("user_id", "other", "distance", F.col("rank").cast("bigint").alias("rank")))


def _euclidean(scaling):
    columns = ["std_utm", "quality_target"]

    def run(spark, d):
        rows = scaling(_knn_frame(spark, d).select("user_id", *columns), columns)
        out = neighbours.nearest_users(rows, "user_id", columns, k=5, metric="euclidean")
        return rounded(out.select("user_id", "other", "distance", F.col("rank").cast("bigint").alias("rank")))
    return run


def _min_max(spark, d):
    return rounded(neighbours.min_max_scaled(_knn_frame(spark, d).select("user_id", "std_utm", "quality_target"),
                                             ["std_utm", "quality_target"]))


def _l2(spark, d):
    return rounded(neighbours.l2_scaled(_knn_frame(spark, d).select("user_id", "std_utm", "quality_target"),
                                        ["std_utm", "quality_target"]))


QUERIES = {
    "model_user_features": _features,
    "model_density_clusters": _clusters,
    "model_user_quality": _quality,
    "model_user_profiles": _profiles,
    "model_judged_answers": lambda s, d: _judged_frame(s, d),
    "model_classification_report": lambda s, d: rounded(behaviour.classification_report(_judged_frame(s, d))),
    "model_chance_agreement": lambda s, d: rounded(behaviour.chance_agreement(_judged_frame(s, d))),
    "model_user_accuracy": lambda s, d: rounded(_accuracy_frame(s, d)),
    "model_low_accuracy_share": lambda s, d: rounded(
        behaviour.low_accuracy_share(etl.survey_labels(proxy.reports_response(s, d)))),
    "model_quality_and_archetypes": _labelled,
    "model_quality_without_accuracy": _quality_plain,
    "model_campaign_covariates": _covariates("percentage"),
    "model_campaign_covariates_raw": _covariates("raw"),
    "model_distance_features": lambda s, d: rounded(_distance_inputs(s, d)),
    "model_nearest_users": _knn,
    "model_nearest_users_euclidean": _euclidean(lambda rows, columns: rows),
    "model_nearest_users_euclidean_min_max": _euclidean(neighbours.min_max_scaled),
    "model_nearest_users_euclidean_l2": _euclidean(neighbours.l2_scaled),
    "model_min_max_scaled": _min_max,
    "model_l2_scaled": _l2,
    "agg_dispersion": _dispersion,
    "agg_mean_by_motivation": lambda s, d: rounded(behaviour.mean_by_motivation(_labelled_frame(s, d))),
    "agg_bounding_box": lambda s, d: rounded(behaviour.bounding_box(proxy.points(s, d), "user_id")),
    "case_archetype": _rule,
    "win_main_location": _home,
}

# SQL ---------------------------------------------------------------------------


def cluster_ctes(points: str, minimum_rows: int = 0) -> dict[str, str]:
    """Textbook density clustering by closure over all pairs; `points` has user_id, lon, lat."""
    return {
        "centre": f"SELECT user_id, sum(round(lon * 1e9)::BIGINT)::DOUBLE / (count(lon) * 1e9::DOUBLE) AS mlon, sum(round(lat * 1e9)::BIGINT)::DOUBLE / (count(lat) * 1e9::DOUBLE) AS mlat, count(*) AS rows FROM {points} GROUP BY 1",
        "joined": f"""SELECT p.user_id, p.lon, p.lat, c.mlat, c.rows, ((floor((c.mlon + 180) / 6) % 60) + 1)::INTEGER AS z
                      FROM {points} p JOIN centre c USING (user_id)""",
        "metres": utm_sql("joined", "user_id, rows", "z", "mlat < 0"),
        "numbered": f"SELECT *, row_number() OVER () AS i FROM metres WHERE rows >= {minimum_rows}",
        "close": f"""SELECT a.user_id, a.i AS i, b.i AS j FROM numbered a JOIN numbered b ON a.user_id = b.user_id
                     AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {EPS}""",
        "core": f"SELECT user_id, i FROM close GROUP BY 1, 2 HAVING count(*) >= {MIN_SAMPLES}",
        "links": "SELECT c.i AS i, c.j AS j FROM close c JOIN core a ON a.i = c.i JOIN core b ON b.i = c.j",
        "reach": "SELECT i, i AS r FROM core UNION SELECT l.j, reach.r FROM reach JOIN links l ON l.i = reach.i",
        "roots": "SELECT i, min(r) AS root FROM reach GROUP BY i",
        "per_user": """SELECT n.user_id, count(DISTINCT root) AS n_clusters,
                              count(*) FILTER (n.i NOT IN (SELECT i FROM core) AND n.i NOT IN (
                                SELECT c.i FROM close c JOIN core k ON k.i = c.j))::BIGINT AS n_random_points
                       FROM numbered n LEFT JOIN roots USING (i) GROUP BY 1""",
    }


_FEATURE_CTES = {
    **cluster_ctes("pts", MIN_SAMPLES),
    "spread": "SELECT user_id, sqrt(var_pop(x) + var_pop(y)) AS s FROM metres GROUP BY 1",
    "features": """SELECT c.user_id, rows AS n_points, 0::BIGINT AS n_invalid_points, CASE WHEN rows > 1 THEN mlon END AS mean_lon,
                          CASE WHEN rows > 1 THEN mlat END AS mean_lat, CASE WHEN rows > 1 THEN s END AS std_utm,
                          n_random_points, n_clusters
                   FROM centre c JOIN spread USING (user_id) LEFT JOIN per_user USING (user_id)""",
}

_QUALITY = {
    "homes": f"""SELECT user_id, {SCALE} FROM (
                   SELECT user_id, {SCALE}, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, {SCALE} NULLS LAST) AS rn
                   FROM v_reports LEFT JOIN v_named USING (version_uuid) GROUP BY user_id, {SCALE}) WHERE rn = 1""",
    "quality": f"""SELECT q.user_id, {SCALE}, n_reports, quality_target, quality_reports FROM (
                     SELECT user_id, count(*) AS n_reports,
                            sum(CASE WHEN labels IN ('other_species', 'not-sure') THEN 0 ELSE 1 END) / count(*) AS quality_target,
                            sum(confidence) / count(*) AS quality_reports
                     FROM v_reports WHERE report_type = 'adult' AND labels <> 'unvalidated' GROUP BY 1) q
                   LEFT JOIN homes USING (user_id)""",
}

_JUDGED = {
    **_SURVEY,
    "judged": """SELECT version_uuid, user_id, cs_labels, labels, cs_labels = labels AS coincidence
                 FROM survey JOIN v_reports USING (version_uuid)
                 WHERE report_type = 'adult' AND validated AND cs_labels IS NOT NULL
                   AND labels IN ('aegypti', 'albopictus', 'culex', 'japonicus', 'koreicus')""",
    "pi": """SELECT po, pe, (po - pe) / (1 - pe) AS chance FROM (
               SELECT (SELECT avg(coincidence::INTEGER) FROM judged) AS po,
                      (SELECT sum(n * n)::DOUBLE / (sum(n) * sum(n)) FROM (
                         SELECT count(*)::DOUBLE AS n FROM judged GROUP BY labels)) AS pe)""",
    "accuracy": """SELECT user_id, count(*) AS accuracy_support, avg(coincidence::INTEGER) AS accuracy,
                          (avg(coincidence::INTEGER) - (SELECT pe FROM pi)) / (1 - (SELECT pe FROM pi)) AS accuracy_chance_adj
                   FROM judged WHERE user_id IS NOT NULL GROUP BY 1""",
}

_SIMPLE = """SELECT c_custkey AS user_id, c_custkey % 40 + 1 AS n_points, c_custkey % 23 AS n_reports,
                    (c_custkey % 10) / 10.0::DOUBLE AS quality_target,
                    CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 4 END AS n_clusters,
                    CASE WHEN c_custkey % 5 <> 0 THEN abs(c_acctbal) / 4 END AS std_utm FROM customer"""


def _rule_sql(std: float | None, quality_limit: float | None, quality: str = "quality") -> str:
    extent = "''" if std is None else f"CASE WHEN std_utm >= {std} THEN ' wide' ELSE ' narrow' END"
    grade = "''" if quality_limit is None else f"CASE WHEN {quality} >= {quality_limit!r} THEN 'HQ-' ELSE 'LQ-' END"
    return f"""CASE WHEN n_clusters = 0 THEN {grade} || 'sparse' || {extent}
                    WHEN n_clusters = 1 THEN {grade} || 'clustered' || {extent}
                    WHEN n_clusters > 1 THEN {grade} || 'multi-clustered' ELSE 'sporadic' END"""


_LABELLED = {
    **_JUDGED, "simple": _SIMPLE,
    "graded": """SELECT *, CASE WHEN adults_ratio = 0 OR quality_target = 0 THEN 0
                                ELSE 2 * adults_ratio * quality_target / (adults_ratio + quality_target) END AS hm
                 FROM (SELECT s.*, n_reports / n_points AS adults_ratio, accuracy, accuracy_chance_adj,
                              greatest(coalesce(accuracy_chance_adj, 0), 0) AS accuracy_chance_adj_pos
                       FROM simple s LEFT JOIN accuracy USING (user_id))""",
    "labelled": f"""SELECT *, {_rule_sql(None, None)} AS custom_labels_1, {_rule_sql(None, 2.0 / 3)} AS custom_labels_2,
                           {_rule_sql(1000, 2.0 / 3)} AS custom_labels_3
                    FROM (SELECT *, (hm + accuracy_chance_adj_pos) / 2 AS quality FROM graded)""",
}

_MEASURES = ("precision", "recall", "f1")


def _covariate_sql(values: str) -> str:
    def total(names):
        return " + ".join(f"coalesce(\"{n}\", 0)" for n in names)
    wide = ", ".join(f"sum(CASE WHEN custom_labels_2 = '{v}' THEN 1 END)::BIGINT AS \"{v}\"" for v in ARCHETYPES_2)
    dates = " ".join(f"WHEN '{c}' THEN DATE '{day}'" for c, day in CAMPAIGNS.items())
    names = ", ".join(f"'{c}'" for c in CAMPAIGNS)
    return with_views(f"""
        SELECT period AS date, country, (date_diff('day', date_trunc('month', CASE country {dates} END)::DATE,
               period::DATE) / 30.0)::DOUBLE AS since, {values} FROM t WHERE period >= TIMESTAMP '{START}'""",
        "v_reports", "v_gadm", extra={
            "users": USER_LABELS_SQL,
            "ct": f"""SELECT {SCALE} AS country, date_trunc('month', upload_date_utc)::TIMESTAMP AS period, {wide}
                      FROM v_reports JOIN users USING (user_id) WHERE report_type = 'adult' AND labels <> 'not-sure'
                        AND labels <> 'unvalidated' AND {SCALE} IN ({names}) GROUP BY 1, 2""",
            "axis": """SELECT country, unnest(generate_series(lo, hi, INTERVAL '1 MONTH'))::TIMESTAMP AS period FROM (
                         SELECT country, min(period) AS lo, max(period) AS hi FROM ct GROUP BY 1)""",
            "t": f"""SELECT *, {total([a for a in ARCHETYPES_2 if a.startswith('HQ')])} AS hq,
                            {total([a for a in ARCHETYPES_2 if a.startswith('LQ')])} AS lq,
                            {total(['sporadic'])} AS sp, {total(ARCHETYPES_2)} AS everything
                     FROM axis LEFT JOIN ct USING (country, period)"""},
    ).replace("(date_diff(", "trunc(date_diff(").replace("/ 30.0)::DOUBLE AS since", "/ 30.0::DOUBLE)::INTEGER AS time_since_campaign")


_KNN = """SELECT user_id, coalesce(std_utm, 0) AS std_utm, quality_target, coalesce(n_clusters::VARCHAR, 'none') AS kind
          FROM simple"""

_RANGE = "(max({0}) OVER () - min({0}) OVER ())"


def _euclidean_sql(features: str) -> str:
    """All pairs of rows of `features` over the users `k`, which are scaled by the widest range as in the operator."""
    apart = "round(sqrt((a.s - b.s) * (a.s - b.s) + (a.q - b.q) * (a.q - b.q)), 12)"
    return with_views(f"""
        SELECT user_id, other, round(distance * w, 6) AS distance, rank FROM (
            SELECT a.user_id, b.user_id AS other, {apart} AS distance, a.w,
                   row_number() OVER (PARTITION BY a.user_id ORDER BY {apart}, b.user_id) AS rank
            FROM even a JOIN even b ON a.user_id <> b.user_id) WHERE rank <= 5""", extra={
        "simple": _SIMPLE, "k": _KNN, "f": features,
        "even": f"""SELECT user_id, w, (x - min(x) OVER ()) / w AS s, (y - min(y) OVER ()) / w AS q FROM (
                      SELECT *, greatest({_RANGE.format("x")}, {_RANGE.format("y")})::DOUBLE AS w FROM f)"""})


ORACLE = {
    "model_nearest_users_euclidean": _euclidean_sql("SELECT user_id, std_utm AS x, quality_target AS y FROM k"),
    "model_nearest_users_euclidean_min_max": _euclidean_sql(f"""
        SELECT user_id, (std_utm - min(std_utm) OVER ()) / {_RANGE.format("std_utm")} AS x,
               (quality_target - min(quality_target) OVER ()) / {_RANGE.format("quality_target")} AS y FROM k"""),
    "model_nearest_users_euclidean_l2": _euclidean_sql("""
        SELECT user_id, if(n = 0, 0, std_utm / n) AS x, if(n = 0, 0, quality_target / n) AS y FROM (
            SELECT *, sqrt(std_utm * std_utm + quality_target * quality_target) AS n FROM k)"""),
    "model_density_clusters": with_views("SELECT * FROM per_user", "v_points", recursive=True,
                                         extra={"pts": "SELECT * FROM v_points", **cluster_ctes("pts")}),
    "model_user_features": with_views(f"""
        SELECT user_id, n_points, n_invalid_points, mean_lon, mean_lat,
               round(std_utm, 3) AS std_utm, round(std_utm, 3) AS msd_utm, n_random_points, n_clusters FROM features""",
        "v_points", recursive=True, extra={"pts": "SELECT * FROM v_points", **_FEATURE_CTES}),
    "model_user_quality": with_views(f"""
        SELECT user_id, {SCALE}, n_reports, round(quality_target, 6) AS quality_target,
               round(quality_reports, 6) AS quality_reports FROM quality""", "v_reports", "v_named", extra=_QUALITY),
    "win_main_location": with_views("SELECT * FROM homes", "v_reports", "v_named", extra={"homes": _QUALITY["homes"]}),
    "model_user_profiles": with_views(f"""
        SELECT user_id, {SCALE}, n_reports, round(quality_target, 3) AS quality_target,
               round(quality_reports, 3) AS quality_reports, rows AS n_points,
               CASE WHEN rows > 1 THEN round(s, 3) END AS std_utm
        FROM quality LEFT JOIN centre USING (user_id) LEFT JOIN spread USING (user_id)""", "v_reports", "v_named",
        extra={"pts": "SELECT user_id, lon, lat FROM v_reports", **_QUALITY,
               **{k: _FEATURE_CTES[k] for k in ("centre", "joined", "metres", "spread")}}),
    "model_judged_answers": with_views("SELECT * FROM judged", "v_reports", "v_response",
                                       extra={k: _JUDGED[k] for k in [*_SURVEY, "judged"]}),
    "model_classification_report": with_views(f"""
        SELECT class, {", ".join(f"round({m}, 6) AS {m}" for m in _MEASURES)}, support FROM per
        UNION ALL SELECT 'accuracy', round(po, 6), round(po, 6), round(po, 6), (SELECT count(*) FROM judged) FROM pi
        UNION ALL SELECT 'macro avg', {", ".join(f"round(avg({m}), 6)" for m in _MEASURES)}, sum(support)::BIGINT FROM per
        UNION ALL SELECT 'weighted avg', {", ".join(f"round(sum({m} * support) / sum(support), 6)" for m in _MEASURES)},
                         sum(support)::BIGINT FROM per""", "v_reports", "v_response", extra={
            **_JUDGED,
            "classes": "SELECT labels AS class FROM judged UNION SELECT cs_labels FROM judged",
            "raw": """SELECT class, (SELECT count(*) FROM judged WHERE labels = class AND coincidence) AS tp,
                             (SELECT count(*) FROM judged WHERE labels = class) AS support,
                             (SELECT count(*) FROM judged WHERE cs_labels = class) AS guessed FROM classes""",
            "pr": """SELECT class, support, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS precision,
                            CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM raw""",
            "per": """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                                     ELSE 0 END AS f1 FROM pr"""}),
    "model_chance_agreement": with_views(
        "SELECT round(po, 6) AS po, round(pe, 6) AS pe, round(chance, 6) AS chance_adj_accuracy FROM pi",
        "v_reports", "v_response", extra={k: _JUDGED[k] for k in [*_SURVEY, "judged", "pi"]}),
    "model_user_accuracy": with_views("""
        SELECT user_id, accuracy_support, round(accuracy, 6) AS accuracy,
               round(accuracy_chance_adj, 6) AS accuracy_chance_adj FROM accuracy""", "v_reports", "v_response", extra=_JUDGED),
    "model_low_accuracy_share": with_views("""
        SELECT round(avg(CASE WHEN cs_labels IS NULL OR cs_labels IN ('aegypti', 'koreicus', 'japonicus') THEN 100.0::DOUBLE
                              ELSE 0 END), 6) AS perc_low_accuracy FROM survey""", "v_response", extra=_SURVEY),
    "model_quality_and_archetypes": with_views("""
        SELECT user_id, round(adults_ratio, 6) AS adults_ratio, round(accuracy, 6) AS accuracy,
               round(accuracy_chance_adj_pos, 6) AS accuracy_chance_adj_pos, round(quality, 6) AS quality,
               custom_labels_1, custom_labels_2, custom_labels_3 FROM labelled""", "v_reports", "v_response", extra=_LABELLED),
    "model_quality_without_accuracy": with_views("SELECT user_id, round(hm, 6) AS quality FROM graded",
                                                 "v_reports", "v_response", extra=_LABELLED),
    "agg_mean_by_motivation": with_views("""
        SELECT CASE WHEN custom_labels_1 = 'sporadic' THEN 'sporadic' ELSE 'motivated' END AS users,
               round(avg(quality), 6) AS mean, count(*) AS n FROM labelled GROUP BY 1""", "v_reports", "v_response",
        extra=_LABELLED),
    "model_distance_features": with_views("""
        SELECT user_id, round(coalesce(CASE WHEN std_utm = 0 THEN 1 WHEN ln(std_utm) < 0 THEN 1 ELSE ln(std_utm) END, 0), 6)
                 AS log_std_utm,
               CASE WHEN n_clusters > 1 THEN 2 ELSE n_clusters END AS type_clusters, custom_labels_1,
               round(coalesce(quality, 0), 6) AS quality
        FROM labelled WHERE custom_labels_3 <> 'sporadic'""", "v_reports", "v_response", extra=_LABELLED),
    "model_campaign_covariates": _covariate_sql("""
        round(CASE WHEN everything > 0 THEN hq / everything * 100 ELSE 0 END, 6) AS "HQ_users",
        round(CASE WHEN everything > 0 THEN lq / everything * 100 ELSE 0 END, 6) AS "LQ_users",
        round(CASE WHEN everything > 0 THEN sp / everything * 100 ELSE 0 END, 6) AS sporadic"""),
    "model_campaign_covariates_raw": _covariate_sql("""
        round(CASE WHEN everything > 0 THEN sp / everything END, 6) AS sporadic,
        round(CASE WHEN lq + hq > 0 THEN lq / (lq + hq) END, 6) AS "LQ2HQ_users" """),
    "model_nearest_users": with_views("""
        SELECT user_id, other, round(distance, 6) AS distance, rank FROM (
            SELECT a.user_id, b.user_id AS other, round((abs(a.s - b.s) + abs(a.q - b.q)
                     + CASE WHEN a.kind = b.kind THEN 0 ELSE 1 END) / 3, 12) AS distance,
                   row_number() OVER (PARTITION BY a.user_id ORDER BY round((abs(a.s - b.s) + abs(a.q - b.q)
                     + CASE WHEN a.kind = b.kind THEN 0 ELSE 1 END) / 3, 12), b.user_id) AS rank
            FROM scaled a JOIN scaled b ON a.user_id <> b.user_id) WHERE rank <= 5""", extra={
        "simple": _SIMPLE, "k": _KNN,
        "scaled": """SELECT user_id, kind, (std_utm - min(std_utm) OVER ()) / (max(std_utm) OVER () - min(std_utm) OVER ()) AS s,
                            (quality_target - min(quality_target) OVER ())
                              / (max(quality_target) OVER () - min(quality_target) OVER ()) AS q FROM k"""}),
    "model_min_max_scaled": with_views("""
        SELECT user_id, round((std_utm - min(std_utm) OVER ()) / (max(std_utm) OVER () - min(std_utm) OVER ()), 6) AS std_utm,
               round((quality_target - min(quality_target) OVER ())
                     / (max(quality_target) OVER () - min(quality_target) OVER ()), 6) AS quality_target FROM k""",
        extra={"simple": _SIMPLE, "k": _KNN}),
    "model_l2_scaled": with_views("""
        SELECT user_id, if(n = 0, 0, round(std_utm / n, 6)) AS std_utm, if(n = 0, 0, round(quality_target / n, 6)) AS quality_target FROM (
            SELECT *, sqrt(std_utm * std_utm + quality_target * quality_target) AS n FROM k)""",
        extra={"simple": _SIMPLE, "k": _KNN}),
    "agg_dispersion": with_views("SELECT user_id, round(s, 3) AS std_utm FROM spread", "v_points", extra={
        "pts": "SELECT * FROM v_points", **{k: _FEATURE_CTES[k] for k in ("centre", "joined", "metres", "spread")}}),
    "agg_bounding_box": with_views("""
        SELECT user_id, round(min(lon), 6) AS min_x, round(min(lat), 6) AS min_y, round(max(lon), 6) AS max_x,
               round(max(lat), 6) AS max_y FROM v_points GROUP BY 1""", "v_points"),
    "case_archetype": with_views(f"SELECT user_id, {_rule_sql(1000, 0.5, 'quality_target')} AS label FROM simple",
                                 extra={"simple": _SIMPLE}),
}
