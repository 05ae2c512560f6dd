"""One query for each operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import align, catalog, lineage, ranking, sampling, scoring, segment, serve
from .tables import documents_catalog, samples, steps, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DAY, HOUR = 86_400_000_000_000, 3_600_000_000_000
ORDER = ["t_ns", "event_id"]
SCORES = ("smoothness", "consistency", "completeness")

# SQL of the shared tables
STEPS = "st AS (SELECT user_id AS episode_id, event_id, epoch_us(ts) * 1000 AS t_ns, value AS a0, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS a1, event_type FROM events)"
CATALOG = """cat AS (SELECT d.doc_id AS episode_id, d.lang AS task, d.source AS embodiment,
    regexp_replace(lower(d.lang), '[-\\s_]+', '', 'g') AS task_key, regexp_replace(lower(d.source), '[-\\s_]+', '', 'g') AS embodiment_key,
    CASE WHEN l.quality IS NOT NULL THEN round((d.n_chars % 97) / 97.0::DOUBLE, 6) END AS overall
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def scored_sql(success: str = "CAST(NULL AS DOUBLE)", source: str = "st", name: str = "sc", w: tuple[float, float, float] = (0.40, 0.35, 0.25), seconds: str = "30e9") -> str:
    """CTEs that end in (episode_id, n, smoothness, consistency, completeness, overall)."""
    return f"""
  d_{name} AS (SELECT *, a0 - lag(a0) OVER w AS d0, a1 - lag(a1) OVER w AS d1 FROM {source} WINDOW w AS (PARTITION BY episode_id ORDER BY t_ns, event_id)),
  c_{name} AS (SELECT *, d0 - lag(d0) OVER w AS c0, d1 - lag(d1) OVER w AS c1, sqrt(d0 * d0 + d1 * d1) AS m,
     (sign(d0) <> sign(lag(d0) OVER w) OR sign(d1) <> sign(lag(d1) OVER w)) AS turn FROM d_{name} WINDOW w AS (PARTITION BY episode_id ORDER BY t_ns, event_id)),
  j_{name} AS (SELECT *, (c0 - lag(c0) OVER w) ** 2 + (c1 - lag(c1) OVER w) ** 2 AS j2, lag(m) OVER w AS pm FROM c_{name} WINDOW w AS (PARTITION BY episode_id ORDER BY t_ns, event_id)),
  a_{name} AS (SELECT episode_id, count(*) AS n, sqrt(sum(j2) / (2 * nullif(count(j2), 0))) AS rms,
     stddev_pop(m) FILTER (m IS NOT NULL AND pm IS NOT NULL) AS sm, stddev_pop(pm) FILTER (m IS NOT NULL AND pm IS NOT NULL) AS sp,
     covar_pop(m, pm) AS cov, avg(CAST(turn AS DOUBLE)) AS rr, max(t_ns) - min(t_ns) AS dur, max({success}) AS ok FROM j_{name} GROUP BY episode_id),
  b_{name} AS (SELECT episode_id, n,
     CASE WHEN n >= 10 THEN greatest(0, least(1, 1 / (1 + rms))) END AS smoothness,
     CASE WHEN n >= 10 THEN greatest(0, least(1, greatest(0, CASE WHEN sm < 1e-9 OR sp < 1e-9 THEN 1 ELSE coalesce(cov / nullif(sm * sp, 0), 0) END) * (1 - rr))) END AS consistency,
     CASE WHEN n >= 10 THEN CASE WHEN ok IS NOT NULL THEN ok ELSE greatest(0, least(1, dur / {seconds})) END END AS completeness FROM a_{name}),
  {name} AS (SELECT *, round(smoothness * {w[0]} + consistency * {w[1]} + completeness * {w[2]}, 6) AS overall FROM b_{name})"""


SCORED = f"WITH {STEPS}, {scored_sql()}"


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def scored(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return scoring.score(steps(spark, sf_dir), ["a0", "a1"], ORDER, **more)


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


# --- scores


@query(f"{SCORED} SELECT episode_id, round(smoothness, 6) AS smoothness FROM sc")
def score_smoothness(spark, sf_dir):
    return scored(spark, sf_dir).select("episode_id", r6("smoothness").alias("smoothness"))


@query(f"{SCORED} SELECT episode_id, round(consistency, 6) AS consistency FROM sc")
def score_consistency(spark, sf_dir):
    return scored(spark, sf_dir).select("episode_id", r6("consistency").alias("consistency"))


@query(f"WITH {STEPS}, {scored_sql('CASE episode_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END')} SELECT episode_id, round(completeness, 6) AS completeness FROM sc")
def score_completeness(spark, sf_dir):
    success = F.when(F.col("episode_id") % 3 == 0, True).when(F.col("episode_id") % 3 == 1, False)
    return scored(spark, sf_dir, success=success).select("episode_id", r6("completeness").alias("completeness"))


SCALED = f"WITH {STEPS}, fast AS (SELECT episode_id, event_id, t_ns // 100000 AS t_ns, a0, a1 FROM st)"


@query(f"{SCALED}, {scored_sql(source='fast')} SELECT episode_id, round(completeness, 6) AS completeness FROM sc")
def score_completeness_scaled(spark, sf_dir):
    fast = steps(spark, sf_dir).withColumn("t_ns", F.expr("t_ns div 100000"))
    return scoring.score(fast, ["a0", "a1"], ORDER).select("episode_id", r6("completeness").alias("completeness"))


@query(f"{SCORED} SELECT episode_id, n AS n_steps, round(smoothness, 6) AS smoothness, round(consistency, 6) AS consistency, round(completeness, 6) AS completeness, overall FROM sc")
def score_overall(spark, sf_dir):
    return scored(spark, sf_dir, digits=6).select("episode_id", "n_steps", *SCORES, "overall")


@query(f"{SCORED} SELECT episode_id, round(smoothness, 6) AS smoothness, round(consistency, 6) AS consistency, overall FROM sc")
def score_array_actions(spark, sf_dir):
    own = steps(spark, sf_dir).withColumn("action", F.array("a0", "a1"))
    return scoring.score(own, "action", ORDER, digits=6).select("episode_id", "smoothness", "consistency", "overall")


@query(f"WITH {STEPS}, {scored_sql(w=(0.5, 0.3, 0.2))} SELECT episode_id, overall FROM sc")
def score_custom_weights(spark, sf_dir):
    return scored(spark, sf_dir, weights={"smoothness": 0.5, "consistency": 0.3, "completeness": 0.2}).select("episode_id", "overall")


@query(f"""WITH {STEPS}, {scored_sql(w=(0.32, 0.28, 0.20))},
  low AS (SELECT episode_id, avg(CASE WHEN a0 < 250 THEN 1.0 ELSE 0.0 END::DOUBLE) AS low_share FROM st GROUP BY episode_id)
  SELECT sc.episode_id, round(low_share, 6) AS low_share, round(overall + low_share * 0.2, 6) AS overall FROM sc JOIN low USING (episode_id)""")
def score_custom_metric(spark, sf_dir):
    share = lambda: F.avg(F.when(F.col("a0") < 250, F.lit(1.0)).otherwise(F.lit(0.0)))
    own = scored(spark, sf_dir, metrics=scoring.Metrics().register("low_share", share, 0.2))
    return own.select("episode_id", r6("low_share").alias("low_share"), "overall")


@query("""SELECT o_custkey AS episode_id, count(*) AS n_steps, count(*) >= 10 AS scored FROM orders GROUP BY o_custkey""")
def score_short_null(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("episode_id"), (keys.micros(F.col("o_orderdate")) * 1000).alias("t_ns"), F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("a0"))
    out = scoring.score(o, ["a0"], ORDER)
    return out.select("episode_id", "n_steps", F.col("overall").isNotNull().alias("scored"))


@query("SELECT conv_id AS episode_id, count(*) AS n_steps, CAST(NULL AS DOUBLE) AS overall FROM conversations GROUP BY conv_id HAVING count(*) < 10")
def score_too_short(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_id"), (F.col("turn") * 1_000_000_000).alias("t_ns"), F.col("turn").alias("event_id"), F.length("text").cast("double").alias("a0"))
    return scoring.score(c, ["a0"], ORDER).where("n_steps < 10").select("episode_id", "n_steps", "overall")


@query("SELECT DISTINCT user_id AS episode_id, 1.0::DOUBLE AS feasibility FROM events")
def feasibility(spark, sf_dir):
    return scoring.feasibility(table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id")).distinct())


@query(f"{SCORED} SELECT episode_id, overall FROM sc WHERE overall >= 0.262")
def quality_filter(spark, sf_dir):
    return scoring.at_least(scored(spark, sf_dir), 0.262).select("episode_id", "overall")


@query(f"""{SCORED} SELECT count(*) AS n_total, count(overall) AS n_scored, min(overall) AS min, max(overall) AS max, round(avg(overall), 6) AS mean,
  round(median(overall), 6) AS median, round(stddev_pop(overall), 6) AS std FROM sc""")
def quality_report_stats(spark, sf_dir):
    own = scoring.report(scored(spark, sf_dir))
    return own.select("n_total", "n_scored", "min", "max", *(r6(c).alias(c) for c in ("mean", "median", "std")))


@query(f"""{SCORED}, s AS (SELECT avg(overall) AS mu, stddev_pop(overall) AS sd FROM sc)
  SELECT episode_id, overall, round((overall - mu) / sd, 4) AS sigma FROM sc, s WHERE sd > 0 AND abs(overall - mu) > 2 * sd""")
def quality_outliers(spark, sf_dir):
    return scoring.outliers(scored(spark, sf_dir)).select("episode_id", "overall", F.round("sigma", 4).alias("sigma"))


@query(f"""{SCORED} SELECT round(avg(overall), 4) AS mean, round(CASE WHEN count(overall) = 1 THEN 0.0 ELSE stddev_samp(overall) END, 4) AS std,
  round(min(overall), 4) AS min, round(max(overall), 4) AS max, count(overall) AS n FROM sc""")
def tracker_stats(spark, sf_dir):
    return scoring.tracker_stats(scored(spark, sf_dir))


# --- catalog


@query(f"""WITH {STEPS} SELECT episode_id, count(*) AS n_steps, min(t_ns) AS t_start_ns, max(t_ns) AS t_end_ns, max(t_ns) - min(t_ns) AS duration_ns,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS obs_keys FROM st GROUP BY episode_id""")
def catalog_summary(spark, sf_dir):
    obs = F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("obs_keys")
    return catalog.summarise(steps(spark, sf_dir), ORDER, keep=[obs]).select("episode_id", "n_steps", "t_start_ns", "t_end_ns", "duration_ns", "obs_keys")


@query("SELECT o_orderpriority AS raw, regexp_replace(lower(o_orderpriority), '[-\\s_]+', '', 'g') AS key, count(*) AS n FROM orders GROUP BY 1, 2")
def normalise_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("raw"))
    return o.groupBy("raw").agg(F.count("*").alias("n")).select("raw", keys.normalise(F.col("raw")).alias("key"), "n")


@query("""SELECT regexp_replace(lower(o_orderpriority), '[-\\s_]+', '', 'g') AS task_key, count(*) AS n, sum(o_orderkey)::BIGINT AS checksum FROM orders GROUP BY 1""")
def by_task_index(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(keys.normalise(F.col("o_orderpriority")).alias("task_key"), F.col("o_orderkey").alias("episode_id"))
    return catalog.inverted_rows(o, "task_key").groupBy("task_key").agg(F.count("*").alias("n"), F.sum("episode_id").alias("checksum"))


@query(f"WITH {CATALOG} SELECT embodiment_key, count(*) AS n, string_agg(CAST(episode_id AS VARCHAR), ',' ORDER BY episode_id) AS episode_ids FROM cat GROUP BY 1")
def by_embodiment_index(spark, sf_dir):
    own = catalog.inverted(documents_catalog(spark, sf_dir), "embodiment_key")
    return own.select("embodiment_key", "n", F.array_join(F.col("episode_ids").cast("array<string>"), ",").alias("episode_ids"))


@query(f"WITH {CATALOG} SELECT row_number() OVER (ORDER BY overall ASC NULLS LAST, episode_id) AS place, overall, episode_id FROM cat")
def quality_index_sorted(spark, sf_dir):
    return catalog.quality_index(documents_catalog(spark, sf_dir))


def _found(where: str) -> str:
    return f"WITH {CATALOG} SELECT episode_id, task, embodiment, overall FROM cat WHERE {where}"


def _find(spark, sf_dir, **wanted) -> DataFrame:
    return catalog.find(documents_catalog(spark, sf_dir), **wanted).select("episode_id", "task", "embodiment", "overall")


@query(_found("task_key = 'fr'"))
def query_task(spark, sf_dir):
    return _find(spark, sf_dir, task=" F-R ")


@query(_found("task_key IN ('fr', 'de')"))
def query_multi_task(spark, sf_dir):
    return _find(spark, sf_dir, task=["fr", "DE", "unknown"])


@query(_found("embodiment_key = 'src1'"))
def query_embodiment(spark, sf_dir):
    return _find(spark, sf_dir, embodiment="SRC_1")


@query(_found("overall BETWEEN 0.25 AND 0.75"))
def query_quality_range(spark, sf_dir):
    return _find(spark, sf_dir, quality_min=0.25, quality_max=0.75)


@query(_found("task_key = 'en' AND embodiment_key IN ('src1', 'src2') AND overall >= 0.5"))
def query_conjunction(spark, sf_dir):
    return _find(spark, sf_dir, task="en", embodiment=["src1", "src2"], quality_min=0.5)


@query(_found("false"))
def query_empty_list(spark, sf_dir):
    return _find(spark, sf_dir, task=[])


@query(f"{SCORED}, du AS (SELECT episode_id, (max(t_ns) - min(t_ns)) / 1e9 AS duration_s FROM st GROUP BY episode_id) SELECT row_number() OVER (ORDER BY overall ASC NULLS LAST, episode_id)::INTEGER AS place, episode_id, round(duration_s, 6) AS duration_s, overall FROM sc JOIN du USING (episode_id)")
def list_episodes(spark, sf_dir):
    own = scored(spark, sf_dir, keep=[(F.max("t_ns") - F.min("t_ns")).alias("duration_ns")]).withColumns({"task_key": F.lit(None).cast("string"), "embodiment_key": F.lit(None).cast("string")})
    ranked = ranking.global_rank(catalog.listing(own), [F.col("overall").asc_nulls_last(), F.col("episode_id")], "place")
    return ranked.select(F.col("place").cast("int").alias("place"), "episode_id", r6("duration_s").alias("duration_s"), "overall")


@query(f"{SCORED} SELECT episode_id, n AS n_steps, overall FROM sc WHERE episode_id = 7")
def episode_info(spark, sf_dir):
    own = steps(spark, sf_dir).where("episode_id = 7")
    return catalog.info(scoring.score(own, ["a0", "a1"], ORDER), 7).select("episode_id", "n_steps", "overall")


@query(f"WITH {CATALOG} SELECT task_key, embodiment_key, count(*) AS n, round(avg(overall), 6) AS mean_overall FROM cat GROUP BY ROLLUP (task_key, embodiment_key)")
def catalog_rollup(spark, sf_dir):
    return catalog.rollup(documents_catalog(spark, sf_dir))


@query(f"WITH {CATALOG} SELECT episode_id, 'a'::VARCHAR AS hit FROM cat WHERE task_key = 'en' INTERSECT SELECT episode_id, 'a' FROM cat WHERE overall >= 0.5")
def index_intersection(spark, sf_dir):
    c = documents_catalog(spark, sf_dir)
    pick = lambda p: c.where(p).select("episode_id", F.lit("a").alias("hit"))
    return pick(catalog.matches(task="en")).intersect(pick(catalog.matches(quality_min=0.5)))


@query(f"WITH {CATALOG} SELECT episode_id FROM cat WHERE task_key = 'fr' UNION SELECT episode_id FROM cat WHERE task_key = 'es'")
def index_union(spark, sf_dir):
    c = documents_catalog(spark, sf_dir)
    return c.where(catalog.matches(task="fr")).select("episode_id").union(c.where(catalog.matches(task="es")).select("episode_id")).distinct()


# --- samples


def unit_sql(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


@query(f"{SCORED} SELECT episode_id, overall FROM sc ORDER BY episode_id LIMIT 20")
def sample_none(spark, sf_dir):
    return sampling.sample(scored(spark, sf_dir), "none", 20).select("episode_id", "overall")


def stratified_sql(source: str, stratum: str, limit: int, seed: int) -> str:
    return f"""{source}, size AS (SELECT {stratum} AS s, count(*) AS n FROM pool GROUP BY 1),
  p AS (SELECT s, n, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS k, count(*) OVER () AS g, least({limit}, sum(n) OVER ())::BIGINT AS cap FROM size),
  q AS (SELECT *, least(n, cap // g + CASE WHEN k < cap % g THEN 1 ELSE 0 END) AS taken FROM p),
  x AS (SELECT *, greatest(0, least(n - taken, cap - sum(taken) OVER () - coalesce(sum(n - taken) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS extra FROM q),
  r AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY {unit_sql('episode_id', seed)}, episode_id) AS stratum_rank FROM pool)
  SELECT r.episode_id, r.{stratum} AS stratum, r.stratum_rank::INTEGER AS stratum_rank FROM r JOIN x ON r.{stratum} IS NOT DISTINCT FROM x.s WHERE r.stratum_rank <= x.taken + x.extra"""


@query(stratified_sql("WITH pool AS (SELECT o_orderkey AS episode_id, o_orderpriority AS task FROM orders)", "task", 203, 3))
def sample_stratified(spark, sf_dir):
    pool = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_id"), F.col("o_orderpriority").alias("task"))
    return sampling.sample(pool, "stratified", 203, seed=3).select("episode_id", F.col("task").alias("stratum"), "stratum_rank")


@query(stratified_sql("WITH pool AS (SELECT doc_id AS episode_id, CASE WHEN doc_id < 3 THEN 'aa' WHEN doc_id < 8 THEN 'zz' ELSE lang END AS task FROM documents)", "task", 150, 9))
def sample_stratified_redistribute(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pool = d.select(F.col("doc_id").alias("episode_id"), F.when(F.col("doc_id") < 3, "aa").when(F.col("doc_id") < 8, "zz").otherwise(F.col("lang")).alias("task"))
    return sampling.sample(pool, "stratified", 150, seed=9).select("episode_id", F.col("task").alias("stratum"), "stratum_rank")


@query(f"{SCORED} SELECT episode_id, overall, round((overall + 1e-9) * {unit_sql('episode_id', 5)}, 9) AS priority FROM sc WHERE overall IS NOT NULL ORDER BY (overall + 1e-9) * {unit_sql('episode_id', 5)} DESC, episode_id LIMIT 40")
def sample_quality_weighted(spark, sf_dir):
    return sampling.sample(scored(spark, sf_dir), "quality_weighted", 40, seed=5).select("episode_id", "overall", F.round("priority", 9).alias("priority"))


@query(f"{SCORED}, f AS (SELECT * FROM sc WHERE overall >= 0.2615) SELECT count(*) AS n_source, least(count(*), 25) AS n_sampled FROM f")
def recipe_ids(spark, sf_dir):
    found = scoring.at_least(scored(spark, sf_dir), 0.2615)
    taken = sampling.sample(found, "none", 25)
    return found.agg(F.count("*").alias("n_source")).crossJoin(taken.agg(F.count("*").alias("n_sampled")))


# --- timelines

GRID = f"""WITH sm AS (SELECT user_id AS recording_id, event_type AS stream, epoch_us(ts) * 1000 AS t_ns, value FROM events),
  own AS (SELECT recording_id, stream, min(t_ns) AS f, max(t_ns) AS l, count(*) AS n FROM sm GROUP BY 1, 2),
  sp AS (SELECT recording_id, max(f) AS t0, min(l) AS t1, min(n) AS fewest FROM own GROUP BY 1 HAVING min(l) >= max(f) AND min(n) >= 2),
  g AS (SELECT recording_id, unnest(range(t0, t1 + 1, {DAY})) AS t_ns FROM sp)"""
NEAR = f"""{GRID}, u AS (SELECT recording_id, stream, t_ns, value, 0 AS g FROM sm UNION ALL SELECT g.recording_id, o.stream, g.t_ns, NULL, 1 FROM g JOIN own o ON g.recording_id = o.recording_id),
  nb AS (SELECT recording_id, stream, t_ns, g,
    last_value(CASE WHEN g = 0 THEN t_ns END IGNORE NULLS) OVER b AS pt, last_value(CASE WHEN g = 0 THEN value END IGNORE NULLS) OVER b AS px,
    first_value(CASE WHEN g = 0 THEN t_ns END IGNORE NULLS) OVER a AS nt, first_value(CASE WHEN g = 0 THEN value END IGNORE NULLS) OVER a AS nx FROM u
    WINDOW b AS (PARTITION BY recording_id, stream ORDER BY t_ns RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY recording_id, stream ORDER BY t_ns RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"{GRID} SELECT recording_id, t_ns FROM g")
def align_grid(spark, sf_dir):
    return align.grid(samples(spark, sf_dir), DAY)


@query(f"""{NEAR} SELECT recording_id, stream, t_ns, round(CASE WHEN pt IS NULL THEN nx WHEN nt IS NULL OR pt = t_ns THEN px WHEN nt = t_ns THEN nx
  ELSE px + (nx - px) * ((t_ns - pt)::DOUBLE / (nt - pt)::DOUBLE) END, 6) AS value FROM nb WHERE g = 1""")
def align_linear(spark, sf_dir):
    return align.align(samples(spark, sf_dir), step_ns=DAY).withColumn("value", r6("value"))


@query(f"{NEAR} SELECT recording_id, stream, t_ns, CASE WHEN pt IS NULL THEN nx WHEN nt IS NULL OR t_ns - pt <= nt - t_ns THEN px ELSE nx END AS value FROM nb WHERE g = 1")
def align_nearest(spark, sf_dir):
    return align.align(samples(spark, sf_dir).withColumn("kind", F.lit("image")), step_ns=DAY, kind="kind")


@query(f"""WITH x AS (SELECT user_id AS recording_id, event_type AS stream, epoch_us(ts) * 1000 - lag(epoch_us(ts) * 1000) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS gap FROM events)
  SELECT recording_id, stream, count(*) FILTER (gap > {HOUR}) AS n_gaps, max(gap) AS max_gap FROM x GROUP BY 1, 2""")
def gap_stats(spark, sf_dir):
    return align.gaps(samples(spark, sf_dir), HOUR)


NUMBERED = f"WITH {STEPS}, nu AS (SELECT episode_id AS recording_id, event_id, t_ns, a0, event_type, row_number() OVER (PARTITION BY episode_id ORDER BY t_ns, event_id) - 1 AS i FROM st)"


def numbered(spark, sf_dir) -> DataFrame:
    return segment.number(steps(spark, sf_dir).withColumnRenamed("episode_id", "recording_id"), ORDER)


@query(f"{NUMBERED}, x AS (SELECT recording_id, i, a0 > 250 AS s, lead(a0 > 250) OVER (PARTITION BY recording_id ORDER BY i) AS n FROM nu) SELECT recording_id, i::INTEGER AS i FROM x WHERE n IS NOT NULL AND n <> s")
def threshold_transitions(spark, sf_dir):
    return segment.transitions(numbered(spark, sf_dir), F.col("a0") > 250)


PAUSES = f"""{NUMBERED}, x AS (SELECT *, a0 < 200 AS z, lead(t_ns) OVER w AS after, lead(i) OVER w AS i2 FROM nu WINDOW w AS (PARTITION BY recording_id ORDER BY i)),
  y AS (SELECT *, i - row_number() OVER (PARTITION BY recording_id ORDER BY i) AS run FROM x WHERE z),
  e AS (SELECT recording_id, run, min(i) AS first, arg_min(t_ns, i) AS t0, arg_max(coalesce(i2, i), i) AS last, arg_max(coalesce(after, t_ns), i) AS t1 FROM y GROUP BY 1, 2)"""


@query(f"{PAUSES} SELECT recording_id, first::INTEGER AS first, last::INTEGER AS last, (first + (last - first) // 2)::INTEGER AS middle FROM e WHERE t1 - t0 >= 40000000000000")
def pause_midpoints(spark, sf_dir):
    return segment.pauses(numbered(spark, sf_dir), F.col("a0") < 200, 40_000_000_000_000)


MARKS = "mk AS (SELECT DISTINCT recording_id, m AS marker_ns FROM nu, (SELECT unnest([1704844800000000000, 1705708800000000000]) AS m))"


def markers(spark, sf_dir) -> DataFrame:
    own = numbered(spark, sf_dir).select("recording_id").distinct()
    return own.select("recording_id", F.explode(F.array(F.lit(1704844800000000000), F.lit(1705708800000000000))).alias("marker_ns"))


MARKED = f"{NUMBERED}, {MARKS}, mi AS (SELECT DISTINCT k.recording_id, coalesce(min(n.i) FILTER (n.t_ns >= k.marker_ns), max(n.i)) AS i FROM mk k JOIN nu n ON k.recording_id = n.recording_id GROUP BY k.recording_id, k.marker_ns)"


@query(f"{MARKED} SELECT recording_id, i::INTEGER AS i FROM mi")
def marker_split(spark, sf_dir):
    return segment.markers_to_steps(numbered(spark, sf_dir), markers(spark, sf_dir))


@query(f"""{MARKED}, b AS (SELECT n.*, coalesce(sum(CASE WHEN mi.i IS NOT NULL THEN 1 END) OVER (PARTITION BY n.recording_id ORDER BY n.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment
    FROM nu n LEFT JOIN mi ON n.recording_id = mi.recording_id AND n.i = mi.i)
  SELECT recording_id || '/' || segment AS episode_id, count(*) AS n_steps, min(i)::INTEGER AS first_step FROM b GROUP BY recording_id, segment HAVING count(*) >= 2""")
def segment_steps(spark, sf_dir):
    own = numbered(spark, sf_dir)
    cut = segment.segment(own, segment.markers_to_steps(own, markers(spark, sf_dir)))
    return cut.groupBy("episode_id").agg(F.count("*").alias("n_steps"), F.min("i").alias("first_step"))


STREAMS = "s AS (SELECT user_id AS recording_id, CASE event_type WHEN 'error' THEN 'gripper_state' WHEN 'signup' THEN 'joint_vel' WHEN 'click' THEN 'action_arm' WHEN 'view' THEN 'robot_cmd_vel' ELSE event_type END AS stream, epoch_us(ts) * 1000 AS t_ns FROM events WHERE NOT (user_id % 3 = 0 AND event_type = 'error') AND NOT (user_id % 2 = 0 AND event_type = 'signup') AND NOT (user_id % 5 = 0 AND event_type = 'click'))"


def role_streams(spark, sf_dir) -> DataFrame:
    own = samples(spark, sf_dir)
    name = F.when(F.col("stream") == "error", "gripper_state").when(F.col("stream") == "signup", "joint_vel").when(F.col("stream") == "click", "action_arm").when(F.col("stream") == "view", "robot_cmd_vel").otherwise(F.col("stream"))
    own = own.where("not (recording_id % 3 = 0 and stream = 'error') and not (recording_id % 2 = 0 and stream = 'signup') and not (recording_id % 5 = 0 and stream = 'click')")
    return own.withColumn("stream", name)


@query(f"""WITH {STREAMS}, g AS (SELECT recording_id, bool_or(contains(stream, 'gripper')) AS gr, bool_or(stream = 'joint_vel') AS ve FROM s GROUP BY 1)
  SELECT recording_id, CASE WHEN gr THEN 'gripper' WHEN ve THEN 'velocity' WHEN recording_id % 7 = 0 THEN 'markers' ELSE 'none' END AS by FROM g""")
def boundary_priority(spark, sf_dir):
    streams = role_streams(spark, sf_dir)
    marked = streams.where("recording_id % 7 = 0").select("recording_id", F.lit(0).cast("bigint").alias("marker_ns"))
    return segment.choose("auto", streams, marked)


@query(f"WITH {STREAMS}, f AS (SELECT recording_id, stream, min(t_ns) AS first_ns FROM s GROUP BY 1, 2) SELECT recording_id, arg_min(stream, (first_ns, stream)) FILTER (stream = 'action' OR stream LIKE 'action\\_%' ESCAPE '\\') AS action_stream FROM f GROUP BY 1")
def action_stream_pick(spark, sf_dir):
    own = role_streams(spark, sf_dir).groupBy("recording_id", "stream").agg(F.min("t_ns").alias("first_ns"))
    return segment.action_stream(own)


# --- sources


@query(f"""WITH {STEPS}, c AS (SELECT episode_id, event_type, count(*) AS n, min((t_ns, event_id)) AS first FROM st GROUP BY 1, 2)
  SELECT episode_id, event_type AS task, n FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY n DESC, first) AS r FROM c) WHERE r = 1""")
def most_common_task(spark, sf_dir):
    from ..sources.dataset import most_common

    return most_common(steps(spark, sf_dir), "event_type", ORDER).select("episode_id", F.col("event_type").alias("task"), "n")


@query("SELECT l_orderkey, l_linenumber, trunc(CAST(CAST(l_quantity / 7 AS FLOAT) AS DOUBLE) * 1e9)::BIGINT AS t_ns, l_linenumber::BIGINT * 20000000 AS made_ns FROM lineitem")
def dataset_timestamps(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem")
    return own.select("l_orderkey", "l_linenumber", keys.seconds_to_ns((F.col("l_quantity") / 7).cast("float")).alias("t_ns"), keys.step_ns(F.col("l_linenumber"), 50).alias("made_ns"))


@query("SELECT count(*) AS n, count(*) FILTER (embedding IS NULL) AS n_null, min(len(embedding)) AS shortest, max(len(embedding)) AS longest FROM embeddings")
def column_validation(spark, sf_dir):
    from ..sources.dataset import column_stats

    return column_stats(table(spark, sf_dir, "embeddings"), "embedding").select("n", "n_null", F.col("shortest").cast("bigint").alias("shortest"), F.col("longest").cast("bigint").alias("longest"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'joint_pos' WHEN 'view' THEN 'robot_arm_cmd' WHEN 'purchase' THEN 'robot_cmd_vel' END AS stream,
  CASE event_type WHEN 'click' THEN value WHEN 'view' THEN value + 1 WHEN 'purchase' THEN value * 2 END AS first, CASE event_type WHEN 'purchase' THEN 6 ELSE 1 END AS width FROM events WHERE event_type IN ('click', 'view', 'purchase')""")
def message_projection(spark, sf_dir):
    from ..sources.messages import project

    e = table(spark, sf_dir, "events")
    topic = F.when(F.col("event_type") == "click", "/joint_states").when(F.col("event_type") == "view", "//robot/arm_cmd").when(F.col("event_type") == "purchase", "/robot/cmd_vel").otherwise("/camera")
    kind = F.when(F.col("event_type") == "click", "JointState").when(F.col("event_type") == "view", "Float64MultiArray").when(F.col("event_type") == "purchase", "Twist").otherwise("Image")
    v = F.col("value")
    vec = lambda x: F.struct(x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    messages = e.select("event_id", topic.alias("topic"), kind.alias("schema"), F.array(v).alias("position"), F.array().cast("array<double>").alias("velocity"), F.array(v + 1).alias("data"), vec(v * 2).alias("linear"), vec(v).alias("angular"))
    return project(messages, keep=["event_id"]).select("event_id", "stream", F.get("values", F.lit(0)).alias("first"), F.size("values").alias("width"))


@query("""WITH v AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN url || '/episode.mp4' END AS own, CASE WHEN page_id % 2 = 0 THEN 'chunk-' || (page_id // 100) || '.mp4' END AS chunk FROM pages)
  SELECT page_id AS episode_id, coalesce(own, chunk) AS path, own IS NULL AND chunk IS NOT NULL AS fallback FROM v""")
def video_fallback(spark, sf_dir):
    from ..sources.dataset import video_paths

    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("episode_id"), "url", F.expr("page_id div 100").alias("chunk"))
    own = p.where("episode_id % 3 = 0").select("episode_id", F.concat("url", F.lit("/episode.mp4")).alias("path"))
    chunks = p.where("episode_id % 2 = 0").select("chunk").distinct().select("chunk", F.concat(F.lit("chunk-"), F.col("chunk").cast("string"), F.lit(".mp4")).alias("path"))
    return video_paths(p.withColumn("chunk", F.when(F.col("episode_id") % 2 == 0, F.col("chunk"))), own, chunks).select("episode_id", "path", "fallback")


@query("""SELECT page_id, CASE WHEN lower(url) LIKE '%.mcap' THEN 'mcap' WHEN lower(url) LIKE '%.html' THEN 'unknown' WHEN regexp_matches(lower(url), '\\.(hdf5|h5)$') THEN 'hdf5'
  WHEN lower(url) LIKE '%.parquet' THEN 'parquet' ELSE 'unknown' END AS format FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '.mcap' WHEN 1 THEN url || '.H5' WHEN 2 THEN url || '.parquet' ELSE url END AS url FROM pages)""")
def detect_format(spark, sf_dir):
    from ..sources.detect import format_of

    ends = F.when(F.col("page_id") % 4 == 0, ".mcap").when(F.col("page_id") % 4 == 1, ".H5").when(F.col("page_id") % 4 == 2, ".parquet").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", format_of(F.concat("url", ends)).alias("format"))


@query("SELECT sum(strlen(html))::BIGINT AS total_bytes, sum(strlen(html)) > 1000000 AS large FROM pages")
def store_size(spark, sf_dir):
    from ..sources.store import size_of

    return size_of(table(spark, sf_dir, "pages").select(F.octet_length("html").cast("bigint").alias("length")), 1_000_000)


# --- storage and serving


@query("SELECT event_id, format('ep_{:04d}', 41 + row_number() OVER (ORDER BY event_id)) AS episode_name FROM events")
def episode_ids(spark, sf_dir):
    from ..sources.store import number_after

    own = table(spark, sf_dir, "events").select("event_id")
    return number_after(own, 41, "event_id").select("event_id", keys.episode_name(F.col("episode_num")).alias("episode_name"))


@query("SELECT vec_id, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS checksum FROM embeddings")
def wide_roundtrip(spark, sf_dir):
    from ..sources.store import from_wide, to_wide

    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    back = from_wide(to_wide(own, {"embedding": 64}), ["embedding"])
    return back.select("vec_id", F.size("embedding").cast("bigint").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("checksum"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def export_semi(spark, sf_dir):
    chosen = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return catalog.read_filtered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), chosen, "l_orderkey")


@query("SELECT c_custkey AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 3 <> 0)")
def export_missing_anti(spark, sf_dir):
    there = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_custkey % 3 <> 0").select(F.col("o_custkey").alias("missing"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("missing")).join(there, "missing", "left_anti")


BATCHES = f"WITH {STEPS}, e AS (SELECT episode_id, count(*) AS n, sum(a0 + a1) AS s FROM st GROUP BY 1), r AS (SELECT *, (row_number() OVER (ORDER BY episode_id) - 1) // 32 AS batch FROM e)"


@query(f"{BATCHES} SELECT episode_id, batch::BIGINT AS batch, n AS n_steps, (max(n) OVER (PARTITION BY batch) * 2)::BIGINT AS padded_values, round(s, 4) AS checksum FROM r")
def collate_pad(spark, sf_dir):
    own = steps(spark, sf_dir)
    episodes = serve.gather(own, F.array("a0", "a1"), ORDER)
    out = serve.pad(serve.batches(episodes, 32), "values", 2)
    return out.select("episode_id", "batch", "n_steps", F.size(F.flatten("values")).cast("bigint").alias("padded_values"), F.round(F.aggregate(F.flatten("values"), F.lit(0.0), lambda a, x: a + x), 4).alias("checksum"))


@query(f"{BATCHES} SELECT batch::BIGINT AS batch, count(*) AS n_episodes, min(episode_id) AS first, max(episode_id) AS last FROM r GROUP BY batch")
def batch_assign(spark, sf_dir):
    own = steps(spark, sf_dir).groupBy("episode_id").agg(F.count("*").alias("n_steps"))
    return serve.batches(own, 32).groupBy("batch").agg(F.count("*").alias("n_episodes"), F.min("episode_id").alias("first"), F.max("episode_id").alias("last"))


@query("SELECT vec_id, len(embedding) + 2 AS width, round(embedding[1]::DOUBLE, 6) AS first, label::DOUBLE AS last FROM embeddings")
def obs_concat(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    obs = F.create_map(F.lit("a_vec"), F.col("embedding").cast("array<double>"), F.lit("b_label"), F.array(F.lit(0.5), F.col("label").cast("double")))
    out = own.select("vec_id", serve.concat_observations(obs, F.array(F.lit("a_vec"), F.lit("b_label"))).alias("o"))
    return out.select("vec_id", F.size("o").cast("bigint").alias("width"), r6(F.get("o", F.lit(0))).alias("first"), F.element_at("o", -1).alias("last"))


@query("SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS bytes_so_far FROM conversations")
def conversation_steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.sum(F.octet_length("text")).over(w).alias("bytes_so_far"))


# --- provenance


def two_snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_id"), "o_orderdate")
    cut = lambda a, b: o.where(f"o_orderdate >= timestamp_ntz'{a}' and o_orderdate < timestamp_ntz'{b}'")
    return cut("1996-01-01", "1998-01-01"), cut("1997-01-01", "1999-01-01")


def _diff_sql(a: str, b: str) -> str:
    one = "SELECT o_orderkey AS episode_id FROM orders WHERE o_orderdate >= TIMESTAMP '{}' AND o_orderdate < TIMESTAMP '{}'"
    parts = {"a": one.format("1996-01-01", "1998-01-01"), "b": one.format("1997-01-01", "1999-01-01")}
    return f"{parts[a]} EXCEPT {parts[b]}"


@query(_diff_sql("b", "a"))
def snapshot_diff_added(spark, sf_dir):
    return lineage.added_removed(*two_snapshots(spark, sf_dir)).where("change = 'added'").select("episode_id")


@query(_diff_sql("a", "b"))
def snapshot_diff_removed(spark, sf_dir):
    return lineage.added_removed(*two_snapshots(spark, sf_dir)).where("change = 'removed'").select("episode_id")


HALVES = "x AS (SELECT o_custkey AS metric, round(sum(o_totalprice), 2) AS a FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), y AS (SELECT o_custkey AS metric, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE round(sum(o_totalprice), 2) END AS b FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)"


@query(f"WITH {HALVES} SELECT coalesce(x.metric, y.metric) AS metric, round(b - a, 2) AS delta FROM x FULL JOIN y ON x.metric = y.metric")
def metric_deltas(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    own = lambda odd: o.where(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_custkey").alias("metric")).agg(F.round(F.sum("o_totalprice"), 2).cast("string").alias("value"))
    b = own(1).withColumn("value", F.when(F.col("metric") % 5 == 0, "not a number").otherwise(F.col("value")))
    return lineage.metric_deltas(own(0), b).select("metric", F.round("delta", 2).alias("delta"))


SETTINGS = "x AS (SELECT o_custkey AS key, max(o_orderpriority) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), y AS (SELECT o_custkey AS key, max(o_orderpriority) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)"


@query(f"""WITH {SETTINGS} SELECT coalesce(x.key, y.key) AS key, x.v AS old, y.v AS new, CASE WHEN x.key IS NULL THEN 'added' WHEN y.key IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM x FULL JOIN y ON x.key = y.key WHERE x.key IS NULL OR y.key IS NULL OR x.v IS DISTINCT FROM y.v""")
def config_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    own = lambda odd: o.where(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("value"))
    return lineage.config_changes(own(0), own(1))


def experiments(spark, sf_dir) -> DataFrame:
    """orders as experiments: a tenth of the customers is a project, the order before is the parent; in chains that start anew at every 150th."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("experiment_id"), (F.col("o_custkey") % 10).alias("project"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("k"))
    w = Window.partitionBy("project").orderBy("created_at", "k")
    o = o.withColumns({"n": F.row_number().over(w) - 1, "before": F.lag("experiment_id").over(w)})
    return o.withColumn("parent_id", F.when(F.col("n") % 150 != 0, F.col("before")))


EXPERIMENTS = """o AS (SELECT CAST(o_orderkey AS VARCHAR) AS experiment_id, o_custkey % 10 AS project, o_orderdate AS created_at, o_orderkey AS k FROM orders),
  x AS (SELECT *, row_number() OVER w - 1 AS n, lag(experiment_id) OVER w AS before FROM o WINDOW w AS (PARTITION BY project ORDER BY created_at, k)),
  ex AS (SELECT *, CASE WHEN n % 150 <> 0 THEN before END AS parent_id FROM x)"""


@query(f"WITH {EXPERIMENTS} SELECT experiment_id, project, parent_id FROM ex")
def experiment_parent(spark, sf_dir):
    return experiments(spark, sf_dir).select("experiment_id", "project", "parent_id")


@query(f"WITH {EXPERIMENTS} SELECT project, arg_max(experiment_id, (created_at, experiment_id)) AS experiment_id FROM ex GROUP BY project")
def latest_by_name(spark, sf_dir):
    return lineage.latest(experiments(spark, sf_dir), "project").select("project", "experiment_id")


@query(f"""WITH RECURSIVE {EXPERIMENTS}, leaf AS (SELECT arg_max(experiment_id, (created_at, experiment_id)) AS id FROM ex GROUP BY project),
  chain AS (SELECT e.experiment_id AS leaf, e.experiment_id, e.parent_id, 0 AS depth FROM ex e JOIN leaf ON e.experiment_id = leaf.id
    UNION ALL SELECT c.leaf, e.experiment_id, e.parent_id, c.depth + 1 FROM chain c JOIN ex e ON e.experiment_id = c.parent_id)
  SELECT leaf, experiment_id, depth FROM chain""")
def lineage_chain(spark, sf_dir):
    own = experiments(spark, sf_dir).select("experiment_id", "project", "created_at", "parent_id")
    leaves = lineage.latest(own, "project")
    return lineage.ancestors(own, leaves.select("experiment_id"))
