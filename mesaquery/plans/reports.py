"""Aggregates, reports and statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import stats, temporal
from ..session import graph_edges, knowledge, table, tool_calls, with_
from .registry import query

K, C, E = with_("knowledge"), with_("calls"), with_("edges")
AS_OF = "2024-02-01"


@query("store_stats", f"""{K}, a AS (SELECT count(*) AS total, count(DISTINCT project) AS projects, count(DISTINCT type) AS types, count(*) FILTER (WHERE date_diff('day', created_at, TIMESTAMP '{AS_OF}') > 15) AS stale FROM knowledge)
SELECT total, projects, types, stale, round(greatest(0, 1 - stale::DOUBLE / total * 0.5), 2) AS health FROM a""")
def store_stats(spark, d):
    """Counts, stale records and the health score, in one pass."""
    k = knowledge(spark, d)
    stale = F.datediff(F.lit(AS_OF).cast("date"), F.col("created_at")) > 15
    a = k.agg(F.count("*").alias("total"), F.countDistinct("project").alias("projects"), F.countDistinct("type").alias("types"), F.count_if(stale).alias("stale"))
    return a.withColumn("health", F.round(F.greatest(F.lit(0.0), 1 - F.col("stale") / F.col("total") * 0.5), 2))


@query("counts_by_dimension", f"{K} SELECT 'project' AS dimension, project AS value, count(*) AS n FROM knowledge GROUP BY project UNION ALL SELECT 'type', type, count(*) FROM knowledge GROUP BY type")
def counts_by_dimension(spark, d):
    """Records by project and by type, as one table."""
    k = knowledge(spark, d)
    one = lambda c: k.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("dimension"), "value", "n")
    return one("project").unionByName(one("type"))


@query("error_frequency", f"{C} SELECT tool, k % 5 AS severity, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS unresolved FROM calls GROUP BY 1, 2")
def error_frequency(spark, d):
    """Conditional sums by two keys."""
    return tool_calls(spark, d).groupBy("tool", (F.col("k") % 5).alias("severity")).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("unresolved"))


@query("repeating_patterns", f"{C} SELECT actor, count(*) AS n, min(id) AS first_id, max(id) AS last_id, min(ts) AS first_seen, max(ts) AS last_seen FROM calls WHERE NOT ok GROUP BY actor HAVING count(*) >= 3")
def repeating_patterns(spark, d):
    """Actors with three errors or more."""
    e = tool_calls(spark, d).where(~F.col("ok"))
    g = e.groupBy("actor").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min("ts").cast("timestamp_ntz").alias("first_seen"), F.max("ts").cast("timestamp_ntz").alias("last_seen"))
    return g.where("n >= 3")


@query("weekly_trend", f"""{C}, w AS (SELECT tool, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 604800) AS BIGINT) AS week FROM calls), p AS (SELECT tool, count(*) FILTER (WHERE week = 0) AS w0, count(*) FILTER (WHERE week = 1) AS w1, count(*) FILTER (WHERE week = 2) AS w2, count(*) FILTER (WHERE week = 3) AS w3 FROM w GROUP BY tool)
SELECT *, CASE WHEN w0 + w1 < w2 + w3 THEN 'improving' WHEN w0 + w1 > w2 + w3 THEN 'degrading' ELSE 'steady' END AS trend FROM p""")
def weekly_trend(spark, d):
    """Four trailing weeks and their direction."""
    week = F.floor((F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_micros("ts") / 1_000_000) / 604800)
    p = tool_calls(spark, d).groupBy("tool").agg(*(F.count_if(week == i).alias(f"w{i}") for i in range(4)))
    now, then = F.col("w0") + F.col("w1"), F.col("w2") + F.col("w3")
    return p.withColumn("trend", F.when(now < then, "improving").when(now > then, "degrading").otherwise("steady"))


@query("queue_status", f"{C} SELECT s.tool AS status, coalesce(n, 0) AS n FROM (VALUES ('click'), ('view'), ('error'), ('waiting')) s(tool) LEFT JOIN (SELECT tool, count(*) AS n FROM calls GROUP BY tool) c ON c.tool = s.tool")
def queue_status(spark, d):
    """A status histogram over a fixed domain, zeros included."""
    dom = spark.sql("SELECT * FROM VALUES ('click'), ('view'), ('error'), ('waiting') AS s(tool)")
    n = tool_calls(spark, d).groupBy("tool").agg(F.count("*").alias("n"))
    return dom.join(n, "tool", "left").select(F.col("tool").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


@query("coverage_ratio", "SELECT round(count(DISTINCT l.doc_id)::DOUBLE / count(DISTINCT d.doc_id), 6) AS coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def coverage_ratio(spark, d):
    """Share of records that are covered."""
    lab = table(spark, d, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    j = table(spark, d, "documents").select("doc_id").distinct().join(lab, "doc_id", "left")
    return j.agg(F.round(F.count("has") / F.count("*"), 6).alias("coverage"))


@query("graph_stats", f"{E} SELECT substr(src, 1, 1) || substr(dst, 1, 1) AS relation, count(*) AS n, round(avg(weight), 6) AS mean_weight, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY 1")
def graph_stats(spark, d):
    """Edges, mean weight and ends by relation."""
    e = graph_edges(spark, d).withColumn("relation", F.concat(F.substring("src", 1, 1), F.substring("dst", 1, 1)))
    return e.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("edge_weight_bands", f"{E} SELECT count(*) FILTER (WHERE weight <= 1) AS weak, count(*) FILTER (WHERE weight = 2) AS medium, count(*) FILTER (WHERE weight = 3) AS strong, count(*) FILTER (WHERE weight > 3) AS very_strong FROM edges")
def edge_weight_bands(spark, d):
    """Edges by bands of weight, in one pass."""
    w = F.col("weight")
    return graph_edges(spark, d).agg(F.count_if(w <= 1).alias("weak"), F.count_if(w == 2).alias("medium"), F.count_if(w == 3).alias("strong"), F.count_if(w > 3).alias("very_strong"))


@query("cross_project_terms", f"""{K}, t AS (SELECT DISTINCT project, id, term FROM (SELECT project, id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM knowledge))
SELECT term, count(DISTINCT project) AS projects, count(DISTINCT id) AS records FROM t GROUP BY term HAVING count(DISTINCT project) >= 18""")
def cross_project_terms(spark, d):
    """Terms of many projects. Distinct (term, project) rows first, so no term's records are gathered."""
    from ..functions.text import tokens

    t = knowledge(spark, d).select("project", "id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("term"))
    per = t.groupBy("term", "project").agg(F.count("*").alias("r"))
    return per.groupBy("term").agg(F.count("*").alias("projects"), F.sum("r").alias("records")).where("projects >= 18")


@query("tool_latency_report", f"""{C}, r AS (SELECT tool, duration_ms, ok, row_number() OVER (PARTITION BY tool ORDER BY duration_ms) AS rn, count(*) OVER (PARTITION BY tool) AS n FROM calls)
SELECT tool, max(n) AS n, min(duration_ms) FILTER (WHERE rn >= ceil(0.5::DOUBLE * n)) AS p50, min(duration_ms) FILTER (WHERE rn >= ceil(0.95::DOUBLE * n)) AS p95, round(avg(CASE WHEN ok THEN 0 ELSE 1 END), 6) AS error_rate FROM r GROUP BY tool""")
def tool_latency_report(spark, d):
    """Nearest-rank percentiles and error rate by tool: a histogram finds the bins, only these are ranked."""
    c = tool_calls(spark, d)
    rate = c.groupBy("tool").agg(F.round(F.avg(F.when(F.col("ok"), 0).otherwise(1)), 6).alias("error_rate"))
    return stats.percentiles(c, "tool", "duration_ms", {"p50": 0.5, "p95": 0.95}).join(rate, "tool")


@query("latency_interp", f"{C} SELECT tool, round(quantile_cont(duration_ms, 0.9), 6) AS p90 FROM calls GROUP BY tool")
def latency_interp(spark, d):
    """Interpolated percentile: between the two nearest ranks, each found by histogram."""
    c = tool_calls(spark, d)
    n = c.where("duration_ms IS NOT NULL").groupBy("tool").agg(F.count("*").alias("_n"))
    # the ranks below and above (n - 1) * p, as shares that the nearest rank maps back to them
    at = (F.col("_n") - 1) * 0.9
    return stats.interpolated(c, n, "tool", "duration_ms", at).select("tool", F.round("value", 6).alias("p90"))


@query("latency_histogram", f"{C} SELECT tool, le, count(*) FILTER (WHERE duration_ms <= le) AS n FROM calls, (VALUES (1.0::DOUBLE), (5.0), (10.0), (50.0), (100.0), (500.0)) b(le) GROUP BY tool, le")
def latency_histogram(spark, d):
    """Cumulative buckets: each call is counted once, in one pass, for all bounds."""
    bounds = (1.0, 5.0, 10.0, 50.0, 100.0, 500.0)
    g = tool_calls(spark, d).groupBy("tool").agg(*(F.count_if(F.col("duration_ms") <= b).alias(str(i)) for i, b in enumerate(bounds)))
    return g.select("tool", F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"`{i}`").alias("n")) for i, b in enumerate(bounds)))).alias("x")).select("tool", "x.le", "x.n")


@query("phrase_counts", f"{K} SELECT count(*) FILTER (WHERE contains(lower(content), 'license')) AS license, count(*) FILTER (WHERE contains(lower(content), 'the')) AS the, count(*) FILTER (WHERE regexp_matches(content, '[0-9]')) AS digits FROM knowledge")
def phrase_counts(spark, d):
    """Document frequencies of several phrases in one scan."""
    low = F.lower("content")
    return knowledge(spark, d).agg(F.count_if(F.contains(low, F.lit("license"))).alias("license"), F.count_if(F.contains(low, F.lit("the"))).alias("the"), F.count_if(F.col("content").rlike("[0-9]")).alias("digits"))


@query("workflow_stats", f"""{C}, g AS (SELECT actor, count(*) AS runs, count(*) FILTER (WHERE ok) AS good, round(avg(duration_ms), 6) AS mean_ms FROM calls GROUP BY actor)
SELECT actor, runs, good, mean_ms, CASE WHEN runs >= 10 AND good::DOUBLE / runs >= 0.8 THEN 'mastered' ELSE 'learning' END AS level FROM g""")
def workflow_stats(spark, d):
    """Runs, successes, mean duration and promotion."""
    g = tool_calls(spark, d).groupBy("actor").agg(F.count("*").alias("runs"), F.count_if("ok").alias("good"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))
    return g.withColumn("level", F.when((F.col("runs") >= 10) & (F.col("good") / F.col("runs") >= 0.8), "mastered").otherwise("learning"))


@query("period_change", f"{C}, p AS (SELECT tool, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22') AS now_n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15') AS before_n FROM calls GROUP BY tool) SELECT tool, now_n, before_n, CASE WHEN before_n > 0 THEN round((now_n - before_n)::DOUBLE / before_n, 6) END AS change FROM p")
def period_change(spark, d):
    """This week against the last."""
    inside = lambda a, b: (F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp"))
    g = tool_calls(spark, d).groupBy("tool").agg(F.count_if(inside("2024-01-15", "2024-01-22")).alias("now_n"), F.count_if(inside("2024-01-08", "2024-01-15")).alias("before_n"))
    return g.withColumn("change", F.round(S.percent_change(F.col("now_n"), F.col("before_n")), 6))


@query("daily_activity", f"{C} SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS errors, count(DISTINCT actor) AS actors FROM calls GROUP BY 1")
def daily_activity(spark, d):
    """Calls, errors and actors by day."""
    return tool_calls(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"), F.countDistinct("actor").alias("actors"))


@query("daily_series", f"{C}, g AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day) SELECT t.tool, g.day, count(c.id) AS n FROM (SELECT DISTINCT tool FROM calls) t CROSS JOIN g LEFT JOIN calls c ON c.tool = t.tool AND c.ts::DATE = g.day GROUP BY 1, 2")
def daily_series(spark, d):
    """Calls by tool and day, zeros included."""
    return temporal.daily_series(tool_calls(spark, d), "ts", "tool", "2024-01-01", "2024-01-31")


@query("contributor_pivot", f"{C} SELECT actor, count(*) FILTER (WHERE tool = 'click') AS click, count(*) FILTER (WHERE tool = 'error') AS error, count(*) FILTER (WHERE tool = 'purchase') AS purchase, count(*) FILTER (WHERE tool = 'signup') AS signup, count(*) FILTER (WHERE tool = 'view') AS \"view\" FROM calls GROUP BY actor")
def contributor_pivot(spark, d):
    """Calls by actor, a column a kind."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    return tool_calls(spark, d).groupBy("actor").pivot("tool", kinds).count().na.fill(0, kinds)


@query("calibration_ece", f"""{C}, b AS (SELECT least(9, floor(duration_ms / 50)) AS bin, duration_ms / 500 AS p, CASE WHEN ok THEN 1.0 ELSE 0.0 END AS y FROM calls), g AS (SELECT bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM b GROUP BY bin)
SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM g""")
def calibration_ece(spark, d):
    """Expected calibration error over ten equal bins."""
    y = F.when(F.col("ok"), 1.0).otherwise(0.0)
    g = tool_calls(spark, d).groupBy(F.least(F.lit(9), F.floor(F.col("duration_ms") / 50)).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("duration_ms") / 500).alias("p"), F.avg(y).alias("y"))
    return g.agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"))


_WILSON = "(k::DOUBLE / n + 1.9208 / n) / (1 + 3.8416 / n)"
_HALF = "1.96::DOUBLE * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + 3.8416::DOUBLE / (4.0 * n * n)) / (1 + 3.8416::DOUBLE / n)"


@query("wilson_report", f"{C}, g AS (SELECT actor, count(*) AS n, count(*) FILTER (WHERE ok) AS k FROM calls GROUP BY actor) SELECT actor, n, k, round(greatest(0, {_WILSON} - {_HALF}), 6) AS low, round(least(1, {_WILSON} + {_HALF}), 6) AS high FROM g")
def wilson_report(spark, d):
    """Success rates with their Wilson bounds."""
    g = tool_calls(spark, d).groupBy("actor").agg(F.count("*").alias("n"), F.count_if("ok").alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return g.select("actor", "n", "k", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


@query("bh_adjust", f"""{C}, g AS (SELECT actor, 1 - count(*) FILTER (WHERE ok)::DOUBLE / count(*) AS p FROM calls GROUP BY actor), r AS (SELECT *, rank() OVER (ORDER BY p, actor) AS rk, count(*) OVER () AS m FROM g)
SELECT actor, round(p, 6) AS p, round(least(1, min(p * m / rk) OVER (ORDER BY p DESC, actor DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_adjust(spark, d):
    """Benjamini-Hochberg step-up over one p value a rule; rules are few (a row each reaches the window)."""
    g = tool_calls(spark, d).groupBy("actor").agg((1 - F.count_if("ok") / F.count("*")).alias("p"))
    r = g.withColumn("rk", F.rank().over(W.orderBy("p", "actor"))).withColumn("m", F.count("*").over(W.partitionBy(F.lit(1))))
    q = F.min(F.col("p") * F.col("m") / F.col("rk")).over(W.orderBy(F.desc("p"), F.desc("actor")).rowsBetween(W.unboundedPreceding, 0))
    return r.select("actor", F.round("p", 6).alias("p"), F.round(F.least(F.lit(1.0), q), 6).alias("q"))


@query("laplace_predict", f"{C} SELECT tool, k % 10 AS step, round((count(*) FILTER (WHERE duration_ms < 20) + 1)::DOUBLE / (count(*) + 2), 6) AS predicted, round(least(0.95, count(*)::DOUBLE / (count(*) + 5)), 6) AS confidence FROM calls GROUP BY 1, 2")
def laplace_predict(spark, d):
    """Smoothed success rate and how far to trust it."""
    g = tool_calls(spark, d).groupBy("tool", (F.col("k") % 10).alias("step")).agg(F.count("*").alias("n"), F.count_if(F.col("duration_ms") < 20).alias("s"))
    return g.select("tool", "step", F.round(S.laplace(F.col("s"), F.col("n")), 6).alias("predicted"), F.round(S.trust(F.col("n")), 6).alias("confidence"))


@query("knowledge_gaps", f"{K} SELECT project, type, count(*) AS n FROM knowledge GROUP BY 1, 2 HAVING count(*) < 4")
def knowledge_gaps(spark, d):
    """Project and type pairs with few records."""
    return knowledge(spark, d).groupBy("project", "type").agg(F.count("*").alias("n")).where("n < 4")


@query("idle_projects", f"{K} SELECT project, count(*) AS n, max(created_at) AS last_at FROM knowledge GROUP BY project HAVING count(*) >= 10 AND max(created_at) < TIMESTAMP '2024-02-11 10:00:00'")
def idle_projects(spark, d):
    """Projects with enough records and no recent one."""
    g = knowledge(spark, d).groupBy("project").agg(F.count("*").alias("n"), F.max("created_at").cast("timestamp_ntz").alias("last_at"))
    return g.where("n >= 10 AND last_at < TIMESTAMP_NTZ '2024-02-11 10:00:00'")


@query("author_activity", f"{C} SELECT actor, count(*) FILTER (WHERE tool = 'purchase') AS saves, count(*) FILTER (WHERE tool = 'click') AS changes, max(ts) AS last_seen FROM calls GROUP BY actor")
def author_activity(spark, d):
    """Saves, changes and last sight of every actor."""
    t = F.col("tool")
    return tool_calls(spark, d).groupBy("actor").agg(F.count_if(t == "purchase").alias("saves"), F.count_if(t == "click").alias("changes"), F.max("ts").cast("timestamp_ntz").alias("last_seen"))


@query("mass_shares", f"{C}, g AS (SELECT tool, sum(duration_ms) AS s FROM calls GROUP BY tool) SELECT tool, round(s / sum(s) OVER () * 0.9, 6) AS mass FROM g")
def mass_shares(spark, d):
    """A ranked list as a mass function: score shares, a tenth left to the unknown."""
    g = tool_calls(spark, d).groupBy("tool").agg(F.sum("duration_ms").alias("s"))
    return g.select("tool", F.round(F.col("s") / F.sum("s").over(W.partitionBy(F.lit(1))) * 0.9, 6).alias("mass"))


@query("evidence_combination", f"""WITH RECURSIVE {C.removeprefix('WITH ')}, g AS (SELECT actor, tool, count(*) FILTER (WHERE ok)::DOUBLE / (count(*) + 1) AS a, count(*) FILTER (WHERE NOT ok)::DOUBLE / (count(*) + 1) AS b, row_number() OVER (PARTITION BY actor ORDER BY tool) AS i FROM calls GROUP BY 1, 2),
f AS (SELECT actor, i, a, b FROM g WHERE i = 1 UNION ALL SELECT g.actor, g.i, (f.a * g.a + f.a * (1 - g.a - g.b) + (1 - f.a - f.b) * g.a) / (1 - f.a * g.b - f.b * g.a), (f.b * g.b + f.b * (1 - g.a - g.b) + (1 - f.a - f.b) * g.b) / (1 - f.a * g.b - f.b * g.a) FROM f JOIN g ON g.actor = f.actor AND g.i = f.i + 1)
SELECT actor, round(arg_max(a, i), 6) AS ok_mass, round(arg_max(b, i), 6) AS failed_mass FROM f GROUP BY actor""")
def evidence_combination(spark, d):
    """Dempster's rule over each actor's tools, as a fold of two-hypothesis masses (ok, failed, unknown).

    Masses are folded per tool, a bounded number a group.
    """
    g = tool_calls(spark, d).groupBy("actor", "tool").agg((F.count_if("ok") / (F.count("*") + 1)).alias("a"), (F.count_if(~F.col("ok")) / (F.count("*") + 1)).alias("b"))
    masses = g.groupBy("actor").agg(F.array_sort(F.collect_list(F.struct("tool", "a", "b"))).alias("m"))

    def step(s, x):
        u, v = 1 - s["a"] - s["b"], 1 - x["a"] - x["b"]
        k = 1 - s["a"] * x["b"] - s["b"] * x["a"]
        return F.struct(((s["a"] * x["a"] + s["a"] * v + u * x["a"]) / k).alias("a"), ((s["b"] * x["b"] + s["b"] * v + u * x["b"]) / k).alias("b"))

    out = F.aggregate("m", F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), step)
    return masses.select("actor", out.alias("o")).select("actor", F.round("o.a", 6).alias("ok_mass"), F.round("o.b", 6).alias("failed_mass"))


@query("eval_metrics", f"""{C}, r AS (SELECT actor AS q, id, row_number() OVER (PARTITION BY actor ORDER BY duration_ms DESC, id) AS rk, tool = 'purchase' AS rel FROM calls),
m AS (SELECT q, min(rk) FILTER (WHERE rel) AS first_rank, sum(CASE WHEN rel AND rk <= 10 THEN 1 / log2(rk + 1) ELSE 0 END) AS dcg, least(10, count(*) FILTER (WHERE rel)) AS g FROM r GROUP BY q),
i AS (SELECT q, first_rank, dcg, coalesce(list_sum(list_transform(range(1, g + 1), lambda x: 1 / log2(x + 1))), 0) AS idcg FROM m)
SELECT round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS r1, round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS r5, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg10 FROM i""")
def eval_metrics(spark, d):
    """Recall at k, mean reciprocal rank and NDCG over ranked lists."""
    from ..operators.metrics import ranking_metrics

    c = tool_calls(spark, d)
    rk = F.row_number().over(W.partitionBy("actor").orderBy(F.desc("duration_ms"), "id"))
    return ranking_metrics(c.select(F.col("actor").alias("q"), rk.alias("rank"), (F.col("tool") == "purchase").alias("relevant")), "q")
