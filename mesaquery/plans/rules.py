"""Rules, skills and routing: follow verdicts, exact tests, suspension, competencies, answer routes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import stats
from ..session import table, tool_calls, with_
from .registry import query
from .retrieval import TOK

C = with_("calls")
_CHOOSE = "(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1))"


@query("binomial_test", f"{C}, g AS (SELECT actor, count(*) AS n, count(*) FILTER (WHERE tool = 'click') AS k FROM calls GROUP BY actor), t AS (SELECT actor, n, k, unnest(range(0, n + 1)) AS i FROM g), l AS (SELECT actor, n, k, i, {_CHOOSE} + i * ln(0.3::DOUBLE) + (n - i) * ln(0.7::DOUBLE) AS lp FROM t), o AS (SELECT actor, lp AS obs FROM l WHERE i = k) SELECT actor, any_value(n) AS n, any_value(k) AS k, round(least(1, sum(exp(lp)) FILTER (WHERE lp <= obs + 0.0000001::DOUBLE)), 6) AS p FROM l JOIN o USING (actor) GROUP BY actor")
def binomial_test(spark, d):
    """Exact two-sided binomial p of each actor's share of clicks against 0.3."""
    g = tool_calls(spark, d).groupBy("actor").agg(F.count("*").alias("n"), F.count_if(F.col("tool") == "click").alias("k"))
    return g.select("actor", "n", "k", F.round(stats.binomial_p(F.col("k"), F.col("n"), 0.3), 6).alias("p"))


@query("rule_effectiveness", f"""{C}, g AS (SELECT actor AS rule, count(*) AS surfaces, count(*) FILTER (WHERE tool = 'view') AS followed, count(*) FILTER (WHERE tool = 'click') AS ignored, count(*) FILTER (WHERE tool = 'error') AS not_applicable, count(*) FILTER (WHERE tool NOT IN ('view', 'click', 'error')) AS unjudged FROM calls GROUP BY actor),
e AS (SELECT rule, followed + ignored AS n, followed AS k FROM g WHERE followed + ignored >= 5), t AS (SELECT *, unnest(range(0, n + 1)) AS i FROM e), l AS (SELECT rule, n, k, i, {_CHOOSE} + n * ln(0.5::DOUBLE) AS lp FROM t), o AS (SELECT rule, lp AS obs FROM l WHERE i = k), p AS (SELECT rule, least(1, sum(exp(lp)) FILTER (WHERE lp <= obs + 0.0000001::DOUBLE)) AS p FROM l JOIN o USING (rule) GROUP BY rule),
r AS (SELECT rule, round(p, 9) AS p, row_number() OVER (ORDER BY round(p, 9), rule) AS rk, count(*) OVER () AS m FROM p), q AS (SELECT rule, p, least(1, min(p * m / rk) OVER (ORDER BY p DESC, rule DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT g.*, round(q.p, 6) AS p_value, round(q.q, 6) AS q_value, CASE WHEN q.q IS NULL THEN 'insufficient' WHEN q.q < 0.05 AND followed > ignored THEN 'useful' WHEN q.q < 0.05 AND followed < ignored THEN 'harmful' ELSE 'unverified' END AS verdict FROM g LEFT JOIN q USING (rule)""")
def rule_effectiveness(spark, d):
    """How often each rule was followed, the exact test of that, its adjusted value and the verdict."""
    t = F.col("tool")
    g = tool_calls(spark, d).groupBy(F.col("actor").alias("rule")).agg(
        F.count("*").alias("surfaces"), F.count_if(t == "view").alias("followed"), F.count_if(t == "click").alias("ignored"), F.count_if(t == "error").alias("not_applicable"), F.count_if(~t.isin("view", "click", "error")).alias("unjudged")
    )
    n = F.col("followed") + F.col("ignored")
    tested = g.where(n >= 5).select("rule", F.round(stats.binomial_p(F.col("followed"), n), 9).alias("p"))
    q = stats.benjamini_hochberg(tested, "p", "rule")
    verdict = F.when(F.col("q").isNull(), "insufficient").when((F.col("q") < 0.05) & (F.col("followed") > F.col("ignored")), "useful").when((F.col("q") < 0.05) & (F.col("followed") < F.col("ignored")), "harmful").otherwise("unverified")
    return g.join(q, "rule", "left").select(*g.columns, F.round("p", 6).alias("p_value"), F.round("q", 6).alias("q_value"), verdict.alias("verdict"))


_W = "(k::DOUBLE / n + 1.9208 / n) / (1 + 3.8416 / n) + 1.96::DOUBLE * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + 3.8416::DOUBLE / (4.0 * n * n)) / (1 + 3.8416::DOUBLE / n)"


@query("rule_suspension", f"{C}, g AS (SELECT actor AS rule, count(*) AS n, count(*) FILTER (WHERE tool = 'click') AS k FROM calls GROUP BY actor) SELECT rule, n, k, n >= 10 AND CASE WHEN k = n THEN 1 ELSE least(1, {_W}) END < 0.35 AS suspended FROM g")
def rule_suspension(spark, d):
    """Rules with enough ratings whose upper Wilson bound stays under the bar."""
    g = tool_calls(spark, d).groupBy(F.col("actor").alias("rule")).agg(F.count("*").alias("n"), F.count_if(F.col("tool") == "click").alias("k"))
    return g.select("rule", "n", "k", ((F.col("n") >= 10) & (S.wilson(F.col("k"), F.col("n"))[1] < 0.35)).alias("suspended"))


ACTION = "the file was checked and its license is in the work that was used"


@query("follow_verdict", rf"""WITH r AS (SELECT item_id, list_distinct({TOK.format('text')}) AS t FROM benchmark), n AS (SELECT count(*) AS n FROM r), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(t) AS term FROM r) GROUP BY 1), a AS (SELECT list_distinct({TOK.format(repr(ACTION))}) AS a),
o AS (SELECT item_id, unnest(list_intersect(t, a)) AS term FROM r, a), c AS (SELECT item_id, count(*) AS overlap, count(*) FILTER (WHERE df <= 1 OR df::DOUBLE / n <= 0.25) AS distinctive FROM o JOIN df USING (term), n GROUP BY 1)
SELECT r.item_id, coalesce(overlap, 0) AS overlap, coalesce(distinctive, 0) AS distinctive, CASE WHEN list_contains(t, 'gpl') AND list_contains(a, 'gpl') THEN 'ignored' WHEN overlap >= 3 AND distinctive >= 2 THEN 'followed' WHEN overlap IS NULL THEN 'not_applicable' ELSE 'unknown' END AS verdict FROM r LEFT JOIN c USING (item_id), a""")
def follow_verdict(spark, d):
    """Whether an action followed each rule: a forbidden word is a breach; three shared words, two of them rare among the rules, are a sign that it did."""
    r = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    n = r.agg(F.count("*").alias("n"))  # one row
    a = sorted(set(ACTION.split()))
    shared = r.select("item_id", F.explode(F.array_intersect("t", F.array(*map(F.lit, a)))).alias("term"))
    df = r.select(F.explode("t").alias("term")).where(F.col("term").isin(a)).groupBy("term").agg(F.count("*").alias("df"))
    rare = (F.col("df") <= 1) | (F.col("df") / F.col("n") <= 0.25)
    c = shared.join(df, "term").join(F.broadcast(n)).groupBy("item_id").agg(F.count("*").alias("overlap"), F.count_if(rare).alias("distinctive"))
    breach = F.array_contains("t", "gpl") & F.lit("gpl" in a)
    verdict = F.when(breach, "ignored").when((F.col("overlap") >= 3) & (F.col("distinctive") >= 2), "followed").when(F.col("overlap").isNull(), "not_applicable").otherwise("unknown")
    return r.join(c, "item_id", "left").select("item_id", F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce("distinctive", F.lit(0)).alias("distinctive"), verdict.alias("verdict"))


_DELTA = "CASE tool WHEN 'purchase' THEN 0.02::DOUBLE WHEN 'signup' THEN 0.01 WHEN 'view' THEN 0.005 WHEN 'error' THEN -0.01 ELSE 0 END"


@query("competency_update", f"""WITH RECURSIVE {C.removeprefix('WITH ')}, o AS (SELECT actor, tool, {_DELTA} AS dl, row_number() OVER (PARTITION BY actor ORDER BY ts, id) AS i FROM calls),
f AS (SELECT actor, i, round(least(1, greatest(0, 0.5::DOUBLE + dl)), 4) AS level FROM o WHERE i = 1 UNION ALL SELECT o.actor, o.i, round(least(1, greatest(0, f.level + o.dl)), 4) FROM f JOIN o ON o.actor = f.actor AND o.i = f.i + 1)
SELECT actor, arg_max(level, i) AS level, max(i) AS based_on FROM f GROUP BY actor""")
def competency_update(spark, d):
    """A level for each actor, moved by every outcome in order and kept between 0 and 1.

    Moves with a floor and a ceiling are composable: a run of them is one move
    with its own floor and ceiling. Each task folds its part of an actor's log, so
    a hot actor is folded in slices of a day.
    """
    t = F.col("tool")
    delta = F.when(t == "purchase", 0.02).when(t == "signup", 0.01).when(t == "view", 0.005).when(t == "error", -0.01).otherwise(0.0)
    c = tool_calls(spark, d).select("actor", F.to_date("ts").alias("day"), "ts", "id", delta.alias("m"))

    def fold(rows: str, then):
        start = F.struct(F.lit(0.0).alias("move"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
        return F.aggregate(rows, start, then)

    clamp = lambda x, lo, hi: F.least(hi, F.greatest(lo, x))
    compose = lambda a, m, lo, hi: F.struct((a["move"] + m).alias("move"), clamp(a["low"] + m, lo, hi).alias("low"), clamp(a["high"] + m, lo, hi).alias("high"))
    zero, one = F.lit(0.0), F.lit(1.0)
    day = c.groupBy("actor", "day").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "m"))).alias("r"), F.count("*").alias("n"))
    day = day.select("actor", "day", "n", fold("r", lambda a, x: compose(a, x["m"], zero, one)).alias("f"))
    whole = day.groupBy("actor").agg(F.sort_array(F.collect_list(F.struct("day", "f"))).alias("r"), F.sum("n").alias("based_on"))  # a row a day
    out = fold("r", lambda a, x: compose(a, x["f"]["move"], x["f"]["low"], x["f"]["high"]))
    return whole.select("actor", F.round(clamp(0.5 + out["move"], out["low"], out["high"]), 4).alias("level"), "based_on")


@query("competency_assess", f"{C}, k AS (SELECT tool, k % 4 AS concept, avg(CASE WHEN ok THEN 0.8::DOUBLE ELSE 0.3 END) AS level, least(1, count(*) / 200.0::DOUBLE) AS confidence FROM calls GROUP BY 1, 2) SELECT concept, round(avg(level), 3) AS level, round(avg(confidence), 6) AS confidence, CASE WHEN avg(level) > 0.8 THEN 'Strong' WHEN avg(level) > 0.5 THEN 'Moderate' ELSE 'Weak' END AS note FROM k GROUP BY concept")
def competency_assess(spark, d):
    """Mean level and confidence over the concepts that a task needs."""
    k = tool_calls(spark, d).groupBy("tool", (F.col("k") % 4).alias("concept")).agg(F.avg(F.when(F.col("ok"), 0.8).otherwise(0.3)).alias("l"), F.least(F.lit(1.0), F.count("*") / 200.0).alias("c"))
    lv = F.avg("l")
    return k.groupBy("concept").agg(F.round(lv, 3).alias("level"), F.round(F.avg("c"), 6).alias("confidence"), F.when(lv > 0.8, "Strong").when(lv > 0.5, "Moderate").otherwise("Weak").alias("note"))


@query("idk_routing", "SELECT event_id, CASE WHEN a AND c >= 0.7 THEN 'answer' WHEN p AND c >= 0.4 THEN 'caveat' WHEN i < 4 AND c >= 0.2 AND (c < 0.4 OR (a AND c < 0.7)) THEN 'search_more' ELSE 'idk' END AS action FROM (SELECT event_id, event_id % 2 = 0 AS a, event_id % 3 = 0 AS p, event_id % 6 AS i, least(1, greatest(0, value / 100)) AS c FROM events)")
def idk_routing(spark, d):
    """Answer, answer with a caveat, search on, or say that it isn't known: by sufficiency, confidence and rounds left."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 2 == 0).alias("a"), (F.col("event_id") % 3 == 0).alias("p"), (F.col("event_id") % 6).alias("i"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)).alias("c"))
    return e.select("event_id", S.route(F.col("a"), F.col("p"), F.col("c"), F.col("i")).alias("action"))


@query("answer_routing", r"SELECT item_id, CASE WHEN n >= 60 THEN 'multi_hop' WHEN regexp_matches(lower(text), '[0-9]') THEN 'temporal' WHEN regexp_matches(lower(text), '\b(license|licen[cs]ed|copyright)\b') THEN 'lookup' ELSE 'semantic' END AS strategy, CASE WHEN n >= 60 THEN 0.75::DOUBLE WHEN regexp_matches(lower(text), '[0-9]') THEN 0.6 ELSE 0.5 END AS threshold FROM (SELECT item_id, text, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n FROM benchmark)")
def answer_routing(spark, d):
    """A retrieval strategy and its confidence threshold by the class of a question."""
    low, n = F.lower("text"), F.size(T.tokens(F.col("text")))
    long_, dated, named = n >= 60, low.rlike("[0-9]"), low.rlike(r"\b(license|licen[cs]ed|copyright)\b")
    strategy = F.when(long_, "multi_hop").when(dated, "temporal").when(named, "lookup").otherwise("semantic")
    return table(spark, d, "benchmark").select("item_id", strategy.alias("strategy"), F.when(long_, 0.75).when(dated, 0.6).otherwise(0.5).alias("threshold"))


@query("answerability", rf"WITH q AS (SELECT conv_id, list_distinct({TOK.format('text')}) AS q FROM conversations WHERE turn = 0), e AS (SELECT conv_id, {TOK.format('text')} AS t FROM conversations WHERE turn > 0), w AS (SELECT conv_id, list_distinct(flatten(list(t))) AS e FROM e GROUP BY conv_id), c AS (SELECT q.conv_id, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, e))::DOUBLE / len(q) END AS c FROM q JOIN w USING (conv_id)) SELECT conv_id, round(c, 6) AS confidence, c >= 0.6 AS answerable, c >= 0.25 AND c < 0.6 AS partial FROM c")
def answerability(spark, d):
    """How much of a question's words the evidence covers, and what that allows."""
    c = table(spark, d, "conversations")
    q = c.where("turn = 0").select("conv_id", F.array_distinct(T.tokens(F.col("text"))).alias("q"))
    # covered words are joined, so no conversation's words are gathered
    words = c.where("turn > 0").select("conv_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w")).distinct()
    has = c.where("turn > 0").select("conv_id").distinct()
    hit = q.select("conv_id", F.explode("q").alias("w")).join(words, ["conv_id", "w"], "left_semi").groupBy("conv_id").agg(F.count("*").alias("k"))
    j = q.join(has, "conv_id", "left_semi").join(hit, "conv_id", "left")
    share = F.when(F.size("q") == 0, 0.0).otherwise(F.coalesce("k", F.lit(0)) / F.size("q"))
    return j.select("conv_id", F.round(share, 6).alias("confidence"), (share >= 0.6).alias("answerable"), ((share >= 0.25) & (share < 0.6)).alias("partial"))


@query("platt_apply", f"{C} SELECT id, round(1 / (1 + exp(-(0.8::DOUBLE * duration_ms / 100 - 0.25))), 6) AS probability FROM calls")
def platt_apply(spark, d):
    """Scores as calibrated probabilities."""
    return tool_calls(spark, d).select("id", F.round(S.platt(F.col("duration_ms") / 100, 0.8, -0.25), 6).alias("probability"))


@query("expertise_profile", f"{C}, w AS (SELECT actor, tool, ts FROM calls WHERE ts >= TIMESTAMP '2024-01-15'), g AS (SELECT actor, tool, count(*) AS n FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY n DESC, actor) AS rn FROM g) SELECT tool, actor, n FROM r WHERE rn <= 10")
def expertise_profile(spark, d):
    """Who did most of each kind in a trailing window."""
    g = tool_calls(spark, d).where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).groupBy("tool", "actor").agg(F.count("*").alias("n"))
    return g.withColumn("rn", F.row_number().over(W.partitionBy("tool").orderBy(F.desc("n"), "actor"))).where("rn <= 10").select("tool", "actor", "n")


@query("context_prediction", f"{C}, g AS (SELECT actor, dayofweek(ts) AS weekday, count(*) AS n FROM calls GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY weekday ORDER BY n DESC, actor) AS place FROM g) SELECT weekday, actor, n, place FROM r WHERE place <= 5")
def context_prediction(spark, d):
    """What is likely to be worked on, by the weekday's past activity."""
    g = tool_calls(spark, d).groupBy((F.dayofweek("ts") - 1).cast("long").alias("weekday"), "actor").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("weekday").orderBy(F.desc("n"), "actor")).cast("long")).where("place <= 5")


@query("entity_registry", "SELECT 'project' AS kind, source AS name, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT * FROM (SELECT 'name', p_name, count(*) FROM part GROUP BY p_name ORDER BY 3 DESC, 2 LIMIT 30)")
def entity_registry(spark, d):
    """Projects and the thirty most frequent names."""
    p = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")).select(F.lit("project").alias("kind"), "name", "n")
    n = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(30)
    return p.unionByName(n.select(F.lit("name").alias("kind"), "name", "n"))


@query("weekly_digest", f"{C}, w AS (SELECT * FROM calls WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15') SELECT 'actor' AS section, actor::VARCHAR AS name, count(*) AS n FROM w GROUP BY actor UNION ALL SELECT 'outcome', CASE WHEN ok THEN 'ok' ELSE 'failed' END, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'concept', k::VARCHAR, count(*) FROM w GROUP BY k")
def weekly_digest(spark, d):
    """A week by project, outcome and concept, in one pass over the log."""
    w = tool_calls(spark, d).where((F.col("ts") >= F.lit("2024-01-08").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp")))
    rows = F.array(*(F.struct(F.lit(s).alias("section"), c.alias("name")) for s, c in (("actor", F.col("actor").cast("string")), ("outcome", F.when(F.col("ok"), "ok").otherwise("failed")), ("concept", F.col("k").cast("string")))))
    return w.select(F.explode(rows).alias("x")).groupBy("x.section", "x.name").agg(F.count("*").alias("n"))


@query("outcome_histogram", f"{C} SELECT tool, CASE WHEN NOT ok THEN 'failure' WHEN duration_ms > 100 THEN 'breakthrough' WHEN duration_ms > 20 THEN 'discovery' ELSE 'routine' END AS outcome, count(*) AS n FROM calls GROUP BY 1, 2")
def outcome_histogram(spark, d):
    """Episodes by outcome."""
    o = F.when(~F.col("ok"), "failure").when(F.col("duration_ms") > 100, "breakthrough").when(F.col("duration_ms") > 20, "discovery").otherwise("routine")
    return tool_calls(spark, d).groupBy("tool", o.alias("outcome")).agg(F.count("*").alias("n"))


@query("analogy_counts", rf"WITH t AS (SELECT doc_id, source, list_distinct({TOK.format('text')}) AS s FROM documents), q AS (SELECT s, source FROM t WHERE doc_id = 1), a AS (SELECT t.source, t.doc_id, len(list_intersect(t.s, q.s))::DOUBLE / len(list_distinct(list_concat(t.s, q.s))) AS j FROM t, q WHERE t.source <> q.source AND len(t.s) > 0) SELECT source, count(*) AS analogies, round(max(j), 6) AS best FROM a WHERE j >= 0.1 GROUP BY source")
def analogy_counts(spark, d):
    """How many lessons of each other project resemble one record, and how closely."""
    k = table(spark, d, "documents").select("doc_id", "source", F.array_distinct(T.tokens(F.col("text"))).alias("s"))
    q = F.broadcast(k.where("doc_id = 1").select(F.col("s").alias("qs"), F.col("source").alias("qp")))  # one record
    a = k.join(q, k["source"] != F.col("qp")).withColumn("j", T.jaccard(F.col("s"), F.col("qs"))).where("j >= 0.1")
    return a.groupBy("source").agg(F.count("*").alias("analogies"), F.round(F.max("j"), 6).alias("best"))
