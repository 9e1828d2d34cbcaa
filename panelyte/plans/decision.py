"""Decisions fed by everything that the library derives: structure, frames, heat, flows, news, reports, chains, style."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.operators import factors as FA
from panelyte.operators import flows as FL
from panelyte.operators import fundamentals as FU
from panelyte.operators import groups as G
from panelyte.operators import points
from panelyte.operators import regime as RG
from panelyte.operators import reports as RP
from panelyte.operators import signals as SG
from panelyte.operators import swing, swing_state
from panelyte.operators.asof import asof
from panelyte.operators.timeframes import aligned_trends
from panelyte.plans.kernels import rounded
from panelyte.plans.registry import query
from panelyte.plans.signals import SEGMENTS
from panelyte.sources.panels import bars, market, reports, table
from panelyte.sources.store import stored


def lines_by_nation(spark, sf_dir) -> DataFrame:
    """Lines with the supplier's nation, the part's type and the day."""
    nation = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("entity"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("concept"))
    lines = table(spark, sf_dir, "lineitem").join(nation, "l_suppkey").join(part, "l_partkey")
    return lines.select("entity", "concept", F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"), (F.col("l_returnflag") == "R").alias("back"))


def structured(rows: DataFrame) -> DataFrame:
    """rows (entity, date, ord, open to volume, ema20, macd_hist) with structure, its points, agreeing levels and stops."""
    p = swing_state.known_structure(swing.window_points(rows))
    return points.stop_prices(points.agreeing_levels(points.second_points(points.fractal_quality(points.first_points(p)))))


def panel_of(spark, sf_dir) -> DataFrame:
    """Weekly bars of nations with ord and the one-row return, stored."""
    c = F.col
    return stored(bars(spark, sf_dir, "nation").withColumn("ord", F.row_number().over(W.by_entity())).withColumn("ret", c("close") / W.lag(c("close")) - 1), "weekly")


def with_structure(weekly: DataFrame) -> DataFrame:
    """weekly with factors, flows, divergences and structure; ret is a tenth of the weekly return, as a day's."""
    c = F.col
    p = FA.with_volatility(FA.prepare(weekly.drop("ret").withColumn("turnover", c("volume") / 100)))
    p = FL.divergences(FA.exponential(FL.news_proxy(FL.capital_flow(p))))
    before = W.lag(c("ma20"), 5)
    p = p.withColumn("ma5", W.sma(c("close"), 5)).withColumn("slope5", F.when(before > 0, (c("ma20") - before) / (before + FA.EPS)))
    p = p.withColumn("volume_ratio_raw", c("vr")).withColumn("trend_initiation", FA.initiation_family(p)["trend_initiation"]).withColumn("ret", c("r") / 10)
    p = structured(p)
    spread = F.abs(c("ema20") - c("ema60")) / (c("close") + FA.EPS)
    order = F.when(c("ema20") > c("ema60"), 0.35).otherwise(-0.35) + F.when(c("ema60") > c("ema120"), 0.35).otherwise(-0.35)
    order = order + F.when((c("ema20") > c("ema60")) & (c("ema60") > c("ema120")), 0.3).when((c("ema20") < c("ema60")) & (c("ema60") < c("ema120")), -0.3).otherwise(0.0)
    p = p.withColumn("mean_order", order).withColumn("zhongyin", F.when((c("ord") > 20) & (spread < 0.02) & (F.abs("mean_order") < 0.3), 1.0).otherwise(0.0))
    p = p.withColumn("pivot_present", F.when(c("pivots") > 0, (c("pivot_position") == 0).cast("double")).otherwise(0.0)).withColumn("divergence_strength", c("area_divergence"))
    return p.withColumn("bottom_fractal_vol_spike", F.coalesce(c("volume") / (W.lag(c("volume")) + FA.EPS), F.lit(1.0)))


def inputs(spark, sf_dir) -> DataFrame:
    """A weekly row for each nation with every input of the decision, each as known on its date."""
    c, weekly, lines = F.col, panel_of(spark, sf_dir), lines_by_nation(spark, sf_dir)
    p = with_structure(weekly.drop("grp"))

    frames = aligned_trends(bars(spark, sf_dir, "nation", "day").select("entity", "date", "open", "high", "low", "close")).select("entity", "date", "week_up", "month_up", "alignment")
    p = asof(p, frames.withColumnRenamed("date", "framed"), "entity", "date", "framed", ["week_up", "month_up", "alignment"])
    p = p.withColumnsRenamed({"week_up": "weekly_trend_up", "month_up": "monthly_trend_up", "alignment": "mtf_alignment_score"})

    members = stored(lines.select("entity", "concept").distinct(), "members")
    moved = weekly.filter("ret is not null")
    regions = weekly.select("grp").distinct().withColumn("seg_ord", F.dense_rank().over(Window.orderBy("grp")))  # five regions
    chain = moved.join(F.broadcast(regions), "grp").select(F.lit("chain").alias("chain"), "seg_ord", c("grp").alias("segment"), c("entity").alias("concept"), "date", "ret")
    leads = moved.select("entity", c("grp").alias("segment")).distinct().join(G.conduction(chain).select("segment", "date", "bonus"), "segment").select("entity", "date", "bonus")
    heat = G.concept_heat(G.concept_returns(moved, members), members, leads).withColumnRenamed("heat", "concept_heat")
    p = p.join(heat, ["entity", "date"], "left")

    daily = weekly.groupBy("date").agg((F.sum(c("amount") * F.signum("ret")) / 1e6).alias("net_flow"), (F.avg("ret") * 100).alias("lead_change"), F.sum("amount").alias("balance")).withColumn("index_change", c("lead_change") / 2)
    flows = FL.margin_flow(FL.market_flow(daily).withColumnRenamed("signal", "market_flow")).withColumnRenamed("signal", "margin_flow")
    p = p.join(flows.select("date", "market_flow", "margin_flow"), "date", "left")
    days = lines.groupBy("entity", "date").agg(F.sum(F.when(~c("back"), c("qty")).otherwise(0)).cast("double").alias("bought"), F.sum(F.when(c("back"), c("qty")).otherwise(0)).cast("double").alias("sold"))
    p = FL.listed_flow(p, days)

    known = stored(reports(spark, sf_dir), "reports")
    p = FU.as_of(p, known)
    p = p.withColumn("fundamental_score", FU.factors(p)["fund_score"]).withColumn("has_fundamental", c("period").isNotNull())
    segments = spark.createDataFrame(SEGMENTS, "chain string, segment string, concept string, barrier string, margin string, tech string")
    latest = known.groupBy("entity").agg((F.max_by("roe", "period") / 100).alias("roe"), (F.max_by("gross_margin", "period") / 100).alias("gross_margin"))
    p = p.join(FL.chain_quality(members, segments, latest).select("entity", c("quality").alias("bom_score")), "entity", "left")

    first, last = (weekly.filter(c("grp") == g).groupBy(F.lit(g).alias("entity"), "date").agg(F.avg("close").alias("close")).withColumn("aux", c("close") / W.lag(c("close")) - 1) for g in ("AFRICA", "ASIA"))
    style = RG.style(RG.ladder(market(weekly)), first, last).select("date", "style_regime", "style_confidence")
    return p.join(style, "date", "left")


def decided_rows(p: DataFrame) -> DataFrame:
    """inputs with gates, score, thresholds, agreeing systems, confidence and decisions."""
    c = F.col
    p = SG.defaults(p)
    p = p.select(*[F.coalesce(k, F.lit(SG.NEUTRAL[k])).alias(k) if k in SG.NEUTRAL else k for k in p.columns])
    graded = SG.gates()
    p = p.select("*", *[g.alias(k) for k, g in graded.items()])
    p = p.withColumn("quality", SG.gate_quality([c(k) for k in graded])).withColumn("rejected", SG.hard_reject(c("ret")) & (c("ord") > 1))
    p = stored(p.withColumn("score", SG.assembled_score(F.tanh(c("mom_20") - c("volatility_20")))), "scored")
    buy, sell = SG.moving_thresholds(c("score"))
    buys, sells = SG.resonance(c("score"))
    p = p.withColumn("buy_threshold", buy).withColumn("sell_threshold", sell).withColumn("buy_systems", buys).withColumn("sell_systems", sells).withColumn("confidence", SG.confidence(c("quality")))
    return SG.decide(p)


@query(None)
def full_decision(spark, sf_dir):
    """The decision on every weekly row of a nation, with what it rests on."""
    p = decided_rows(inputs(spark, sf_dir))
    return rounded(p.select(
        "entity", "date", "buy_point", "sell_point", "signal_level", "trend_type", "gate_structure", "gate_frames", "gate_heat", "gate_trend", "quality", "rejected", "score", "buy_threshold", "sell_threshold",
        "buy_systems", "sell_systems", "tag", "confidence", "buy", "sell", "stop_price", "stop_reason",
    ), 5)


def diagnosed(spark, sf_dir) -> DataFrame:
    """Weekly rows of nations with the columns of a diagnosis, all from known structure, and composite."""
    c, recent = F.col, W.by_entity().rowsBetween(-4, 0)
    p = with_structure(panel_of(spark, sf_dir)).filter("ord > 60")
    p = p.select(
        "entity", "grp", "date", "ord", "close", "trend_type", "buy_point", "sell_point", "buy_confidence", "sell_confidence", "buy_strength", "sell_strength", "confirmed_buy", "confirmed_sell", "signal_level", "pivot_position", "pivot_zg", "stroke_direction",
        (c("ret") * 100).alias("change"), c("vr").alias("volume_ratio"), c("mean_order").alias("alignment"), F.coalesce("second_buy_confidence", F.lit(0.0)).alias("second_buy"), (c("top_divergence") > 0.3).alias("top_divergence"), (c("bottom_divergence") > 0.3).alias("bottom_divergence"),
        F.coalesce("depleted", F.lit(False)).alias("depleted"), F.count_if(c("sell_point") == 3).over(recent).alias("breakdowns"), c("s3_conf").isNotNull().alias("pivot_breakdown"), "bottom_quality",
    )
    return p.withColumn("composite", RP.composite())


@query(None)
def structure_diagnosis(spark, sf_dir):
    """Composite score, opportunity grade and risk class from known structure."""
    p = diagnosed(spark, sf_dir)
    return rounded(p.select("entity", "date", "trend_type", "buy_point", "sell_point", "signal_level", "composite", RP.grade(F.col("composite")).alias("grade"), RP.risk().alias("risk")))


@query(None)
def structure_main_lines(spark, sf_dir):
    """Main-line table of each date's regions from known structure."""
    return rounded(RP.main_lines(diagnosed(spark, sf_dir)))


@query(None)
def structure_attribution(spark, sf_dir):
    """Pattern behind each surge (a move of more than 5 % as a day's), from the structure known on the row before."""
    c = F.col
    p = diagnosed(spark, sf_dir)
    quiet = F.sum((F.abs("change") < 2).cast("int")).over(W.by_entity().rowsBetween(-20, -1))
    p = p.select(
        "*", F.when(c("close") > c("pivot_zg"), (c("close") / c("pivot_zg") - 1) * 100).alias("above_pct"), c("volume_ratio").alias("vol_spike"), W.lag(c("bottom_divergence")).alias("pre_divergence"), W.lag(c("trend_type")).alias("pre_trend"),
        W.lag(c("pivot_position")).alias("pre_position"), W.lag(c("buy_point")).alias("pre_buy_point"), W.lag(c("alignment")).alias("pre_alignment"), W.lag(c("stroke_direction")).alias("pre_direction"), quiet.alias("pre_quiet"),
    )
    hit = p.filter("change > 5").withColumn("found", RP.limit_type())
    return rounded(hit.select("entity", "date", "change", "found.type", "found.confidence"))
