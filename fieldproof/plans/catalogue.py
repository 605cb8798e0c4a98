"""Queries over the driver's tables, one or more per operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import FIELDS, GATE, GENESIS, REQUIRED_FIELDS
from ..functions import geometry as G
from ..functions import text as T
from ..operators import analysis, audit, compare, costs, digest, fairness, generator, metrics, review, scoring, training
from ..operators.generator import GENDERS, GROUPS
from ..operators.parse import json_text, with_parsed
from ..sources import line_index
from ..sources.working import once_json
from ..streaming.review import windowed
from . import claims
from .claims import DOCUMENTS_SQL, facts, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str, from_claims: bool = False) -> Callable[[Query], Query]:
    """Register a query under its function's name; from_claims: its SQL starts from the scored claim rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = (f"with {DOCUMENTS_SQL} " if from_claims else "") + sql
        return f

    return add


# -- scoring and metrics --------------------------------------------------------------------------------------------
@query("""select f.field, sum(correct::int)::double / count(correct::int) as accuracy, sum(case when gold_present then (correct and citation_ok)::int end)::double / count(case when gold_present then (correct and citation_ok)::int end) as grounded_accuracy,
  count(*) filter (where gold_present) as n_present from scored f group by f.field""", from_claims=True)
def field_accuracy_by_field(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.per_field(facts(spark, sf), digits=None).select("field", "accuracy", "grounded_accuracy", "n_present")


@query("""select sum(correct::int)::double / count(correct::int) as field_accuracy, sum(case when gold_present then (correct and citation_ok)::int end)::double / count(case when gold_present then (correct and citation_ok)::int end) as grounded_accuracy,
  sum(case when pred_present then evidence_supported::int end)::double / count(case when pred_present then evidence_supported::int end) as evidence_supported_rate, sum(case when not gold_present then pred_present::int end)::double / count(case when not gold_present then pred_present::int end) as hallucination_rate,
  sum(case when gold_present then (not pred_present)::int end)::double / count(case when gold_present then (not pred_present)::int end) as miss_rate from scored""", from_claims=True)
def summary_populations(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.field_summary(facts(spark, sf))


@query(" union all ".join(f"""select '{c}' as slice, case when {c}::varchar = 'true' then 'True' when {c}::varchar = 'false' then 'False' else coalesce({c}::varchar, 'None') end as value,
  count(*) as n_fields, sum(correct::int)::double / count(correct::int) as field_accuracy from scored group by {c}""" for c in metrics.SLICES), from_claims=True)
def slice_accuracy_sets(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.slices(facts(spark, sf), digits=None)


@query("select error_type, count(*) as n from scored where not correct group by 1", from_claims=True)
def error_type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.error_types(facts(spark, sf)).select("error_type", "n")


@query("""select error_type, sum(case error_type when 'correct' then 100 when 'correct_null' then 100 when 'missed' then -50 else -100 end)::bigint as cost_cents, count(*) as n
  from scored group by error_type""", from_claims=True)
def cost_by_error_type(spark: SparkSession, sf: str) -> DataFrame:
    from ..constants import DEFAULT_COSTS

    prices = F.create_map(*[F.lit(x) for k, v in DEFAULT_COSTS.items() for x in (k, int(v * 100))])
    rows = facts(spark, sf).withColumn("cost", F.element_at(prices, scoring.outcome(F.col("error_type"))))
    return rows.groupBy("error_type").agg(F.sum("cost").cast("bigint").alias("cost_cents"), F.count("*").alias("n"))


# -- fairness -------------------------------------------------------------------------------------------------------
@query("""select 'group' as key, "group" as value, sum(case when field != 'claimant_name' then correct::int end)::double / count(case when field != 'claimant_name' then correct::int end) as other_fields_accuracy,
  sum(case when field = 'claimant_name' then correct::int end)::double / count(case when field = 'claimant_name' then correct::int end) as name_accuracy, count(distinct doc_id) as n_docs from scored group by "group\"""", from_claims=True)
def group_parity(spark: SparkSession, sf: str) -> DataFrame:
    return fairness.parity(claims.rows_for_one(spark, sf), "group", digits=None)


@query("""select 'gender' as key, max(o) - min(o) as other_fields_accuracy_gap, max(n) - min(n) as name_accuracy_gap from (
  select gender, sum(case when field != 'claimant_name' then correct::int end)::double / count(case when field != 'claimant_name' then correct::int end) as o, sum(case when field = 'claimant_name' then correct::int end)::double / count(case when field = 'claimant_name' then correct::int end) as n from scored group by gender)""", from_claims=True)
def parity_gap(spark: SparkSession, sf: str) -> DataFrame:
    return fairness.gaps(fairness.parity(facts(spark, sf), "gender", digits=None), digits=None)


# -- error analysis -------------------------------------------------------------------------------------------------
@query("""select case when grouping(field) = 1 then 'All' else field end as field, case when grouping(error_type) = 1 then 'All' else error_type end as error_type, count(*) as n
  from scored group by cube (field, error_type)""", from_claims=True)
def crosstab_cube(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.crosstab(facts(spark, sf), "field", "error_type")


@query("select error_type, count(*) as n, count(*) / (select count(*) from scored where not correct)::double as share from scored where not correct group by 1", from_claims=True)
def error_share(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.error_shares(facts(spark, sf))


@query("select least(floor(iou * 20), 19)::int as bin, count(*) as n from scored group by 1", from_claims=True)
def iou_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.histogram(facts(spark, sf), "iou")


@query("select field, accuracy from (select field, sum(correct::int)::double / count(correct::int) as accuracy from scored group by field) order by accuracy, field limit 1", from_claims=True)
def weakest_field(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.field_accuracy(facts(spark, sf)).agg(F.min_by("field", F.struct("accuracy", "field")).alias("field"), F.min("accuracy").alias("accuracy"))


@query("""select line_of_business as value, errors from (select line_of_business, count(*) filter (where not correct) as errors, count(*) as n from scored group by 1)
  order by errors / n::double desc, line_of_business limit 1""", from_claims=True)
def top_slice(spark: SparkSession, sf: str) -> DataFrame:
    rows = analysis.concentration(facts(spark, sf), "line_of_business")
    return rows.orderBy(F.desc(F.col("errors") / F.col("fields")), "value").limit(1).select("value", "errors")


# -- geometry -------------------------------------------------------------------------------------------------------
_BOXES = """select l_orderkey, l_linenumber, (l_partkey % 50)::double as x0, (l_suppkey % 40)::double as y0, (l_partkey % 50 + 10 + l_quantity)::double as x1, (l_suppkey % 40 + 20)::double as y1 from lineitem"""


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    x0, y0 = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array(x0, y0, x0 + 10 + F.col("l_quantity"), y0 + 20).alias("box"))



@query(f"""with b as ({_BOXES}), p as (select a.l_orderkey, a.l_linenumber,
    greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) as i, (a.x1 - a.x0) * (a.y1 - a.y0) as s, (c.x1 - c.x0) * (c.y1 - c.y0) as t
    from b a join b c on a.l_orderkey = c.l_orderkey and a.l_linenumber + 1 = c.l_linenumber)
  select l_orderkey, l_linenumber, (i / (s + t - i))::double as iou, (i / s)::double as covered from p""")
def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = _boxes(spark, sf)
    after = b.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("box").alias("other"))
    return b.join(after, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", G.iou(F.col("box"), F.col("other")).alias("iou"), G.covered(F.col("box"), F.col("other")).alias("covered"))


@query(f"""with b as ({_BOXES}) select l_orderkey, count(*) as n_inside, min(l_linenumber) as first_line from b
  where greatest(0, least(x1, 40.0) - greatest(x0, 0.0)) * greatest(0, least(y1, 40.0) - greatest(y0, 0.0)) / ((x1 - x0) * (y1 - y0)) >= 0.5 group by l_orderkey""")
def text_in_box(spark: SparkSession, sf: str) -> DataFrame:
    layout = _boxes(spark, sf).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("box").alias("bbox"), "l_linenumber")).alias("layout"))
    cited = layout.withColumn("cited", G.text_in_box(F.col("layout"), F.array(*map(F.lit, (0.0, 0.0, 40.0, 40.0)))))
    return cited.where(F.size("cited") > 0).select("l_orderkey", F.size("cited").cast("bigint").alias("n_inside"), F.array_min(F.transform("cited", lambda s: s["l_linenumber"])).alias("first_line"))


@query(f"""with b as ({_BOXES}), r as (select *, radians((l_linenumber - 3)::double) as t, l_linenumber - 3 as deg from b),
  c as (select l_orderkey, l_linenumber, deg, x0, y0, x1, y1,
    490.0 + (x0 - 490) * cos(t) + (y0 - 630) * sin(t) as a, 490.0 + (x0 - 490) * cos(t) + (y1 - 630) * sin(t) as b, 490.0 + (x1 - 490) * cos(t) + (y0 - 630) * sin(t) as c, 490.0 + (x1 - 490) * cos(t) + (y1 - 630) * sin(t) as d,
    630.0 - (x0 - 490) * sin(t) + (y0 - 630) * cos(t) as e, 630.0 - (x0 - 490) * sin(t) + (y1 - 630) * cos(t) as f, 630.0 - (x1 - 490) * sin(t) + (y0 - 630) * cos(t) as g, 630.0 - (x1 - 490) * sin(t) + (y1 - 630) * cos(t) as h from r)
  select l_orderkey, l_linenumber, round(case when deg = 0 then x0 else greatest(0, least(a, b, c, d)) end, 3)::double as rx0, round(case when deg = 0 then y0 else greatest(0, least(e, f, g, h)) end, 3)::double as ry0,
    round(case when deg = 0 then x1 else least(980, greatest(a, b, c, d)) end, 3)::double as rx1, round(case when deg = 0 then y1 else least(1260, greatest(e, f, g, h)) end, 3)::double as ry1 from c""")
def rotate_bbox(spark: SparkSession, sf: str) -> DataFrame:
    turned = _boxes(spark, sf).withColumn("r", G.rotated(F.col("box"), (F.col("l_linenumber") - 3).cast("double")))
    return turned.select("l_orderkey", "l_linenumber", *[F.round(F.col("r")[i], 3).alias(n) for i, n in enumerate(("rx0", "ry0", "rx1", "ry1"))])


# -- normal forms ---------------------------------------------------------------------------------------------------
@query("""select event_id, trim(props) as body from events""")
def fenced_json_extract(spark: SparkSession, sf: str) -> DataFrame:
    fenced = F.concat(F.lit("answer ["), F.lit("```"), F.lit("\n "), F.col("props"), F.lit(" \n```]"))
    return table(spark, sf, "events").select("event_id", json_text(fenced).alias("body"))


# -- joins and sets -------------------------------------------------------------------------------------------------
@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def missing_labels_anti(spark: SparkSession, sf: str) -> DataFrame:
    return audit.remaining(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"))


# -- comparison, gate, cost -----------------------------------------------------------------------------------------
_RUNS = """m as (select source as run_id, cast(substr(source, 4) as int) as run_order, sum(quality)::double / count(quality) as field_accuracy, sum(toxic)::double / count(toxic) as hallucination_rate
  from documents d join labels l on d.doc_id = l.doc_id group by source),
  v as (select run_id, run_order, 'field_accuracy' as metric, field_accuracy as value from m union all select run_id, run_order, 'hallucination_rate', hallucination_rate from m)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    made = joined.groupBy(F.col("source").alias("run_id")).agg(F.avg("quality").alias("field_accuracy"), F.avg("toxic").alias("hallucination_rate"))
    return made.withColumn("run_order", F.expr("cast(substring(run_id, 4) as int)"))


@query(f"""with {_RUNS}, b as (select metric, arg_min(value, run_order) as base, min(run_order) as f from v group by metric)
  select run_id, v.metric, value, base, case when run_order != f and abs(value - base) > 1e-9 then value - base end as delta,
    case when run_order != f and abs(value - base) > 1e-9 then (value > base) = (v.metric = 'field_accuracy') end as better from v join b on v.metric = b.metric""")
def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    long = compare.long_metrics(_runs(spark, sf), ["field_accuracy", "hallucination_rate"], ("run_id", "run_order"))
    return compare.against_base(long).drop("run_order")


@query(f"""with {_RUNS} select run_id, metric, value, value = case when metric = 'hallucination_rate' then min(value) over (partition by metric) else max(value) over (partition by metric) end as best from v""")
def best_per_metric(spark: SparkSession, sf: str) -> DataFrame:
    long = compare.long_metrics(_runs(spark, sf), ["field_accuracy", "hallucination_rate"])
    return compare.best_per_metric(long, ["hallucination_rate"])


_GATE = """m as (select case when d.doc_id % 2 = 0 then 'new' else 'old' end as model, case when lang = 'en' then 'test' else 'holdout' end as split, '1.1' as evaluator_version,
  sum(quality)::double / count(quality) as field_accuracy, sum(1 - toxic)::double / count(1 - toxic) as grounded_accuracy, sum(toxic)::double / count(toxic) as hallucination_rate from documents d join labels l on d.doc_id = l.doc_id group by 1, 2),
  spec as (select * from (values """ + ", ".join(f"('{s}', '{m}', {str(h).lower()}, {x}::double)" for s, m, h, x in GATE) + """) t(split, metric, higher, slack)),
  v as (select model, split, 'field_accuracy' as metric, field_accuracy as value from m union all select model, split, 'grounded_accuracy', grounded_accuracy from m union all select model, split, 'hallucination_rate', hallucination_rate from m),
  g as (select s.split, s.metric, c.value as candidate, p.value as production, case when p.value is null then true when higher then c.value >= p.value - slack else c.value <= p.value + slack end as passed
  from spec s join v c on c.split = s.split and c.metric = s.metric and c.model = 'new' left join v p on p.split = s.split and p.metric = s.metric and p.model = 'old')"""


def _gate(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    made = joined.groupBy(F.when(F.col("doc_id") % 2 == 0, "new").otherwise("old").alias("model"), F.when(F.col("lang") == "en", "test").otherwise("holdout").alias("split")).agg(
        F.avg("quality").alias("field_accuracy"), F.avg(1 - F.col("toxic")).alias("grounded_accuracy"), F.avg("toxic").alias("hallucination_rate"))
    models = spark.createDataFrame([("new", False), ("old", False)], "model string, quick_test boolean")
    return compare.gate_rows(made.withColumn("evaluator_version", F.lit("1.1")), models, "new", "old")


@query(f"with {_GATE} select split, metric, candidate, production, case when passed then 'pass' else 'FAIL' end as result from g")
def gate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _gate(spark, sf).select("split", "metric", "candidate", "production", "result")


@query(f"with {_GATE} select bool_and(passed) as ok, count(*) filter (where not passed) as failed from g")
def gate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return compare.verdict(_gate(spark, sf))


# -- windows, ranks, chains -----------------------------------------------------------------------------------------
@query("""select event_type, count(*) as n, list_sort(list(value))[count(*) // 2 + 1] as p50, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95)::bigint) + 1] as p95
  from events where value is not null group by event_type""")
def latency_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, sf, "events"), "value", ("event_type",))


@query("""select user_id, event_id, avg(value) over (partition by user_id order by event_id rows between 9 preceding and current row) as value_rolling from events""")
def rolling_mean_10(spark: SparkSession, sf: str) -> DataFrame:
    return training.rolling(table(spark, sf, "events"), "value", 10, "event_id", ("user_id",)).select("user_id", "event_id", "value_rolling")


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as a, row_number() over (partition by user_id order by event_id desc) as z from events)
  select user_id, sum(case when a <= 10 then event_id end)::bigint / count(case when a <= 10 then 1 end)::double as first, sum(case when z <= 10 then event_id end)::bigint / count(case when z <= 10 then 1 end)::double as last from r group by user_id""")
def first_last_window(spark: SparkSession, sf: str) -> DataFrame:
    return training.first_and_last(table(spark, sf, "events"), ("event_id",), 10, "event_id", ("user_id",)).drop("metric")


# -- generation and training sets -----------------------------------------------------------------------------------
@query("select p_partkey, substr(sha256('7|' || cast(p_partkey as varchar)), 1, 12) as seed_hex from part")
def stable_seed(spark: SparkSession, sf: str) -> DataFrame:
    seed = T.stable_seed(F.lit("7"), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.lower(F.lpad(F.hex(seed), 12, "0")).alias("seed_hex"))


@query("""with d as (select doc_id, source = 'src0' as poor from documents), n as (select count(*) filter (where poor) as p, count(*) filter (where not poor) as o from d)
  select p as poor, o as other, greatest(0, ceil(0.35 * o / 0.65)::bigint - p) as extra from n""")
def oversample_poor(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("source") == "src0", "poor").otherwise("clean").alias("quality"))
    made = training.oversampled(rows, 0.35)
    copy = F.col("doc_id").contains("#dup")
    return made.agg(F.count_if((F.col("quality") == "poor") & ~copy).alias("poor"), F.count_if(F.col("quality") != "poor").alias("other"), F.count_if(copy).alias("extra"))


# -- the parser and the scorer over raw outputs ---------------------------------------------------------------------
_SCORED = ("doc_id", *claims._META, "json_valid", "schema_valid", "parse_error", "field_pos", "field", "gold_value", "p_norm", "g_norm", "gold_present", "pred_present", "error_type", "iou", "evidence_supported", "correct", "citation_ok")


@query("select " + ", ".join(f'"{c}"' for c in _SCORED) + " from scored", from_claims=True)
def scored_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Raw texts through the parser, the scorer and the manifest's join, anew."""
    return claims.scored_rows(spark, sf).select(*_SCORED)


@query("select doc_id, any_value(json_valid) as json_valid, any_value(schema_valid) as schema_valid, any_value(parse_error) as error, count(*) filter (where pred_present) as n_given from scored group by doc_id", from_claims=True)
def parsed_outputs(spark: SparkSession, sf: str) -> DataFrame:
    given = F.size(F.filter("parsed.fields", lambda f: f.isNotNull())).cast("bigint")
    return with_parsed(claims.outputs(spark, sf)).select("doc_id", "parsed.json_valid", "parsed.schema_valid", "parsed.error", given.alias("n_given"))


_CREDIT = "case when correct then 0.5 * evidence_supported::int + 0.5 * least(1.0, iou / 0.5) else 0.0 end::double"
_DOCUMENT = f"""parts as (select doc_id, any_value(json_valid) as json_valid, any_value(schema_valid) as schema_valid, any_value(parse_error) as parse_error, avg(correct::int) as acc,
  avg(case when gold_present then (correct and citation_ok)::int end) as grounded, avg(case when gold_present then {_CREDIT} end) as credit, bool_and(correct) as all_correct from scored group by doc_id),
  documents_scored as (select doc_id, json_valid, schema_valid, parse_error, round(acc, 4)::double as field_accuracy, round(coalesce(grounded, 1), 4)::double as grounded_accuracy, all_correct,
  round(case when json_valid then 0.1 * case when schema_valid then 1.0 else 0.5 end + 0.6 * acc + 0.3 * coalesce(credit, 1) else 0 end, 4)::double as reward,
  case when json_valid then case when schema_valid then 1.0 else 0.5 end else 0.0 end::double as format_part, round(case when json_valid then acc else 0 end, 4)::double as accuracy_part,
  round(case when json_valid then coalesce(credit, 1) else 0 end, 4)::double as grounding_part from parts)"""


@query(f", {_DOCUMENT} select * from documents_scored", from_claims=True)
def document_scores(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.col(f"reward_components.{c}").alias(f"{c}_part") for c in ("format", "accuracy", "grounding")]
    return scoring.document_scores(claims.rows_for_one(spark, sf)).select("doc_id", "json_valid", "schema_valid", "parse_error", "field_accuracy", "grounded_accuracy", "all_correct", "reward", *parts)


@query(f""", {_DOCUMENT}, d as (select count(*) as n_docs, avg(json_valid::int) as json_valid_rate, avg(schema_valid::int) as schema_valid_rate, avg(all_correct::int) as doc_exact_match, avg(reward) as mean_reward from documents_scored),
  f as (select avg(correct::int) as field_accuracy, avg(case when gold_present then (correct and citation_ok)::int end) as grounded_accuracy, avg(case when pred_present then evidence_supported::int end) as evidence_supported_rate,
  avg(case when not gold_present then pred_present::int end) as hallucination_rate, avg(case when gold_present then (not pred_present)::int end) as miss_rate from scored) select d.*, f.* from d cross join f""", from_claims=True)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.summary(facts(spark, sf), claims.scored_documents(spark, sf), digits=None)


_WORTH = f"case error_type when 'correct' then 0.5 + 0.5 * {_CREDIT} when 'correct_null' then 1.0 when 'missed' then -0.5 else -1.0 end"


@query(f"""select doc_id, case when bool_and(json_valid) then round(greatest(-1.0, least(1.0, sum({_WORTH}) / 7 - case when bool_and(schema_valid) then 0.0 else 0.1 end)), 4) else -1.0 end::double as reward,
  count(*) filter (where json_valid and error_type = 'correct') as n_correct, count(*) filter (where json_valid and error_type = 'correct_null') as n_correct_null, count(*) filter (where json_valid and error_type = 'missed') as n_miss,
  count(*) filter (where json_valid and error_type in ('hallucinated', 'distractor_for_absent')) as n_hallucination,
  count(*) filter (where json_valid and error_type in ('near_miss', 'wrong_value', 'distractor_confusion', 'field_swap', 'diacritics')) as n_wrong, case when bool_and(json_valid) then 0 else 1 end as n_invalid from scored group by doc_id""", from_claims=True)
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.costed_rewards(facts(spark, sf))


_FLIPS = "flips as (select set_id, field, count(distinct coalesce(p_norm, '#none')) > 1 as flipped from scored where field != 'claimant_name' group by 1, 2)"


@query(f", {_FLIPS} select count(*) as counterfactual_sets, sum((not f)::int)::double / count(*) as counterfactual_consistency from (select set_id, bool_or(flipped) as f from flips group by 1)", from_claims=True)
def counterfactual_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return fairness.consistency(claims.rows_for_one(spark, sf), digits=None)


@query(f", {_FLIPS} select field, count(distinct set_id) as n_sets, sum(flipped::int)::double / count(*) as flip_rate from flips group by field", from_claims=True)
def flip_rate(spark: SparkSession, sf: str) -> DataFrame:
    return fairness.flip_rates(facts(spark, sf), digits=None)


@query("""select quality as value, fields, errors, fields / all_fields::double as share_of_fields, errors / all_errors::double as share_of_errors, round((errors / all_errors::double) / (fields / all_fields::double), 2) as lift, 1 - errors / fields::double as accuracy
  from (select quality, count(*) as fields, count(*) filter (where not correct) as errors from scored group by quality) cross join (select count(*) as all_fields, count(*) filter (where not correct) as all_errors from scored)""", from_claims=True)
def lift_by_slice(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.concentration(facts(spark, sf), "quality")


@query("select doc_id, field, error_type from scored where not correct and error_type != 'unparseable' order by sha256('3|' || doc_id || '|' || field), doc_id, field limit 50", from_claims=True)
def failure_sample(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.failures(claims.rows_for_one(spark, sf), 50, seed=3).select("doc_id", "field", "error_type")


@query("select doc_id, field, iou from scored where error_type = 'correct' and iou < 0.6", from_claims=True)
def right_values_cited_badly(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.right_values(claims.rows_for_one(spark, sf), most_iou=0.6).select("doc_id", "field", "iou")


_QUALITIES = ("clean", "moderate", "poor")


@query("select error_type, " + ", ".join(f"count(*) filter (where quality = '{q}') as {q}" for q in _QUALITIES) + " from scored where not correct group by error_type", from_claims=True)
def error_types_by_run(spark: SparkSession, sf: str) -> DataFrame:
    """Runs here are the rows of one scan quality each."""
    counts = metrics.error_types(facts(spark, sf).withColumn("run_id", F.col("quality")))
    return compare.error_type_table(counts, list(_QUALITIES))


_VERDICT = "case error_type " + " ".join(f"when '{k}' then '{v[0]}'" for k, v in review.VERDICTS.items()) + " end"
_TONE = "case error_type " + " ".join(f"when '{k}' then '{v[1]}'" for k, v in review.VERDICTS.items()) + " end"


@query(f"select doc_id, field, {_VERDICT} as verdict, {_TONE} as tone, case when error_type in ('correct', 'correct_null') and not citation_ok then 'warn' else {_TONE} end as box_tone from scored", from_claims=True)
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """What is shown of every field: label, tone, and the tone of its box, which warns where a right value is cited badly."""
    return review.with_verdict(facts(spark, sf)).select("doc_id", "field", "verdict", "tone", "box_tone")


_REQUIRED = ", ".join(f"'{f}'" for f in REQUIRED_FIELDS)


@query(f"""select reason, count(*) as n from (
  select doc_id, 'model output could not be parsed' as reason from docs where not json_valid union all select doc_id, 'output did not match the schema exactly' from docs where json_valid and not schema_valid
  union all select doc_id, field || ': required field not found' from scored where json_valid and not pred_present and field in ({_REQUIRED})
  union all select doc_id, field || ': value has no citation box' from scored where pred_present and box = 'none'
  union all select doc_id, field || ': value does not match its own evidence text' from scored where pred_present and gold_present and kind != 'right') group by reason""", from_claims=True)
def review_reasons(spark: SparkSession, sf: str) -> DataFrame:
    flagged = review.with_review(with_parsed(claims.outputs(spark, sf)))
    return flagged.select(F.explode("review_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f""", {_DOCUMENT} select d.doc_id, d.doc_id as split, 'look' as note, docs.g2 as gold_name, d.reward::varchar as reward, 1 as n_predictions
  from documents_scored d join docs on d.doc_id = docs.doc_id where docs.k <= 200""", from_claims=True)
def replay_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """What replays show of a hand-written list of documents; the list is the feature."""
    few, run = claims.unwritten(spark, sf).where("k <= 200"), F.lit("r").alias("run_id")
    chosen = few.select(F.col("k").cast("string").alias("doc_id"), F.lit("look").alias("note"))
    documents = scoring.document_scores(claims.scored_of(few)).select(run, "*")
    bundles = review.replay_bundle(claims.labels_of(few), with_parsed(claims.outputs_of(few).select(run, "*")), documents, chosen)
    part = lambda path: F.get_json_object("bundle", path)
    predictions = F.size(F.from_json(part("$.predictions"), "array<struct<run_id: string>>"))
    return bundles.select("doc_id", "split", part("$.note").alias("note"), part("$.gold.claimant_name.value").alias("gold_name"), part("$.predictions[0].scores.reward").cast("double").cast("string").alias("reward"), predictions.alias("n_predictions"))


@query("select d.doc_id, d.lang, l.quality from documents d left join (select doc_id, arg_max(quality, quality) as quality from labels group by doc_id) l on d.doc_id = l.doc_id")
def manifest_left_join(spark: SparkSession, sf: str) -> DataFrame:
    marks = table(spark, sf, "labels").select("doc_id", "quality", F.col("quality").alias("seq"))
    return scoring.with_meta(table(spark, sf, "documents").select("doc_id", "lang"), marks)


# -- normal forms ---------------------------------------------------------------------------------------------------
def _form(text, kind: str):
    return T.forms_of(F.array(text))[0][kind]


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso from orders")
def normalize_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates printed in four ways and read back."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    printed = F.when(k == 0, F.date_format(d, "MM/dd/yyyy")).when(k == 1, F.date_format(d, "MMMM dd, yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd MMM yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", _form(printed, "date").alias("iso"))


@query("select o_orderkey, round(o_totalprice * 100)::bigint as cents from orders")
def normalize_amounts(spark: SparkSession, sf: str) -> DataFrame:
    k, x = F.col("o_orderkey") % 4, F.col("o_totalprice").cast("decimal(18,2)")
    comma = F.format_number(x, 2)
    printed = F.when(k == 0, F.concat(F.lit("$"), comma)).when(k == 1, comma).when(k == 2, F.concat(F.lit("$"), x.cast("string"))).otherwise(F.concat(F.lit("CAD "), comma))
    return table(spark, sf, "orders").select("o_orderkey", (_form(printed, "amount").cast("decimal(18,2)") * 100).cast("bigint").alias("cents"))


@query("""select p_partkey, upper(regexp_replace(p_name || '-' || p_brand || '. ' || cast(p_partkey as varchar), '[^0-9A-Za-z]', '', 'g')) as id, lower('Été ' || p_name) as text, lower('Ete ' || p_name) as plain from part""")
def normalize_ids(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat("p_name", F.lit("-"), "p_brand", F.lit(". "), F.col("p_partkey").cast("string"))
    named = F.concat(F.lit("  ÉTÉ  "), "p_name", F.lit(".;"))
    return table(spark, sf, "part").select("p_partkey", _form(raw, "id").alias("id"), _form(named, "text").alias("text"), _form(named, "plain").alias("plain"))


@query("""select p_partkey, case when a = b then 1.0 else 1.0 - levenshtein(a, b) / greatest(length(a), length(b))::double end::double as similarity from (select p_partkey, p_name as a, case when p_partkey % 5 = 0 then p_name else p_type end as b from part)""")
def similarity_near_miss(spark: SparkSession, sf: str) -> DataFrame:
    other = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", T.similarity(F.col("p_name"), other).alias("similarity"))


# -- cost, advantages, logs -----------------------------------------------------------------------------------------
@query("""select event_type, docs, round(p50, 1) as latency_s_p50, round(each, 5) as usd_per_doc, round(each * 1000, 2) as usd_per_1000_docs, round(each * 500, 2) as batch_api_usd_per_1000_docs, round(i)::bigint as input_tokens_mean, round(o)::bigint as output_tokens_mean
  from (select event_type, count(*) as docs, median(value) / 1000 as p50, avg(event_id) as i, avg(user_id) as o, avg(event_id) / 1e6 * 1.0 + avg(user_id) / 1e6 * 5.0 as each from events group by event_type)""")
def cost_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "events").select("event_type", F.col("value").alias("latency_ms"), F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return costs.run_cost(records, ("event_type",), in_price=1.0, out_price=5.0)


@query("""select l_orderkey, l_linenumber, m as reward_mean, round(s, 6) as reward_std, case when s >= 1e-6 then round((l_quantity - m) / greatest(s, 0.1), 6) end::double as advantage from (
  select l_orderkey, l_linenumber, l_quantity, avg(l_quantity) over (partition by l_orderkey) as m, stddev_pop(l_quantity) over (partition by l_orderkey) as s from lineitem)""")
def group_advantage(spark: SparkSession, sf: str) -> DataFrame:
    rewards = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("reward"))
    return training.advantages(rewards, ("l_orderkey",)).select("l_orderkey", "l_linenumber", "reward_mean", F.round("reward_std", 6).alias("reward_std"), F.round("advantage", 6).alias("advantage"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as logs: a record per turn."""
    turns = table(spark, sf, "conversations").dropDuplicates(["conv_id", "turn"])
    record = F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "role"))
    return audit.appended(turns.select(F.col("conv_id").alias("log_id"), F.col("turn").alias("seq"), record.alias("record")))


_CHAIN = f"""t as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as n from (select conv_id, turn, any_value(role) as role from conversations group by 1, 2)),
  c as (select conv_id, n, sha256('{{"doc_id":"' || conv_id || '-' || turn || '","prev_hash":"{GENESIS}","role":"' || role || '"}}') as h from t where n = 1
  union all select t.conv_id, t.n, sha256('{{"doc_id":"' || t.conv_id || '-' || t.turn || '","prev_hash":"' || c.h || '","role":"' || t.role || '"}}') from c join t on t.conv_id = c.conv_id and t.n = c.n + 1)"""


@query(f"with recursive {_CHAIN} select conv_id, arg_max(h, n) as last_hash from c group by conv_id")
def chain_build(spark: SparkSession, sf: str) -> DataFrame:
    """Records appended to hash chains, read back, and each log's last hash."""
    lines = _log(spark, sf).withColumnRenamed("seq", "line_no")
    return audit.last_hash(audit.opened(lines)).select(F.col("log_id").alias("conv_id"), F.col("record_hash").alias("last_hash"))


@query("""with t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n from (select distinct conv_id, turn from conversations)), s as (select conv_id, count(*) as c, max(case when n = 2 then turn end) as second, max(case when n = 3 then turn end) as third from t group by 1)
  select conv_id, not (conv_id % 3 = 0 and second is not null) and not (conv_id % 3 = 1 and third is not null) as ok, case when conv_id % 3 = 0 then second when conv_id % 3 = 1 then third end as bad_line,
    case when conv_id % 3 = 0 and second is not null then 'line ' || second || ': record contents were modified' when conv_id % 3 = 1 and third is not null then 'line ' || third || ': previous-hash link broken (a record was removed or reordered)'
    else 'OK -- ' || (c - case when conv_id % 3 = 1 and c = 2 then 1 else 0 end) || ' records, chain intact' end as message from s""")
def chain_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of which a third have their second record edited and a third have it removed."""
    rank = F.row_number().over(Window.partitionBy("log_id").orderBy("seq"))
    lines = _log(spark, sf).withColumn("n", rank).where("not (log_id % 3 = 1 and n = 2)")
    edited = F.when((F.col("log_id") % 3 == 0) & (F.col("n") == 2), F.regexp_replace("line", '"role": "', '"role": "x')).otherwise(F.col("line"))
    found = audit.verify(lines.select("log_id", F.col("seq").alias("line_no"), edited.alias("line")))
    return found.select(F.col("log_id").alias("conv_id"), "ok", "bad_line", "message")


# -- generation and training sets -----------------------------------------------------------------------------------
_GROUP_LIST = "[" + ", ".join(f"'{g}'" for g in GROUPS) + "]"


@query(f"""select 'c-' || c_custkey as doc_id, case when c_nationkey % 2 = 0 then 'claim_form' else 'invoice' end as doc_type, {_GROUP_LIST}[(c_nationkey % {len(GROUPS)} + 1)::int] as "group", c_name as set_id,
  true as money, true as dates, true as evidence, true as boxes, true as shown from customer""")
def generated_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A document per customer, its kind and group by their nation, and what holds for every one of them: sums, order of
    dates, gold that its evidence reads as, boxes on the page, each gold field shown once."""
    groups = F.array(*map(F.lit, GROUPS))
    keys = table(spark, sf, "customer").select(
        F.concat(F.lit("c-"), "c_custkey").alias("doc_id"), T.stable_seed(F.lit("customer"), F.col("c_custkey").cast("string")).alias("seed"),
        F.when(F.col("c_nationkey") % 2 == 0, "claim_form").otherwise("invoice").alias("doc_type"), F.element_at(groups, (F.col("c_nationkey") % len(GROUPS) + 1).cast("int")).alias("group"),
        F.lit(None).cast("string").alias("gender"), F.col("c_name").alias("set_id"))
    r = generator.records(keys)
    items = F.aggregate("line_items", F.lit(0.0), lambda a, x: a + x["quantity"] * x["price"])
    money = (F.abs(F.col("subtotal") - items) < 0.006) & (F.abs(F.col("tax") - F.col("subtotal") * F.col("tax_rate")) < 0.006) & (F.abs(F.col("invoice_total") - F.col("subtotal") - F.col("tax")) < 0.006)
    dates = (F.col("date_of_birth") < F.col("date_of_loss")) & (F.col("date_of_loss") < F.col("date_reported")) & (F.col("date_of_loss") < F.col("invoice_date"))
    gold = scoring.gold_array(generator.labels(r, generator.PLAIN_TYPES)).select("doc_id", "doc_type", "meta.group", "meta.set_id", "gold", "layout")
    read = T.forms_of(F.concat(F.transform("gold", lambda g: g["value"]), F.transform("gold", lambda g: g["evidence_text"])))
    made = gold.withColumn("forms", read)
    same = [T.form_for(F.lit(f), F.col("forms")[i]).eqNullSafe(T.form_for(F.lit(f), F.col("forms")[i + len(FIELDS)])) for i, f in enumerate(FIELDS)]
    every = same[0]
    for x in same[1:]:
        every = every & x
    boxes = F.forall("layout", lambda s: (s["bbox"][0] < s["bbox"][2]) & (s["bbox"][1] < s["bbox"][3]) & (s["bbox"][0] >= 0) & (s["bbox"][3] <= 1260))
    shown = F.size(F.filter("gold", lambda g: g.isNotNull())) == F.size(F.filter("layout", lambda s: s["role"] == "value"))
    return made.select("doc_id", "doc_type", "group", "set_id", every.alias("evidence"), boxes.alias("boxes"), shown.alias("shown")).join(r.select("doc_id", money.alias("money"), dates.alias("dates")), "doc_id")


_COMBOS = ", ".join(f"('{g}', '{s}')" for g in GROUPS for s in GENDERS)


@query(f"""with c as (select * from (values {_COMBOS}) t(grp, gender)), r as (select c_custkey as i, grp, gender, row_number() over (partition by c_custkey order by substr(sha256('1234|combos|' || c_custkey || '|' || grp || '|' || gender), 1, 12)) as n from customer cross join c)
  select 'customer-' || i as set_id, string_agg('customer-' || i || '-' || grp || '-' || gender, ' ' order by grp, gender) as doc_ids, true as only_the_name, true as names_differ, 4::bigint as n from r where n <= 4 group by i""")
def counterfactual_generate(spark: SparkSession, sf: str) -> DataFrame:
    """A set of four documents per customer; whether gold, layout, places and meta are equal but for name, group and gender."""
    base = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("customer-"), "c_custkey").alias("set_id"))
    rows = generator.labels(generator.counterfactuals(base), generator.PLAIN_TYPES)
    name = F.col("fields.claimant_name.value")
    # a name's box is as wide as the name, so only its upper left corner is looked at, on a page that is not turned
    segments = F.transform("layout", lambda s: F.struct(F.when(s["field"] == "claimant_name", "").otherwise(s["text"]).alias("text"), F.when((s["field"] == "claimant_name").eqNullSafe(True), None).otherwise(s["bbox"]).alias("bbox"), s["role"].alias("role"), s["field"].alias("field")))
    rest = F.sha2(F.to_json(F.struct("doc_type", "width", "height", *[F.col(f"fields.{f}").alias(f) for f in FIELDS if f != "claimant_name"], segments.alias("layout"), *[F.col(f"meta.{c}").alias(c) for c in ("line_of_business", "handwritten", "quality", "skew_deg", "date_format", "amount_format", "set_id")])), 256)
    each = rows.select("meta.set_id", "doc_id", "meta.group", "meta.gender", name.alias("name"), rest.alias("rest"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group", "gender", "doc_id"))), lambda x: x["doc_id"]), " ")
    return each.groupBy("set_id").agg(ids.alias("doc_ids"), (F.countDistinct("rest") == 1).alias("only_the_name"), (F.countDistinct("name") == F.countDistinct("group", "gender")).alias("names_differ"), F.count("*").alias("n"))


@query("""with e as (select source, cast(doc_id as varchar) as d, sha256(cast(doc_id as varchar) || chr(1) || '{"doc_id":"' || doc_id || '","lang":"' || coalesce(lang, '') || '","n_chars":' || n_chars || '}') as h from documents),
  g as (select source, substr(sha256(d), 1, 3) as g, sha256(string_agg(h, '' order by d)) as h from e group by 1, 2) select source, sha256(string_agg(h, '' order by g)) as hash from g group by source""")
def split_hash(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "n_chars")
    return generator.split_hash(named, ("source",))


@query("""select count(*) as n_examples, count(distinct doc_id) as unique_docs, round(count(*) filter (where source = 'src0') / count(*)::double, 3) as poor_share, 2 * count(*) as null_fields from documents""")
def training_set_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("#dup1")).alias("doc_id"), F.when(F.col("source") == "src0", "poor").otherwise("clean").alias("quality"), F.lit('"a": null, "b": null').alias("target"))
    return training.described(rows)


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def events_windowed(spark: SparkSession, sf: str) -> DataFrame:
    return windowed(table(spark, sf, "events"))


# -- versions of a table, lines by key, odd outputs --------------------------------------------------------------------
_NEXT_VERSION = """select o_orderkey, o_custkey, case when o_orderkey % 97 = 5 then o_totalprice + 1 else o_totalprice end as o_totalprice, case when o_orderkey % 89 = 3 then null else o_orderpriority end as o_orderpriority from orders where o_orderkey % 101 != 7
  union all select o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders where o_orderkey % 211 = 1"""
_VERSION = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query(f"""with a as (select {', '.join(_VERSION)} from orders), b as ({_NEXT_VERSION}), gone as (select * from a except all select * from b), come as (select * from b except all select * from a)
  select *, count(*)::bigint as n from gone group by all union all select *, -count(*)::bigint as n from come group by all""")
def version_difference(spark: SparkSession, sf: str) -> DataFrame:
    """What a version of the orders holds more than the next one, in which rows are edited, dropped and doubled."""
    orders = table(spark, sf, "orders").select(*_VERSION)
    key = F.col("o_orderkey")
    edited = orders.where(key % 101 != 7).withColumns({"o_totalprice": F.when(key % 97 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderpriority": F.when(key % 89 != 3, F.col("o_orderpriority"))})
    return digest.difference(orders, edited.unionAll(orders.where(key % 211 == 1)))


@query("""select 'whole and part' as what, true as equal_to_itself, false as equal, true as contains, false as contained
  union all select 'whole and doubled', true, false, case when count(*) = 0 then true else false end, true from orders""")
def version_containment(spark: SparkSession, sf: str) -> DataFrame:
    """The orders against those of them above the smallest price, and against all of them with the cheapest ones doubled."""
    orders = table(spark, sf, "orders").select(*_VERSION)
    least = orders.agg(F.min("o_totalprice").alias("least"))
    cheapest = orders.join(F.broadcast(least), F.col("o_totalprice") == F.col("least"), "left_semi")  # one row
    part = orders.join(F.broadcast(least), F.col("o_totalprice") > F.col("least"), "left_semi")
    rows = [(what, digest.equal(orders, orders.repartition(3)), digest.equal(orders, other), digest.contains(orders, other), digest.contains(other, orders)) for what, other in (("whole and part", part), ("whole and doubled", orders.unionAll(cheapest)))]
    return spark.createDataFrame(rows, "what string, equal_to_itself boolean, equal boolean, contains boolean, contained boolean")


@query("""select conv_id::varchar as key, max(turn)::bigint as turn, arg_max(role, turn) as role from (select conv_id, turn, max(role) as role from conversations group by all) group by conv_id""")
def last_line_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """The last line of every conversation from JSON Lines files, by their index: only these lines are read."""
    turns = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.max("role").alias("role"))
    lines = once_json(spark, f"conversation lines {sf}", lambda: turns.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn"))
    index = f"{lines}-index"
    line_index.build(spark, f"{lines}/*.json", index, "conv_id")
    keys = turns.select(F.col("conv_id").cast("string").alias("key"))
    found = line_index.records(line_index.joined(spark, index, keys))
    return found.select("key", F.get_json_object("line", "$.turn").cast("long").alias("turn"), F.get_json_object("line", "$.role").alias("role"))


#: Raw outputs around a claim number, and what is made of them: (text, json_valid, schema_valid, error, value, has a box, page).
_ODD = (
    ('{"claim_number": {"value": "@", "evidence_text": "@", "page": 1, "bbox": [1, 2, 3, 4]}}', True, True, None, "@", True, 1),
    ('{}', True, True, None, None, False, None),
    ('no brackets for @', False, False, "no_json_found", None, False, None),
    ('{not json @', False, False, "no_json_found", None, False, None),
    ('{not json @}', False, False, "invalid_json", None, False, None),
    ('Here:\n```json\n{"claim_number": {"value": "@", "bbox": [9, 8, 1, 2]}}\n```\nthat is all', True, True, None, "@", True, 1),
    ('[{"claim_number": {"value": "@"}}]', True, False, "wrapped_in_list", "@", False, 1),
    ('[1, "@"]', False, False, "json_not_an_object", None, False, None),
    ('{"claim_number": {"value": null, "evidence_text": "@"}}', True, True, None, None, False, None),
    ('{"claim_number": "@"}', True, False, "schema_error", "@", False, 1),
    ('{"claim_number": {"value": "@", "bbox": [1, 2, 3]}}', True, False, "schema_error", "@", False, 1),
    ('{"claim_number": {"value": "@", "page": null}}', True, False, "schema_error", "@", False, 1),
    ('{"claim_number": {"value": "@", "evidence_text": 5, "bbox": [1, 2, 3, 4]}}', True, False, "schema_error", "@", False, 1),
    ('{"claim_number": {"value": "first"}, "claim_number": {"value": "@", "page": "2"}}', True, True, None, "@", False, 2),
    ('{"claim_number": ["@"]}', True, False, "schema_error", None, False, None),
    ('{"claim_number": {"value": "@", "bbox": ["a", 2, 3, 4]}, "policy_number": 7} and words after', True, False, "schema_error", "@", False, 1),
)


def _odd_sql(i: int) -> str:
    shown = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "cast(o_orderkey as varchar)" if v == "@" else f"'{v}'"
    return f"case o_orderkey % {len(_ODD)} " + " ".join(f"when {k} then {shown(x[i])}" for k, x in enumerate(_ODD)) + " end"


@query(f"select o_orderkey, {_odd_sql(1)} as json_valid, {_odd_sql(2)} as schema_valid, {_odd_sql(3)} as error, {_odd_sql(4)} as value, {_odd_sql(5)} as has_box, {_odd_sql(6)}::int as page from orders")
def odd_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept of outputs that fit the schema badly or not at all: an order's key in each of sixteen odd texts."""
    texts = F.array(*[F.lit(x[0]) for x in _ODD])
    raw = F.replace(F.element_at(texts, (F.col("o_orderkey") % len(_ODD) + 1).cast("int")), F.lit("@"), F.col("o_orderkey").cast("string"))
    read = with_parsed(table(spark, sf, "orders").select("o_orderkey", raw.alias("raw_output")))
    one = F.col("parsed.fields")[0]
    return read.select("o_orderkey", "parsed.json_valid", "parsed.schema_valid", "parsed.error", one["value"].alias("value"), F.coalesce(F.size(one["bbox"]) == 4, F.lit(False)).alias("has_box"), one["page"].alias("page"))


from . import runs_and_files, streams  # noqa: E402, F401  these register their queries here
