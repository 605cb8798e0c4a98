"""Queries over files that are written from the tables and scanned again, and over runs, models and training records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..constants import FIELDS, GATE, REGISTRY_METRICS
from ..functions import text as T
from ..operators import analysis, compare, costs, parse, rewards, scoring, training
from ..sources import files, written
from ..sources.working import once_folder
from . import claims
from .catalogue import _CREDIT, query
from .claims import facts, table

# -- files ----------------------------------------------------------------------------------------------------------
_LABEL_ROWS = "select 's-' || s_suppkey as doc_id, case when s_suppkey % 2 = 0 then 'val' else 'test' end as split, 'C-' || s_suppkey as claim, s_acctbal as total from supplier"


def _label_folder(spark: SparkSession, sf: str) -> str:
    key = F.col("s_suppkey")
    supplier = table(spark, sf, "supplier").select(F.concat(F.lit("s-"), key).alias("doc_id"), F.when(key % 2 == 0, "val").otherwise("test").alias("split"), F.concat(F.lit("C-"), key).alias("claim"), F.col("s_acctbal").cast("string").alias("total"))
    fields = F.struct(*[F.struct(F.col(c).alias("value")).alias(name) for name, c in (("claim_number", "claim"), ("total_amount", "total"))])
    text = F.to_json(F.struct("doc_id", fields.alias("fields")))

    def write(folder: str) -> None:
        for split in ("val", "test"):
            written.keyed_files(supplier.where(F.col("split") == split).select("doc_id", text.alias("text")), "doc_id", "text", f"{folder}/{split}/labels")

    return once_folder(spark, f"labels {sf}", write)


@query(f"select doc_id, split, claim, total from ({_LABEL_ROWS})")
def label_files(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of two splits, a JSON file each, read by one glob with the split they lie in."""
    found = files.labels(spark, f"{_label_folder(spark, sf)}/*")
    return found.select("doc_id", "split", F.col("fields.claim_number.value").alias("claim"), F.col("fields.total_amount.value").cast("double").alias("total"))


@query(f"select o_orderkey as doc_id from orders where not exists (select 1 from ({_LABEL_ROWS}) l where l.doc_id = 's-' || o_custkey and l.split = 'test')")
def labels_not_there(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose customer's key is no label file of the split."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("s-"), "o_custkey").alias("doc_id"))
    return files.missing_labels(rows, files.labels(spark, f"{_label_folder(spark, sf)}/test")).select(F.col("o_orderkey").alias("doc_id"))


@query("""select 'n-' || n_nationkey as doc_id, 'second' as quality, n_nationkey::int + 1 as seq from nation union all select 'r-' || r_regionkey, 'first', (select count(*) from nation)::int * 2 + r_regionkey::int + 2 from region""")
def manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest in which each nation stands twice: the last line counts, in the place of the first; a blank line keeps its number."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    line = lambda doc, quality: F.to_json(F.struct(doc.alias("doc_id"), F.lit(quality).alias("quality")))
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    lines = [nation.select(F.lit(i).alias("part"), n.alias("at"), line(F.concat(F.lit("n-"), n), quality).alias("line")) for i, quality in ((0, "first"), (1, "second"))]
    lines.append(spark.createDataFrame([(2, 0, "  ")], "part int, at int, line string"))
    lines.append(region.select(F.lit(3).alias("part"), r.alias("at"), line(F.concat(F.lit("r-"), r), "first").alias("line")))
    every = lines[0].union(lines[1]).union(lines[2]).union(lines[3])
    folder = once_folder(spark, f"manifest {sf}", lambda path: written.one_file(every, "line", f"{path}/manifest.jsonl", ["part", "at"]))
    return files.manifest(spark, folder).select("doc_id", "quality", "seq")


@query("select event_id::int + 1 as seq, 'e-' || event_id as doc_id, value as latency_ms, user_id as input_tokens from events")
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """An audit log of the events: records with their order, unknown keys left in the line."""
    events = table(spark, sf, "events")
    line = F.to_json(F.struct(F.concat(F.lit("e-"), "event_id").alias("doc_id"), F.col("value").alias("latency_ms"), F.col("user_id").alias("input_tokens"), F.col("event_type").alias("unknown")))
    folder = once_folder(spark, f"audit {sf}", lambda path: written.one_file(events.select("event_id", line.alias("line")), "line", f"{path}/audit.jsonl", ["event_id"]))
    return files.audit(spark, folder).select("seq", "doc_id", "latency_ms", "input_tokens")


@query("select 'p-' || s_suppkey || '.jpg' as name, sha256(s_name) as sha256 from supplier")
def file_hashes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("p-"), "s_suppkey").alias("k"), "s_name")
    folder = once_folder(spark, f"pictures {sf}", lambda path: written.keyed_files(rows, "k", "s_name", f"{path}/images", ".jpg"))
    return files.image_hashes(spark, f"{folder}/images").select(F.substring_index("path", "/", -1).alias("name"), "sha256")


@query("""select p_partkey, case p_partkey % 4 when 0 then 'test-' || lpad(p_partkey::varchar, 5, '0') when 1 then 'holdout-' || lpad(p_partkey::varchar, 5, '0') end as doc_id, case when p_partkey % 2 = 0 then 'Invoice' else 'Claim form' end as kind from part""")
def file_name_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that file names begin with (two of four kinds of name have one), and the family of a document's type."""
    key, padded = F.col("p_partkey"), F.lpad(F.col("p_partkey").cast("string"), 5, "0")
    name = F.when(key % 4 == 0, F.concat(F.lit("test-"), padded, F.lit(".jpg"))).when(key % 4 == 1, F.concat(F.lit("holdout-"), padded, F.lit("_scan 2.png"))).when(key % 4 == 2, F.concat(F.lit("other-"), padded)).otherwise(F.concat(F.lit("my test-"), padded))
    kind = F.when(key % 4 == 0, "invoice").when(key % 4 == 2, "invoice_r").when(key % 4 == 1, "claim_form").otherwise("claim_form_b")
    return table(spark, sf, "part").select("p_partkey", T.id_of_file_name(name).alias("doc_id"), T.document_kind(kind).alias("kind"))


@query("""select c_custkey, case when c_custkey % 5 = 0 then null else round(c_custkey * 2.0, 1)::double end as x0, case when c_custkey % 5 = 0 then null else round(c_custkey * 0.5, 1)::double end as y0,
  case when c_custkey % 5 = 0 then null else round((c_custkey + 7) * 2.0, 1)::double end as x1, case when c_custkey % 5 = 0 then null else round((c_custkey + 9) * 0.5, 1)::double end as y1, c_custkey % 5 != 0 as changed from customer""")
def rescaled_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes in raw texts scaled to another page size; texts that can't be read stay as they are."""
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit("unreadable "), k)).otherwise(F.format_string('{"claim_number": {"value": "%d", "bbox": [%d, %d, %d, %d]}}', k, k, k, k + 7, k + 9))
    rows = parse.with_parsed(parse.rescaled(table(spark, sf, "customer").select("c_custkey", raw.alias("raw_output")), F.lit(2.0), F.lit(0.5)))
    box = F.col("parsed.fields")[0]["bbox"]
    return rows.select("c_custkey", *[F.get(box, i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], (F.col("raw_output") != F.col("raw_text_before_rescale")).alias("changed"))


# -- runs and models ------------------------------------------------------------------------------------------------
_RUNS = """runs as (select c_custkey as k, case when c_custkey % 17 = 0 then 'quick_' else '' end || 'm' || (c_custkey % 12) || case when c_custkey % 19 = 0 then '_v1_' else '_v2_greedy_' end || s as run_id, s as split, c_acctbal as field_accuracy,
  case when c_custkey % 3 = 0 then '1.0' when c_custkey % 3 = 1 then '1.1' end as evaluator_version from (select *, case when c_custkey % 2 = 0 then 'test' else 'holdout' end as s from customer)),
  evaluations as (select * from (select 'm' || (k % 12) as model, *, row_number() over (partition by k % 12, split order by k desc) as n from runs where k % 17 != 0 and k % 19 != 0) where n = 1)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    split = F.when(k % 2 == 0, "test").otherwise("holdout")
    name = F.concat(F.when(k % 17 == 0, "quick_").otherwise(""), F.lit("m"), (k % 12).cast("string"), F.when(k % 19 == 0, "_v1_").otherwise("_v2_greedy_"), split)
    made = table(spark, sf, "customer").select(
        name.alias("run_id"), split.alias("split"), F.when(k % 3 == 0, "1.0").when(k % 3 == 1, "1.1").alias("evaluator_version"), *[F.col("c_acctbal").alias(m) for m in REGISTRY_METRICS],
        (k % 4).cast("int").alias("counterfactual_sets"), F.lit(0.5).alias("counterfactual_consistency"), F.format_string("/runs/%012d/metrics.json", k).alias("_path"))
    return made


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.lit("m"), k.cast("string"))
    parent = F.when(k % 3 != 0, F.struct(F.concat(F.lit("m"), (k - 1).cast("string")).alias("name"), F.sha2((k - 1).cast("string"), 256).alias("sha256")))
    made = table(spark, sf, "supplier").select(
        F.when(k % 7 != 0, name).alias("adapter_name"), F.sha2(k.cast("string"), 256).alias("adapter_sha256"), F.when(k % 2 == 0, "grpo").alias("mode"), F.when(k % 4 == 0, "other base").alias("base_model"), F.lit("r1").alias("base_revision"),
        parent.alias("parent_adapter"), (k % 5 == 0).alias("quick_test"), F.when(k % 10 == 0, F.struct(F.lit(False).alias("quick_test"))).alias("training"))
    return made.to(spark.createDataFrame([], schemas.TRAINING_CARD).schema).withColumns({"_dir": F.coalesce("adapter_name", F.lit("")), "_path": F.lit("")})


@query(f"""with {_RUNS}, cards as (select case when s_suppkey % 7 != 0 then 'm' || s_suppkey else '' end as model, * from supplier), names as (select model from evaluations union select 'baseline')
  select coalesce(n.model, c.model) as model, case when s_suppkey % 4 = 0 then 'other base' else 'base' end as base_model, case when s_suppkey is not null then case when s_suppkey % 2 = 0 then 'grpo' else 'sft' end when n.model != 'baseline' then 'unknown' end as trained_by,
  case when s_suppkey % 10 = 0 then false else s_suppkey % 5 = 0 end as quick_test, case when s_suppkey is null then '' when s_suppkey % 3 != 0 then 'm' || (s_suppkey - 1) || ' ' || substr(sha256((s_suppkey - 1)::varchar), 1, 8) || ',' else '' end
    || case when s_suppkey is null then '' else c.model || ' ' || substr(sha256(s_suppkey::varchar), 1, 8) end as lineage from names n full join cards c on n.model = c.model""")
def registry_models(spark: SparkSession, sf: str) -> DataFrame:
    """Models with their lineage (direct parent, then the adapter): cards of suppliers, runs of customers."""
    models, _ = compare.registry(_cards(spark, sf), _runs(spark, sf), "base")
    lineage = F.array_join(F.transform("adapters", lambda a: F.concat(a["name"], F.lit(" "), F.substring(a["sha256"], 1, 8))), ",")
    return models.select("model", "base_model", "trained_by", "quick_test", lineage.alias("lineage"))


@query(f"""with {_RUNS} select model, max(field_accuracy) filter (where split = 'test') as test_accuracy, max(field_accuracy) filter (where split = 'holdout') as holdout_accuracy, max(coalesce(evaluator_version, '1.0')) filter (where split = 'test') as test_evaluator from evaluations group by model""")
def results_by_split(spark: SparkSession, sf: str) -> DataFrame:
    """A row per model, columns per split: the last run by path of each model and split; quick runs and other names don't count."""
    _, evaluations = compare.registry(_cards(spark, sf), _runs(spark, sf), "base")
    wide = compare.results_table(evaluations, ["test", "holdout"], ["field_accuracy", "evaluator_version"])
    return wide.select("model", F.col("test_field_accuracy").alias("test_accuracy"), F.col("holdout_field_accuracy").alias("holdout_accuracy"), F.col("test_evaluator_version").alias("test_evaluator"))


@query(f"with {_RUNS} select array_to_string(list_sort(list(distinct coalesce(evaluator_version, '1.0'))), ',') as versions, count(distinct coalesce(evaluator_version, '1.0')) > 1 as mixed from runs")
def evaluator_versions(spark: SparkSession, sf: str) -> DataFrame:
    return compare.mixed_evaluators(_runs(spark, sf)).select(F.array_join("versions", ",").alias("versions"), "mixed")


_EDGE = "select avg(quality) as q from documents join labels using (doc_id)"


@query(f"""with v as ({_EDGE}), spec as (select * from (values {', '.join(f"({i}, '{s}', '{m}')" for i, (s, m, _, _) in enumerate(GATE))}) t(pos, split, metric))
  select pos, split, metric, q as candidate, q + 1 as production, case when metric = 'hallucination_rate' then 'pass' else 'FAIL' end as result from spec cross join v where split = 'test'
  union all select min(pos), split, '(missing)', null, null, 'FAIL: candidate not evaluated on this split' from spec where split = 'holdout' group by split
  union all select min(pos) - 1, split, '(evaluator)', null, null, 'FAIL: scored with different evaluator versions' from spec where split = 'test' group by split
  union all select {len(GATE)}, '-', '(training)', null, null, 'FAIL: adapter came from a quick test run'""")
def gate_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A candidate that is worse, lacks a split, was scored by another evaluator and comes from a quick run."""
    q = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id").agg(F.avg("quality").alias("q"))
    row = lambda model, split, version, x: q.select(F.lit(model).alias("model"), F.lit(split).alias("split"), F.lit(version).alias("evaluator_version"), *[x.alias(m) for m in ("field_accuracy", "grounded_accuracy", "hallucination_rate")])
    rows = row("new", "test", "1.1", F.col("q")).union(row("old", "test", "1.0", F.col("q") + 1)).union(row("old", "holdout", "1.0", F.col("q")))
    models = spark.createDataFrame([("new", True), ("old", False)], "model string, quick_test boolean")
    return compare.gate_rows(rows, models, "new", "old").select("pos", "split", "metric", "candidate", "production", "result")


@query("""select event_type, count(*) as docs, round_even(avg(value) / 1000 / 3600 * 0.42, 5) as usd_per_doc, null::double as batch_api_usd_per_1000_docs from events group by event_type""")
def gpu_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Cost by the price of a GPU hour: no token prices, so no figure for a hosted service."""
    records = table(spark, sf, "events").select("event_type", (F.col("value") * 1.0).alias("latency_ms"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    return costs.run_cost(records, ("event_type",), gpu_hourly=0.42).select("event_type", "docs", "usd_per_doc", "batch_api_usd_per_1000_docs")


# -- analysis, rewards and training records ---------------------------------------------------------------------------
_SLICES = ("quality", "line_of_business")


@query(""", f as (select field, avg(correct::int) as a from scored group by field), w as (select 0 as at, 'Weakest field: ' || field || ' (' || printf('%.1f', a * 100) || '% correct).' as line from f order by a, field limit 1),
  e as (select error_type, count(*) as n from scored where not correct group by 1), t as (select 1 as at, 'Most common error: ' || error_type || ' (' || n || ' fields, ' || printf('%.0f', n / (select sum(n) from e) * 100) || '% of errors).' as line from e order by n desc, error_type limit 1),
  """ + ", ".join(f"""l{i} as (select {i + 2} as at, 'Errors concentrate in {c} = ' || value || ': ' || printf('%.2f', lift) || ' times their share (' || errors || ' errors in ' || fields || ' fields).' as line from (select {c} as value, count(*) as fields,
  count(*) filter (where not correct) as errors, round_even((count(*) filter (where not correct) / (select count(*) from scored where not correct)::double) / (count(*) / (select count(*) from scored)::double), 2) as lift from scored group by 1) where lift >= 1.001 order by lift desc, value limit 1)""" for i, c in enumerate(_SLICES)) + """
  select * from w union all select * from t union all select * from l0 union all select * from l1""", from_claims=True)
def findings(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of an error report."""
    found = analysis.findings(facts(spark, sf), _SLICES, least_lift=1.001)
    kinds = ["Weakest", "Most", *(f"Errors concentrate in {c} " for c in _SLICES)]
    return spark.createDataFrame([(i, line) for line in found for i, k in enumerate(kinds) if line.startswith(k)], "at int, line string")


@query("""select doc_id, count(*) filter (where not pred_present) as null_fields, case when bool_or(pred_present and box != 'none') then 4000.0 else 0.0 end::double as mean_box_area from scored group by doc_id""", from_claims=True)
def answer_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Absent fields and mean box area of each answer."""
    return training.sample_signals(claims.rows_for_one(spark, sf))


def _grounded_shares(rows):
    """Rewards of one's own: right fields count one, with a good citation two, inventions minus two, by field."""
    worth = rows["correct"].astype(float) + rows["citation_ok"].astype(float) - 2.0 * rows["error_type"].isin(["hallucinated", "distractor_for_absent"])
    return worth.to_numpy().reshape(-1, len(FIELDS)).sum(axis=1) / len(FIELDS)


@query("select doc_id, sum(correct::int + citation_ok::int - 2 * (error_type in ('hallucinated', 'distractor_for_absent'))::int) / 7.0::double as reward from scored group by doc_id", from_claims=True)
def own_reward(spark: SparkSession, sf: str) -> DataFrame:
    """A reward function of a user's, over each document's seven rows."""
    rows = facts(spark, sf).select("doc_id", "field_pos", "field", "correct", "citation_ok", "error_type")
    return rewards.rewarded_at_once(rows, _grounded_shares)


_PRICED = f"case error_type when 'correct' then 2.0 * (0.5 + 0.5 * {_CREDIT}) when 'correct_null' then 1.0 when 'missed' then -0.25 else -1.0 end"


@query(f"""select doc_id, case when bool_and(json_valid) then round_even(greatest(-1.0, least(1.0, sum({_PRICED}) / 7 - case when bool_and(schema_valid) then 0.0 else 0.1 end)), 4) else -3.0 end::double as reward from scored group by doc_id""", from_claims=True)
def own_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Rewards with other prices for right, missed and unreadable answers."""
    return scoring.costed_rewards(facts(spark, sf), costs={"correct": 2.0, "miss": -0.25, "invalid": -3.0}).select("doc_id", "reward")


@query("select l_linenumber as epoch, avg(l_quantity) as train_loss, max(l_discount) as val_loss, max(l_orderkey) as updates from lineitem group by 1")
def loss_by_epoch(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("epoch"), F.col("l_quantity").alias("train_loss"), F.col("l_discount").alias("val_loss"), F.col("l_orderkey").alias("update"))
    return training.loss_averages(rows)


@query("select user_id, event_id, avg(value) over (partition by user_id order by event_id rows between unbounded preceding and current row) as train_loss_mean from events")
def running_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("train_loss"))
    return training.running_loss(rows, ("user_id",), "event_id").select("user_id", "event_id", "train_loss_mean")


@query("select sum(p_size::bigint * p_partkey * 3)::bigint as parameters, sum(case when p_size > 25 then p_size::bigint * p_partkey * 3 else 0 end)::bigint as trainable, sum(case when p_size > 25 then p_size::bigint * p_partkey * 3 else 0 end) / sum(p_size::bigint * p_partkey * 3)::double as share from part")
def parameter_counts(spark: SparkSession, sf: str) -> DataFrame:
    weights = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.array(F.col("p_size").cast("long"), "p_partkey", F.lit(3).cast("long")).alias("shape"), (F.col("p_size") > 25).alias("trainable"))
    return training.parameter_counts(weights)
