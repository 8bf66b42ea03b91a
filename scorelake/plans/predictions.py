"""Queries of template repair, predicted tables and run logs over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import cells, repair, text
from ..operators import align, attempts, evidence, sessions, strata, tables, vote
from ..session import scratch_folder
from ..sources import nodes
from ..streaming import registry
from . import trace
from .catalog import Tables, query


def _n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def _pick(*texts: Column) -> Column:
    return F.element_at(F.array(*texts), (F.col("event_id") % len(texts) + 1).cast("int"))


# template repair


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'SELECT a FROM df WHERE bowler = ''{bowler}'' AND k = ''' || event_type || '''' WHEN 1 THEN 'SELECT a FROM df WHERE bowler = ''{bowler}''' WHEN 2 THEN 'SELECT a FROM df WHERE bowler = {bowler} AND u = ' || CAST(user_id AS VARCHAR) ELSE 'SELECT bowler FROM df WHERE x = 1' END AS sql FROM events")
def repair_statements(t: Tables) -> DataFrame:
    sql = _pick(
        F.concat(F.lit("SELECT a FROM df WHERE bowler = ' bowler ' AND k = '"), "event_type", F.lit("'")), F.lit("SELECT a FROM df WHERE bowler = Bowler"),
        F.concat(F.lit("SELECT a FROM df WHERE bowler = {bowler} AND u = "), F.col("user_id").cast("string")), F.lit("SELECT bowler FROM df WHERE x = 1"),
    )
    return t.events.select("event_id", repair.braced_sql(sql, "bowler").alias("sql"))


@query("SELECT event_id, 'Did {bowler} or {bowler} ' || event_type || ' more than a bowler?' AS question FROM events")
def repair_marked_texts(t: Tables) -> DataFrame:
    asked = F.concat(F.lit("Did 'bowler' or < Bowler > "), F.col("event_type"), F.lit(" more than a bowler?"))
    return t.events.select("event_id", repair.marked_text(asked, "bowler").alias("question"))


@query("SELECT p_partkey, 'Was {batsman} or {batsman}, not x' || upper(p_name) || ', the best?' AS question FROM part")
def repair_values(t: Tables) -> DataFrame:
    asked = F.concat(F.lit("Was '"), "p_name", F.lit("' or "), F.upper("p_name"), F.lit(", not x"), F.upper("p_name"), F.lit(", the best?"))
    return t.part.select("p_partkey", repair.value_to_hole(asked, "batsman", F.col("p_name")).alias("question"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'What did the bowler ''{bowler}'' do? Parameters: {batsman}.' WHEN 1 THEN 'What did {bowler} do? Parameters: {batsman}.' ELSE 'What did they do to any batsman? Parameters: {bowler}.' END AS question, CASE event_id % 3 WHEN 0 THEN 'And {bowler}?' ELSE '' END AS others FROM events")
def repair_questions(t: Tables) -> DataFrame:
    """Values and quoted names become holes; what nothing names is appended."""
    made = t.events.select("event_id", _pick(F.lit("What did the bowler do?"), F.concat(F.lit("What did "), "event_type", F.lit(" do? ")), F.lit("What did they do to any batsman?")).alias("q"), F.when(F.col("event_id") % 3 == 0, F.array(F.lit("And <bowler>?"))).alias("p"), F.col("event_type").alias("v"))
    question, others = repair.repaired(F.col("q"), F.col("p"), {"bowler": F.col("v"), "batsman": F.lit(None).cast("string")})
    return made.select("event_id", question.alias("question"), F.array_join(others, "|").alias("others"))


@query("SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'x,bowler,y' ELSE 'bowler,y' END AS variables FROM events")
def declared_variables(t: Tables) -> DataFrame:
    variables = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("x"), F.lit("bowler")))
    return t.events.select("event_id", F.array_join(repair.declared(variables, F.lit("SELECT {bowler}"), F.lit("{bowler} or {y}?")), ",").alias("variables"))


@query("SELECT event_id, event_id % 3 = 2 AS temporal FROM events")
def temporal_records(t: Tables) -> DataFrame:
    return t.events.select("event_id", repair.is_temporal(_pick(F.lit(None).cast("string"), F.lit("(1 = 1)"), F.lit("(overs < 3)"))).alias("temporal"))


# predicted tables


def _predicted(t: Tables) -> DataFrame:
    number, kind = F.col("value").cast("string"), F.col("event_type")
    shown = _pick(
        F.concat(F.lit('{"columns":["kind","total_v"],"rows":[["'), kind, F.lit('",'), number, F.lit('],["other",null]]}')),
        F.concat(F.lit('{"table":[{"kind":"'), kind, F.lit('","total_v":'), number, F.lit('},{"kind":"other"}]}')),
        F.concat(F.lit('[{"total_v":'), number, F.lit(',"kind":"'), kind, F.lit('"},{"kind":"other"}]')),
        F.lit("no table"), F.lit("[]"),
    )
    return t.events.select("event_id", "event_type", tables.from_text(shown, F.array(F.lit("kind"), F.lit("total_v"))).alias("table"))


@query("SELECT event_id, CASE WHEN event_id % 5 <= 2 THEN event_type || '|' || CAST(value AS VARCHAR) || chr(10) || 'other|-' WHEN event_id % 5 = 4 THEN '' END AS rows FROM events")
def predicted_tables(t: Tables) -> DataFrame:
    """Tables in any of the accepted shapes as rows in header order; other text is none."""
    return _predicted(t).select("event_id", tables.as_text(F.col("table")).alias("rows"))


@query("SELECT event_id, event_id % 5 <= 2 AS valid, event_id % 5 <= 2 AND event_id % 2 = 0 AS valid_with_rows FROM events")
def predicted_tables_valid(t: Tables) -> DataFrame:
    headers = F.array(F.lit("kind"), F.lit("total_v"))
    return _predicted(t).select("event_id", tables.is_valid(F.col("table"), headers).alias("valid"), tables.is_valid(F.col("table"), headers, 3 - F.when(F.col("event_id") % 2 == 0, 1).otherwise(0)).alias("valid_with_rows"))


_HEADERS = (("batsman", "bowler", "total_runs"), ("total_runs", "batsman"), ("batsman", "team"), ("count", "runs"), ("team", "over_no", "strike_rate"))
_KEYS = (("bowler",), ("batsman",), (), (), ("total_x", "zone"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'bowler' WHEN 1 THEN 'batsman' WHEN 2 THEN CASE WHEN event_id % 2 = 1 THEN '' ELSE 'batsman,team' END WHEN 3 THEN CASE WHEN event_id % 2 = 1 THEN '' ELSE 'count' END ELSE 'team,over_no' END AS keys FROM events")
def table_row_keys(t: Tables) -> DataFrame:
    """Key columns by the primary key and the headers before the first measure."""
    of = lambda lists: _pick(*(F.array(*map(F.lit, x)).cast("array<string>") for x in lists))
    return t.events.select("event_id", F.array_join(tables.row_keys(of(_KEYS), of(_HEADERS), F.when(F.col("event_id") % 2 == 1, 1).otherwise(3)), ",").alias("keys"))


@query("SELECT user_id, string_agg(event_type || '|-', chr(10) ORDER BY first) AS rows FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def table_skeletons(t: Tables) -> DataFrame:
    """A row for each distinct row header, its measures empty."""
    heads = t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda r: F.create_map(F.lit("kind"), r["event_type"])).alias("heads"))
    keys, headers = F.array(F.lit("kind")), F.array(F.lit("kind"), F.lit("total"))
    return heads.select("user_id", tables.as_text(tables.skeleton(headers, keys, tables.distinct_headers(F.col("heads"), keys))).alias("rows"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL OR toxic <> 1")
def mismatched_records(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left").withColumn("content_match", F.col("toxic") == 1)
    return tables.mismatches(joined).select("doc_id")


@query("SELECT model, l.doc_id, lang, score FROM (SELECT 'a' AS model, doc_id, quality AS score FROM labels UNION ALL SELECT 'b', doc_id, toxic FROM labels) l JOIN documents d ON d.doc_id = l.doc_id")
def results_with_skills(t: Tables) -> DataFrame:
    """Two models' results beside their records' skills."""
    results = [t.labels.select(F.lit(m).alias("model"), "doc_id", F.col(c).alias("score")) for m, c in (("a", "quality"), ("b", "toxic"))]
    return tables.joined_results(t.documents.select("doc_id", "lang"), results, ["doc_id"]).select("model", "doc_id", "lang", "score")


# run logs: events as attempts, a user's as a sample's

_SQL = "(SELECT user_id AS sample, event_id AS attempt, value > 30 AS valid, event_type AS answer, event_id % 3 AS part, event_id % 7 AS size FROM events)"


def _attempts(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("sample"), F.col("event_id").alias("attempt"), (F.col("value") > 30).alias("valid"), F.col("event_type").alias("answer"), (F.col("event_id") % 3).cast("int").alias("part"), (F.col("event_id") % 7).alias("size"))


def _last_valid(name: str, condition: str) -> None:
    def run(t: Tables) -> DataFrame:
        return attempts.winners(_attempts(t).filter(condition), ["sample"]).select("sample", "attempt", "answer")

    run.__name__ = name
    query(f"SELECT sample, attempt, answer FROM {_SQL} WHERE valid AND {condition} QUALIFY row_number() OVER (PARTITION BY sample ORDER BY attempt DESC) = 1")(run)


for _name, _condition in (("log_zero_shot", "part >= 0"), ("log_chain_of_thought", "part = 0"), ("log_one_pass", "part = 1"), ("log_row_chain", "part = 2")):
    _last_valid(_name, _condition)


@query(f"SELECT sample, string_agg(answer || ':' || size, '|' ORDER BY part) AS cells FROM (SELECT * FROM {_SQL} WHERE valid QUALIFY row_number() OVER (PARTITION BY sample, part ORDER BY attempt DESC) = 1) GROUP BY sample HAVING count(*) = 3")
def log_modular_rows(t: Tables) -> DataFrame:
    """Rows answered one by one, put together."""
    cell = F.concat_ws(":", "answer", F.col("size").cast("string"))
    return attempts.stitched(_attempts(t), "sample", "part", cell, 3).select("sample", F.array_join("cells", "|").alias("cells"))


@query(f"WITH w AS (SELECT * FROM {_SQL} WHERE valid QUALIFY row_number() OVER (PARTITION BY sample, part ORDER BY attempt) = 1), c AS (SELECT sample, answer, count(*) AS votes, min(part) AS first FROM w GROUP BY 1, 2) SELECT sample, answer AS winner, votes FROM c QUALIFY row_number() OVER (PARTITION BY sample ORDER BY votes DESC, first) = 1")
def log_self_consistency(t: Tables) -> DataFrame:
    """The first valid attempt of each vote, then the most frequent answer."""
    return attempts.voted(_attempts(t), "sample", "part", "answer").select("sample", "winner", "votes")


@query(f"WITH w AS (SELECT * FROM {_SQL} WHERE valid QUALIFY row_number() OVER (PARTITION BY sample, part ORDER BY attempt DESC) = 1) SELECT a.sample, a.answer AS plan, b.answer AS filled FROM w a JOIN w b ON a.sample = b.sample AND a.part = 0 AND b.part = 1")
def log_plan_and_fill(t: Tables) -> DataFrame:
    stages = attempts.staged(_attempts(t).withColumn("stage", F.when(F.col("part") == 0, "plan").when(F.col("part") == 1, "fill")), "sample", "stage", ["plan", "fill"], ["answer"])
    return stages.select("sample", F.col("plan_answer").alias("plan"), F.col("fill_answer").alias("filled"))


@query(f"WITH w AS (SELECT *, min(attempt) OVER (PARTITION BY sample, part) AS first FROM {_SQL} WHERE valid), s AS (SELECT sample, part, attempt FROM w WHERE attempt = first) SELECT sample, part, attempt FROM s WHERE part = 0 OR part = 1 AND sample IN (SELECT sample FROM s WHERE part = 0) OR part = 2 AND sample IN (SELECT sample FROM s WHERE part = 0) AND sample IN (SELECT sample FROM s WHERE part = 1)")
def log_least_to_most(t: Tables) -> DataFrame:
    """First valid attempts of the steps, as far as they are unbroken."""
    return attempts.unbroken_steps(_attempts(t), "sample", "part").select("sample", F.col("part").cast("bigint").alias("part"), "attempt")


@query(f"WITH w AS (SELECT * FROM {_SQL} WHERE valid QUALIFY row_number() OVER (PARTITION BY sample, part ORDER BY attempt DESC) = 1) SELECT a.sample, b.answer FROM w a JOIN w b ON a.sample = b.sample AND a.part = 0 AND b.part = 1 WHERE a.size <= b.size")
def log_evidence_then_compute(t: Tables) -> DataFrame:
    """Both stages' winners, if the evidence has no more rows than the table."""
    stages = attempts.staged(_attempts(t).withColumn("stage", F.when(F.col("part") == 0, "evidence").when(F.col("part") == 1, "table")), "sample", "stage", ["evidence", "table"], ["answer", "size"])
    return stages.filter("evidence_size <= table_size").select("sample", F.col("table_answer").alias("answer"))


@query(f"SELECT sample, CAST(sum(size) AS BIGINT) AS size, bool_or(valid) AS success FROM {_SQL} GROUP BY sample")
def log_usage(t: Tables) -> DataFrame:
    return attempts.usage(_attempts(t), "sample", ["size"])


@query(f"SELECT round(avg(size), 6) AS size FROM (SELECT sample, sum(size) AS size FROM {_SQL} GROUP BY sample HAVING bool_or(valid))")
def log_usage_of_successes(t: Tables) -> DataFrame:
    return attempts.usage_of_successes(attempts.usage(_attempts(t), "sample", ["size"]), ["size"]).select(F.round("size", 6).alias("size"))


@query("SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ON c_custkey = o_custkey")
def log_batch_outputs(t: Tables) -> DataFrame:
    """Requests with their latest output."""
    outputs = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return attempts.consumed(t.customer.select("c_custkey"), outputs, "c_custkey", "o_orderkey")


@query("SELECT user_id AS sample_id, max(event_id % 4) AS attempt FROM (SELECT user_id, event_id % 4 AS event_id FROM events GROUP BY user_id, event_id % 4 HAVING avg(value) > 40) GROUP BY user_id")
def log_files(t: Tables) -> DataFrame:
    """A run's log folder, a subfolder an attempt: the last valid one of each sample."""
    folder = session.scratch_folder(t.spark, "logs")
    logged = t.events.groupBy(F.col("user_id").alias("sample_id"), (F.col("event_id") % 4).alias("attempt")).agg(cells.mean_above(F.col("value"), "40").alias("valid"))
    logged.write.partitionBy("attempt").json(folder)
    return attempts.winners(attempts.read_attempts(t.spark, folder, "sample_id bigint, valid boolean"), ["sample_id"]).select("sample_id", "attempt")


# profiles, evidence and similar questions


@query("SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS hop_count, CASE event_id % 3 WHEN 0 THEN 'batsman' WHEN 1 THEN 'both' ELSE 'unknown' END AS entity_target, CASE event_id % 3 WHEN 0 THEN 'SUM' WHEN 1 THEN 'COUNT' ELSE '' END AS functions FROM events")
def statement_profiles(t: Tables) -> DataFrame:
    sql = _pick(F.lit("SELECT batsman, sum(runs) FROM df"), F.lit("SELECT batsman, n FROM (SELECT batsman, count(DISTINCT bowler) AS n FROM df GROUP BY batsman)"), F.lit("SELECT a.x FROM df a JOIN df b ON a.i = b.i JOIN df c ON c.i = a.i"))
    made = text.sql_profile(sql)
    return t.events.select("event_id", made["hop_count"].cast("bigint").alias("hop_count"), made["entity_target"].alias("entity_target"), F.array_join(made["functions"], ",").alias("functions"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) || ' | user_id=' || CAST(user_id AS VARCHAR) || CASE WHEN event_type = 'view' THEN '' ELSE ' | event_type=' || event_type END || ' | value=' || CAST(value AS VARCHAR) AS line FROM events")
def evidence_lines(t: Tables) -> DataFrame:
    made = t.events.withColumn("event_type", F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))).withColumn("none", F.lit(None).cast("string"))
    return made.select("event_id", evidence.ledger_line("event_id", ["user_id"], ["event_type", "value", "none"], ["event_type"]).alias("line"))


@query("SELECT user_id, count(*) AS n, count(*) AS evidence_rows, string_agg(CAST(event_id AS VARCHAR) || ' | value=' || CAST(value AS VARCHAR), chr(10) ORDER BY event_id) FILTER (nth <= 3) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WHERE event_type = 'purchase') GROUP BY user_id HAVING count(*) > 1")
def answers_with_evidence(t: Tables) -> DataFrame:
    """Each answer row with the first lines of the base rows behind it."""
    traced = trace.trace(t.events, "event_id", "SELECT user_id, count(*) AS n FROM df WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) > 1")
    told = evidence.with_evidence(traced.result, traced.lineage, t.events, "event_id", evidence.ledger_line("event_id", [], ["value"]), most=3)
    return told.select("user_id", "n", "evidence_rows", F.array_join("evidence", "\n").alias("evidence"))


@query("SELECT event_id, round(event_id / CAST(greatest((SELECT count(*) FROM events) - 1, 1) AS DOUBLE), 9) AS position FROM events")
def relative_positions(t: Tables) -> DataFrame:
    rows = t.events.count()
    return t.events.select("event_id", F.round(evidence.relative_position(F.col("event_id"), F.lit(rows)), 9).alias("position"))


@query("SELECT p_partkey AS record_id, p_partkey % 3 AS idx, 1.0 AS similarity FROM part")
def similar_templates(t: Tables) -> DataFrame:
    """The template whose question is most like the one asked."""
    asks = lambda i: F.concat(F.lit("How often is "), "p_name", F.element_at(F.array(F.lit(" sold?"), F.lit(" seen by a customer?"), F.lit(" the best of all in size and price?")), (i + 1).cast("int")))
    records = t.part.select(F.col("p_partkey").alias("record_id"), F.col("p_partkey").alias("item_id"), F.upper(asks(F.col("p_partkey") % 3)).alias("question"))
    templates = t.part.select(F.col("p_partkey").alias("item_id"), F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(3)))).alias("idx"), "p_name").select("item_id", "idx", asks(F.col("idx")).alias("question"))
    return evidence.best_template(records, templates)


_SPENT = "SELECT user_id, count(*) AS n FROM df WHERE value > 5 GROUP BY user_id HAVING count(*) > 1"
_STATS = """SELECT user_id, count(*) AS num_events, min(event_id)::DOUBLE AS first_place, max(event_id)::DOUBLE AS last_place, round(sum(value), 6) AS sum_value, count(*) FILTER (event_type = 'purchase') AS purchases,
count(*) FILTER (value > 50) AS large, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, count(DISTINCT props) AS n_props FROM events WHERE value > 5 GROUP BY user_id HAVING count(*) > 1"""


def _statistics(t: Tables) -> DataFrame:
    traced = trace.trace(t.events, "event_id", _SPENT)
    base = t.events.withColumn("at", F.col("event_id"))
    found = evidence.evidence_statistics(traced.lineage, base, "event_id", "at", ["value"], {"purchases": F.col("event_type") == "purchase", "large": F.col("value") > 50}, ["event_type", "props"])
    return found.join(traced.result, "__out").withColumn("sum_value", F.round("sum_value", 6))


@query(_STATS)
def evidence_statistics(t: Tables) -> DataFrame:
    """Statistics of the base rows behind each answer row, over the long lineage."""
    named = _statistics(t).withColumn("kinds", F.array_join("unique_event_type", ",")).withColumn("n_props", F.size("unique_props").cast("bigint"))
    return named.select("user_id", "num_events", "first_place", "last_place", "sum_value", "purchases", "large", "kinds", "n_props")


_QUESTION = "CASE user_id % 4 WHEN 0 THEN 'How much did they SPEND?' WHEN 1 THEN 'How many purchases were made first?' WHEN 2 THEN 'Which large amounts came last?' END"


@query(f"""SELECT user_id, num_events, CASE user_id % 4 WHEN 0 THEN 'event_id,value' WHEN 1 THEN 'event_id,event_type' WHEN 2 THEN 'event_id,value' ELSE 'event_id' END AS columns, CASE WHEN user_id % 4 IN (1, 2) THEN first_place END AS first_place,
CASE WHEN user_id % 4 IN (1, 2) THEN last_place END AS last_place, CASE WHEN user_id % 4 IN (0, 2) THEN sum_value END AS sum_value, CASE WHEN user_id % 4 = 1 THEN purchases::DOUBLE END AS purchases, CASE WHEN user_id % 4 = 2 THEN large::DOUBLE END AS large FROM ({_STATS})""")
def task_statistics(t: Tables) -> DataFrame:
    """Those statistics that a question about the answer row concerns, and the columns it concerns."""
    asked = _statistics(t).withColumn("question", F.expr(_QUESTION))
    columns = evidence.relevant_columns(F.col("question"), F.array(F.lit("event_id")), {"event_type": ["purchase"], "value": ["spend", "amount"]}, ["event_id", "event_type", "value"])
    told = evidence.task_statistics(asked.withColumn("columns", columns), F.col("question"), F.col("columns"), ["value"], ["first", "last"], {"purchases": (["event_type"], ["purchase"]), "large": (["value"], ["large"])})
    return told.select("user_id", "num_events", F.array_join("columns", ",").alias("columns"), "first_place", "last_place", "sum_value", F.col("purchases").cast("double").alias("purchases"), F.col("large").cast("double").alias("large"))


@query(r"""SELECT conv_id AS id, '$.steps[' || (nth - 1) || '].final' AS path, 0 AS nth, role AS item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS sql, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS sha256
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS nth FROM conversations) WHERE text IS NOT NULL""")
def final_nodes(t: Tables) -> DataFrame:
    """Statements below the ``final`` nodes of nested documents, one document a conversation."""
    steps = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    final = F.transform(steps, lambda s: F.struct(s["turn"].alias("turn"), F.array(F.struct(s["role"].alias("item_id"), s["text"].alias("sql"))).alias("final")))
    docs = t.conversations.groupBy("conv_id").agg(final.alias("steps")).select("conv_id", F.to_json(F.struct("conv_id", "steps")).alias("body"))
    found = nodes.final_statements(nodes.nodes(docs, "conv_id", "body"))
    return found.select("id", "path", "nth", "item_id", "sql", "sha256")


@query("""SELECT event_id, event_type, props AS fp, row_number() OVER (PARTITION BY event_type, props ORDER BY event_id) = 1 OR coalesce(props, '') = '' AS kept FROM events""")
def streamed_registry(t: Tables) -> DataFrame:
    """Events read as a stream, each kept unless its type has had its properties: bounded state, in shards."""
    at, out = (scratch_folder(t.spark, n) for n in ("registry-state", "registry"))
    stream = t.stream("events").select("event_type", "event_id", F.col("props").alias("fp"))
    admitted = registry.admit(stream, ["event_type"], "fp", "event_id", capacity=1_000_000, shards=8)
    admitted.writeStream.format("parquet").option("checkpointLocation", at).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select("event_id", "event_type", "fp", "kept")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length FROM documents WHERE text IS NOT NULL ORDER BY text_length, doc_id LIMIT 5")
def shortest_texts(t: Tables) -> DataFrame:
    return evidence.shortest(t.documents, "text", ["doc_id"], 5).select("doc_id", F.col("text_length").cast("bigint").alias("text_length"))


@query("SELECT CAST(6 AS BIGINT) AS sessions, true AS same, true AS dense, 0 AS oversold")
def simulated_sessions(t: Tables) -> DataFrame:
    """A seeded simulator's logs: the same twice, numbered without gaps, and nothing returned that wasn't bought."""
    catalog = t.part.groupBy(F.col("p_brand").alias("product_id")).agg(F.round(F.avg("p_retailprice"), 2).alias("price"))
    one, two = (sessions.simulate(catalog, 6, 30).repartition(n) for n in (1, 4))
    numbers = one.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("time_idx").alias("last"))
    dense = numbers.agg(_n("sessions"), F.bool_and(F.col("n") == F.col("last") + 1).alias("dense"))
    held = sessions.signed(one.filter("order_id IS NOT NULL")).groupBy("session_id", "order_id", "product_id").agg(F.sum("signed_qty").alias("q"))
    oversold = held.agg(F.count_if(F.col("q") < 0).cast("int").alias("oversold"))
    row = (dense.first(), one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty(), oversold.first())
    return t.spark.createDataFrame([(row[0].sessions, row[1], row[0].dense, row[2].oversold)], "sessions bigint, same boolean, dense boolean, oversold int")


# suites: settings, questions and pairs of models

_RESULTS = "(SELECT 'a' AS model, d.doc_id, lang, source, quality AS score FROM documents d JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT 'b', d.doc_id, lang, source, CASE WHEN d.doc_id % 4 > 0 THEN toxic END FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _results(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id")
    one = joined.select(F.lit("a").alias("model"), "doc_id", "lang", "source", F.col("quality").alias("score"))
    return one.unionByName(joined.select(F.lit("b").alias("model"), "doc_id", "lang", "source", F.when(F.col("doc_id") % 4 > 0, F.col("toxic")).alias("score")))


@query(f"SELECT 'lang' AS factor, lang AS level, count(score) FILTER (model = 'a') AS n_a, count(score) FILTER (model = 'b') AS n_b, round(avg(score) FILTER (model = 'b') - avg(score) FILTER (model = 'a'), 6) AS delta FROM {_RESULTS} GROUP BY lang UNION ALL SELECT 'source', source, count(score) FILTER (model = 'a'), count(score) FILTER (model = 'b'), round(avg(score) FILTER (model = 'b') - avg(score) FILTER (model = 'a'), 6) FROM {_RESULTS} GROUP BY source")
def suite_pooled(t: Tables) -> DataFrame:
    """Two models' scores pooled by the levels of every factor."""
    return strata.model_suite(_results(t), ["lang", "source"], "score", "model", "a", "b").select("factor", "level", "n_a", "n_b", F.round("delta", 6).alias("delta"))


@query(f"WITH p AS (SELECT doc_id, lang, max(score) FILTER (model = 'a') AS a, max(score) FILTER (model = 'b') AS b FROM {_RESULTS} GROUP BY 1, 2) SELECT lang, count(*) AS pairs, round(avg(b - a), 6) AS delta, count(*) FILTER (b > a) AS wins, count(*) FILTER (b < a) AS losses FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY lang")
def suite_paired(t: Tables) -> DataFrame:
    return strata.paired_deltas(_results(t), "doc_id", "lang", "score", "model", "a", "b").select("lang", "pairs", F.round("delta", 6).alias("delta"), "wins", "losses")


@query(f"SELECT doc_id FROM {_RESULTS} GROUP BY doc_id HAVING count(score) FILTER (model = 'a') > 0 AND count(score) FILTER (model = 'b') > 0")
def suite_paired_records(t: Tables) -> DataFrame:
    return strata.paired_keys(_results(t), "doc_id", "score", "model", ["a", "b"])


@query(f"SELECT doc_id FROM {_RESULTS} GROUP BY doc_id HAVING coalesce(max(score) FILTER (model = 'a'), 0) = 1 AND coalesce(max(score) FILTER (model = 'b'), 0) = 1")
def suite_both_right(t: Tables) -> DataFrame:
    return strata.paired_keys(_results(t), "doc_id", "score", "model", ["a", "b"], true_only=True)


@query("SELECT l_returnflag AS split, l_linestatus AS setting, CAST(count(*) AS BIGINT) AS records, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def suite_totals(t: Tables) -> DataFrame:
    """Counters of each split and setting, of each split, and of all."""
    counters = t.lineitem.select(F.col("l_returnflag").alias("split"), F.col("l_linestatus").alias("setting"), F.lit(1).cast("bigint").alias("records"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("correct"))
    return strata.totals(counters, ["split", "setting"], ["records", "correct"]).select("split", "setting", "records", "correct")


@query("WITH e AS (SELECT event_id // 8 AS r, event_type <> 'error' AS there, event_id % 2 = 0 AS near FROM events), s AS (SELECT r, count(*) AS g, count(*) FILTER (there) AS p, count(*) FILTER (there AND near) AS c FROM e GROUP BY r) SELECT count(*) AS records, count(*) FILTER (g = p) AS row_matches, count(*) AS col_matches, round(sum(p) / sum(g), 6) AS micro_recall, round(avg(p / g), 6) AS macro_recall, round(100 * sum(c) / sum(p), 6) AS micro_cell_acc, round(avg(100.0 * c / nullif(p, 0)), 6) AS macro_cell_acc FROM s")
def suite_summary(t: Tables) -> DataFrame:
    """Micro and macro means over records."""
    from .columns import _answers

    made = strata.summary(align.score_tables(_answers(t)))
    return made.select("records", "row_matches", "col_matches", *(F.round(c, 6).alias(c) for c in ("micro_recall", "macro_recall", "micro_cell_acc", "macro_cell_acc")))


_SQL_SUMS = "SELECT l_returnflag AS q, l_partkey AS k, sum(l_quantity) AS v FROM lineitem WHERE {} GROUP BY 1, 2"


@query(f"WITH g AS ({_SQL_SUMS.format('l_discount < 0.08')}), p AS ({_SQL_SUMS.format('l_tax > 0.01')}), m AS (SELECT coalesce(g.q, p.q) AS q, g.v AS gv, p.v AS pv, g.k AS gk, p.k AS pk FROM g FULL JOIN p ON g.q = p.q AND g.k = p.k) SELECT q AS question, count(gk) AS gold_rows, round(count(*) FILTER (abs(pv - gv) <= 0.4) / count(gk), 6) AS accuracy, round(count(*) FILTER (gk IS NOT NULL AND pk IS NOT NULL) / count(pk), 6) AS precision_at_k, round(sqrt(avg((pv - gv) * (pv - gv))), 4) AS rmse FROM m GROUP BY q")
def suite_question_scores(t: Tables) -> DataFrame:
    """Accuracy within a tolerance, precision and error of each question's table, where the prediction asked for other
    lines."""
    sums = lambda condition: t.lineitem.filter(condition).groupBy(F.col("l_returnflag").alias("question"), F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    scored = strata.question_scores(sums("l_discount < 0.08"), sums("l_tax > 0.01"), "question", ["k"], "v")
    return scored.select("question", "gold_rows", F.round("accuracy", 6).alias("accuracy"), F.round("precision_at_k", 6).alias("precision_at_k"), F.round("rmse", 4).alias("rmse"))


@query("SELECT user_id, max(event_id) FILTER (nth = user_id % 3) AS by_place, max(event_id) FILTER (event_id % 5 = user_id % 3 AND first) AS by_number FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) = 1 AS first FROM events) GROUP BY user_id")
def chosen_attempts(t: Tables) -> DataFrame:
    """The attempt that a result chose, by place and by number."""
    listed = F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 5).alias("attempt"))))
    results = t.events.groupBy("user_id").agg(listed.alias("attempts")).withColumn("chosen_attempt", F.col("user_id") % 3)
    one = attempts.chosen(results, by_place=True).select("*", F.col("chosen.event_id").alias("by_place")).drop("chosen")
    return attempts.chosen(one).select("user_id", "by_place", F.col("chosen.event_id").alias("by_number"))


@query("SELECT event_id // 10 AS record_id, event_id AS k, value AS v FROM events WHERE event_id % 4 <> 0")
def voted_tables(t: Tables) -> DataFrame:
    """Three votes a record: rows that two have, and the value that two gave."""
    e = t.events.select(F.floor(F.col("event_id") / 10).alias("record_id"), F.col("event_id").alias("k"), F.col("value").alias("v"), F.explode(F.array(*map(F.lit, range(3)))).alias("vote"))
    said = e.filter("k % 4 <> 0 OR vote = 2").withColumn("v", F.when((F.col("vote") == 1) & (F.col("k") % 2 == 1), F.col("v") + 5).otherwise(F.col("v")))
    votes = said.groupBy("record_id", "vote").agg(F.to_json(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("rows")).withColumn("keys", F.array(F.lit("k")))
    made = vote.vote_records(votes).select("record_id", F.explode(F.from_json("rows", "array<struct<k: bigint, v: double>>")).alias("r"))
    return made.select("record_id", "r.k", "r.v")
