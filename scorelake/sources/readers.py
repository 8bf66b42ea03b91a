"""Readers: event tables, records in JSON and JSONL, templates, benchmark rows and predictions.

Schemas are declared.  Paths are opened by Spark's readers, so any store that Spark reaches will do;
only template files, which are program text, are parsed on the driver.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the ball-by-ball table, in the order its files must have (fixed values).
BALL_SCHEMA = (
    "raw_data string, overs double, runs string, team_runs double, commentary string, bowler string, batsman string, batsman_runs double, "
    "batsman_fours int, batsman_sixes int, batsman_bowls_faced int, bowler_bowls_done int, bowler_runs_given double, bowler_wickets int, dismissal string, runs_given_bool int"
)
#: Columns of the second event shape.
EVENT_SCHEMA = "event_id bigint, minute int, team string, player string, event_type string, description string"
#: Text columns that a schema preview leaves out.
PREVIEW_DROPS = ("raw_data", "commentary", "dismissal", "team_runs", "runs_given_bool")
ENVELOPE_KEYS = ("final", "records", "items")


def read_events(spark: SparkSession, path: str | Sequence[str], schema: str = BALL_SCHEMA) -> DataFrame:
    """CSV event tables (quoted text may span lines) with ``source_id``, the file of each row."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True)
    return reader.csv(path if isinstance(path, str) else list(path)).withColumn("source_id", F.col("_metadata.file_path"))


def list_sources(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` and ``bytes`` of the CSV files below ``folder``, by path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    return files.select("path", F.col("length").alias("bytes")).orderBy("path")


def preview(df: DataFrame, rows: int = 5, seed: int = 0) -> tuple[list[tuple[str, str]], DataFrame]:
    """Names with types, and a seeded sample of ``rows`` rows, without the long text columns."""
    kept = df.drop(*PREVIEW_DROPS)
    return kept.dtypes, kept.orderBy(F.rand(seed)).limit(rows)


def head_columns(df: DataFrame, columns: Sequence[str], rows: int) -> DataFrame:
    """First rows of the named columns; a column that the table lacks is null."""
    return df.limit(rows).select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def read_records(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Records of a JSONL file, or of a JSON file that is an array or an envelope around one."""
    if path.endswith(".jsonl"):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    df = spark.read.option("multiLine", True).json(path)
    arrays = [k for k in ENVELOPE_KEYS if k in df.columns and isinstance(df.schema[k].dataType, T.ArrayType)]
    if not arrays:
        return df
    return df.select(F.inline(F.col(arrays[0])))


def with_record_ids(df: DataFrame, candidates: Sequence[str] = ("record_id", "id", "item_id"), order: str | None = None) -> DataFrame:
    """``record_id`` from the first column that has one, else ``r`` and the row's place in ``order``."""
    from ..operators.lineage import with_row_ids

    there = [F.col(c).cast("string") for c in candidates if c in df.columns]
    if order is None:
        return df.withColumn("record_id", F.coalesce(*there))
    placed = with_row_ids(df, [order], "__place")
    return placed.withColumn("record_id", F.coalesce(*there, F.concat(F.lit("r"), F.col("__place").cast("string")))).drop("__place")


def check_benchmark(df: DataFrame) -> DataFrame:
    """``df`` with ``problem``: null for rows with context, question, answer and a unique record id."""
    counts = df.groupBy("record_id").agg(F.count(F.lit(1)).alias("__k"))
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    problem = F.when(blank("record_id"), "no record_id").when(blank("context"), "no context").when(blank("question"), "no question").when(F.col("answer").isNull(), "no answer").when(F.col("__k") > 1, "repeated record_id")
    return df.join(counts, "record_id", "left").withColumn("problem", problem).drop("__k")


def parse_templates(text: str, name: str = "question_templates") -> list[dict]:
    """Templates of a Python file that assigns ``name`` a literal, or of JSON text.  Nothing is run."""
    try:
        found = json.loads(text)
    except ValueError:
        values = [n.value for n in ast.parse(text).body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == name for t in n.targets)]
        if not values:
            raise ValueError(f"no {name} in the template file") from None
        found = ast.literal_eval(values[-1])
    found = next((found[k] for k in ENVELOPE_KEYS if k in found), []) if isinstance(found, dict) else found
    return [dict(x) for x in found if isinstance(x, dict)]


#: Columns of a template table.
TEMPLATE_SCHEMA = "id string, question string, sql string, description string, variables array<string>, paraphrases array<string>, primary_key array<string>"


def list_field(value: object) -> list[str]:
    """List from a list, a set, the text of a list, or names separated by commas or blanks."""
    if value is None:
        return []
    if isinstance(value, list | tuple | set | frozenset):
        return [str(v) for v in value]
    text = str(value).strip()
    if text[:1] in "[(" and text:
        try:
            return [str(v) for v in ast.literal_eval(text)]
        except (ValueError, SyntaxError):
            text = text.strip("[]()")
    return [x.strip(" '\"") for x in text.replace(",", " ").split() if x.strip(" '\"")]


def read_templates(spark: SparkSession, paths: Iterable[str], name: str = "question_templates") -> DataFrame:
    """Union of template files under one schema; other key names are mapped."""
    rows = []
    for path in paths:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        for i, t in enumerate(parse_templates(text, name)):
            rows.append((str(t.get("id", t.get("template_id", t.get("item_id", i)))), t.get("question"), t.get("sql") or t.get("query") or t.get("original_sql"), t.get("exp") or t.get("description"), *(list_field(t.get(k)) for k in ("variables", "paraphrases", "primary_key"))))
    return spark.createDataFrame(rows, TEMPLATE_SCHEMA)


def final_nodes(payload: object, path: str = "$") -> list[tuple[str, object]]:
    """Every ``final`` node at any depth of a JSON value, with its path."""
    out = []
    if isinstance(payload, dict):
        for key, value in payload.items():
            out += [(f"{path}.{key}", value)] if key == "final" else final_nodes(value, f"{path}.{key}")
    elif isinstance(payload, list):
        for i, value in enumerate(payload):
            out += final_nodes(value, f"{path}[{i}]")
    return out


def read_sql_file(spark: SparkSession, path: str) -> DataFrame:
    """Statements of a SQL file (cut at ``-- Query`` lines, else at empty lines): ``nth``, ``sql``, ``sha256``."""
    whole = spark.read.text(path, wholetext=True)
    marked = F.col("value").rlike(r"(?m)^--\s*Query")
    parts = F.when(marked, F.split("value", r"(?m)^--\s*Query[^\n]*$")).otherwise(F.split("value", r"\n\s*\n"))
    cut = whole.select(F.posexplode(F.filter(F.transform(parts, F.trim), lambda x: F.regexp_replace(x, r"\s", "") != "")).alias("nth", "sql"))
    return cut.withColumn("sql", F.regexp_replace("sql", r"^\s+|\s+$", "")).withColumn("sha256", F.sha2("sql", 256))


def latest_run(spark: SparkSession, folder: str, pattern: str = "predictions*.jsonl") -> str | None:
    """Path of the newest prediction file below ``folder``: by folder name, then by time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    best = files.agg(F.max_by("path", F.struct(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "modificationTime", "path")).alias("p")).first()
    return best["p"] if best else None
