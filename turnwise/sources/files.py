"""JSON lines, word lists, documents and logs: what is read and written besides Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: The columns of a summary, in order; roles of training turns.
SUMMARY_FIELDS = "model strategy n n_pass adherence robustness n_adv n_adv_pass mean_per_100_words softened anchor_breaks top_violations n_judged n_judge_pass judge_pass_rate".split()
ROLES = ["system", "user", "assistant"]

SCENARIO = (
    "id string, category string, notice_text string, turns array<string>, judge_note string, "
    "metadata struct<operative_deadline:string,adverse_action:boolean,amounts:array<string>,must_actions:array<string>,may_rights:array<string>>"
)
_COUNTS = "map<string,bigint>"
_TURN = f"struct<word_count:bigint,violations:bigint,violations_per_100_words:double,by_rule:{_COUNTS},advisory:bigint,advisory_by_rule:{_COUNTS},quoted_ratio:double,new_taught_terms:array<string>,strict_pass:boolean>"
RECORD = (
    "model string, strategy string, scenario_id string, category string, turns array<struct<role:string,content:string>>, "
    f"checker struct<turns:array<{_TURN}>,total_words:bigint,total_violations:bigint,total_advisory:bigint,violations_per_100_words:double,by_rule:{_COUNTS},advisory_by_rule:{_COUNTS},strict_pass:boolean>, "
    "judge struct<turn_verdicts:array<struct<turn_index:bigint,pass:boolean,violation:string,reasoning:string>>,conversation_pass:boolean,summary:string>"
)
CONVERSATION = "id string, messages array<struct<role:string,content:string>>"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """A row for each line by a declared schema; blank lines are skipped, a line that is no JSON fails the job.

    Maps of counts stay maps: inferred, each would become a struct of the keys seen.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def in_file_order(rows: DataFrame, name: str = "line_order") -> DataFrame:
    """Rows of files with a struct that orders them as their lines are: file, start of the split, place in it."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("i"))
    return rows.withColumn(name, place)


def read_runs(spark: SparkSession, folders: list[str], schema: str | StructType = RECORD) -> DataFrame:
    """Records of several runs with run_order, so that a later run's record of a key can win."""
    runs = [in_file_order(read_jsonl(spark, f, schema)).withColumn("run_order", F.struct(F.lit(i).alias("run"), F.col("line_order"))).drop("line_order") for i, f in enumerate(folders)]
    all_runs = runs[0]
    for r in runs[1:]:
        all_runs = all_runs.unionByName(r)
    return all_runs


def checked_unique(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, if no key occurs twice; else an error that names some."""
    twice = [r[key] for r in rows.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
    if twice:
        raise ValueError(f"{key} occurs more than once: {', '.join(map(str, twice))}")
    return rows


def conversation_problem(messages: Column) -> Column:
    """Why a conversation can't be trained on; null if it can."""
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "no messages")
        .when(F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(ROLES), F.lit(False)) | m["content"].isNull()), "bad turn")
        .when(~F.exists(messages, lambda m: m["role"] == "assistant"), "no assistant turn")
    )


def read_conversations(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): conversations to train on, and the rest with `problem` and where they stand."""
    rows = in_file_order(read_jsonl(spark, path, CONVERSATION)).withColumn("problem", conversation_problem(F.col("messages")))
    return rows.where("problem is null").drop("problem", "line_order"), rows.where("problem is not null")


def read_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON document a file, over any number of lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, null fields left out; as many files as partitions."""
    rows.write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, fields: list[str] | None = None, mode: str = "errorifexists") -> None:
    """CSV with a header and the fields in this order; null is an empty cell. Summaries come in one file."""
    named = rows.select(*(fields or rows.columns))
    (named.coalesce(1) if fields else named).write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """More rows of a CSV log of steps."""
    rows.write.mode("append").option("header", True).csv(path)


def write_outputs(records: DataFrame, summary: DataFrame, path: str) -> None:
    """transcripts/ and judge_verdicts/ as JSON lines, results/ as CSV."""
    write_jsonl(records, f"{path}/transcripts")
    write_jsonl(records.where("judge is not null").select("model", "strategy", "scenario_id", "judge"), f"{path}/judge_verdicts")
    write_csv(summary.orderBy("model", "strategy"), f"{path}/results", SUMMARY_FIELDS)


def write_dataset(dialogs: DataFrame, path: str) -> None:
    """train/ has accepted dialogs, rejected/ a row for each rejected reply with the rewrite that passed, if any."""
    write_jsonl(dialogs.where("accepted").drop("rejected"), f"{path}/train")
    write_jsonl(dialogs.select("dialog_id", F.explode("rejected").alias("r")).select("dialog_id", "r.*"), f"{path}/rejected")


def freeze_words(words: DataFrame, path: str) -> None:
    """forms/ has the words, each once, a line each, in order over its files; provenance/ their number and hash."""
    from turnwise.operators.lexicon import provenance

    words.select(F.col("word").cast(StringType()).alias("value")).distinct().orderBy("value").write.text(f"{path}/forms")
    provenance(words).write.json(f"{path}/provenance")


def read_or_build_words(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """(word): the words that freeze_words() wrote to `path`, which are built and written first if they aren't there."""
    forms = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/forms/_SUCCESS")
    if not forms.getFileSystem(spark._jsc.hadoopConfiguration()).exists(forms):
        freeze_words(build(), path)
    from turnwise.operators.lexicon import read_words

    return read_words(spark, f"{path}/forms")


def read_open(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record variant): JSON lines without a declared schema; every key of every record is kept, with its own type."""
    return spark.read.option("singleVariantColumn", "record").json(path)


def fields(record: Column, wanted: dict[str, tuple[str, str]]) -> list[Column]:
    """Columns of a variant by name: (path, type) each; a record without the path, or with what can't be cast, has null."""
    return [F.try_variant_get(record, path, kind).alias(name) for name, (path, kind) in wanted.items()]


def _told(metrics: Observation, names: list[str]) -> dict[str, int]:
    """The metrics of a write; zeros where Spark left them out, as it does where it can tell that no row comes by."""
    try:
        return metrics.get
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception):
            raise
        return dict.fromkeys(names, 0)


def write_checked(rows: DataFrame, path: str, keys: list[str], rules: dict[str, Column]) -> dict[str, int]:
    """Writes the rows that pass all rules, of those with equal keys one, as Parquet, and says what came of all in the same pass.

    read, dropped by each rule (a null counts as failed), valid, written and repeated: rows that
    passed but had the keys of another. Counts are made where rows go by, so nothing is read twice; a
    stage that is done again for a lost executor may be counted again.
    """
    seen, valid, written = Observation(), Observation(), Observation()
    ok = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    rows = rows.observe(seen, F.count(F.lit(1)).alias("read"), *[F.count_if(~c).alias(name) for name, c in ok.items()])
    for c in ok.values():
        rows = rows.where(c)
    rows = rows.observe(valid, F.count(F.lit(1)).alias("valid")).dropDuplicates(keys).observe(written, F.count(F.lit(1)).alias("written"))
    rows.write.parquet(path)
    names = (seen, ["read", *ok]), (valid, ["valid"]), (written, ["written"])
    found = {k: v for told, of in names for k, v in _told(told, of).items()}
    return found | {"repeated": found["valid"] - found["written"]}


def write_batches(rows: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each batch of a stream to a folder of its own as JSON lines; a batch that is done again replaces itself."""
    return rows.writeStream.foreachBatch(lambda batch, n: write_jsonl(batch, f"{path}/batch={n}", "overwrite")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
