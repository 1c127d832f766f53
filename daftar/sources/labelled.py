"""Labelled pairs, cached scores and baselines: reading, checking, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.functions import text as T
from daftar.sources.corpus import fail_when

FIELDS = ("id", "question", "dialect_tag", "answer", "source_doc", "source_chunk_ids")


def pair_reject_reason(tags: tuple[str, ...] = S.DIALECT_TAGS) -> Column:
    """First rule a pair breaks, or NULL; works on the columns of :data:`FIELDS`."""

    def blank(name: str) -> Column:
        return F.coalesce(T.is_blank(name), F.lit(True))

    ids = F.col("source_chunk_ids")
    prefix = F.concat(F.col("source_doc"), F.lit(":"))
    rules = [
        (blank("id"), "id: blank"),
        (blank("question"), "question: blank"),
        (blank("answer"), "answer: blank"),
        (blank("source_doc"), "source_doc: blank"),
        (~F.coalesce(F.col("dialect_tag").isin(*tags), F.lit(False)), "dialect_tag: unknown"),
        (ids.isNull(), "source_chunk_ids: not a list"),
        (F.exists(ids, lambda c: F.coalesce(T.is_blank(c), F.lit(True))), "source_chunk_ids: blank id"),
        (F.exists(ids, lambda c: ~c.startswith(prefix)), "source_chunk_ids: other document"),
    ]
    return F.coalesce(*(F.when(broken, F.lit(reason)) for broken, reason in rules))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files of any size, lines counted from 1 in each file.

    A file is read in as many tasks as it has splits. Lines are numbered in two passes: the first
    counts the lines of each split, the second adds what lies before the split. Both read the same
    splits in the same order, which is what makes a row's number within its task the same in both.
    """
    split = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
    rows = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_name").alias("file"), *split, F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line")
    )
    # One row per split: the number of its first row, and how many lines the splits before it have.
    splits = rows.groupBy("_path", "_start").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return rows.join(splits, ["_path", "_start"]).select("file", number.alias("line_no"), "line")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Every non-blank line of JSONL files: file, line, the pair's fields and ``reject_reason``."""
    raw = numbered_lines(spark, path).where(~T.is_blank("line"))
    parsed = raw.select("file", "line_no", "line", F.try_parse_json("line").alias("_v"))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", kind)

    typed = parsed.select(
        "file",
        "line_no",
        F.col("_v").isNull().alias("_broken"),
        F.schema_of_variant("_v").startswith("OBJECT").alias("_object"),
        *(
            F.when(F.schema_of_variant(F.variant_get("_v", f"$.{name}", "variant")) == "STRING", field(name, "string")).alias(name)
            for name in ("id", "question", "dialect_tag", "answer", "source_doc", "derived_from")
        ),
        F.when(
            F.schema_of_variant(F.variant_get("_v", "$.source_chunk_ids", "variant")).isin("ARRAY<STRING>", "ARRAY<VOID>"),
            field("source_chunk_ids", "array<string>"),
        ).alias("source_chunk_ids"),
    )
    reason = (
        F.when(F.col("_broken"), "invalid JSON")
        .when(~F.col("_object"), "not an object")
        .otherwise(pair_reject_reason())
    )
    return typed.withColumn("reject_reason", reason).drop("_broken", "_object")


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Valid pairs sorted by id, from one file or a glob; any bad or repeated pair fails, naming its line."""
    pairs = read_pairs(spark, path)
    where = F.concat_ws(":", "file", F.col("line_no").cast("string"))
    good = fail_when(
        pairs, F.col("reject_reason").isNotNull(), F.concat_ws(": ", where, "reject_reason")
    )
    # The key is never null: a join on the id itself would filter rows without one before they are checked.
    good = good.withColumn("_key", F.coalesce("id", F.lit("")))
    repeats = good.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max(where).alias("_at"))
    message = F.concat(F.col("_at"), F.lit(": duplicate pair id "), F.col("_key"))
    unique = fail_when(repeats, F.col("_n") > 1, message).select("_key")
    return good.join(unique, "_key").select(*FIELDS, "derived_from").orderBy("id")


def save_pairs(pairs: DataFrame, path: str) -> None:
    """JSONL files that are sorted by id in the order of their names, keys in alphabetical order; repeated ids fail.

    A labelled set that fits one task is one file; a larger one has a file for each range of ids.
    """
    repeats = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    unique = fail_when(repeats, F.col("_n") > 1, F.concat(F.lit("duplicate pair id "), F.col("id")))
    ordered = pairs.join(unique.select("id"), "id").select(*sorted(FIELDS))
    ordered.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(path)


SCORES = "pair_id string, answerable boolean, top_score double"


def save_scores(scored: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Scores at six decimals next to a one-row metadata table."""
    rows = scored.select("pair_id", "answerable", F.round("top_score", 6).alias("top_score"))
    rows.write.mode("overwrite").json(f"{path}/scores")
    items = sorted(meta.items())
    scored.sparkSession.createDataFrame(items, "key string, value string").write.mode("overwrite").json(f"{path}/meta")


def check_scores(records: DataFrame) -> DataFrame:
    """(index, record JSON) -> typed scores with ``reject_reason`` naming what is wrong."""
    v = F.try_parse_json("record")
    parsed = records.select("index", v.alias("_v"))
    has = {n: F.try_variant_get("_v", f"$.{n}", "string").isNotNull() for n in ("pair_id", "answerable", "top_score")}
    number = F.try_variant_get("_v", "$.top_score", "string").try_cast("double")
    reason = F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), "not an object")
    for name, present in has.items():
        reason = reason.when(~present, f"missing {name}")
    reason = reason.when(number.isNull(), "top_score is not a number")
    return parsed.select(
        "index",
        F.try_variant_get("_v", "$.pair_id", "string").alias("pair_id"),
        F.try_variant_get("_v", "$.answerable", "boolean").alias("answerable"),
        number.alias("top_score"),
        reason.alias("reject_reason"),
    )


def load_scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scores and metadata; a malformed record fails the job."""
    records = spark.read.text(f"{path}/scores").select(F.lit(None).cast("long").alias("index"), F.col("value").alias("record"))
    checked = check_scores(records)
    good = fail_when(checked, F.col("reject_reason").isNotNull(), F.concat(F.lit("scores: "), F.col("reject_reason")))
    meta = spark.read.schema("key string, value string").json(f"{path}/meta")
    return good.select("pair_id", "answerable", "top_score"), meta


def baseline_entry(baseline: DataFrame, key: str) -> DataFrame:
    """Rows of one recorded configuration; an unknown key fails the job."""
    rows = baseline.where(F.col("entry_key") == key)
    found = rows.agg(F.count(F.lit(1)).alias("_n"))
    checked = fail_when(found, F.col("_n") == 0, F.lit(f"no baseline entry {key!r}"))
    return rows.join(F.broadcast(checked.select((F.col("_n") > 0).alias("_ok")))).drop("_ok")  # one row


def update_baseline(baseline: DataFrame, entry: DataFrame) -> DataFrame:
    """The baseline with one or more entries replaced; all others stay as they are."""
    kept = baseline.join(entry.select("entry_key").distinct(), "entry_key", "left_anti")
    return kept.unionByName(entry)


def merge_sections(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(section, body): new sections win, sections only the old document has are preserved."""
    joined = existing.select("section", F.col("body").alias("_old")).join(
        new.select("section", F.col("body").alias("_new"), F.lit(True).alias("_is_new")), "section", "full"
    )
    return joined.select("section", F.when(F.col("_is_new"), F.col("_new")).otherwise(F.col("_old")).alias("body"))
