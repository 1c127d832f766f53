"""Query rewriting as projections over a table of questions.

Vocabularies are parameters, so the same expressions serve any register pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.functions import text as T
from daftar.operators import lexicon as X

GULF, MSA = "gulf", "msa"


def _gulf_table() -> dict[str, str]:
    return {k: v for table in X.CATEGORIES.values() for k, v in table.items()}


@dataclass(frozen=True)
class Dialect:
    """Vocabulary of one register: markers, replacements, and the two productive clitics."""

    markers: tuple[str, ...] = X.REGISTER_MARKERS
    replacements: dict[str, str] = field(default_factory=_gulf_table)
    prefix: str = X.DEMONSTRATIVE
    prefix_min: int = X.DEMONSTRATIVE_MIN
    prefix_becomes: str = X.ARTICLE
    conjunction: str = X.AND
    conjunction_blocklist: tuple[str, ...] = X.AND_BLOCKLIST


def lexicon_table(spark: SparkSession, categories: dict[str, dict[str, str]] | None = None) -> DataFrame:
    rows = [
        (key, value, name)
        for name, table in (categories or X.CATEGORIES).items()
        for key, value in table.items()
    ]
    return spark.createDataFrame(rows, "key string, value string, category string")


def lexicon_problems(lexicon: DataFrame) -> DataFrame:
    """(key, problem): conflicting values, keys not in index form, values that are keys again."""
    conflicts = lexicon.groupBy("key").agg(F.count_distinct("value").alias("n")).where("n > 1")
    conflicts = conflicts.select("key", F.lit("conflicting values").alias("problem"))
    raw = lexicon.where(F.col("key") != T.normalize_query("key"))
    raw = raw.select("key", F.lit("key not normalized").alias("problem")).distinct()
    keys = lexicon.select(F.col("key").alias("value"))
    chained = lexicon.join(keys, "value", "left_semi")
    chained = chained.select("key", F.lit("value is a key").alias("problem")).distinct()
    return conflicts.unionByName(raw).unionByName(chained)


def _keys(words: Column) -> Column:
    return F.transform(words, lambda w: T.normalize_query(w))


def _after(key: Column, start: str) -> Column:
    """What follows the first ``len(start)`` characters, however long."""
    return F.substr(key, F.lit(len(start) + 1))


def _in(value: Column, words) -> Column:
    return value.isin(*words) if words else F.lit(False)


def detect_register(question, dialect: Dialect = Dialect()) -> Column:
    """The dialect's register when any token is unmistakable, else the standard one."""

    def marked(key: Column) -> Column:
        clitic = key.startswith(dialect.prefix) & (F.length(key) >= dialect.prefix_min)
        bare = _after(key, dialect.conjunction)
        joined = key.startswith(dialect.conjunction) & _in(bare, dialect.markers)
        return _in(key, dialect.markers) | clitic | joined

    found = F.exists(_keys(T.tokens(question)), marked)
    return F.when(found, F.lit(GULF)).otherwise(F.lit(MSA))


def rewrite(question, dialect: Dialect = Dialect()) -> Column:
    """Replace known dialect tokens; every other character is kept as typed."""
    pairs = [F.lit(s) for item in dialect.replacements.items() for s in item]
    table = F.create_map(*pairs)

    def direct(key: Column) -> Column:
        rest = _after(key, dialect.prefix)
        clitic = key.startswith(dialect.prefix) & (F.length(key) >= dialect.prefix_min)
        return F.coalesce(
            F.try_element_at(table, key),
            F.when(clitic, F.concat(F.lit(dialect.prefix_becomes), rest)),
        )

    def replaced(part: Column) -> Column:
        key = part.key
        bare = _after(key, dialect.conjunction)
        strips = (
            key.startswith(dialect.conjunction)
            & (F.length(key) > 2)
            & ~_in(bare, dialect.conjunction_blocklist)
        )
        joined = F.when(strips, F.concat(F.lit(dialect.conjunction), direct(bare)))
        return F.coalesce(direct(key), joined, part.raw)

    parts = F.regexp_extract_all(T._col(question), F.lit(rf"({T.WORD}|[^\p{{L}}\p{{N}}_]+)"), 1)
    keyed = F.transform(parts, lambda p: F.struct(p.alias("raw"), T.normalize_query(p).alias("key")))
    return F.array_join(F.transform(keyed, replaced), "")


@dataclass(frozen=True)
class Clauses:
    """Vocabulary for splitting a two-part question."""

    conjunction: str = X.AND
    stems: tuple[str, ...] = X.CLAUSE_STEMS
    asking: tuple[str, ...] = X.ASKING
    proclitics: tuple[str, ...] = X.CONJUNCTIONS
    comma: str = "،"
    sentence_end: str = "؟?"
    trim: str = X.SEGMENT_TRIM
    min_words: int = X.MIN_SEGMENT_WORDS


def decompose(question, clauses: Clauses = Clauses()) -> Column:
    """The parts of a question that ask different things, or the question alone.

    Splits at sentence ends, and at a conjunction that opens a new asking clause.
    """
    question = T._col(question)
    space = rf"[{T.SPACE}]"
    stems = "|".join(clauses.stems)
    boundary = (
        rf"[{clauses.sentence_end}{clauses.comma}]{space}*(?={clauses.conjunction})"
        rf"|{space}+(?={clauses.conjunction}(?:{stems})(?![\p{{L}}\p{{N}}_]))"
    )
    sentences = F.split(question, rf"[{clauses.sentence_end}]+")
    raw = F.flatten(F.transform(sentences, lambda s: F.split(s, boundary)))
    trimmed = F.transform(raw, lambda s: F.trim(s, F.lit(clauses.trim)))
    segments = F.filter(trimmed, lambda s: F.size(T.tokens(s)) >= clauses.min_words)

    def asked(segment: Column) -> Column:
        keys = _keys(T.tokens(segment))
        glued = F.filter(keys, lambda k: _in(F.substring(k, 1, 1), clauses.proclitics))
        bare = F.transform(glued, lambda k: F.substr(k, F.lit(2)))
        words = F.array(*map(F.lit, clauses.asking))
        return F.array_intersect(F.concat(keys, bare), words)

    asking = F.filter(
        F.transform(segments, lambda s: F.struct(s.alias("text"), asked(s).alias("words"))),
        lambda part: F.size(part.words) > 0,
    )
    distinct = F.array_distinct(F.flatten(F.transform(asking, lambda part: part.words)))
    splits = (F.size(asking) >= 2) & (F.size(distinct) >= 2)
    return F.when(splits, F.transform(asking, lambda part: part.text)).otherwise(F.array(question))


def dedupe(queries: Column, cap: int = X.MAX_SEARCH_QUERIES) -> Column:
    """Stripped, non-blank, first occurrences, capped."""
    stripped = F.transform(queries, lambda q: T.strip(q))
    return F.slice(F.array_distinct(F.filter(stripped, lambda q: q != "")), 1, cap)


def _plan_columns(df: DataFrame, queries: Column, rewritten: Column, strategy: Column) -> DataFrame:
    return df.select(
        "query_id",
        "original",
        queries.alias("search_queries"),
        "register",
        rewritten.alias("rewritten"),
        strategy.alias("strategy"),
    )


def plan_noop(questions: DataFrame, dialect: Dialect = Dialect()) -> DataFrame:
    """One stripped query plus the register; the typed question is kept as it came."""
    base = questions.select(
        "query_id", F.col("question").alias("original"), detect_register("question", dialect).alias("register")
    )
    return _plan_columns(base, F.array(T.strip("original")), F.lit(None).cast("string"), F.lit("noop"))


def plan_rules(
    questions: DataFrame,
    dialect: Dialect = Dialect(),
    clauses: Clauses = Clauses(),
    decompose_enabled: bool = False,
) -> DataFrame:
    """Original question, its rewrite when that changes anything, and optionally its parts."""
    base = questions.select("query_id", T.strip("question").alias("original"))
    base = base.withColumn("register", detect_register("original", dialect))
    is_gulf = F.col("register") == GULF
    base = base.withColumn("_rewrite", F.when(is_gulf, rewrite("original", dialect)))
    rewritten = F.when(F.col("_rewrite") != F.col("original"), F.col("_rewrite"))
    queries = F.array_compact(F.array("original", rewritten))
    if decompose_enabled:
        parts = decompose("original", clauses)
        rewritten_parts = F.transform(parts, lambda p: F.when(is_gulf, rewrite(p, dialect)).otherwise(p))
        none = F.array().cast("array<string>")
        queries = F.concat(queries, F.when(F.size(parts) > 1, rewritten_parts).otherwise(none))
    return _plan_columns(base, dedupe(queries), rewritten, F.lit("rules"))


def plan_from_replies(
    replies: DataFrame, dialect: Dialect = Dialect(), clauses: Clauses = Clauses()
) -> DataFrame:
    """Plans read from stored model replies (query_id, question, reply); bad ones fall back to rules."""
    parsed = F.from_json(
        F.nullif(F.regexp_extract("reply", r"(?s)\{.*\}", 0), F.lit("")),
        "rewritten string, sub_queries array<string>, _bad string",
        {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"},
    )
    known = replies.select("query_id", "question", parsed.alias("_p"))
    good = F.col("_p").isNotNull() & F.col("_p._bad").isNull()
    rules = plan_rules(replies.select("query_id", "question"), dialect, clauses)
    base = known.select(
        "query_id",
        T.strip("question").alias("original"),
        good.alias("_good"),
        T.strip(F.coalesce("_p.rewritten", F.lit(""))).alias("_rewrite"),
        F.coalesce("_p.sub_queries", F.array().cast("array<string>")).alias("_subs"),
    )
    base = base.withColumn("register", detect_register("original", dialect))
    rewritten = F.when((F.col("_rewrite") != "") & (F.col("_rewrite") != F.col("original")), F.col("_rewrite"))
    queries = F.concat(F.array_compact(F.array("original", rewritten)), "_subs")
    replied = _plan_columns(base.where("_good"), dedupe(queries), rewritten, F.lit("llm"))
    failed = base.where(~F.col("_good")).select("query_id")
    return replied.unionByName(rules.join(failed, "query_id", "left_semi"))


def fan_out(plans: DataFrame) -> DataFrame:
    """One row per search query: (query_id, list_id, question)."""
    return plans.select("query_id", F.posexplode("search_queries").alias("list_id", "question"))


def register_confusion(tagged: DataFrame, dialect: Dialect = Dialect()) -> DataFrame:
    """One row of confusion counts, recall and precision of the detector against the tag."""
    seen = tagged.select(
        (F.col("dialect_tag") == GULF).alias("truth"),
        (detect_register("question", dialect) == GULF).alias("said"),
    )
    counts = seen.agg(
        F.count_if(F.col("truth") & F.col("said")).alias("tp"),
        F.count_if(~F.col("truth") & F.col("said")).alias("fp"),
        F.count_if(F.col("truth") & ~F.col("said")).alias("fn"),
        F.count_if(~F.col("truth") & ~F.col("said")).alias("tn"),
    )
    return counts.select(
        "*",
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
    )
