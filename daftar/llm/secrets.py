"""Secret scans: a random forest takes false positives out of candidate findings.

Candidates are long runs of the characters that keys are made of. Each is described by its length,
its character transitions, how much of it dictionary words cover, its place in a path, and the
words beside it. A random forest fitted on labelled findings decides. The dictionary and the letter
pairs that tell words from keys are counted over all documents; the forest is fitted on a bounded
sample of the labelled findings.

Everything is DataFrame and SQL operations and Spark's own forest.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import LOWER, Scratch, ascii_lower

CANDIDATE = r"[A-Za-z0-9_+/-]{16,}={0,2}"
#: Words beside a finding that name a secret. Fixed values.
NAMES = (
    "token", "secret", "password", "passwd", "pwd", "passphrase", "apikey", "api_key", "api-key", "key", "auth",
    "authorization", "bearer", "credential", "credentials", "private", "access", "client_secret",
)
FEATURES = (
    "size", "digits", "uppers", "changes", "distinct", "pair_score", "longest_run", "covered", "slashes", "dashes",
    "in_path", "assigned", "quoted", "named", "name_bucket", "next_bucket",
)
DICTIONARY = 1024
SAMPLE = 20_000
REDACTED = "[secret]"
_CONTEXT = 48
_ALPHABET = LOWER + "0123456789"


def candidates(docs: DataFrame) -> DataFrame:
    """A row per candidate: doc_id, row, ordinal, value, left and right context, and lengths for its place.

    ``row`` tells apart rows that repeat a doc_id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    found = F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1))
    gaps = F.split("text", CANDIDATE)
    hits = rows.where(F.regexp_like("text", F.lit(CANDIDATE))).select("doc_id", "row", found.alias("values"), gaps.alias("gaps"))
    pair = lambda v, k: F.struct(
        v.alias("value"), F.length(F.get("gaps", k)).alias("gap"), F.right(F.get("gaps", k), F.lit(_CONTEXT)).alias("left"),
        F.left(F.get("gaps", k + 1), F.lit(_CONTEXT)).alias("right"),
    )
    return hits.select("doc_id", "row", F.posexplode(F.transform("values", pair)).alias("ordinal", "c")).select(
        "doc_id", "row", "ordinal", "c.*"
    )


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The ``size`` most frequent words of 4 to 12 letters in all documents, as a bounded list."""
    words = docs.select(F.explode(F.split(ascii_lower("text"), "[^a-z]+")).alias("word")).where("length(word) BETWEEN 4 AND 12")
    common = words.groupBy("word").count().where("count > 1").orderBy(F.desc("count"), "word").limit(size)
    return [r["word"] for r in common.collect()]


def letter_pairs(docs: DataFrame) -> dict[str, float]:
    """Log share of each pair of ASCII letters and digits in the words of all documents; at most 36 * 36 pairs.

    Every place of every word counts. Equal words are one row before they are cut into pairs.
    """
    words = docs.select(F.explode(F.split(ascii_lower("text"), "[^a-z0-9]+")).alias("word")).where("length(word) >= 2")
    words = words.groupBy("word").agg(F.count("*").alias("n"))
    places = F.sequence(F.lit(1), F.length("word") - 1)
    pairs = words.select("n", F.explode(F.transform(places, lambda k: F.substring("word", k, F.lit(2)))).alias("pair"))
    rows = pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in rows) or 1
    return {r["pair"]: math.log(r["n"] / total) for r in rows}


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def features(found: DataFrame, common: list[str], pairs: dict[str, float]) -> DataFrame:
    """``found`` with the columns of ``FEATURES``, all doubles."""
    value, left, right = F.col("value"), F.col("left"), F.col("right")
    low = ascii_lower(value)
    # Pairs as one array, by the places of their characters in the alphabet (0: none of it).
    worst = min(pairs.values(), default=0.0) - 2.0
    width = len(_ALPHABET) + 1
    known = F.array(*(F.lit(pairs.get(a + b, worst)) for a in ["", *_ALPHABET] for b in ["", *_ALPHABET]))
    codes = F.transform(F.split(low, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    first, second = F.slice(codes, 1, F.length(value) - 1), F.slice(codes, 2, F.length(value) - 1)
    scores = F.zip_with(first, second, lambda x, y: F.get(known, x * width + y))
    score = F.aggregate(scores, F.lit(0.0), lambda total, x: total + x) / (F.length(value) - 1)
    rest = F.regexp_replace(low, "|".join(sorted(common, key=len, reverse=True)), "") if common else low
    name = ascii_lower(F.regexp_extract(left, r"""([A-Za-z_-]+)["']?\s*[:=]*\s*["']?$""", 1))
    after = ascii_lower(F.regexp_extract(right, r"""^["']?\s*([A-Za-z_-]+)""", 1))
    one = lambda condition: F.coalesce(condition.cast("double"), F.lit(0.0))
    changes = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "\x01"), "[A-Z]+", "\x02"), "[a-z]+", "\x03"))
    computed = {
        "size": F.length(value), "digits": _share(value, "[^0-9]"), "uppers": _share(value, "[^A-Z]"),
        "changes": changes / F.length(value), "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "pair_score": score,
        "longest_run": F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), F.length)) / F.length(value),
        "covered": 1 - F.length(rest) / F.length(value),
        "slashes": _share(value, "[^/]"), "dashes": _share(value, "[^_-]"),
        "in_path": one(F.regexp_like(left, F.lit(r"[/\\.@]$")) | F.regexp_like(right, F.lit(r"^[/\\.@]\w"))),
        "assigned": one(F.regexp_like(left, F.lit(r"""[:=]\s*["']?$"""))), "quoted": one(F.regexp_like(left, F.lit("""["']$"""))),
        "named": one(name.isin(*NAMES)), "name_bucket": F.pmod(F.xxhash64(name), F.lit(8)), "next_bucket": F.pmod(F.xxhash64(after), F.lit(8)),
    }
    return found.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in computed.items()})


def weak_labels(found: DataFrame) -> DataFrame:
    """Findings that are labelled beyond doubt: ``found`` with ``label`` 1 or 0, the others left out.

    A secret is named and assigned, or has the fixed form of a provider. No secret is a run of
    letters alone, a number, or a path of words.
    """
    value, left = F.col("value"), ascii_lower("left")
    named = F.regexp_like(left, F.lit(rf"""(?:{"|".join(NAMES)})["']?\s*[:=]\s*["']?$""")) & F.regexp_like(value, F.lit("[0-9]"))
    form = F.regexp_like(value, F.lit(r"^(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})$"))
    plain = F.regexp_like(value, F.lit(r"^(?:[A-Za-z]+|[0-9]+|[a-z/_-]+)$"))
    label = F.when(named | form, 1.0).when(plain, 0.0)
    return found.withColumn("label", label).where("label IS NOT NULL")


def fit(labelled: DataFrame, scratch: Scratch, sample: int = SAMPLE, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest from the columns of ``FEATURES`` and ``label``; None unless both labels occur.

    Equal findings count once. Of each label, the share that leaves about ``sample`` findings is
    drawn by a hash of the value, so the sample does not depend on how the table is dealt out.
    """
    known = labelled.select("value", "label", *FEATURES).distinct()
    known = scratch.put(known, "labelled")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if set(sizes) != {0.0, 1.0}:
        return None
    share = F.when(F.col("label") == 1.0, min(1.0, sample / sizes[1.0])).otherwise(min(1.0, sample / sizes[0.0]))
    drawn = known.where(F.shiftrightunsigned(F.xxhash64("value", F.lit(seed)), 12) / float(1 << 52) < share)
    # One sorted partition of bounded size: the forest draws by partition, so this makes it repeatable.
    # Behind a shuffle, so that the drawing itself runs in all tasks.
    ready = drawn.repartition(1).sortWithinPartitions("label", *FEATURES)
    weights = {label: sum(sizes.values()) / (2 * n) for label, n in sizes.items()}
    ready = ready.withColumn("weight", F.when(F.col("label") == 1.0, weights[1.0]).otherwise(weights[0.0]))
    ready = scratch.put(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(ready).select("features", "label", "weight"), "sample")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=24, maxDepth=7, maxBins=32, seed=seed,
        featureSubsetStrategy="sqrt", probabilityCol="probability",
    )
    return forest.fit(ready)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """A row per candidate: doc_id, row, ordinal, start, value, probability, is_secret.

    ``start`` counts characters of the text from 0. ``labelled`` are findings (value, left, right,
    label) to learn from; without it those that ``weak_labels`` is sure of are used. Where only one
    label or none occurs there is no forest, and every candidate stays a finding.

    Null, empty and candidate-free texts have no rows. Repeated rows have findings each, told apart
    by ``row``; a null doc_id is kept. Equal candidates in equal surroundings get equal results. An
    empty table gives an empty result; further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    common, pairs = dictionary(docs), letter_pairs(docs)
    found = scratch.put(features(candidates(docs), common, pairs), "candidates")
    known = weak_labels(found) if labelled is None else features(labelled, common, pairs)
    model = fit(known, scratch, sample)
    # One character per candidate and one per character between them; a document's candidates only.
    order = "PARTITION BY row ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    placed = found.withColumn("start", F.expr(f"sum(gap + length(value)) OVER ({order}) - length(value)"))
    if model is None:
        scored = placed.withColumn("probability", F.lit(1.0))
    else:
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(placed)
        scored = model.transform(assembled).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return scored.select(
        "doc_id", "row", "ordinal", F.col("start").cast("long").alias("start"), "value", "probability",
        (F.col("probability") >= threshold).alias("is_secret"),
    )


def redact(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with every secret of a document replaced wherever it stands there as a candidate.

    All columns are kept; ``n_chars``, where there is one, is counted anew for the texts that change.
    A document is a doc_id: rows that repeat it have each other's secrets taken out too. Rows
    without an id share the secrets found in such rows.
    """
    scratch = Scratch(docs.sparkSession, "redact")
    fresh = max(map(len, docs.columns)) * "_"  # longer than any name the input has
    doc, held = f"doc{fresh}", f"secrets{fresh}"
    secrets = scan(docs, labelled, threshold).where("is_secret").groupBy("doc_id").agg(F.collect_set("value").alias(held))
    secrets = scratch.put(secrets.withColumnRenamed("doc_id", doc), "secrets")
    met = docs.join(secrets, F.col("doc_id").eqNullSafe(F.col(doc)), "left")
    values = F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1))
    hidden = F.transform(values, lambda v: F.when(F.array_contains(held, v), F.lit(REDACTED)).otherwise(v))
    gaps = F.split("text", CANDIDATE)
    text = F.array_join(F.zip_with(gaps, hidden, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    changed = met.withColumn("text", F.when(F.col(held).isNotNull() & F.col("text").isNotNull(), text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        count = F.when(F.col(held).isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", count)
    return changed.select(*docs.columns)


def report(found: DataFrame) -> DataFrame:
    """Findings without the secrets themselves: doc_id, start, size, value_sha256, probability, is_secret."""
    return found.select(
        "doc_id", "start", F.length("value").cast("long").alias("size"), F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret"
    )
