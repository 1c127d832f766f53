"""Registry of runnable queries, the roles the given tables play, and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from daftar.functions import text as T
from daftar.operators.chunking import chunk_documents
from daftar.session import spread, stored, stored_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


MONEY = 9  # decimals: more than any cost has, so that none is a tie


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Integers as long, doubles at ``places`` decimals: the edge where results are reported."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (t.IntegerType, t.ShortType, t.ByteType)):
            column = column.cast("long")
        elif isinstance(field.dataType, (t.DoubleType, t.FloatType, t.DecimalType)):
            column = F.round(column.cast("double"), places)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = (), places: int = 6):
    """Register a query over :class:`Tables`, with the SQL it must agree with where SQL can say it."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, sf_dir: tidy(build(Tables(spark, sf_dir)), places)
        if sql is not None:
            ORACLES[name] = with_ctes(sql, uses)
        return build

    return register


def contained_gold(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id) where the chunk contains the whole question text.

    A chunk that contains a passage contains each of its inner words whole, so the longest inner
    word is an equi join key; the substring test only runs on chunks that share it. Passages too
    short to have an inner word are compared directly.
    """
    words = F.filter(F.split("question", rf"[{T.SPACE}]+"), lambda w: w != "")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    keyed = queries.select("query_id", "question", longest.w.alias("word"))
    texts = chunks.select(F.col("id").alias("chunk_id"), "text")
    present = F.array_distinct(F.split("text", rf"[{T.SPACE}]+"))
    spread_words = texts.select("chunk_id", F.explode(present).alias("word"))
    met = spread_words.join(keyed.select("query_id", "word"), "word").select("query_id", "chunk_id")
    checked = texts.join(met, "chunk_id").join(keyed.select("query_id", "question"), "query_id")
    found = checked.where(F.contains("text", "question")).select("query_id", "chunk_id")
    short = keyed.where(F.col("word").isNull()).select("query_id", "question")
    direct = texts.join(short, F.contains("text", "question")).select("query_id", "chunk_id")
    return found.unionByName(direct)


class Tables:
    """The given tables, and the same data in the roles retrieval needs."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        rows = spread(self.read("documents"))
        return rows.select(F.concat(F.lit("doc-"), "doc_id").alias("doc_id"), "text", "lang", "source")

    def stored(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        return stored(df, name, f"{self.sf_dir}/documents.parquet", **options)

    @cached_property
    def chunks(self) -> DataFrame:
        """The corpus in chunks, split once per application."""
        return self.stored(chunk_documents(self.docs), "chunks")

    @cached_property
    def n_chunks(self) -> int:
        return self.chunks.count()  # a sum over file footers

    @cached_property
    def queries(self) -> DataFrame:
        rows = self.read("benchmark")
        return rows.select(F.concat(F.lit("q"), "item_id").alias("query_id"), F.col("text").alias("question"))

    @cached_property
    def index(self) -> DataFrame:
        from daftar.operators.lexical import FILE_OPTIONS, block_index

        return self.stored(block_index(self.chunks), "blocks", **FILE_OPTIONS)

    @cached_property
    def vector_index(self):
        """The index over the given vectors, written once per application."""
        from daftar.operators.vector_index import read_index, write_index

        source = f"{self.sf_dir}/embeddings.parquet"
        path = stored_path(self.spark, "vectors", source, lambda path: write_index(self.vectors, path))
        return read_index(self.spark, path)

    @cached_property
    def qrels(self) -> DataFrame:
        """What contains each question, found once per application: every list is measured against it."""
        return self.stored(contained_gold(self.chunks, self.queries), "qrels")

    @cached_property
    def pairs(self) -> DataFrame:
        """Labelled pairs: gold chunks contain the question; tags alternate; answer is the first line."""
        gold = self.qrels.groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids"))
        number = F.substr("query_id", F.lit(2)).cast("long")
        joined = self.queries.join(gold, "query_id", "left")
        ids = F.coalesce("source_chunk_ids", F.array().cast("array<string>"))
        return joined.select(
            "query_id",
            "question",
            F.when(number % 2 == 0, "msa").otherwise("gulf").alias("dialect_tag"),
            F.substring_index("question", ".", 1).alias("answer"),
            F.coalesce(F.substring_index(F.get(ids, 0), ":", 1), F.lit("none")).alias("source_doc"),
            ids.alias("source_chunk_ids"),
        )

    @cached_property
    def labelled(self) -> DataFrame:
        """Labelled documents as pairs, four to a source; a good one cites it, a bad one cites nothing."""
        rows = self.read("labels").join(self.read("documents"), "doc_id")
        source = F.concat(F.lit("src"), F.floor(F.col("doc_id") / 4).cast("string"))
        cites = F.array(F.concat(source, F.lit(":p:0")))
        none = F.array().cast("array<string>")
        return rows.select(
            F.concat(F.lit("p"), "doc_id").alias("query_id"),
            F.col("text").alias("question"),
            F.when(F.col("doc_id") % 2 == 0, "msa").otherwise("gulf").alias("dialect_tag"),
            F.substring_index("text", ".", 1).alias("answer"),
            source.alias("source_doc"),
            F.when(F.col("quality") == 1, cites).otherwise(none).alias("source_chunk_ids"),
            F.when(F.col("doc_id") >= 10, F.concat(F.lit("p"), (F.col("doc_id") - 10).cast("string"))).alias("derived_from"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Labelled documents with a score in [0, 1): lower for short documents."""
        rows = self.read("labels").join(self.read("documents").select("doc_id", "n_chars"), "doc_id")
        return rows.select(
            F.concat(F.lit("p"), "doc_id").alias("pair_id"),
            (F.col("quality") == 1).alias("answerable"),
            ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("top_score"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")

    @cached_property
    def vector_queries(self) -> DataFrame:
        """One query per vector: the sum of a vector and the next one."""
        rows = self.read("embeddings")
        after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_next"))
        total = F.zip_with("embedding", "_next", lambda a, b: a.cast("double") + b.cast("double"))
        return rows.join(after, "vec_id").select(F.col("vec_id").cast("string").alias("query_id"), total.alias("vector"))

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")


# --- SQL side ------------------------------------------------------------------------------------

WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def sql_norm(x: str) -> str:
    source = T.LETTERS_FROM + T.DIGITS_FROM + T.MARKS + T.FORMATS
    folded = f"translate({x}, {_q(source)}, {_q(T.LETTERS_TO + T.DIGITS_TO)})"
    return f"trim(regexp_replace({folded}, '[{WS}]+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), "SELECT 'doc-' || doc_id AS doc_id, text, lang, source FROM documents"),
    "q": ((), "SELECT 'q' || item_id AS query_id, text AS question FROM benchmark"),
    "body": (("docs",), f"SELECT doc_id, {sql_strip('text')} AS t FROM docs WHERE {sql_strip('text')} <> ''"),
    # Window walk: s is the 1-based start, cut the characters before the last white space.
    "walk": (
        ("body",),
        f"""
        SELECT doc_id, t, CAST(1 AS BIGINT) AS s, CAST(0 AS BIGINT) AS i FROM body
        UNION ALL
        SELECT doc_id, t, CASE
            WHEN cut = 0 THEN s + 1400
            WHEN regexp_matches(substr(t, greatest(s + 1, s + cut - 150) - 1, 1), '[{WS}]') THEN greatest(s + 1, s + cut - 150)
            ELSE greatest(s + 1, s + cut - 150) + length(regexp_extract(substr(t, greatest(s + 1, s + cut - 150)), '^[^{WS}]*[{WS}]*'))
          END AS s, i + 1
        FROM (SELECT doc_id, t, s, i, length(regexp_extract(substr(t, s, 1400), '(?s)^(.+)[{WS}]', 1)) AS cut
              FROM walk WHERE s + 1400 <= length(t)) w
        """,
    ),
    "pieces": (
        ("walk",),
        f"""
        SELECT doc_id, i, {sql_strip('piece')} AS text FROM (
          SELECT doc_id, i, CASE WHEN s + 1400 > length(t) THEN substr(t, s)
            ELSE substr(t, s, CASE WHEN length(regexp_extract(substr(t, s, 1400), '(?s)^(.+)[{WS}]', 1)) > 0
              THEN length(regexp_extract(substr(t, s, 1400), '(?s)^(.+)[{WS}]', 1)) ELSE 1400 END) END AS piece
          FROM walk WHERE s <= length(t)) p
        """,
    ),
    "chunks": (
        ("pieces",),
        f"""
        SELECT doc_id || ':p:' || seq AS id, doc_id, seq, text, text_normalized FROM (
          SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq, text, {sql_norm('text')} AS text_normalized
          FROM pieces WHERE {sql_norm('text')} <> '') n
        """,
    ),
    "qterms": (
        ("q",),
        f"""
        SELECT DISTINCT query_id, lower(w) AS term FROM (
          SELECT query_id, unnest(list_slice(list_filter({sql_tokens(sql_norm('question'))}, lambda x: length(x) <= 64), 1, 32)) AS w FROM q) u
        """,
    ),
    "post": (
        ("chunks",),
        f"""
        SELECT chunk_id, term, count(*) AS tf FROM (
          SELECT id AS chunk_id, unnest({sql_tokens('lower(text_normalized)')}) AS term FROM chunks) u GROUP BY chunk_id, term
        """,
    ),
    "lex": (
        ("qterms", "post"),
        """
        SELECT query_id, chunk_id, score, rank FROM (
          SELECT query_id, chunk_id, 0.1 * mass AS score,
                 row_number() OVER (PARTITION BY query_id ORDER BY mass DESC, chunk_id) AS rank
          FROM (SELECT query_id, chunk_id, CAST(sum(tf) AS DOUBLE) AS mass FROM qterms JOIN post USING (term) GROUP BY query_id, chunk_id) m) r
        WHERE rank <= 20
        """,
    ),
    "idf": (
        ("post", "chunks"),
        "SELECT term, ln((SELECT count(*) FROM chunks) / count(*)) AS w FROM post GROUP BY term",
    ),
    "lexidf": (
        ("qterms", "post", "idf"),
        """
        SELECT query_id, chunk_id, score, rank FROM (
          SELECT query_id, chunk_id, 0.1 * mass AS score,
                 row_number() OVER (PARTITION BY query_id ORDER BY round(mass, 9) DESC, chunk_id) AS rank
          FROM (SELECT query_id, chunk_id, sum(tf * w) AS mass FROM qterms JOIN post USING (term) JOIN idf USING (term) GROUP BY query_id, chunk_id) m) r
        WHERE rank <= 20
        """,
    ),
    "qrels": (("chunks", "q"), "SELECT query_id, id AS chunk_id FROM q JOIN chunks ON contains(text, question)"),
    "pairs": (
        ("q", "qrels"),
        """
        SELECT query_id, question, CASE WHEN CAST(substr(query_id, 2) AS BIGINT) % 2 = 0 THEN 'msa' ELSE 'gulf' END AS dialect_tag,
               split_part(question, '.', 1) AS answer,
               coalesce(split_part(ids[1], ':', 1), 'none') AS source_doc, coalesce(ids, []) AS source_chunk_ids
        FROM q LEFT JOIN (SELECT query_id, list_sort(list(DISTINCT chunk_id)) AS ids FROM qrels GROUP BY query_id) g USING (query_id)
        """,
    ),
    "labelled": (
        (),
        """
        SELECT 'p' || doc_id AS query_id, text AS question, CASE WHEN doc_id % 2 = 0 THEN 'msa' ELSE 'gulf' END AS dialect_tag,
               split_part(text, '.', 1) AS answer, 'src' || (doc_id // 4) AS source_doc,
               CASE WHEN quality = 1 THEN ['src' || (doc_id // 4) || ':p:0'] ELSE [] END AS source_chunk_ids,
               CASE WHEN doc_id >= 10 THEN 'p' || (doc_id - 10) END AS derived_from
        FROM labels JOIN documents USING (doc_id)
        """,
    ),
    "scored": (
        (),
        """
        SELECT 'p' || doc_id AS pair_id, quality = 1 AS answerable, (n_chars % 1000) / 1000.0::DOUBLE AS top_score
        FROM labels JOIN documents USING (doc_id)
        """,
    ),
    "vq": (
        (),
        """
        SELECT a.vec_id AS query_id, list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE + x[2]::DOUBLE) AS vector
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
        """,
    ),
    "sims": (
        ("vq",),
        """
        SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) AS chunk_id,
               round(list_cosine_similarity(vector, list_transform(embedding, lambda x: x::DOUBLE)), 12) AS score, label
        FROM vq CROSS JOIN embeddings
        """,
    ),
    "dense": (
        ("sims",),
        """
        SELECT query_id, chunk_id, score, rank FROM (
          SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims) r
        WHERE rank <= 20
        """,
    ),
}


def with_ctes(body: str, uses: tuple[str, ...]) -> str:
    """Prefix a query with the common tables it uses, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return body
    parts = [f"{n} AS {'' if n == 'walk' else 'MATERIALIZED '}({CTES[n][1]})" for n in ordered]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
