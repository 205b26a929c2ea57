"""Positional postings and corpus statistics of chunks, as DataFrames and as a written index.

``postings(field, term, id, doc_id, tree, tf, len, positions)`` has one row for each term of a field of a chunk;
``stats(field, docs, avg_len)`` and ``terms(field, term, df)`` hold what scoring needs. Written, postings are sorted by field
and term, so that the few terms of a query read few row groups.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseek.functions.stem import stem_column, stem_words
from arborseek.functions.text import terms
from arborseek.operators.current import current_rows
from arborseek.session import scratch_dir, written

FIELDS = ("hierarchy", "tags", "path", "body")
BOOSTS = {"hierarchy": 3.0, "tags": 5.0, "path": 12.0, "body": 1.0}
EXPANDED = 20_000  # rows a query sends along (terms, ids) up to which they are collected and broadcast, below 2 MB
ALTERNATIVES = 200  # values up to which a filter names each; of longer lists Spark hands only the range to the scan
GAP = 100_000  # positions between two elements of a hierarchy, so that no phrase spans them
POSTING = ("field", "term", "id", "doc_id", "tree", "tf", "len", "positions")
META = "count long, language string, masked long"
COLUMNS = ("doc_id", "parent_id", "hierarchy", "depth", "tags", "path", "tree", "body", "position", "byte_start", "byte_end", "sibling_count", "mtime")


def index_rows(chunks: DataFrame) -> DataFrame:
    """The rows an index holds: the current row of each id, with all its columns."""
    return current_rows(chunks, *[c for c in COLUMNS if c != "mtime"], F.col("mtime").alias("__stamp")).withColumnRenamed("__stamp", "mtime")


def among(column: str, values: list) -> Column:
    """Whether a column has one of the values, as a filter that lets the scan skip what holds none of them."""
    if not values:
        return F.lit(False)
    each = sorted(set(values))
    if len(each) > ALTERNATIVES:
        return F.col(column).isin(each)
    tests = [F.col(column) == v for v in each]
    while len(tests) > 1:  # a balanced tree: a chain of hundreds would be as deep
        tests = [a | b for a, b in zip(tests[::2], tests[1::2], strict=False)] + (tests[-1:] if len(tests) % 2 else [])
    return tests[0]


def field_parts(rows: DataFrame) -> DataFrame:
    """``(id, doc_id, tree, field, part, words, len)``; tags are one text, each element of a hierarchy is a part of its own.

    ``len`` counts the words of the field, over all its parts.
    """
    worded = rows.select(
        "id",
        "doc_id",
        "tree",
        terms("body").alias("body"),
        terms("path").alias("path"),
        terms(F.array_join("tags", " ")).alias("tags"),
        F.transform(F.coalesce("hierarchy", F.array().cast("array<string>")), terms).alias("titles"),
    )

    def one(field: str) -> Column:
        return F.array(F.struct(F.lit(field).alias("field"), F.lit(0).alias("part"), F.col(field).alias("words"), F.size(field).alias("len")))

    sized = worded.withColumn("title_len", F.size(F.flatten("titles")))
    titles = F.transform("titles", lambda w, i: F.struct(F.lit("hierarchy").alias("field"), i.alias("part"), w.alias("words"), F.col("title_len").alias("len")))
    return sized.select("id", "doc_id", "tree", F.inline(F.concat(one("body"), one("path"), one("tags"), titles))).where("size(words) > 0")


def field_terms() -> dict[str, Column]:
    """The terms of each field of a chunk in order, those of a hierarchy over all its elements; a null field has none."""
    titles = F.transform(F.coalesce("hierarchy", F.array().cast("array<string>")), terms)
    return {"body": terms("body"), "path": terms("path"), "tags": terms(F.array_join("tags", " ")), "hierarchy": F.flatten(titles)}


def chunk_words(rows: DataFrame, language: str = "none") -> DataFrame:
    """``(id, doc_id, hierarchy, tags, path, body)``, one row a chunk, each field as the array of its terms."""
    each = field_terms()
    worded = rows.select("id", "doc_id", *[each[f].alias(f) for f in FIELDS])
    return worded.withColumns({f: stem_words(f, language) for f in FIELDS})


def by_field(words: DataFrame) -> DataFrame:
    """``(id, field, words)`` of :func:`chunk_words`, one row for each field that has any."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("words")) for f in FIELDS])
    return words.select("id", F.inline(fields)).where("size(words) > 0")


def tokens(rows: DataFrame, language: str = "none", parts: int | None = None) -> DataFrame:
    """``(id, doc_id, tree, field, len, pos, term)``, one row a token. With ``parts`` they are spread by id over so many partitions."""
    worded = field_parts(rows).withColumn("words", stem_words("words", language))
    if parts is not None:
        worded = worded.repartition(parts, "id")
    found = worded.select("id", "doc_id", "tree", "field", "part", "len", F.posexplode("words").alias("place", "term"))
    return found.select("id", "doc_id", "tree", "field", "len", (F.col("part") * GAP + F.col("place")).alias("pos"), "term")


def postings(rows: DataFrame, language: str = "none", parts: int | None = None) -> DataFrame:
    """One row for each term of a field of a chunk; the field's length comes along, so that scoring joins nothing.

    With ``parts`` texts are spread by id before they are taken apart, so that tokens meet where they are.
    """
    found = tokens(rows, language, parts).groupBy("field", "term", "id", "doc_id", "tree", "len")
    counted = found.agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return counted.select("field", "term", "id", "doc_id", "tree", "tf", "len", "positions")


def term_stats(found: DataFrame) -> DataFrame:
    return found.groupBy("field", "term").agg(F.count("*").alias("df"))


def crowded_terms(rows: DataFrame, language: str, parts: int) -> DataFrame:
    """``(term, pieces)`` of the terms with more postings than half the mean of ``parts`` files: fewer than twice ``parts``.

    ``pieces`` is how many such halves the postings of the term fill. A term counts once for each field of a row that
    holds it, and is added up before the shuffle.
    """
    each = rows.select(F.explode(F.concat(*[F.array_distinct(w) for w in field_terms().values()])).alias("term"))
    counts = each.groupBy("term").agg(F.count("*").alias("n"))
    if language.lower() != "none":
        counts = stem_column(counts, "term", language).groupBy("term").agg(F.sum("n").alias("n"))
    counts = written(counts, "term-sizes")
    half = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // (2 * parts))
    return counts.where(F.col("n") > half).select("term", F.ceil(F.col("n") / half).alias("pieces"))


def field_stats(rows: DataFrame, chunks: int) -> DataFrame:
    """``(field, docs, avg_len)``; the mean is over all chunks, those without the field too. Each field of a row counts once."""
    first = field_parts(rows).groupBy("id", "field").agg(F.first("len").alias("len"))
    return first.groupBy("field").agg(F.count("*").alias("docs"), (F.sum("len") / F.lit(float(max(chunks, 1)))).alias("avg_len"))


def _sums(found: DataFrame) -> DataFrame:
    """``(field, docs, words)`` of postings; each field of a row counts once."""
    return found.groupBy("field", "id").agg(F.sum("tf").alias("len")).groupBy("field").agg(F.count("*").alias("docs"), F.sum("len").alias("words"))


@dataclass
class Index:
    """What a query reads. Statistics are over all trees, whatever a query filters.

    Written, an index is a folder, or several: the first holds a whole index, each later one what an update changed
    (:meth:`extend`): chunks and postings of the new rows, the documents whose earlier rows count no more, and
    statistics as differences, less for rows that went. Read together they are what one built anew would be.
    """

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    count: int
    language: str = "none"
    words: DataFrame | None = None  # as chunk_words gives them, where they are written

    @cached_property
    def averages(self) -> dict[str, float]:
        """Mean lengths by field, read once: there are four fields."""
        return {r["field"]: r["avg_len"] for r in self.stats.collect()}

    @staticmethod
    def of(rows: DataFrame, language: str = "none") -> Index:
        """An index over rows as :func:`index_rows` gives them, made anew by each query that reads it."""
        count = rows.select("id").count()
        found = postings(rows, language)
        return Index(rows, found, term_stats(found), field_stats(rows, count), count, language)

    @staticmethod
    def of_words(rows: DataFrame, language: str = "none") -> Index:
        """An index over rows for a query that reads each chunk whole: only words are written, and no token is shuffled.

        ``terms`` and ``stats`` come from the words; ``postings`` would be made anew by each query that reads them.
        """
        words = written(chunk_words(rows, language), "words")
        count = words.count()
        each = by_field(words)
        frequencies = each.select("field", F.explode(F.array_distinct("words")).alias("term")).groupBy("field", "term").agg(F.count("*").alias("df"))
        stats = each.groupBy("field").agg(F.count("*").alias("docs"), (F.sum(F.size("words")) / F.lit(float(max(count, 1)))).alias("avg_len"))
        return Index(rows, postings(rows, language), frequencies, stats, count, language, words)

    @staticmethod
    def _write(rows: DataFrame, folder: str, language: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Chunks and postings of the rows.

        Rows are spread by id over all partitions, since what follows costs far more than their bytes tell, and sorted
        by id, so by tree and document. Postings are laid out by term and sorted, so that row groups hold few terms;
        a term whose postings would fill more than half a file is divided by id into as many pieces. ``most`` bounds
        the number of files where the rows are known to be few.
        """
        spark = rows.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        parts = parts if most is None else max(1, min(parts, most))
        rows.repartition(parts, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/chunks")
        chunks = spark.read.schema(rows.schema).parquet(f"{folder}/chunks")
        crowded = F.broadcast(crowded_terms(chunks, language, parts))
        piece = F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1)))
        placed = postings(chunks, language, parts).join(crowded, "term", "left").withColumn("piece", piece).drop("pieces")
        by_term = placed.repartition(parts, "term", "piece").drop("piece").sortWithinPartitions("field", "term", "id").select(*POSTING)
        by_term.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(f"{folder}/postings")
        return chunks, spark.read.schema(by_term.schema).parquet(f"{folder}/postings")

    @staticmethod
    def _meta(spark: SparkSession, folder: str, count: int, language: str, masked: int) -> None:
        spark.createDataFrame([(count, language, masked)], META).coalesce(1).write.mode("overwrite").json(f"{folder}/meta")

    @staticmethod
    def build(rows: DataFrame, folder: str, language: str = "none") -> Index:
        """Write an index of the rows and read it back. Each part is made from the one written before."""
        spark = rows.sparkSession
        chunks, found = Index._write(rows, folder, language)
        term_stats(found).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
        _sums(found).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
        Index._meta(spark, folder, chunks.count(), language, 0)
        return Index.read(spark, folder)

    def extend(self, rows: DataFrame, gone: DataFrame, folder: str) -> None:
        """Write what an update changes: ``rows`` come in, those of the documents in ``gone(doc_id)`` go.

        Of the index only the chunks of documents that go are read.
        """
        spark = rows.sparkSession
        gone.select("doc_id").distinct().write.mode("overwrite").parquet(f"{folder}/masked")
        masked = spark.read.schema("doc_id string").parquet(f"{folder}/masked")
        few = [r["doc_id"] for r in masked.limit(EXPANDED + 1).collect()]
        old = self.chunks.where(among("doc_id", few)) if len(few) <= EXPANDED else self.chunks.join(masked, "doc_id", "left_semi")
        chunks, found = Index._write(rows, folder, self.language, 1 + rows.count() // 1000)
        old = written(old, "old-rows")
        went = postings(old, self.language)
        signed = lambda df, *names: df.withColumns({n: -F.col(n) for n in names})
        terms_now = term_stats(found).unionByName(signed(term_stats(went), "df")).groupBy("field", "term").agg(F.sum("df").alias("df"))
        terms_now.where("df <> 0").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
        _sums(found).unionByName(signed(_sums(went), "docs", "words")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
        Index._meta(spark, folder, chunks.count() - old.count(), self.language, masked.count())

    @staticmethod
    def read(spark: SparkSession, *folders: str) -> Index:
        metas = [spark.read.schema(META).json(f"{f}/meta").first() for f in folders]
        count = sum(m["count"] for m in metas)

        def rows(name: str) -> DataFrame:
            made = None
            for i, folder in enumerate(folders):
                part = spark.read.parquet(f"{folder}/{name}")
                for later, meta in zip(folders[i + 1 :], metas[i + 1 :], strict=True):
                    if meta["masked"]:
                        masked = spark.read.schema("doc_id string").parquet(f"{later}/masked")
                        part = part.join(F.broadcast(masked) if meta["masked"] <= EXPANDED else masked, "doc_id", "left_anti").select(*part.columns)
                made = part if made is None else made.unionByName(part)
            return made

        terms_now, sums = (reduce(DataFrame.unionByName, [spark.read.parquet(f"{f}/{n}") for f in folders]) for n in ("terms", "stats"))
        if len(folders) > 1:
            terms_now = terms_now.groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")
        stats = sums.groupBy("field").agg(F.sum("docs").alias("docs"), (F.sum("words") / F.lit(float(max(count, 1)))).alias("avg_len")).where("docs > 0")
        return Index(rows("chunks"), rows("postings"), terms_now, stats, count, metas[0]["language"])


_built: dict[tuple[str, str, str], tuple[str, Index]] = {}


def _stamp(spark: SparkSession, table: str) -> str:
    """Names, sizes and times of a table's files: the time of a folder alone may be old or 0 in an object store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def shared_index(spark: SparkSession, folder: str, chunks: DataFrame) -> Index:
    """The index of a folder's chunk table, written to the shared folder by the first query of this application that needs it.

    It is made anew when the table was written since, or the index was deleted.
    """
    key = (spark.sparkContext.applicationId, folder, _stamp(spark, f"{folder}/chunks.parquet"))
    if key in _built:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{_built[key][0]}/meta")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return _built[key][1]
    at = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    _built[key] = at, Index.build(index_rows(chunks), at)
    return _built[key][1]
