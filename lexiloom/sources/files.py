"""Readers and writers at the file boundary, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

LEXICON = T.StructType([T.StructField(c, T.StringType()) for c in ("cui", "aui", "sab", "str", "preferred")])
CRITERIA = T.StructType([T.StructField(c, T.StringType()) for c in ("tid", "criteria", "thread_id")])


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, path, text)``, one row per file; ids are hashes of the path, the same at every run."""
    t = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return t.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def read_separated(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", quote: str = '"', header: bool = False, line_sep: str | None = None) -> DataFrame:
    """Separated values with a given schema; quoted fields may hold line ends, a backslash escapes."""
    r = spark.read.schema(schema).option("sep", sep).option("quote", quote).option("escape", "\\").option("header", header)
    r = r.option("lineSep", line_sep) if line_sep else r.option("multiLine", True)
    return r.csv(path)


def read_database(spark: SparkSession, url: str, relation: str, key: str, low: int, high: int, parts: int, **properties: str) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric key, one connection each."""
    return spark.read.jdbc(url, relation, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)


def read_types(spark: SparkSession, types: str, groups: str) -> DataFrame:
    """``(tui, abbr, name, grp)`` from two pipe-separated files, merged by type; a type of one file only is kept."""
    a = read_separated(spark, types, T.StructType([T.StructField(c, T.StringType()) for c in ("abbr", "tui", "name")]), "|")
    b = read_separated(spark, groups, T.StructType([T.StructField(c, T.StringType()) for c in ("grp", "group_name", "tui", "type_name")]), "|")
    return a.join(b, "tui", "full").select("tui", "abbr", F.coalesce("name", "type_name").alias("name"), "grp")


def read_vocabulary(spark: SparkSession, path: str, least: int) -> DataFrame:
    """``(word, freq)`` of a file of words and frequencies, from a frequency on."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("freq", T.LongType())])
    return read_separated(spark, path, schema, " ").filter(F.col("freq") >= least)


def read_lexicon(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Dictionary source rows with all five fields; shorter rows are left out."""
    return read_separated(spark, path, LEXICON, sep).filter(F.col("preferred").isNotNull())


def parse_dump(lines: DataFrame, column: str) -> DataFrame:
    """``(doc_id, title, body)`` of dump texts: a header with id and title, a body, an end mark.

    Tags of up to 30 characters and illegal characters are taken out, blank lines dropped; text
    before the first header is ignored.
    """
    piece = lines.select(F.explode(F.split(column, r"</doc>")).alias("p")).filter(F.col("p").rlike(r'<doc id="'))
    head = r'(?s)<doc id="(\d+)"[^<>]*?title="([^"]*)"[^<>]*>'
    body = F.regexp_replace(F.regexp_extract("p", r'(?s)<doc id="\d+"[^<>]*>\n?(.*)$', 1), r"<[^<>]{0,30}>", "")
    body = F.regexp_replace(F.regexp_replace(body, r"[\x00-\x08\x0b-\x1f]", " "), r"(?m)^\s*\n", "")
    return piece.select(F.regexp_extract("p", head, 1).try_cast("bigint").alias("doc_id"), F.regexp_extract("p", head, 2).alias("title"), body.alias("body"))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """``(root, keyword)``: each row under the last ``#`` line before it in its file."""
    from pyspark.sql import Window

    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    root = F.when(F.col("line").startswith("#"), F.trim(F.expr("substring(line, 2)")))
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("root", F.last(root, ignorenulls=True).over(w)).filter("trim(line) <> '' and not startswith(line, '#')").select("root", F.trim("line").alias("keyword"))


def read_keyword_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(root, depth, cui, keyword)`` of a keyword file whose rows are depth, concept and keyword."""
    parts = F.split("keyword", ",", 3)
    return read_keywords(spark, path).select("root", F.trim(parts[0]).try_cast("int").alias("depth"), F.trim(F.get(parts, F.lit(1))).alias("cui"), F.trim(F.get(parts, F.lit(2))).alias("keyword")).filter("keyword <> ''")


def read_quantities(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """``(name, pattern)`` rows of a quantity file in their order; rows without a pattern are left out. A file of bounded size."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    t = t.select("at", F.from_csv("line", "name string, pattern string").alias("r")).select("at", "r.*").filter("trim(pattern) <> ''")
    return [(r.name, r.pattern) for r in t.orderBy("at").collect()]


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """``(a, b, preferred)`` of a tab-separated rule file with a header: two types, their names, a count, and the type that is preferred."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "name_a", "b", "name_b", "cnt", "preferred")])
    return read_separated(spark, path, schema, "\t", header=True).filter("a is not null and b is not null and preferred in (a, b)").select("a", "b", "preferred").distinct()


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A word list without ``#`` comments and blanks, longest first; a file of bounded size."""
    t = spark.read.text(path).filter("trim(value) <> '' and not startswith(value, '#')")
    return sorted((r.value.strip() for r in t.collect()), key=lambda w: (-len(w), w))


def write_quoted(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", "\\").option("sep", sep).csv(path)


def write_tabbed(df: DataFrame, path: str) -> None:
    """Tab-separated text; arrays are joined by spaces."""
    flat = [F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), " ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by its lookup key, which stands in for an index."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def visible_text(html: Column) -> Column:
    """Text of a page without its head, style and script."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head|title)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^<>]*>", " "), r"\s+", " "))
