"""Configuration: keys that code reads, queue names and ARNs among its strings, and the files that set them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Forms of reads, of queue names and of strings that are none, and of configuration files.
READ = r"\b(?:config|Config::get)\(\s*['\"]([^'\"]+)['\"]"
STRING = r"'([^'\\]*)'|\"([^\"\\]*)\""
ARN = r"(?i)^arn:aws:sqs:[a-z0-9-]+:\d+:[a-z0-9-]+$"
QUEUE, TOLD = r"(?i)^[a-z0-9]+(?:-[a-z0-9]+){2,}$", r"(?i)queue|sqs|expired|object|consumer|prod|dev"
SAMPLE = r"(?i)your-|example|placeholder|changeme"
FILE = r"(?i)/config/([a-z0-9_]+)\.php$"
LINKED = r"(?i)queue|sqs|expired|vod"
SHORTEST = 5


def _strings(text: Column) -> Column:
    return F.zip_with(F.regexp_extract_all(text, F.lit(STRING), F.lit(1)), F.regexp_extract_all(text, F.lit(STRING), F.lit(2)), lambda a, b: F.trim(F.when(a != "", a).otherwise(b)))


def literals(files: DataFrame) -> DataFrame:
    """(file, literal): the queue names and ARNs among the strings of files (file, content); an ARN gives its queue too."""
    raw = files.select("file", F.explode(F.array_distinct(_strings(F.col("content")))).alias("raw")).where(F.char_length("raw") >= SHORTEST)
    arn = F.col("raw").rlike(ARN)
    other = (F.col("raw").rlike(QUEUE) & F.col("raw").rlike(TOLD)) | (F.col("raw").rlike("(?i)sqs") & F.contains("raw", F.lit("-")) & ~F.col("raw").rlike(SAMPLE))
    found = F.when(arn, F.array(F.substring_index("raw", ":", -1), F.col("raw"))).when(other, F.array("raw"))
    return raw.where(arn | other).select("file", F.explode(found).alias("literal")).where("literal <> ''").distinct()


def reads(methods: DataFrame) -> DataFrame:
    """(from_id, key): the configuration keys that methods (id, body) read."""
    return methods.select(F.col("id").alias("from_id"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(READ), F.lit(1)))).alias("key"))


def _base(file: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(file, r"\\", "/"), FILE, 1), F.lit(""))


def edges(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(from_id, to_id, type, reason) between readers, keys, and the literals (file, literal) of the file that a key's first
    part names; a configuration file's queues also hang on its key `queue`."""
    key, value = F.concat(F.lit("config_key:"), "key"), F.concat(F.lit("config_literal:"), "literal")
    read = asked.select("from_id", key.alias("to_id"), F.lit("Reads Laravel config key").alias("reason"))
    of_file = found.withColumn("base", _base(F.col("file"))).where("base is not null")
    own = of_file.where(F.col("literal").rlike(LINKED)).select(F.concat(F.lit("config_key:"), "base", F.lit(".queue")).alias("from_id"), value.alias("to_id"), F.lit("Config file default queue value").alias("reason"))
    named = asked.select("key", F.substring_index("key", ".", 1).alias("base")).distinct().join(of_file.select("base", "literal").distinct(), "base")
    named = named.select(key.alias("from_id"), value.alias("to_id"), F.lit("Config key resolves to file literal").alias("reason"))
    # where both say the same of a pair, the file's word stands
    every = read.withColumn("place", F.lit(0)).unionByName(own.withColumn("place", F.lit(1))).unionByName(named.withColumn("place", F.lit(2)))
    return every.groupBy("from_id", "to_id").agg(F.min_by("reason", "place").alias("reason")).withColumn("type", F.lit("REFERENCES"))


def settings(files: DataFrame) -> DataFrame:
    """(file, key, value): the strings of nested arrays under dotted keys, `file.a.b` for `'a' => ['b' => 'value']`.

    An array is the interval from its opening bracket to the next one of its depth, which closes it; a value's key is made
    of the names of the intervals around it. Values that aren't strings, or have no key, give none.
    """
    cut = files.select("file", F.posexplode(F.split("content", r"(?<=[\[\],])")).alias("k", "text"))
    opens, closes = F.col("text").endswith("["), F.col("text").endswith("]")
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(Window.partitionBy("file").orderBy("k"))
    name = F.nullif(F.regexp_extract("text", r"['\"]([^'\"]+)['\"]\s*=>\s*\[$", 1), F.lit(""))
    cut = cut.withColumn("depth", depth + F.when(closes, 1).otherwise(0)).withColumn("name", F.when(opens, name))
    bounds = cut.where(opens | closes).withColumn("until", F.lead("k").over(Window.partitionBy("file", "depth").orderBy("k")))
    arrays = bounds.where(opens).select("file", F.col("k").alias("since"), "until", F.col("depth").alias("level"), "name")
    leaf = cut.select("file", "k", F.regexp_extract("text", r"['\"]([^'\"]+)['\"]\s*=>\s*['\"]([^'\"]*)['\"]", 1).alias("last"), F.regexp_extract("text", r"['\"]([^'\"]+)['\"]\s*=>\s*['\"]([^'\"]*)['\"]", 2).alias("value")).where("last <> ''")
    inside = leaf.join(arrays.where("name is not null"), "file").where("k > since and (until is null or k <= until)")
    path = inside.groupBy("file", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"]), ".").alias("path"))
    whole = F.concat_ws(".", F.coalesce(_base(F.col("file")), F.regexp_extract("file", r"([^/]*?)(\.php)?$", 1)), "path", "last")
    return leaf.join(path, ["file", "k"], "left").select("file", whole.alias("key"), "value")
