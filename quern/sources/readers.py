"""Sources as DataFrames: JSON documents in three layouts, labelled queries, files, chat threads, API specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DOC = "struct<id:string,_id:string,doc_id:string,title:string,name:string,passage:string,content:string,text:string,type:string>"

#: Stands between the JSON values of a sequence.
SEPARATOR = "\x1e"


def _chain(*names: str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.col(f"d.{n}")), F.lit("")) for n in names))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, content, type of JSON files: one document, a list, or a map of documents by id. Empty contents go.

    A file is one JSON value, or a sequence of values between record separators (RFC 7464). JSON never has that character
    itself, so a file of one value is read whole, and one of many value by value, by as many tasks as its size asks for.
    """
    raw = spark.read.text(path, lineSep=SEPARATOR).select(F.trim("value").alias("j"))
    many = raw.where(F.startswith("j", F.lit("["))).select(F.posexplode(F.from_json("j", f"array<{_DOC}>")).alias("k", "d")).select(F.col("k").cast("string").alias("key"), "d")
    one = raw.where(~F.startswith("j", F.lit("[")))
    # an object with a text of its own is a document, any other a map of documents
    own = one.select("j", F.from_json("j", _DOC).alias("d")).where(_chain("passage", "content", "text").isNotNull()).select(F.lit(None).cast("string").alias("key"), "d")
    mapped = one.where(F.coalesce(F.get_json_object("j", "$.passage"), F.get_json_object("j", "$.content"), F.get_json_object("j", "$.text")).isNull()).select(F.explode(F.from_json("j", f"map<string,{_DOC}>")).alias("key", "d"))
    rows = many.union(own).union(mapped)
    return rows.select(F.coalesce(_chain("id", "_id", "doc_id"), "key").alias("doc_id"), F.coalesce(_chain("title", "name"), F.lit("")).alias("title"), _chain("passage", "content", "text").alias("content"), F.coalesce(_chain("type"), F.lit("")).alias("type")).where("content is not null")


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, question, answer (null without labels) of a JSON map of queries."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,struct<question:string,answer:array<string>>>")).alias("qid", "q")).select("qid", "q.question", "q.answer")


def files(spark: SparkSession, path: str, include: str = "*", exclude: str | None = None, modified_after: str | None = None) -> DataFrame:
    """path, modified, size, text of files by glob, without those whose path matches `exclude`; only later than a time if given."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", include).option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    rows = reader.load(path)
    if exclude:
        rows = rows.where(~F.col("path").rlike(exclude))
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def chat_threads(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, participants, text of messages (conv_id, turn, role, text): one line a message, in order.

    A thread's messages meet in one row; a conversation is bounded by what one document may be.
    """
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(": "), "text")
    return messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.sort_array(F.collect_set("role")), ",").alias("participants"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("text"),
    )


def api_operations(specs: DataFrame) -> DataFrame:
    """path, method, summary, parameters, responses of specs (spec: JSON with paths): one row for each operation."""
    kind = "struct<paths:map<string,map<string,struct<summary:string,description:string,parameters:array<struct<name:string>>,responses:map<string,struct<description:string>>>>>>"
    paths = specs.select(F.explode(F.from_json("spec", kind)["paths"]).alias("path", "methods"))
    return paths.select("path", F.explode("methods").alias("method", "op")).select("path", F.upper("method").alias("method"), F.coalesce("op.summary", "op.description", F.lit("")).alias("summary"), F.col("op.parameters.name").alias("parameters"), F.sort_array(F.map_keys("op.responses")).alias("responses"))


def sample_rows(spark: SparkSession) -> DataFrame:
    """doc_id, title, content, type: three rows to try an ingestion on."""
    rows = [("sample_1", "Deploying a service", "Build the image, push it and restart the service.", "runbook"), ("sample_2", "Database ownership", "The storage team owns the orders database.", "documentation"), ("sample_3", "Outage of the gateway", "The gateway failed as its certificate had expired.", "incident")]
    return spark.createDataFrame(rows, "doc_id string, title string, content string, type string")


def restored(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Checkpoints of several folders as one: of a key the row with the latest `order`, of equals that of the first folder."""
    from functools import reduce

    both = reduce(DataFrame.unionByName, (p.withColumn("_at", F.lit(-k)) for k, p in enumerate(parts)))
    last = both.groupBy(key).agg(F.max_by(F.struct(*parts[0].columns), F.struct(F.col(order), "_at")).alias("r"))
    return last.select("r.*")
