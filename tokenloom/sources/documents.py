"""Feature documents: one JSON file per track, found by the track's path.

Three layouts: a folder of files, a dump of JSON lines, and the shredded table that
``shred`` makes of either, in which the leaves of the feature catalog are typed
columns beside the whole document.  A feature set then reads its own leaves only, and no
text is parsed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_leaf import leaf, parse


def json_name(path_col: str = "path"):
    """``<dir>/<id>.mp3`` -> ``<dir>/<id>.json`` (every occurrence replaced)."""
    return F.replace(F.col(path_col), F.lit(".mp3"), F.lit(".json"))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root`` as ``(rel_path, text)``; parsed later, after the join.

    ``rel_path`` is the file path relative to ``root`` (nested folders included, decoded).
    """
    root_uri = root.rstrip("/")
    raw = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
           .text(root_uri).select(F.col("value").alias("text"),
                                  F.col("_metadata.file_path").alias("file_path")))
    # file_path is an encoded URI (file:/..., s3a://...): its path below the qualified root's path
    at = spark._jvm.org.apache.hadoop.fs.Path(root_uri)
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at)
    prefix = at.toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace("file_path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return raw.select(F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).alias("rel_path"), "text")


def read_documents_jsonl(spark: SparkSession, path: str, path_field: str = "path",
                         doc_field: str = "doc") -> DataFrame:
    """S5, line layout: one JSON object per line ``{"path": <relative json name>, "doc": {...}}``.

    Millions of small files are slow to list and open on any object store; a dump
    with one document per line splits into ordinary scan partitions.  Output is the
    same ``(rel_path, text)`` as ``read_documents``; a malformed line gives a null
    text and so no record.
    """
    lines = spark.read.text(path)
    v = F.try_parse_json(F.col("value"))
    return lines.select(F.try_variant_get(v, f"$.{path_field}", "string").alias("rel_path"),
                        F.to_json(F.try_variant_get(v, f"$.{doc_field}", "variant")).alias("text")) \
        .filter(F.col("rel_path").isNotNull())


def parsed_documents(spark: SparkSession, root: str, doc_format: str = "files") -> DataFrame:
    """``(rel_path, doc)``: the documents as variants, each parsed once; a malformed one is null."""
    if doc_format == "files":
        return read_documents(spark, root).select("rel_path", parse("text").alias("doc"))
    if doc_format == "jsonl":
        v = F.try_parse_json(F.col("value"))
        lines = spark.read.text(root).select(v.alias("v"))
        return lines.select(F.try_variant_get("v", "$.path", "string").alias("rel_path"), F.try_variant_get("v", "$.doc", "variant").alias("doc")) \
            .filter(F.col("rel_path").isNotNull())
    if doc_format == "shredded":
        return spark.read.parquet(root).select("rel_path", "doc")
    raise ValueError("doc_format must be files, jsonl or shredded")


def document_names(spark: SparkSession, root: str, doc_format: str = "files") -> DataFrame:
    """``rel_path`` of each document; a shredded table is read for its names only."""
    if doc_format == "shredded":
        return spark.read.parquet(root).select("rel_path")
    return parsed_documents(spark, root, doc_format).select("rel_path")


def shred(docs: DataFrame, path: str, leaves: dict[str, tuple[str, str]], keep_document: bool = True) -> None:
    """Store ``(rel_path, doc)`` at ``path`` with a typed column for each of the ``leaves`` (column -> path, type), in one pass."""
    columns = [leaf(F.col("doc"), where, kind).alias(name) for name, (where, kind) in sorted(leaves.items())]
    docs.select("rel_path", F.col("doc").isNull().alias("malformed"), *columns, *(["doc"] if keep_document else [])).write.parquet(path)


def attach_documents(tags: DataFrame, docs: DataFrame, how: str = "inner") -> DataFrame:
    """Tag rows joined to their documents on the relative JSON name, then parsed.

    The join happens on the path BEFORE parsing, so unmatched documents are
    never parsed.  Spark's adaptive execution converts the join to a broadcast
    when the runtime size of the tag side is under the broadcast threshold;
    otherwise it stays a sort-merge join.  A malformed document gives a null
    ``doc`` (S5: no record).
    """
    keyed = tags.withColumn("rel_path", json_name("path"))
    joined = keyed.join(docs, "rel_path", how)
    return joined.withColumn("doc", parse("text")).drop("text")


def document_coverage(tags: DataFrame, docs: DataFrame) -> DataFrame:
    """A1: share (in %) of tag rows whose document exists."""
    keyed = tags.withColumn("rel_path", json_name("path"))
    hit = docs.select("rel_path").distinct().withColumn("found", F.lit(1))
    j = keyed.join(hit, "rel_path", "left")
    return j.agg(F.count("*").alias("n_rows"),
                 F.count("found").alias("n_found"),
                 (F.avg(F.col("found").isNotNull().cast("double")) * 100).alias("coverage_pct"))
