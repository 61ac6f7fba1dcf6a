"""Readers and writers: graph JSON, markdown, binary listings, graph responses, caches, streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions.text import slices
from pathweave.schema import GRAPH_DOCUMENT
from pathweave.session import ship_package

#: Parameters of the vector index, kept with the written table.
INDEX_OPTIONS = {"m": "16", "ef_construction": "512", "ef_search": "512", "space": "cosine", "dimension": "1024"}


def read_graph_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each graph JSON document of a folder; names that begin with ``_`` are left out."""
    read = spark.read.schema(GRAPH_DOCUMENT).option("multiLine", True).option("pathGlobFilter", "[!_]*.json").json(path)
    return read.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def entities(documents: DataFrame) -> DataFrame:
    """The vertices of graph documents; ``ord`` is an entity's place in its document."""
    one = documents.select("document_id", F.posexplode("entities").alias("ord", "e"))
    return one.select("document_id", "ord", "e.id", "e.type", "e.label", "e.properties", "e.provenance.source_section_id", "e.provenance.source_text", "e.provenance.confidence")


def relations(documents: DataFrame) -> DataFrame:
    """The edges of graph documents."""
    one = documents.select("document_id", F.posexplode("relations").alias("ord", "r"))
    return one.select("document_id", "ord", F.col("r.source_id").alias("src"), F.col("r.target_id").alias("dst"), "r.type", "r.properties", "r.provenance.source_section_id", "r.provenance.source_text", "r.provenance.confidence")


def read_markdown(spark: SparkSession, path: str, contains: str = "") -> DataFrame:
    """``file, length, text`` of the markdown files of a folder whose name contains a word."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    file = F.element_at(F.split("path", "/"), -1)
    return read.where(F.contains(file, F.lit(contains))).select(file.alias("file"), "length", F.col("content").cast("string").alias("text"))


def list_binaries(spark: SparkSession, path: str, suffix: str = ".pdf", duplicates: list[str] | None = None) -> DataFrame:
    """Paths and sizes of a folder's files, but for those that match a pattern of duplicates.

    Contents are not read: the column is pruned.
    """
    read = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length")
    return read.where(~F.col("path").rlike("|".join(f"(?:{p})" for p in duplicates))) if duplicates else read


def decode_response(value: object) -> object:
    """A tagged graph response as plain values: maps alternate keys and values, ``T`` becomes
    ``T.name``, other tags give their value."""
    if isinstance(value, list):
        return [decode_response(v) for v in value]
    if not isinstance(value, dict):
        return value
    if "@type" not in value:
        return {k: decode_response(v) for k, v in value.items()}
    kind, inner = value["@type"], value.get("@value")
    if kind == "g:Map":
        flat = [decode_response(v) for v in inner]
        return {str(k): v for k, v in zip(flat[::2], flat[1::2], strict=True)}
    if kind in ("g:T", "g:Direction"):
        return f"T.{inner}" if kind == "g:T" else inner
    return decode_response(inner)


def decode_responses(frame: DataFrame, column: str) -> DataFrame:
    """A column of tagged responses (JSON) as plain JSON."""
    ship_package(frame.sparkSession)

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        import json

        return texts.map(lambda t: None if t is None else json.dumps(decode_response(json.loads(t)), ensure_ascii=False))

    return frame.withColumn(column, decode(F.col(column)))


def index_documents(vertices: DataFrame, embed: Column | None = None) -> DataFrame:
    """Search documents of vertices: their text, and a vector if there is an embedder."""
    text = F.concat(F.col("type"), F.lit(": "), F.col("label"), F.lit(". "), F.coalesce("source_text", F.lit("")))
    out = vertices.select(F.col("id").alias("entity_id"), F.col("type").alias("node_type"), F.col("label").alias("node_label"), text.alias("text_content"))
    return out if embed is None else out.withColumn("embedding", embed)


def hashed_embedding(text: Column, dimension: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed hashes of words, of unit length."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    places = F.sequence(F.lit(0), F.lit(dimension - 1))
    value = F.transform(places, lambda p: F.aggregate(F.filter(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)) == p), F.lit(0.0), lambda s, w: s + F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)))
    norm = F.sqrt(F.aggregate(value, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(value, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def embed_distinct(frame: DataFrame, text: str, embed) -> DataFrame:
    """Each row's vector, with the model run once for each distinct text (``embed``: a function
    of a list of texts)."""
    ship_package(frame.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(embedding=list(embed(part["_t"].tolist())))

    vectors = frame.select(F.col(text).alias("_t")).distinct().mapInPandas(run, "_t string, embedding array<float>")
    return frame.join(vectors, F.col(text).eqNullSafe(F.col("_t")), "left").drop("_t")


def cached(requests: DataFrame, cache: DataFrame, live: Column) -> DataFrame:
    """The cached answer of each request by persona and the first 80 characters of its query, else
    the live one; ``from_cache`` says which."""
    key = F.concat(F.lit("mock/"), "persona", F.lit("/"), F.substring("query", 1, 80), F.lit(".json"))
    hit = requests.withColumn("cache_key", key).join(cache, "cache_key", "left")
    return hit.withColumn("from_cache", F.col("response").isNotNull()).withColumn("response", F.coalesce("response", live))


def chunked(frame: DataFrame, id_: list[str], text: str, size: int = 40) -> DataFrame:
    """A row for each ``size`` characters of a text, in order."""
    return frame.select(*id_, F.posexplode(slices(F.col(text), size)).alias("pos", "chunk"))


def event_lines(frame: DataFrame, kind: str, value: Column) -> DataFrame:
    """Lines of an event stream: ``0:`` text, ``2:`` data, ``8:`` annotation, then JSON."""
    prefix = F.element_at(F.create_map(*[F.lit(x) for x in ("text", "0:", "data", "2:", "annotation", "8:")]), F.col(kind))
    return frame.withColumn("line", F.concat(prefix, value))


def health(parts: dict[str, DataFrame]) -> dict[str, bool]:
    """Whether each table can be read and has a row."""
    out = {}
    for name, frame in parts.items():
        try:
            out[name] = frame.limit(1).count() == 1
        except Exception as error:  # any failure to read means unhealthy
            out[name] = False
            del error
    return out
