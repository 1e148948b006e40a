"""Sources: images, transcription records, vocabularies, ledgers, scenes and tables of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionflow.operators.vocab import SPECIALS
from regionflow.sources import schema
from regionflow.sources.images import decode_images

# The files of a model.
MODEL_FILES = ("encoder_model.onnx", "decoder_model.onnx", "decoder_with_past_model.onnx", "vocab.txt")


def images(spark: SparkSession, paths: list[str], pattern: str = "*.{png,pgm,jpg}", recursive: bool = False) -> DataFrame:
    """(path, content, length) of files, folders and globs; each path once, in order of paths."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        read = read.option("recursiveFileLookup", "true")
    return read.load(paths).select("path", "content", "length").dropDuplicates(["path"]).orderBy("path")


def pages(files: DataFrame) -> DataFrame:
    """(path, width, height, pixels, error) of image files; a file that can't be decoded has an error and goes on."""
    return decode_images(files)


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line, text, intentional) of transcription records in a folder tree: .jsonl by line, .json as one record.

    Blank lines are skipped. A line that isn't a record, a rejected record or a text that isn't a string is an
    error that names file and line.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*")
    whole = read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    is_lines = F.endswith("path", F.lit(".jsonl"))
    kept = whole.filter(is_lines | F.endswith("path", F.lit(".json")))
    rows = kept.select("path", F.posexplode(F.when(is_lines, F.split("value", "\n")).otherwise(F.array("value"))).alias("k", "body"))
    rows = rows.filter(F.regexp_replace("body", r"(?U)\s", "") != "")
    record = F.from_json("body", schema.LABEL, {"mode": "PERMISSIVE"})
    kind = F.expr("schema_of_variant(try_variant_get(try_parse_json(body), '$.text', 'variant'))")
    place = F.concat(F.col("path"), F.lit(":"), (F.col("k") + 1).cast("string"))
    problem = (
        F.when(F.expr("try_parse_json(body) is null"), "not a record")
        .when(F.col("r.provenance.state") == "rejected", "a rejected record")
        .when(F.coalesce(kind, F.lit("")) != "STRING", "text is not a string")
    )
    checked = rows.withColumn("r", record).withColumn("problem", problem)
    text = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(place, F.lit(": "), F.col("problem")))).otherwise(F.col("r.text"))
    return checked.select("path", (F.col("k") + 1).cast("long").alias("line"), text.alias("text"), F.coalesce("r.empty_is_intentional", F.lit(False)).alias("intentional"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of a vocabulary file: the line number is the id, blank lines keep their place, the first of equal
    tokens counts. An empty file or a missing special token is an error."""
    whole = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\n$", "")
    lines = whole.select(F.posexplode(F.split(body, "\n")).alias("id", "token")).filter("token != ''")
    tokens = lines.groupBy("token").agg(F.min("id").cast("long").alias("id")).select("id", "token")
    have = {r["token"] for r in tokens.filter(F.col("token").isin(*SPECIALS)).collect()}
    if missing := [s for s in SPECIALS if s not in have]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return tokens


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark rows of a JSON array; missing fields take their defaults."""
    rows = spark.read.schema(schema.LEDGER).option("multiLine", "true").json(path)
    defaults = {"status": "fail", "cer_divergence": 1.0, "confidence": 0.0, "expected_text": "", "actual_text": "", "label_kind": "crop"}
    return rows.na.fill(defaults)


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scene documents, nested as they are."""
    return spark.read.schema(schema.SCENE).option("multiLine", "true").json(path)


def scene_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """Pages, panels, containers, text regions and art regions of scene documents as flat tables."""
    pages_ = documents.select(F.col("id").alias("document_id"), F.explode("pages").alias("p"))

    def part(name: str, *columns) -> DataFrame:
        return pages_.select(F.col("p.id").alias("page_id"), F.explode(f"p.{name}").alias("e")).select("page_id", *columns)

    box = lambda path: [F.col(f"e.{path}.px.{c}").alias(n) for c, n in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))]
    return {
        "pages": pages_.select("document_id", F.col("p.id").alias("page_id"), F.col("p.pageNumber").alias("number"), *(F.size(f"p.{c}").alias(c) for c in ("panels", "containers", "text_regions"))),
        "panels": part("panels", F.col("e.id").alias("idx"), F.col("e.logicalOrder").alias("reading_order"), *box("frame.bounds")),
        "containers": part("containers", F.col("e.id").alias("id"), F.col("e.panelId").alias("panel_id"), F.col("e.type").alias("type")),
        "texts": part("text_regions", F.col("e.id").alias("idx"), F.col("e.panelId").alias("panel"), F.col("e.translation.displayText").alias("display"), *box("geometry.bounds")),
        "art": part("art_regions", F.col("e.panelId").alias("panel"), F.col("e.protection").alias("protection"), F.col("e.penalty").alias("weight"), *box("bounds")),
    }


def model_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name to path of the files that a model needs; the first that is missing is an error that names it. Contents aren't read."""
    listed = spark.read.format("binaryFile").load(folder).select("path")
    found = {r["path"].rsplit("/", 1)[1]: r["path"] for r in listed.filter(F.element_at(F.split("path", "/"), -1).isin(*MODEL_FILES)).collect()}
    for name in MODEL_FILES:
        if name not in found:
            raise ValueError(f"{name} is missing from the model directory {folder}")
    return {name: found[name] for name in MODEL_FILES}


def settings(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A CSV table with a header; quotes are doubled inside quoted fields."""
    return spark.read.schema(columns).option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with `ordinal` from 0 in a total order. For small listings: all rows are ranked in one task."""
    return df.withColumn("ordinal", (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))
