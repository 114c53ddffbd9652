"""Continuous ingest of new documents: spans in, sections and entities out, each document once.

What a sink holds is kept in an index beside it (``<sink>-index``, see ``membership``), so a batch opens
only the buckets that may hold one of its documents. Within a sink one stream at a time may run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.functions.skew import buckets_for
from quireworks.operators import entities, layout
from quireworks.sources import schemas
from quireworks.staging import scratch, stage
from quireworks.streaming.membership import Membership, children


def read_span_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New span files with the name of the file each row came from."""
    return (
        spark.readStream.schema(schemas.SPANS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
        .withColumn("file", F.input_file_name())
    )


def fingerprints(spans: DataFrame) -> DataFrame:
    """(doc_id, content): one number for the distinct spans of each document, whatever files they came in."""
    place = ["page", "block_no", "line_no", "span_no"]
    row = F.xxhash64(*(c for c in spans.columns if c not in ("doc_id", "file")))
    distinct = spans.groupBy("doc_id", *place).agg(F.min(row).alias("least"), F.max(row).alias("most"))
    return distinct.groupBy("doc_id").agg(
        F.bit_xor(F.xxhash64(*place, "least")).alias("content"),
        F.max(F.col("least") != F.col("most")).alias("conflict"),
    )


def sort_out(spans: DataFrame, entries: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The spans of new documents, each once, and (doc_id, reason) of what cannot be taken in.

    A document may come in several files of a batch. It is refused if two files disagree on a span, or if
    it was taken in before with other content; the same content again has no effect. ``entries`` gives
    (doc_id, content) of earlier documents, at least of those that it is asked for.
    """
    prints = stage(fingerprints(spans), "batch-documents")
    done = entries(prints.select("doc_id"))
    earlier = done.select("doc_id", F.col("content").alias("known")).join(prints.select("doc_id"), "doc_id", "left_semi")
    earlier = earlier.groupBy("doc_id").agg(F.max("known").alias("known"))
    judged = prints.join(earlier, "doc_id", "left").withColumn(
        "reason",
        F.when(F.col("conflict"), "files of one document disagree").when(F.col("known") != F.col("content"), "already taken in with other content"),
    )
    judged = stage(judged, "batch-judged")
    fresh = judged.where("reason IS NULL AND known IS NULL").select("doc_id", "content")
    columns = [c for c in spans.columns if c != "file"]
    taken = spans.join(fresh, "doc_id").select(*columns, "content").distinct()
    return taken, judged.where("reason IS NOT NULL").select("doc_id", "reason")


def process_batch(taken: DataFrame, mode: str = "strict") -> DataFrame:
    """Sections and entities of the documents in ``taken`` (spans with ``content``)."""
    blocks = layout.blocks_with_sections(taken.drop("content"), mode, tasks=buckets_for(taken))  # written already
    docs = layout.with_full_text(layout.document_sections(blocks))
    found = entities.with_entities(docs, "full_text").select(
        "doc_id", "sections", "sections_found", entities.entity_names().alias("entities")
    )
    # a document without any text block is taken in as well, with nothing found
    return taken.select("doc_id", "content").distinct().join(found, "doc_id", "left")


COMPACT_EVERY = 32  # batches


def catch_up(spark: SparkSession, sink: str, index: Membership) -> list[str]:
    """Index the batches of ``sink`` that the index has no mark of: of a stream that broke off, or from before the index."""
    marked, missing = set(children(spark, f"{index.path}/batches")), []
    for run in children(spark, sink):
        for batch in children(spark, f"{sink}/{run}"):
            folder = f"{sink}/{run}/{batch}"
            if run.startswith("run=") and f"{run},{batch}" not in marked and "_SUCCESS" in children(spark, folder):
                number = int(batch.split("=")[1])
                rows = spark.read.schema("doc_id BIGINT, content BIGINT").parquet(folder)
                add_batch(rows, index, run.split("=", 1)[1], number)
                missing.append(f"{run}/{batch}")
    return missing


def add_batch(rows: DataFrame, index: Membership, run: str, batch: int) -> None:
    """Enter a batch's documents (doc_id, content) and mark it as entered."""
    spark = rows.sparkSession
    index.add(rows.select("doc_id", "content", F.lit(run).alias("run"), F.lit(batch).cast("bigint").alias("batch")))
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{index.path}/batches/run={run},batch={batch}")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()


def ingest(stream: DataFrame, sink: str, checkpoint: str, mode: str = "strict", index: Membership | None = None) -> object:
    """Start the ingest.

    Each batch writes its own folder ``run=<id of the stream>/batch=<n>``; the id is kept in the
    checkpoint, so a repeated batch replaces itself and another stream never meets its folders. What is
    refused goes to ``<sink>-refused`` in the same way. The index follows the sink: a batch that broke off
    in between is entered when it is repeated, or when the next stream starts.
    """
    index = index or Membership(f"{sink}-index")
    catch_up(stream.sparkSession, sink, index)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = "id-" + spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        folder = f"run={run}/batch={batch_id}"

        def others(keys: DataFrame) -> DataFrame:
            return index.entries_for(keys).where((F.col("run") != run) | (F.col("batch") != batch_id))

        with scratch(spark):
            taken, refused = sort_out(stage(batch, "batch"), others)
            taken = stage(taken, "batch-taken")
            process_batch(taken, mode).write.mode("overwrite").parquet(f"{sink}/{folder}")
            refused.write.mode("overwrite").parquet(f"{sink}-refused/{folder}")
            add_batch(stage(taken.select("doc_id", "content").distinct(), "batch-entries"), index, run, batch_id)
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            index.compact(spark)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
