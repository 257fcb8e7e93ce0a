"""Notes that keep coming: a folder watched by Structured Streaming, each batch merged into the table of notes.

What `KnowledgeBase.ingest_notes` does with a folder at once, this does with files
as they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from inkwell.base import KnowledgeBase, utc_now
from inkwell.operators import merge
from inkwell.sources.notes import parsed


def watch(base: KnowledgeBase, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Takes in the *.md files of a folder that haven't been taken in yet; with `once` it stops when there are no more.

    Files of a batch are taken in the order of their paths.  A batch that is
    repeated after a failure gives the same notes again.
    """
    spark = base.spark
    found = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    texts = found.select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text"))

    def take(batch: DataFrame, _: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        rows = parsed(batch).select(F.split("path", "/").alias("seq"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*\z", "").alias("stem"), "meta", "body")
        base.take(merge.gate_notes(rows).where("reason is null"), utc_now())

    query = texts.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
