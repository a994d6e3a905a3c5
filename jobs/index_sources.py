"""Keep a search index of source texts up to date: index what has arrived since the last run.

    python -m jobs.index_sources --input IN --output OUT --checkpoint CHECKPOINT [--config FILE]

``IN`` is a folder to which Parquet files of texts are added, or a pattern of folders or files.  Each run is a file stream that takes the
files its checkpoint doesn't know, in batches of ``files_per_batch``, and ends.  A batch adds its own partitions to
``OUT/postings`` (batch, shard) and ``OUT/files`` (batch); one that runs again after a failure overwrites them.  A text whose
file name comes again in a later batch takes the place of the earlier one when the index is read (``search.Index.load``).

The config names the SQL expressions of a text's file, content and package.  Running without new files changes nothing.
"""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquery.graph import exists
from meshquery.session import ship, shared_folder
from meshquery.sources import search

log = logging.getLogger("jobs.index_sources")
CONFIG = Path(__file__).with_suffix(".json")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """Index what is new in ``source``; gives the postings of all runs so far."""
    digits = int(config["shard_digits"])
    texts = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", int(config["files_per_batch"])).parquet(source)
    texts = texts.select(*[F.expr(config[c]).cast("string").alias(c) for c in search.FIELDS]).where("file IS NOT NULL")

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # it is read for the postings and for the files; what doesn't fit goes to disk
        search.write_batch(batch, output, number, digits)
        batch.unpersist()
        put = spark.read.schema(search.FILES).parquet(f"{output}/files").where(F.col("batch") == number).agg(F.count("*").alias("files"), F.sum("n_tokens").alias("tokens")).first()
        log.info("batch %d: wrote %d files of %s words to %s", number, put.files, put.tokens, output)

    query = texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows of %s in %d batches", sum(p["numInputRows"] for p in query.recentProgress), source, sum(p["numInputRows"] > 0 for p in query.recentProgress))
    if not exists(spark, f"{output}/postings"):  # nothing has ever arrived
        return spark.createDataFrame([], search.POSTINGS)
    return spark.read.schema(search.POSTINGS).parquet(f"{output}/postings")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job1: two runs over ``documents`` into one new folder, and the index as it stands then, positions joined by commas."""
    at = f"{shared_folder(ship(spark))}/job1-{uuid.uuid4().hex}"
    config = json.loads(CONFIG.read_text())
    for _ in range(2):
        out = run(spark, f"{sf_dir}/documents.parquet*", f"{at}/index", f"{at}/checkpoint", config)
    return out.withColumn("positions", F.array_join("positions", ","))


#: The whole index of ``documents``: positions are 0-based places in the field, the shard is a digit of the word's MD5.
SQL = r"""
WITH d AS (SELECT 'doc' || doc_id || '.go' AS file, text, source FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT file, unnest(['file', 'content', 'package']) AS field, unnest([file, coalesce(text, ''), coalesce(source, '')]) AS body FROM d),
w AS (SELECT file, field, list_filter(regexp_split_to_array(translate(lower(body), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM f),
p AS (SELECT file, field, unnest(ws) AS term, unnest(range(len(ws)))::INT AS position FROM w)
SELECT term, field, file, list_aggregate(list_sort(list(DISTINCT position)), 'string_agg', ',') AS positions, 0::BIGINT AS batch, substr(md5(term), 1, 1) AS shard FROM p GROUP BY term, field, file
"""


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("input", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("index_sources").getOrCreate()  # master and settings are those of spark-submit
    try:
        run(spark, args.input, args.output, args.checkpoint, json.loads(Path(args.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
