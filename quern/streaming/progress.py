"""Incremental scoring: new files of generations are scored once, across restarts and crashes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import extract_answer
from ..sources.readers import parse_jsonl
from ..sources.scratch import hadoop


def stream_jsonl(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of rows and ``malformed``, as read_jsonl gives them."""
    return parse_jsonl(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder), schema)


def score_answers(generations: DataFrame, out: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Append the extracted answer of every new generation to ``out``; the checkpoint is where a restart resumes. A
    malformed line is no generation and has a null answer."""
    answer = extract_answer(generations[text])
    if "malformed" in generations.columns:
        answer = F.when(~F.col("malformed"), answer)
    return generations.withColumn("answer", answer).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ScoreStore:
    """Scored generations at ``path``, published batch by batch.

    A batch is written aside; one small file of the ledger then names its tables, and from then on readers see it whole.
    What the ledger doesn't name isn't there: a run that dies between writing and publishing leaves nothing, one that dies
    between publishing and the stream's own commit finds its batch in the ledger when it is replayed and writes nothing.
    Malformed lines go to a table of their own. ``compact`` folds the published batches into one entry, so that readers
    read few tables; batches that it folds stay known. A store has one writer at a time.
    """

    TABLES = ("scored", "bad")

    def __init__(self, spark: SparkSession, path: str, schema: str, text: str = "text"):
        self.spark, self.path, self.schema, self.text = spark, path.rstrip("/"), schema, text

    def _entries(self) -> tuple[int, list[dict]]:
        """Last batch of the newest base (-1: none), and the entries that count: that base and those after it."""
        files, at = hadoop(self.spark, f"{self.path}/ledger")
        if not files.exists(at):
            return -1, []
        names = [f.getPath().getName() for f in files.listStatus(at)]
        number = lambda n: int(n.rpartition(".")[0].rpartition("-")[2])
        upto = max((number(n) for n in names if n.startswith("base-") and n.endswith(".json")), default=-1)
        kept = [f"base-{upto:012d}.json"] * (upto >= 0) + [n for n in names if n.startswith("batch-") and n.endswith(".json") and number(n) > upto]
        if not kept:
            return upto, []
        lines = self.spark.read.text([f"{self.path}/ledger/{n}" for n in kept]).collect()  # a line an entry since the base
        return upto, [json.loads(r.value) for r in lines]

    def _publish(self, name: str, entry: dict) -> None:
        """The entry appears under its name at once or not at all."""
        files, aside = hadoop(self.spark, f"{self.path}/ledger/.{uuid.uuid4().hex}")
        out = files.create(aside, False)
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
        out.close()
        _, at = hadoop(self.spark, f"{self.path}/ledger/{name}.json")
        if files.exists(at) or not files.rename(aside, at):
            raise OSError(f"{name} is in the ledger: another writer")

    def has(self, batch: int) -> bool:
        upto, entries = self._entries()
        return batch <= upto or any(e["batch"] == batch for e in entries)

    def add(self, lines: DataFrame, batch: int) -> bool:
        """Score a batch of lines (``value``) and publish it; False if it is published already."""
        if self.has(batch):
            return False
        folder, rows = f"batch-{batch}-{uuid.uuid4().hex}", parse_jsonl(lines, self.schema, keep_line=True)
        counts = self._write(folder, rows.withColumn("answer", extract_answer(F.col(self.text))))
        self._publish(f"batch-{batch:012d}", {"batch": batch, "folder": folder, **counts})
        return True

    def _write(self, folder: str, rows: DataFrame) -> dict[str, int]:
        """Both tables of a batch in one pass over the lines, as one table cut by ``malformed``; rows of each are counted on the way."""
        from pyspark.sql import Observation

        seen = Observation()
        counted = rows.observe(seen, F.count_if(~F.col("malformed")).alias("scored"), F.count_if("malformed").alias("bad"))
        counted.write.partitionBy("malformed").parquet(f"{self.path}/{folder}")
        return seen.get

    def run(self, folder: str, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
        """Score the files of a folder that the checkpoint hasn't seen, and end."""
        lines = self.spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
        return lines.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _table(self, malformed: bool) -> DataFrame:
        from pyspark.sql.types import _parse_datatype_string

        schema = _parse_datatype_string(self.schema).add("line", "string").add("answer", "string").add("malformed", "boolean")
        folders = [f"{self.path}/{e['folder']}" for e in self._entries()[1] if e["scored"] + e["bad"]]
        if not folders:
            return self.spark.createDataFrame([], schema).drop("malformed")
        every = None
        for f in folders:
            part = self.spark.read.schema(schema).parquet(f)
            every = part if every is None else every.unionByName(part)
        return every.where(F.col("malformed") == malformed).drop("malformed")

    def scored(self) -> DataFrame:
        """The schema's columns and the answer of every published generation."""
        return self._table(False).drop("line")

    def bad(self) -> DataFrame:
        """Published lines that are no JSON object of the schema."""
        return self._table(True).select("line")

    def progress(self) -> dict[str, int]:
        """Published batches, generations and malformed lines."""
        entries = self._entries()[1]
        return {"batches": sum(e.get("batches", 1) for e in entries), **{t: sum(e[t] for e in entries) for t in self.TABLES}}

    def compact(self) -> None:
        """Fold what is published into one entry and one folder; the folders before stay for readers that are at them."""
        _, entries = self._entries()
        if len(entries) < 2:
            return
        last, folder = max(e["batch"] for e in entries), f"base-{uuid.uuid4().hex}"
        both = self._table(False).withColumn("malformed", F.lit(False)).unionByName(self._table(True).withColumn("malformed", F.lit(True)), allowMissingColumns=True)
        both.write.partitionBy("malformed").parquet(f"{self.path}/{folder}")
        self._publish(f"base-{last:012d}", {"batch": last, "folder": folder, **self.progress()})
