"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes (inserts, deletes, revised counts) is aggregated to one signed row for each group and added to the
totals before it. The new totals, and the table of batches that are in them, are written aside and then published by one
small file of the store's log, which names them. What isn't in the log isn't there: a commit that dies half way leaves the
old totals, and readers never see a part of one. A batch that the table has already is a replay: with the same content it changes nothing, with other
content it is an error. A store has one writer at a time; readers may come at any time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import hadoop
from .common import Stored

GROUP = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts go, new ones come; a group whose numbers are the same in both nets to nothing."""
    return deletes(old).unionByName(inserts(new))


def count_tokens(docs: DataFrame, tokenizer: str, ranks_path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and GROUP columns and tokens of each row, by the rank file at ``ranks_path`` (by default the public 50k one);
    ``tokenizer`` is the version's name. Null texts have no token; null sources and languages are groups of their own."""
    if ranks_path is None:
        import public_tokenizers

        ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = docs.select(*(docs[c] for c in keep or []), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.col(text).alias("tokens"))
    names, last = kept.columns, len(kept.columns) - 1
    counted = kept.withColumn("tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .packing import Encoder

        encode = Encoder(ranks_path)
        for batch in batches:
            n = [encode.count(t or "") for t in batch.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(n, pa.int64())], names=names)

    return kept.mapInArrow(run, counted)


class Rollup:
    """The store at ``path`` in a shared folder. Its log's newest entry names the totals and the table of all batches that
    they contain; entries before the last but one, and tables that neither of the last two names, are removed by the next
    commit. So the store stays of bounded size but for one short row a batch, and a replay is known however old it is."""

    BATCHES = "batch string, groups string, digest string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _entries(self) -> list[str]:
        files, at = hadoop(self.spark, f"{self.path}/log")
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        return sorted(n for n in names if n.endswith(".json") and n[0].isdigit())

    def _entry(self, name: str) -> dict | None:
        line = self.spark.read.text(f"{self.path}/log/{name}").first()
        return json.loads(line.value) if line and line.value.endswith("}") else None

    def _last(self) -> dict | None:
        """The newest whole entry: one that its writer died in counts for nothing."""
        return next((e for n in reversed(self._entries()) if (e := self._entry(n))), None)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of signed rows; False if it is a replay. Pre-aggregation runs before the shuffle, so a hot group is
        one row a task. An empty batch is a valid commit. A batch's id may be any text."""
        net = Stored(_summed(deltas.select(*GROUP, "docs", "tokens")), "net")
        content = net.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*GROUP, "docs", "tokens").cast("decimal(38,0)"))).first()
        content = [str(x) for x in content]
        last = self._last()
        if seen := self._batches(last).where(F.col("batch") == batch).first():
            net.drop()
            if [seen.groups, seen.digest] != content:
                raise ValueError(f"batch {batch} was committed with other content")
            return False
        one = self.spark.createDataFrame([(batch, *content)], self.BATCHES)
        self._publish(last, _summed(self._totals(last).unionByName(net.df)), self._batches(last).unionByName(one))
        net.drop()
        return True

    def _publish(self, last: dict | None, totals: DataFrame, batches: DataFrame) -> None:
        tag, nth = uuid.uuid4().hex, last["nth"] + 1 if last else 0
        totals.write.parquet(f"{self.path}/totals-{tag}")
        batches.coalesce(1).write.parquet(f"{self.path}/batches-{tag}")  # a short row a batch
        files, at = hadoop(self.spark, f"{self.path}/log/{nth:09d}.json")
        if files.exists(at) and self._entry(f"{nth:09d}.json") is None:
            files.delete(at, False)  # its writer died in it
        out = files.create(at, False)  # an error if it is there: another writer
        out.write(bytearray((json.dumps({"nth": nth, "tag": tag}) + "\n").encode()))
        out.close()
        self._clean({tag, last["tag"]} if last else {tag}, nth)

    def _clean(self, tags: set[str], nth: int) -> None:
        """Removes what no reader of this entry or of the one before can be at, dead commits' tables among it."""
        files, root = hadoop(self.spark, self.path)
        for f in files.listStatus(root):
            kind, _, tag = f.getPath().getName().partition("-")
            if kind in ("totals", "batches") and tag not in tags:
                files.delete(f.getPath(), True)
        for name in self._entries():
            if int(name.removesuffix(".json")) < nth - 1:
                files.delete(hadoop(self.spark, f"{self.path}/log/{name}")[1], False)

    def _totals(self, entry: dict | None) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/totals-{entry['tag']}") if entry else self.spark.createDataFrame([], SCHEMA)

    def _batches(self, entry: dict | None) -> DataFrame:
        return self.spark.read.schema(self.BATCHES).parquet(f"{self.path}/batches-{entry['tag']}") if entry else self.spark.createDataFrame([], self.BATCHES)

    def totals(self) -> DataFrame:
        """GROUP columns, docs and tokens of the groups that aren't empty, as of the last commit; no rows without one."""
        return self._totals(self._last())

    def compact(self, target: str) -> Rollup:
        """A new store at ``target`` with these totals in few files. It knows every batch of this one, so a replay there
        changes nothing either. A store that is there already is an error."""
        out, last = Rollup(self.spark, target), self._last()
        if out._entries():
            raise ValueError(f"{target} holds a store")
        if last:
            out._publish(None, self._totals(last).repartition(1 + self._totals(last).count() // 1_000_000), self._batches(last))
        return out


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
