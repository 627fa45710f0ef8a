"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes becomes one signed delta per total it touches: what a document counted before is taken away, what it
counts now is added. Totals are the sum of all committed deltas. A batch is committed by the marker written last, under
a name of the caller's choice; committing that name again changes nothing, and what an unfinished attempt left behind is
overwritten by the next one.

What documents count is kept in buckets by hash of the document. A batch reads only the buckets its documents are in, and
of these the last base, which holds one entry per document, and the batches since: cost follows the batch and its buckets,
not the history. Every ``compact`` batches a new base and its totals are written; until they are complete the old one counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm.common import whole

GROUP = ["source", "lang", "version"]
AMOUNTS = ["n_docs", "n_tokens", "n_bytes"]
ENTRY = "doc_id long, source string, lang string, version string, n_tokens long, n_bytes long, live boolean, batch string, turn long"
DELTA = "source string, lang string, version string, n_docs long, n_tokens long, n_bytes long"
_loaded: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, one per worker process."""
    if path not in _loaded:
        import base64

        import public_tokenizers

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _loaded[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, version: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, source, lang, version, n_tokens, n_bytes of every row's whole text; a missing text counts nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            n = pd.Series([len(encode(t)) for t in batch["t"]], dtype="int64")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "lang": batch["lang"], "n_tokens": n, "n_bytes": batch["n_bytes"]})

    t = whole(text)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"),
        F.octet_length(t).cast("long").alias("n_bytes"), t.alias("t"),
    )
    # Ids beyond 2^53 must not pass through floats on the way to pandas.
    found = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, source string, lang string, n_tokens long, n_bytes long")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.lit(version).alias("version"), "n_tokens", "n_bytes")


class Rollup:
    """Totals kept below ``folder``, which every executor reaches. One writer at a time.

    ``buckets`` belongs to the folder and must not change; more of them make small batches cheaper.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, compact: int = 8):
        self.spark, self.folder, self.buckets, self.compact = spark, folder.rstrip("/"), buckets, compact

    def _found(self, pattern: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        return [f.getPath().toString() for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []]

    def batches(self) -> list[str]:
        """Names of the committed batches, in order of commit."""
        if not self._found("commits"):
            return []
        rows = self.spark.read.schema("batch string, turn long").parquet(f"{self.folder}/commits/*").orderBy("turn", "batch").collect()
        return [r["batch"] for r in rows]

    def base(self) -> int:
        """Number of batches that the last complete base covers; 0 if there is none. Its totals are written last."""
        return max((int(path.split("/")[-3]) for path in self._found("bases/*/totals/_SUCCESS")), default=0)

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        """The tables at ``paths``, of which there are as many as batches since the last base, and that."""
        out = self.spark.createDataFrame([], schema)
        for path in paths:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/{path}"))
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id", "version"), F.lit(self.buckets)).cast("int")

    def _store(self, entries: DataFrame, path: str) -> None:
        entries.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{path}")

    def entries(self, buckets: list[int] | None = None) -> DataFrame:
        """What every document counts now, dead ones included: the latest committed entry per document and version.

        With ``buckets`` only those are read.
        """
        base, done = self.base(), self.batches()
        paths = [f"bases/{base}/entries"] * (base > 0) + [f"entries/{b}" for b in done[base:]]
        log = self._read(paths, f"{ENTRY}, bucket int")
        if buckets is not None:
            log = log.filter(F.col("bucket").isin(buckets))
        value = F.struct("turn", "source", "lang", "n_tokens", "n_bytes", "live", "batch")
        latest = log.groupBy("doc_id", "version").agg(F.max(value).alias("e"))
        return latest.select("doc_id", "version", "e.*")

    def _compact(self) -> None:
        """Write a base of all batches: one live entry per document, and the totals."""
        n = len(self.batches())
        live = self.entries().filter("live")
        self._store(live, f"bases/{n}/entries")
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/bases/{n}/totals")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens, n_bytes over all committed deltas; totals without documents go."""
        base = self.base()
        paths = [f"bases/{base}/totals"] * (base > 0) + [f"deltas/{b}" for b in self.batches()[base:]]
        sums = self._read(paths, DELTA).groupBy(*GROUP).agg(*[F.sum(a).alias(a) for a in AMOUNTS])
        return sums.filter("n_docs <> 0")

    def commit(self, changes: DataFrame, batch: str) -> bool:
        """Apply a batch; False, and nothing done, if a batch of that name is committed.

        ``changes`` has doc_id, version, action (insert, revise or delete), source, lang, n_tokens, n_bytes. An insert of
        a document that is there is a revision and a revision of one that is not an insert, so sending a document twice
        does not count it twice; deleting one that is not there does nothing. Of several changes to one document and
        version in a batch one counts, by a fixed order: the delete if there is one, else the largest source, language
        and counts. Missing sources and languages are totals of their own. Rows without doc_id, version or a known
        action are ignored; missing counts are zero. An empty batch is committed as such.
        """
        done = self.batches()
        if batch in done:
            return False
        turn = len(done)
        known = changes.filter(F.col("doc_id").isNotNull() & F.col("version").isNotNull() & F.col("action").isin("insert", "revise", "delete"))
        new = known.select(
            F.col("doc_id").cast("long").alias("doc_id"), "version",
            F.struct(
                (F.col("action") == "delete").alias("gone"), "source", "lang",
                F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), F.coalesce(F.col("n_bytes").cast("long"), F.lit(0)).alias("n_bytes"),
            ).alias("e"),
        ).groupBy("doc_id", "version").agg(F.max("e").alias("e"))
        entries = new.select(
            "doc_id", "e.source", "e.lang", "version", "e.n_tokens", "e.n_bytes", (~F.col("e.gone")).alias("live"),
            F.lit(batch).alias("batch"), F.lit(turn).cast("long").alias("turn"),
        )
        self._store(entries, f"entries/{batch}")
        entries = self._read([f"entries/{batch}"], f"{ENTRY}, bucket int")
        # As many names as there are buckets at most.
        touched = sorted(r["bucket"] for r in entries.select("bucket").distinct().collect())
        known = self.entries(touched).filter("live")
        old = known.join(entries.select("doc_id", "version").hint("shuffle_merge"), ["doc_id", "version"], "left_semi")
        plus = entries.filter("live").select(*GROUP, F.lit(1).alias("n_docs"), "n_tokens", "n_bytes")
        minus = old.select(*GROUP, F.lit(-1).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_bytes")).alias("n_bytes"))
        signed = plus.unionByName(minus).groupBy(*GROUP).agg(*[F.sum(a).alias(a) for a in AMOUNTS])
        signed.filter("n_docs <> 0 or n_tokens <> 0 or n_bytes <> 0").write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch}")
        marker = self.spark.createDataFrame([(batch, turn)], "batch string, turn long")
        marker.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{batch}")
        if turn + 1 - self.base() >= self.compact:
            self._compact()
        return True
