"""Quality rules of documents, judged again at the level of their host.

Rules fail single documents; failures are then counted by host, each host's rate is shrunk
towards the corpus by a beta prior fitted to all hosts' rates (method of moments), and hosts
whose shrunk rate reaches a limit fail with all their documents.

Defined cases: a null text has no words and so fails; a null host is a host of its own; repeated
rows count each; an empty table gives no rows; only the named columns are read, so further
columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import durable, ship

#: The white space that parts words, and the symbols that are counted.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Hosts whose verdicts are broadcast, counted before; beyond, each host is dealt in so many parts, so that none meets in one task.
BROADCAST_HOSTS, SALTS = 5_000, 64


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """The counts that the rules use, over one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes part at exactly the six characters of SPACE
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, reach = Counter(windows), 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _measured(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(measures(x.as_py()) for x in batch.column(2)))) or [[]] * 5
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in found)], schema=schema)

    return run


def host_verdicts(judged: DataFrame, most_failed: float) -> DataFrame:
    """host, n_docs, n_failed, prior_a, prior_b, host_rate, host_ok from one row a document.

    The prior's mean and strength are those that the spread of the hosts' rates implies, sampling
    noise taken off; a spread no wider than the noise gives a strength that trusts the corpus.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    p, one = F.col("n_failed") / F.col("n_docs"), F.lit(1.0)
    seen = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("__mean"), F.avg(p * p).alias("__square"), F.avg(p).alias("__plain"), F.avg(one / F.col("n_docs")).alias("__noise")
    )
    mean = F.greatest(F.least(F.col("__mean"), F.lit(0.999)), F.lit(0.001))
    spread = F.col("__square") - F.col("__plain") * F.col("__plain") - mean * (1 - mean) * F.col("__noise")
    strength = F.greatest(F.least(mean * (1 - mean) / F.greatest(spread, F.lit(1e-6)) - 1, F.lit(1000.0)), F.lit(2.0))
    prior = seen.select((mean * strength).alias("prior_a"), ((1 - mean) * strength).alias("prior_b"))
    rate = (F.col("n_failed") + F.col("prior_a")) / (F.col("n_docs") + F.col("prior_a") + F.col("prior_b"))
    # the prior is a single row
    return hosts.join(F.broadcast(prior), F.lit(True)).withColumn("host_rate", F.round(rate, 9)).withColumn("host_ok", F.col("host_rate") < most_failed)


def apply_rules(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_failed: float = 0.5
) -> DataFrame:
    """One row a document: the measures, base_failed, kept, then host, host_rate."""
    ship(documents.sparkSession)
    read = documents.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    arrow = pa.schema([("doc_id", pa.string() if kind == "string" else pa.int64()), ("host", pa.string()), *((m, pa.int64()) for m in MEASURES)])
    found = read.mapInArrow(_measured(arrow), f"doc_id {kind}, host string, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = durable(found.withColumn("base_failed", failed))
    verdicts = host_verdicts(judged, most_failed).select(F.col("host").alias("__host"), "host_rate", "host_ok")
    # checked before the hint: few rows of one short key and two numbers
    if len(judged.select("host").distinct().limit(BROADCAST_HOSTS + 1).collect()) <= BROADCAST_HOSTS:
        joined = judged.join(F.broadcast(verdicts), F.col("host").eqNullSafe(F.col("__host")))
    else:
        dealt = judged.withColumn("__part", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
        parts = verdicts.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(parts, F.col("host").eqNullSafe(F.col("__host")) & (F.col("__part") == F.col("__of")))
    return joined.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"), "host", "host_rate")
