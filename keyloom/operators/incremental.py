"""Processing only what the last successful run did not cover (problem 3)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keyloom.session import cut, file_bytes, file_system, publish_bytes


def last_checkpoints(checkpoints: DataFrame, kind: str) -> DataFrame:
    """The last successful checkpoint of each store: ``store_id, kl_ck, kl_started``.

    Successful: finished, not a temporary file, and as many records counted in
    the footer as were written.  The last is that with the highest LSN; of two
    with one LSN, that which started later.  Rows with null in any of these
    fields don't succeed.
    """
    lsn = {"raw": "checkpoint_lsn", "object": "lsn"}[kind]
    good = checkpoints.where((F.col("kind") == kind) & F.col("finished_at").isNotNull() & ~F.col("path").endswith(".tmp") & (F.col("footer_count") == F.col("record_count")))
    good = good.where(F.col(lsn).isNotNull() & F.col("started_at").isNotNull())
    best = good.groupBy("store_id").agg(F.max(F.struct(F.col(lsn).alias("l"), F.col("started_at").alias("s"))).alias("b"))
    return best.select("store_id", F.col("b.l").alias("kl_ck"), F.col("b.s").alias("kl_started"))


#: What a staged row is: beyond the checkpoint, a late copy below it, or processed in time.
BEYOND, LATE, PROCESSED = 0, 1, 2


def stage(log: DataFrame, checkpoints: DataFrame, kind: str) -> DataFrame:
    """One pass over ``log`` that stores what the last run processed apart from what it can't have seen.

    Returns store_id, rec_key, lsn and ``kl_part``.  Part ``PROCESSED`` is the
    processed ledger of (key, version) pairs; the others are what a new run has
    to look at.  Each part has a folder of its own, and files are in order of
    LSN, so that a reader skips what lies below the LSN it asks for.
    """
    marked = log.select("store_id", "rec_key", "lsn", "arrived_at").join(last_checkpoints(checkpoints, kind), "store_id", "left")
    beyond = F.col("kl_ck").isNull() | F.col("lsn").isNull() | (F.col("lsn") > F.col("kl_ck"))
    in_time = F.col("arrived_at").isNotNull() & (F.col("arrived_at") <= F.col("kl_started"))
    part = F.when(beyond, BEYOND).when(in_time, PROCESSED).otherwise(LATE)
    return cut(marked.select("store_id", "rec_key", "lsn", part.alias("kl_part")).sortWithinPartitions("kl_part", "lsn"), by=("kl_part",))


def null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of columns pair by pair, nulls equal."""
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def pending_records(log: DataFrame, checkpoints: DataFrame, kind: str) -> DataFrame:
    """Records of ``log`` (store_id, rec_key, lsn, arrived_at) that the last checkpoint does not cover.

    A record is covered if its LSN is at most the checkpoint's and its first
    copy arrived no later than the checkpoint started.  Steps:

    1. one pass stores the processed ledger and the candidates (:func:`stage`);
    2. what lies beyond the checkpoint's LSN, or has none, is pending;
    3. copies at or below it that arrived after the start are reread.  The
       lowest LSN among them is the store's oldest transaction that was open at
       the last run;
    4. rereads whose (key, version) pair stands in the ledger were covered by an
       earlier copy and drop out in an anti-join.  Of the ledger only what lies
       from the oldest open LSN on is read, and of that only stores that reread.

    Copies combine before each shuffle, so that a record delivered very often
    burdens no single task.  Each record comes out once.  A null arrival counts
    as later than any start; a record without LSN is pending in any case; null
    stores and keys are values like any other.  Stores without a successful
    checkpoint are pending as a whole.
    """
    ident, known = ["store_id", "rec_key", "lsn"], ["kl_s", "kl_k", "kl_l"]
    staged = stage(log, checkpoints, kind)
    new = staged.where(F.col("kl_part") == BEYOND).select(*ident)
    reread = staged.where(F.col("kl_part") == LATE).select(*ident).distinct()
    open_since = reread.groupBy(F.col("store_id").alias("kl_o")).agg(F.min("lsn").alias("kl_open"))
    oldest = open_since.agg(F.min("kl_open")).first()[0]
    if oldest is not None:
        ledger = staged.where((F.col("kl_part") == PROCESSED) & (F.col("lsn") >= F.lit(oldest))).select(*[F.col(a).alias(b) for a, b in zip(ident, known)])
        ledger = ledger.join(open_since, F.col("kl_s").eqNullSafe(F.col("kl_o")) & (F.col("kl_l") >= F.col("kl_open"))).select(*known).distinct()
        new = new.unionByName(reread.join(ledger, null_safe(ident, known), "left_anti"))
    return new.distinct()


class RunLedger:
    """A ledger of processed (key, version) pairs that makes reruns neither skip nor repeat.

    Each run writes its output and its ledger rows under a run id of its own
    and then publishes both with one numbered manifest, the commit point.  A
    run that fails before that leaves nothing that a later one reads.  Of two
    runs that started from one state only the first to publish counts; the
    other is told so and has to start again.

    A manifest lists the ledger parts that a later run may still need, so only
    the newest one is read.  With a low-water mark, the oldest transaction that
    is still open, the next run rereads from there, and parts that lie wholly
    below it are dropped from the list.
    """

    def __init__(self, spark: SparkSession, root: str, ident: Sequence[str], seq: str):
        self.spark, self.root, self.ident, self.seq = spark, root.rstrip("/"), list(ident), seq

    def state(self) -> dict:
        """The newest manifest; before the first run one that lists nothing."""
        p, fs = file_system(self.spark, f"{self.root}/_runs")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        last = max((n for n in names if n.endswith(".json") and n[:1] != "_"), default=None)
        if last is None:
            return {"number": -1, "parts": [], "open_since": None}
        return json.loads(file_bytes(self.spark, f"{self.root}/_runs/{last}").decode())

    def manifests(self) -> list[dict]:
        """What all committed runs published, oldest first; small files, for looking back."""
        p, fs = file_system(self.spark, f"{self.root}/_runs")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [json.loads(file_bytes(self.spark, f"{self.root}/_runs/{n}").decode()) for n in sorted(names) if n.endswith(".json") and n[:1] != "_"]

    def pending(self, log: DataFrame) -> DataFrame:
        """Rows of ``log`` that no committed run has processed, one per identity."""
        state = self.state()
        mark = state["open_since"]
        rows = log if mark is None else log.where(F.col(self.seq).isNull() | (F.col(self.seq) >= F.lit(mark)))
        rows = rows.dropDuplicates(self.ident)
        if not state["parts"]:
            return rows
        done = self.spark.read.parquet(*[x["path"] for x in state["parts"]])
        if mark is not None:
            done = done.where(F.col(self.seq).isNull() | (F.col(self.seq) >= F.lit(mark)))
        names = [f"kl_d{i}" for i in range(len(self.ident))]
        return rows.join(done.select(*[F.col(c).alias(n) for c, n in zip(self.ident, names)]), null_safe(self.ident, names), "left_anti")

    def commit(self, pending: DataFrame, open_since: int | None = None, based_on: dict | None = None) -> str:
        """Write ``pending`` and its ledger rows, then publish them; returns the output path.

        ``open_since``: the lowest sequence number that may still arrive; None
        makes the next run reread everything.  ``based_on``: the state that
        ``pending`` was made from (the newest, unless given); if another run has
        been published since, this one is not, and RuntimeError is raised.
        """
        state = self.state() if based_on is None else based_on
        run = uuid.uuid4().hex
        out, led = f"{self.root}/out/{run}", f"{self.root}/ledger/{run}"
        pending.write.parquet(out)
        rows = self.spark.read.schema(pending.schema).parquet(out).select(*dict.fromkeys([*self.ident, self.seq]))
        rows.sortWithinPartitions(self.seq).write.parquet(led)
        top, nulls = self.spark.read.schema(rows.schema).parquet(led).agg(F.max(self.seq), F.count_if(F.col(self.seq).isNull())).first()
        parts = [*state["parts"], {"path": led, "last": None if nulls else top, "empty": top is None and not nulls}]
        if open_since is not None:
            parts = [x for x in parts if not x["empty"] and (x["last"] is None or x["last"] >= open_since)]
        number = state["number"] + 1
        body = {"number": number, "run": run, "out": out, "parts": parts, "open_since": open_since}
        if not publish_bytes(self.spark, f"{self.root}/_runs/{number:020d}.json", json.dumps(body).encode(), overwrite=False):
            raise RuntimeError(f"run {run} was not published: another one was since it began")
        return out
