"""Filling containers of fixed capacity with whole documents (problem 7).

Sum-of-squares packing: of all levels that still take an item, and a new
container, the one is chosen that keeps the sum of squared counts of partly
filled containers least.  The state is one array of counts by level, so the cost
of an item depends on the capacity alone.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyloom.session import cut

#: Documents that one packer handles.  Packers work apart from each other; a second
#: round then packs the containers they left partly filled.
GROUP_ITEMS = 100_000
#: Packers whose leftovers one packer of the second round takes.
MERGE_GROUPS = 64
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind split text beforehand.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def token_counter(path: str):
    """A function from texts to token counts for a public tokenizer file; kept per worker."""
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            enc = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            _loaded[path] = lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            _loaded[path] = lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    return _loaded[path]


def shipped_file(spark: SparkSession, path: str) -> str:
    """Send a file to all workers, once per application; the name they find it by.  Files of one name must be one file."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_keyloom_files", {})
    name = os.path.basename(path)
    if sent.setdefault(name, path) != path:
        raise ValueError(f"{name} was sent from {sent[name]} already")
    if name not in {os.path.basename(f) for f in sc.listFiles}:
        sc.addFile(path)
    return name


def token_counts(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of each document; null and empty texts have 0.

    The driver sends the tokenizer's file to the workers; no other machine needs it.
    """

    name = shipped_file(documents.sparkSession, tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(SparkFiles.get(name))
        for batch in batches:
            n = count([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id bigint, n_tokens bigint")


class SumOfSquares:
    """Online packer of items into containers of ``capacity``."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.gain = np.full(capacity + 1, 1 << 40, np.int64)
        self.open: dict[int, list[int]] = {}
        self.fill: list[int] = []

    def place(self, size: int) -> int:
        """Put an item of 1 to ``capacity`` tokens into a container and return its number."""
        cap, count = self.capacity, self.count
        if size == cap:
            self.fill.append(cap)
            return len(self.fill) - 1
        best, level = 2 * int(count[size]) + 1, 0
        change = count[size:cap] + self.gain[: cap - size]
        at = len(change) - 1 - int(change[::-1].argmin())
        if 2 * int(change[at]) + 2 <= best:
            best, level = 2 * int(change[at]) + 2, at
        exact = cap - size
        if count[exact] and 1 - 2 * int(count[exact]) <= best:
            level = exact
        if level:
            number = self.open[level].pop()
            self._step(level, -1)
        else:
            number = len(self.fill)
            self.fill.append(0)
        self.fill[number] += size
        if level + size < cap:
            self.open.setdefault(level + size, []).append(number)
            self._step(level + size, 1)
        return number

    def _step(self, level: int, by: int) -> None:
        self.count[level] += by
        n = int(self.count[level])
        self.gain[level] = -n if n else 1 << 40


PARTS = "spec_id string, capacity int, grp int, slot bigint, doc_id bigint, part int, start_token bigint, n_tokens bigint, fill int"


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """First round: the documents of one packer, in order of a hash of their id."""
    cap = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["kl_order", "doc_id"], kind="stable", na_position="last")
    packer = SumOfSquares(cap)
    docs, parts, starts, sizes, slots = [], [], [], [], []
    for doc, n in zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist()):
        n, part, start = int(n), 0, 0
        while True:
            size = min(n - start, cap)
            docs.append(doc)
            parts.append(part)
            starts.append(start)
            sizes.append(size)
            slots.append(packer.place(size) if size else -1)
            start += size
            part += 1
            if start >= n:
                break
    fill = np.array([*packer.fill, 0])
    out = pd.DataFrame({"slot": slots, "doc_id": pd.array(docs, "Int64"), "part": parts, "start_token": starts, "n_tokens": sizes})
    out["fill"] = fill[out["slot"].to_numpy(int)] if len(out) else 0
    for c in ("spec_id", "capacity", "grp"):
        out[c] = pdf[c].iloc[0]
    return out[["spec_id", "capacity", "grp", "slot", "doc_id", "part", "start_token", "n_tokens", "fill"]]


def _merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Second round: partly filled containers as items, the fullest first."""
    packer = SumOfSquares(int(pdf["capacity"].iloc[0]))
    pdf = pdf.sort_values(["fill", "grp", "slot"], ascending=[False, True, True], kind="stable")
    to = [packer.place(int(f)) for f in pdf["fill"]]
    return pd.DataFrame({"spec_id": pdf["spec_id"], "grp": pdf["grp"], "slot": pdf["slot"], "merged_grp": pdf["merged_grp"], "merged_slot": to})


def pack(documents: DataFrame, specs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Pack all documents into containers of each specification.

    ``documents``: doc_id, text; ``specs``: spec_id, capacity_tokens (a few
    rows, read to the driver).  Returns spec_id, container_id, doc_id, part,
    start_token, n_tokens: a document is one part unless it has more tokens than
    the capacity, then full containers and a rest.  Documents without tokens are
    listed with a null container.  Repeated rows are packed as often as they
    come; specifications without a positive capacity are ignored.

    Only ids and counts are shuffled, to packers of about ``group_items``
    documents each, so no task grows with the input.  The first round is
    written to the shared folder once, as both it and the leftovers are read.
    """
    spark = documents.sparkSession
    caps = [(r[0], int(r[1])) for r in specs.select("spec_id", "capacity_tokens").distinct().collect() if r[1] and r[1] > 0]
    if not caps:
        return spark.createDataFrame([], "spec_id string, container_id string, doc_id bigint, part int, start_token bigint, n_tokens bigint")
    groups = max(1, -(-documents.count() // group_items))
    spec_rows = F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).alias("capacity")) for s, c in caps])
    counted = token_counts(documents, tokenizer).withColumn("kl_order", F.xxhash64("doc_id", "n_tokens"))
    items = counted.withColumn("grp", F.pmod(F.xxhash64("kl_order", F.lit(7)), F.lit(groups)).cast("int")).withColumn("kl_spec", F.explode(spec_rows))
    items = items.select("kl_spec.spec_id", "kl_spec.capacity", "grp", "kl_order", "doc_id", "n_tokens")
    first = cut(items.groupBy("spec_id", "grp").applyInPandas(_pack_group, PARTS))
    partly = first.where("slot >= 0 and fill < capacity").select("spec_id", "capacity", "grp", "slot", "fill").distinct()
    partly = partly.withColumn("merged_grp", F.shiftright("grp", MERGE_GROUPS.bit_length() - 1))
    merged = partly.groupBy("spec_id", "merged_grp").applyInPandas(_merge_group, "spec_id string, grp int, slot bigint, merged_grp int, merged_slot bigint")
    placed = first.join(merged, ["spec_id", "grp", "slot"], "left")
    name = F.when(F.col("merged_slot").isNotNull(), F.concat_ws("-", "spec_id", F.lit("m"), "merged_grp", "merged_slot")).when(F.col("slot") >= 0, F.concat_ws("-", "spec_id", F.lit("g"), "grp", "slot"))
    return placed.select("spec_id", name.alias("container_id"), "doc_id", "part", "start_token", "n_tokens")


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per specification: documents, parts, tokens, containers, the least possible number of them, and the share of room used."""
    sums = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("p"), F.sum(F.when(F.col("part") == 0, 1).otherwise(0)).alias("d"))
    totals = sums.groupBy("spec_id").agg(F.sum("d").alias("documents"), F.sum("p").alias("parts"), F.sum("t").alias("tokens"), F.count("container_id").alias("containers"), F.max("t").alias("fullest"))
    rows = totals.join(specs.select("spec_id", "capacity_tokens").distinct(), "spec_id")
    return rows.select("spec_id", "documents", "parts", "tokens", "containers", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), F.round(F.try_divide("tokens", F.col("containers") * F.col("capacity_tokens")), 6).alias("used"))


def faults(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """What a packing must not have, per specification: spec_id, documents, overfull, torn, gaps, unplaced.

    ``overfull``: containers above their capacity; ``torn``: documents in
    several parts though they fit one container; ``gaps``: documents whose parts
    don't follow each other from token 0; ``unplaced``: parts with tokens but no
    container.  doc_id must be unique.
    """
    caps = specs.select("spec_id", F.col("capacity_tokens").alias("kl_cap")).distinct()
    rows = packed.join(caps, "spec_id")
    fill = rows.where("container_id is not null").groupBy("spec_id", "container_id", "kl_cap").agg(F.sum("n_tokens").alias("t"))
    over = fill.groupBy("spec_id").agg(F.count_if(F.col("t") > F.col("kl_cap")).alias("overfull"))
    per_doc = rows.groupBy("spec_id", "doc_id", "kl_cap").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("t"), F.max(F.col("start_token") + F.col("n_tokens")).alias("e"), F.max("part").alias("last"), F.count_if((F.col("n_tokens") > 0) & F.col("container_id").isNull()).alias("u"),
        F.count_if((F.col("start_token") != F.col("part") * F.col("kl_cap"))).alias("moved"),
    )
    torn = F.count_if((F.col("parts") > 1) & (F.col("t") <= F.col("kl_cap")))
    gaps = F.count_if((F.col("t") != F.col("e")) | (F.col("last") + 1 != F.col("parts")) | (F.col("moved") > 0))
    sums = per_doc.groupBy("spec_id").agg(F.count(F.lit(1)).alias("documents"), torn.alias("torn"), gaps.alias("gaps"), F.sum("u").alias("unplaced"))
    return sums.join(over, "spec_id", "left").select("spec_id", "documents", F.coalesce("overfull", F.lit(0).cast("bigint")).alias("overfull"), "torn", "gaps", "unplaced")
