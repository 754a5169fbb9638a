"""Filling fixed-capacity containers with items: vector bin packing.

Every container is limited in tokens, in segments and in loss-bearing tokens at
once. Items are dealt by hash into pools of about POOL_CONTAINERS containers; each pool is
packed by the dot-product heuristic (an open container takes the fitting item
whose demands point most along what is left of it). A pool leaves one
container partly filled, so unused space does not grow with the number of pools'
items. Only ids and sizes are exchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import FOLDER, TOKENIZER, document_sizes
from tidemark.session import materialise, read_table

#: Pools are about as large as POOL_CONTAINERS containers, so that the one partly filled at the end costs the same share at every capacity.
POOL_CONTAINERS, LEAST_POOL, MOST_POOL = 200, 500, 10_000
#: A container of c tokens holds at most c / TOKENS_PER_SEGMENT segments, and LOSS_SHARE of its tokens may bear loss.
TOKENS_PER_SEGMENT, LOSS_SHARE = 32, 0.99


def dot_product_packing(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container number of each item.

    ``demand`` is (items, dimensions), ``limits`` the container's. One container is
    open at a time; it takes the fitting item with the largest dot product of demand
    and remaining room, both as shares of the limits (ties: the first), until none fits.
    Every item must fit an empty container.
    """
    share = demand / limits
    if len(share) and share.max() > 1 + 1e-9:
        raise ValueError("an item exceeds the container")
    order = np.lexsort((np.arange(len(share)), -share.sum(axis=1)))
    todo = share[order]
    ids = order.copy()
    out = np.full(len(share), -1)
    bin_no = -1
    while len(ids):
        bin_no += 1
        room = np.ones(share.shape[1])
        used = np.zeros(len(ids), bool)
        k, left, fits = np.arange(len(ids)), [c.copy() for c in todo.T], np.ones(len(ids), bool)
        while True:  # what does not fit is left out: room only shrinks, so nothing comes back
            point = sum((c * r for c, r in zip(left, room)), np.zeros(len(k)))
            point[~fits] = -1.0
            j = int(np.argmax(point))
            used[k[j]] = True
            out[ids[k[j]]] = bin_no
            room = room - np.array([c[j] for c in left])
            for c, r in zip(left, room):
                fits &= c <= r + 1e-12
            fits[j] = False
            n = int(np.count_nonzero(fits))
            if not n:
                break
            if 2 * n < len(k):
                k, left, fits = k[fits], [c[fits] for c in left], np.ones(n, bool)
        todo, ids = todo[~used], ids[~used]
    return out


def pieces(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per container kind and item: (container_kind, capacity, doc_id, piece, first_token, tokens, loss_tokens, whole).

    A text within the capacity is one piece; a larger one is divided into full
    pieces and a rest. Loss is spread over the pieces in proportion and adds up to
    the text's. Kinds with a null or non-positive capacity take no items; texts without tokens have no pieces.
    """
    s = specs.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    both = sizes.where("tokens > 0").crossJoin(F.broadcast(s))
    n = F.ceil(F.col("tokens") / F.col("capacity"))
    cut = both.select("container_kind", "capacity", "doc_id", F.col("tokens").alias("all"), F.col("loss_tokens").alias("loss"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("piece"))
    first = F.col("piece") * F.col("capacity")
    size = F.least("capacity", F.col("all") - first)
    return cut.select("container_kind", "capacity", "doc_id", F.col("piece").cast("int").alias("piece"), first.alias("first_token"), size.alias("tokens"), (F.floor(F.col("loss") * (first + size) / F.col("all")) - F.floor(F.col("loss") * first / F.col("all"))).alias("loss_tokens"), (size == F.col("capacity")).alias("full"))


def pack(sizes: DataFrame, specs: DataFrame, tokens_per_segment: int = TOKENS_PER_SEGMENT, loss_share: float = LOSS_SHARE, pool_containers: int = POOL_CONTAINERS) -> DataFrame:
    """(container_kind, container_id, segment, doc_id, piece, first_token, tokens, loss_tokens): every piece of every text, once per kind.

    Container ids are unique within a kind. A piece that alone bears more loss than
    allowed has the surplus masked, so that it fits.
    """
    items = pieces(sizes, specs)
    total, n = sizes.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    mean = (total or 0) / max(n, 1)  # tokens of an item; a kind's pool has as many items as fill its containers
    size = F.greatest(F.lit(LEAST_POOL), F.least(F.lit(MOST_POOL), F.ceil(F.col("capacity") * pool_containers / max(mean, 1.0))))
    pools = F.greatest(F.lit(1), F.ceil(F.lit(n) / size)).cast("int")
    full = items.where("full").select("container_kind", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container_id"), F.lit(0).alias("segment"), "doc_id", "piece", "first_token", "tokens", F.least("loss_tokens", F.floor(F.col("capacity") * loss_share)).alias("loss_tokens"))
    rest = items.where("not full").withColumn("pool", F.pmod(F.xxhash64("doc_id", "container_kind"), pools).cast("int"))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf.capacity.iloc[0])
        pdf = pdf.sort_values(["doc_id", "piece"]).reset_index(drop=True)
        limits = np.array([capacity, max(1, capacity // tokens_per_segment), max(1, int(capacity * loss_share))], float)
        loss = np.minimum(pdf.loss_tokens.to_numpy(), int(limits[2]))
        at = dot_product_packing(np.stack([pdf.tokens.to_numpy(), np.ones(len(pdf)), loss], axis=1).astype(float), limits)
        out = pd.DataFrame({"container_kind": pdf.container_kind, "container_id": [f"p{key[1]}-{b}" for b in at], "segment": pd.Series(at).groupby(at).cumcount().astype("int32"), "doc_id": pdf.doc_id, "piece": pdf.piece, "first_token": pdf.first_token, "tokens": pdf.tokens, "loss_tokens": loss})
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.schema.fields)
    return full.unionByName(rest.groupBy("container_kind", "pool").applyInPandas(fill, schema))


def fill_report(packed: DataFrame, specs: DataFrame, tokens_per_segment: int = TOKENS_PER_SEGMENT, loss_share: float = LOSS_SHARE) -> DataFrame:
    """(container_kind, containers, segments, tokens, fill, loss_fill, at_segment_limit, at_loss_limit).

    Fill is the used share of all containers' tokens, loss_fill that of the loss they may bear; the
    last two count the containers with no segment left, and those with less loss than tokens left.
    """
    s = specs.where("container_kind is not null").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    c = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t"), F.sum("loss_tokens").alias("l"), F.count("*").alias("n")).join(F.broadcast(s), "container_kind")
    may, spare = F.floor(F.col("capacity") * loss_share), F.col("capacity") - F.col("t")
    return c.groupBy("container_kind").agg(
        F.count("*").alias("containers"), F.sum("n").alias("segments"), F.sum("t").alias("tokens"), F.round(F.sum("t") / F.sum("capacity"), 4).alias("fill"), F.round(F.sum("l") / F.sum(may), 4).alias("loss_fill"),
        F.count_if(F.col("n") >= F.floor(F.col("capacity") / tokens_per_segment)).alias("at_segment_limit"), F.count_if(may - F.col("l") < spare).alias("at_loss_limit"),
    )


def _packed(spark, sf_dir, tokenizer: str = TOKENIZER, folder: str = FOLDER):
    sizes = materialise(document_sizes(read_table(spark, sf_dir, "documents"), (), tokenizer, folder), "sizes")
    specs = read_table(spark, sf_dir, "container_specs")
    return pack(sizes, specs), specs


def p8_packing(spark, sf_dir):
    return _packed(spark, sf_dir)[0]


def p8_fill(spark, sf_dir):
    return fill_report(*_packed(spark, sf_dir))
