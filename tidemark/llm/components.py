"""Splits that keep related records together: component table and split assignment.

Components come from contraction with pointer jumping: every node points to its
smallest neighbour, pointers are jumped until they stand at roots, edges are
rewritten to roots, and so on until no edge is left. Each round at least halves
the nodes that still have edges. Rounds are written to the shared folder, and
deleted once the next one stands. What links nodes (company numbers, calls) are
nodes themselves, so the stored table (``ComponentStore``) is all a later run needs
to attach new records to the components of earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_ticker, digits_key
from tidemark.session import discard, exists, materialise, read_table, scratch_path

QUARANTINE = "quarantine"
#: A component above this share of all weight is placed by itself; the lighter ones go in BUCKETS groups by hash.
HEAVY_SHARE, BUCKETS = 0.002, 4096
#: From so many rows on a key may be hot.
HOT_ROWS = 100_000


def star_edges(members: DataFrame, key: str, member: str) -> DataFrame:
    """(a, b): each member of a key linked to the key's smallest member.

    As many edges as members, however large a group; no pairs. Null keys link nobody.
    """
    m = members.select(F.col(key).alias("k"), F.col(member).alias("a")).where("k is not null and a is not null").distinct()
    reps = m.groupBy("k").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").select("k", "b")
    return m.join(reps, "k").where("a <> b").select("a", "b").distinct()


def look_up(df: DataFrame, key: str, table: DataFrame, on: str, how: str = "left", hot_rows: int = HOT_ROWS, share: int = 256, rows: int | None = None) -> DataFrame:
    """``df`` joined with a table that has one row per ``on``, also where one key holds most of the rows.

    Keys of more than ``hot_rows`` rows and more than 1 / share of all, so at most ``share`` of them, are looked
    up by broadcast; their rows take no part in the exchange by key but are spread over ``share`` groups.
    ``rows`` is the number of rows where it is known.
    """
    n = df.count() if rows is None else rows
    hot = []
    if n > hot_rows:
        hot = [r[0] for r in df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(hot_rows, n // share)).select(key).collect()]
    if not hot:
        return df.join(table.withColumnRenamed(on, key), key, how)
    cols = [c for c in table.columns if c != on]
    few = table.where(F.col(on).isin(hot)).select(F.col(on).alias("__h"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__x_{c}") for c in cols])
    cold = table.select(F.col(on).alias("__on"), F.lit(0).alias("__s"), F.lit(True).alias("__cold"), *[F.col(c).alias(f"__y_{c}") for c in cols])
    spread = F.when(F.col(key).isin(hot) | F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(share)).cast("int") + 1).otherwise(0)
    out = df.withColumn("__t", spread).join(F.broadcast(few), F.col(key) == F.col("__h"), "left").join(cold, (F.col(key) == F.col("__on")) & (F.col("__t") == F.col("__s")), "left")
    if how == "inner":
        out = out.where("__hit or __cold")
    return out.select(*df.columns, *[F.coalesce(f"__x_{c}", f"__y_{c}").alias(c) for c in cols])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the component's smallest node.

    Nulls and loops link nobody; repeated edges count once; without edges the result is empty.
    """
    spark = edges.sparkSession
    n = F.count(F.lit(1))
    work = materialise(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "edges", n=n)
    labels = None
    while work._tallies["n"]:
        both = work.select("a", "b").unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p")).select(F.col("a").alias("v"), "p"), "pointers", n=n)
        spent, nodes = [], up._tallies["n"]
        while True:
            above = up.select(F.col("v").alias("p"), F.col("p").alias("g"))
            jumped = look_up(up.select("v", "p"), "p", above, "p", rows=nodes).select("v", F.col("g").alias("p"), (F.col("p") != F.col("g")).alias("moved"))
            spent.append(up)
            up = materialise(jumped, "pointers", moved=F.count_if("moved"))
            if not up._tallies["moved"]:
                break
        if labels is None:
            labels = up.select(F.col("v").alias("node"), F.col("p").alias("root"))
            labels._tidemark_path, labels._tallies = up._tidemark_path, {"n": nodes}
        else:
            higher = up.select(F.col("v").alias("root"), F.col("p").alias("r2"))
            spent += [labels, up]
            labels = materialise(look_up(labels, "root", higher, "root", rows=labels._tallies["n"]).select("node", F.coalesce("r2", "root").alias("root")), "labels", n=n)
        a, b, k = up.select(F.col("v").alias("a"), F.col("p").alias("pa")), up.select(F.col("v").alias("b"), F.col("p").alias("pb")), work._tallies["n"]
        rest = look_up(look_up(work.select("a", "b"), "a", a, "a", rows=k), "b", b, "b", rows=k)
        rest = materialise(rest.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges", n=n)
        discard(spark, work, *spent)
        work = rest
    if labels is None:
        return work.select(F.col("a").alias("node"), F.col("b").alias("root"))
    discard(spark, work)
    return labels


def ticker_links(universe: DataFrame, calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): every canonical ticker linked to its company number, its former listing and the calls that name it.

    Numbers and calls are nodes of their own, ``cik:`` and ``call:``; as many edges as namings, and no pairs.
    """
    t = canonical_ticker(F.col("ticker"))
    u = universe.select(t.alias("t"), digits_key(F.col("cik")).alias("cik"), canonical_ticker(F.col("former_ticker")).alias("former"))
    named = calls.select("call_id", t.alias("t")).unionByName(pairs.select("call_id", t.alias("t"))).where("call_id is not null and t is not null").distinct()
    keys = u.select("t", F.concat(F.lit("cik:"), "cik").alias("k")).unionByName(named.select("t", F.concat(F.lit("call:"), "call_id").alias("k")))
    return keys.unionByName(u.where("t <> former").select("t", F.col("former").alias("k"))).where("t is not null and k is not null").select(F.col("t").alias("a"), F.col("k").alias("b")).distinct()


def is_ticker(node):
    """Not a number or a call."""
    return ~node.rlike("^(?:cik|call):")


def linked_tickers(table: DataFrame, universe: DataFrame) -> DataFrame:
    """(ticker_a, ticker_b): all pairs of listed tickers in one component of the table (node, component), the smaller first.

    The pairs are the result asked for; a component is one company's listings.
    """
    listed = universe.select(canonical_ticker(F.col("ticker")).alias("node")).where("node is not null").distinct()
    c = table.join(listed, "node", "left_semi")
    a, b = c.select("component", F.col("node").alias("ticker_a")), c.select("component", F.col("node").alias("ticker_b"))
    return a.join(b, "component").where("ticker_a < ticker_b").select("ticker_a", "ticker_b")


def component_table(weights: DataFrame, links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The component table (node, component, weight, split, state) after new nodes and links.

    ``weights`` (node, weight) are the nodes to place, ``known`` the persisted table
    of an earlier run: its components enter as links to their root, and their splits hold.
    A component with one known split keeps it, one without is "new" (split null), one
    that merges different known splits is quarantined whole. A known node's new weight is added to its old one.
    """
    w = weights.where("node is not null").groupBy("node").agg(F.sum("weight").alias("weight"))
    old = None
    if known is not None:
        old = known.select("node", "component", F.col("split").alias("old_split"), F.col("weight").alias("old_weight"))
        links = links.unionByName(old.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
    roots = connected_components(links)
    nodes = w.select("node").unionByName(links.select(F.col("a").alias("node"))).unionByName(links.select(F.col("b").alias("node")))
    if old is not None:
        nodes = nodes.unionByName(old.select("node"))
    t = nodes.distinct().join(roots, "node", "left").join(w, "node", "left").select("node", F.coalesce("root", "node").alias("component"), "weight")
    if old is None:
        return t.select("node", "component", F.coalesce("weight", F.lit(0).cast("long")).alias("weight"), F.lit(None).cast("string").alias("split"), F.lit("new").alias("state"))
    t = t.join(old.select("node", "old_split", "old_weight"), "node", "left")
    c = t.groupBy("component").agg(
        F.count_distinct(F.when(F.col("old_split") != QUARANTINE, F.col("old_split"))).alias("n"), F.max(F.when(F.col("old_split") != QUARANTINE, F.col("old_split"))).alias("s"),
        F.max(F.coalesce(F.col("old_split") == QUARANTINE, F.lit(False))).alias("q"),
    )
    state = F.when((F.col("n") > 1) | F.col("q"), QUARANTINE).when(F.col("n") == 1, "kept").otherwise("new")
    c = c.select("component", state.alias("state"), F.when((F.col("n") > 1) | F.col("q"), QUARANTINE).otherwise(F.col("s")).alias("split"))
    return t.join(c, "component").select("node", "component", (F.coalesce("weight", F.lit(0)) + F.coalesce("old_weight", F.lit(0))).cast("long").alias("weight"), "split", "state")


def fill_deficits(table: DataFrame, targets: DataFrame) -> DataFrame:
    """``table`` with a split for every component: new ones fill what the splits lack.

    Heaviest first, each goes to the split that lacks most. Only components above
    HEAVY_SHARE of the weight (at most 1 / HEAVY_SHARE of them) and the sums of
    BUCKETS hash groups of the others reach the driver: a fixed bound, whatever
    the number of components. Targets are scaled to sum to 1; null ones count as 0.
    """
    spark = table.sparkSession
    shares = {r["split_name"]: float(r["target_share"] or 0) for r in targets.where("split_name is not null").groupBy("split_name").agg(F.max("target_share").alias("target_share")).collect()}
    total = sum(shares.values()) or 1.0
    table = materialise(table, "components")
    sizes = materialise(table.groupBy("component").agg(F.sum("weight").alias("w"), F.max("split").alias("split")), "sizes")
    per = {r["split"]: r["w"] for r in sizes.groupBy("split").agg(F.sum("w").alias("w")).collect()}
    held = {k: v for k, v in per.items() if k is not None}
    new = sizes.where("split is null").select("component", "w", F.pmod(F.xxhash64("component"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    all_w = sum(v for k, v in held.items() if k in shares) + (per.get(None) or 0)
    heavy_at = max(HEAVY_SHARE * all_w, 1)
    goal = {s: v / total * all_w for s, v in shares.items()}
    have = {s: float(held.get(s, 0)) for s in shares}

    def place(w: float) -> str:
        s = max(sorted(goal), key=lambda x: (goal[x] - have[x], goal[x]))
        have[s] += w
        return s

    heavy = [(r["component"], place(r["w"])) for r in new.where(F.col("w") > heavy_at).orderBy(F.desc("w"), "component").collect()]
    groups = [(r["bucket"], place(r["w"])) for r in new.where(F.col("w") <= heavy_at).groupBy("bucket").agg(F.sum("w").alias("w")).orderBy(F.desc("w"), "bucket").collect()]
    h = F.broadcast(spark.createDataFrame(heavy, "component string, s1 string"))
    g = F.broadcast(spark.createDataFrame(groups, "bucket int, s2 string"))
    placed = new.join(h, "component", "left").join(g, "bucket", "left").select("component", F.coalesce("s1", "s2").alias("given"))
    return table.join(placed, "component", "left").select("node", "component", "weight", F.coalesce("split", "given").alias("split"), "state")


def call_weights(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, weight): pairs and calls of each canonical ticker, a pair or call counted once."""
    t = canonical_ticker(F.col("ticker"))
    p = pairs.where("pair_id is not null").groupBy("pair_id").agg(F.min(t).alias("node"))
    c = calls.where("call_id is not null").groupBy("call_id").agg(F.min(t).alias("node"))
    return p.select("node").unionByName(c.select("node")).where("node is not null").groupBy("node").agg(F.count("*").alias("weight"))


class ComponentStore:
    """The component table (node, component, weight, split, state) stored under ``path``, one version per run."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _version(self, n: int) -> str:
        return f"{self.path}/v{n:06d}"

    def versions(self) -> int:
        """How many whole versions there are; one whose writing was cut short does not count."""
        n = 0
        while exists(self.spark, f"{self._version(n + 1)}/_SUCCESS"):
            n += 1
        return n

    def table(self) -> DataFrame | None:
        n = self.versions()
        return self.spark.read.parquet(self._version(n)) if n else None

    def extend(self, weights: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
        """Takes in new nodes and links and stores the next version: components keep their split, new ones fill
        deficits, conflicting merges are quarantined."""
        n = self.versions() + 1
        new = fill_deficits(component_table(weights, links, self.table()), targets)
        new.write.mode("overwrite").parquet(self._version(n))
        return self.table()


def _tables(spark: SparkSession, sf_dir: str):
    return [read_table(spark, sf_dir, x) for x in ("universe", "call_features", "qa_pairs")]


def stored_components(spark: SparkSession, sf_dir: str, runs: int = 2, path: str | None = None) -> DataFrame:
    """The stored table after so many runs over the calls in order of their days; the universe comes with the first.

    A call and its pairs come with one run, and each run opens the store anew.
    """
    u, c, q = _tables(spark, sf_dir)
    targets = read_table(spark, sf_dir, "split_targets")
    path = path or scratch_path(spark, "components")
    if runs == 1:
        return ComponentStore(spark, path).extend(call_weights(c, q), ticker_links(u, c, q), targets)
    day = F.datediff(F.min("event_date"), F.lit("1970-01-01").cast("date"))
    days = c.where("call_id is not null").groupBy("call_id").agg(F.coalesce(day, F.lit(0)).alias("day"))
    cuts = days.agg(F.percentile_approx("day", [i / runs for i in range(1, runs)])).first()[0] or [0] * (runs - 1)
    run = sum(((F.col("day") > x).cast("int") for x in cuts[1:]), (F.col("day") > cuts[0]).cast("int"))
    days = materialise(days.select("call_id", run.alias("run")), "runs")
    of_run = lambda d, n: d.join(days.where(F.col("run") == n), "call_id", "left_semi")
    for n in range(runs):
        lost = q.join(days, "call_id", "left_anti") if n == 0 else None  # pairs of calls that have no features come with the first run
        cn, qn = of_run(c, n), of_run(q, n)
        qn = qn.unionByName(lost) if lost is not None else qn
        ComponentStore(spark, path).extend(call_weights(cn, qn), ticker_links(u if n == 0 else u.limit(0), cn, qn), targets)
    discard(spark, days)
    return ComponentStore(spark, path).table()


def p3_found(spark, sf_dir):
    """From the stored table after two runs."""
    return linked_tickers(stored_components(spark, sf_dir), read_table(spark, sf_dir, "universe"))


def p3_incremental(spark, sf_dir):
    """(ticker, component, split, state): the calls of the earlier half of days are placed and stored by one run, the
    later ones by another. Components keep their split, new ones fill deficits, conflicting merges are quarantined."""
    return stored_components(spark, sf_dir).where(is_ticker(F.col("node"))).select(F.col("node").alias("ticker"), "component", "split", "state")


def ticker_splits(spark, sf_dir):
    """The split of every ticker, from all links by one run."""
    return stored_components(spark, sf_dir, 1).where(is_ticker(F.col("node")))


def p3_splits(spark, sf_dir):
    return ticker_splits(spark, sf_dir).select(F.col("node").alias("ticker"), "component", "split", "state")


def p3_shares(spark, sf_dir):
    """(split_name, weight, share, target_share): what the splits reached; quarantined weight is reported too."""
    got = ticker_splits(spark, sf_dir).groupBy(F.col("split").alias("split_name")).agg(F.sum("weight").alias("weight"))
    total = got.agg(F.sum("weight").alias("total"))
    targets = read_table(spark, sf_dir, "split_targets").groupBy("split_name").agg(F.max("target_share").alias("target_share"))
    return got.crossJoin(F.broadcast(total)).join(F.broadcast(targets), "split_name", "left").select("split_name", "weight", F.round(F.col("weight") / F.col("total"), 4).alias("share"), "target_share")


def p3_assigned(spark, sf_dir):
    """(call_id, split): every call's split; a call without any ticker is a company of its own and placed by its hash."""
    _, c, q = _tables(spark, sf_dir)
    t = canonical_ticker(F.col("ticker"))
    named = c.select("call_id", t.alias("ticker")).unionByName(q.select("call_id", t.alias("ticker"))).where("call_id is not null")
    by_call = named.groupBy("call_id").agg(F.min("ticker").alias("ticker"))
    got = by_call.join(p3_splits(spark, sf_dir).select("ticker", "split"), "ticker", "left")
    targets = read_table(spark, sf_dir, "split_targets").where("split_name is not null").groupBy("split_name").agg(F.max("target_share").alias("s"))
    ends = [(r["split_name"], r["s"]) for r in targets.orderBy("split_name").collect()]
    u, low, pick = F.pmod(F.xxhash64("call_id"), F.lit(1_000_000)) / 1_000_000 * sum(s or 0 for _, s in ends), 0.0, F.lit(ends[-1][0] if ends else None).cast("string")
    for name, s in ends:
        pick = F.when((u >= low) & (u < low + (s or 0)), F.lit(name)).otherwise(pick)
        low += s or 0
    return got.select("call_id", F.coalesce("split", pick).alias("split"))
