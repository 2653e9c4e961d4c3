"""Exact and perceptual duplicates, leakage flags, groups by evidence, and the strict regrouping of large groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.operators.quantiles import same
from tallyframe.operators.splits import ranked
from tallyframe.sources.tables import materialize


def content_hash(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("exact_sha256", F.sha2(F.col(col), 256))


def once(col: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``col``, which is evaluated once however often ``f`` names it, in lambdas too."""
    return F.get(F.transform(F.array(col), f), F.lit(0))


def _bits_to_hex(bits: Column, n: int) -> Column:
    """Hex of an array of 0/1, first bit highest; ``n`` is a multiple of 4."""
    digit = lambda b, k: F.substring(F.lit("0123456789abcdef"), F.aggregate(F.slice(b, k * 4 + 1, 4), F.lit(0), lambda x, y: x * 2 + y) + 1, F.lit(1))
    return once(bits, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n // 4 - 1)), lambda k: digit(b, k)), ""))


def ahash(grid: Column, bits: int = 64) -> Column:
    """Bit = value above the grid's mean, row by row; the first ``bits`` bits as hex."""
    mean = lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(g)
    above = lambda g, m: F.transform(F.slice(g, 1, bits), lambda x: (x.cast("double") > m).cast("int"))
    return once(grid, lambda g: once(mean(g), lambda m: _bits_to_hex(above(g, m), bits)))


def dhash(grid: Column, bits: int = 64, width: int = 9) -> Column:
    """Bit = value above its left neighbour in a grid of ``width`` columns, row by row; the first ``bits`` bits as hex."""
    per_row = width - 1
    at = [k // per_row * width + k % per_row for k in range(bits)]
    flags = lambda g: F.array(*((F.get(g, F.lit(i + 1)) > F.get(g, F.lit(i))).cast("int") for i in at))
    return once(grid, lambda g: _bits_to_hex(flags(g), bits))


def tag_split(df: DataFrame, train: DataFrame, val: DataFrame, key: str) -> DataFrame:
    """split: test, generated_train, generated_val or train_unassigned; ``df`` has ``pool`` train or test."""
    a = train.select(key).distinct().withColumn("_t", F.lit(True))
    b = val.select(key).distinct().withColumn("_v", F.lit(True))
    tag = F.when(F.col("pool") == "test", "test").when(F.col("_t"), "generated_train").when(F.col("_v"), "generated_val").otherwise("train_unassigned")
    return df.join(a, key, "left").join(b, key, "left").withColumn("split", tag).drop("_t", "_v")


def _by_hash(df: DataFrame, hashes: Sequence[str], *cols: Column) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(h).alias("duplicate_type"), F.col(h).alias("hash")) for h in hashes))
    return df.select(*cols, F.explode(kinds).alias("k")).select("*", "k.*").drop("k").where("hash IS NOT NULL")


def duplicate_members(df: DataFrame, key: str, hashes: Sequence[str]) -> DataFrame:
    """(duplicate_type, hash, member) of every row whose hash another row shares; no list grows with a group."""
    long = _by_hash(df, hashes, F.col(key).alias("member"))
    shared = long.groupBy("duplicate_type", "hash").agg(F.count("*").alias("n")).where("n > 1").select("duplicate_type", "hash")
    return long.join(shared, ["duplicate_type", "hash"]).select("duplicate_type", "hash", "member")


def duplicate_report(df: DataFrame, key: str, hashes: Sequence[str], split: str = "split", max_members: int | None = None) -> DataFrame:
    """One row for each hash that two rows share: type, hash, count, splits, members and the leakage flags.

    Counts and flags are sums, so a hash that a third of all rows hold costs a row for each task. The member list names every
    member; ``max_members`` (1 or more) limits it to the smallest ids, for display, beside the whole count.
    ``duplicate_members`` gives all members as rows and gathers nothing, however large a bucket is.
    """
    long = _by_hash(df, hashes, F.col(key).alias("member"), F.col(split).alias("split"))
    has = lambda *names: F.max(F.col("split").isin(*names))
    shared = long.groupBy("duplicate_type", "hash").agg(
        F.count("*").alias("count"), F.sort_array(F.collect_set("split")).alias("splits"),
        has("generated_train").alias("_t"), has("generated_val").alias("_v"), has("test").alias("_x"),
        has("generated_train", "generated_val", "train_unassigned", "train").alias("_any"), F.count_if(F.col("split") != "test").alias("train_members"),
    ).where("count > 1")
    # the ids of every bucket, spread over salts first
    member = long.join(shared.select("duplicate_type", "hash"), ["duplicate_type", "hash"])
    if max_members is None:
        salted = member.groupBy("duplicate_type", "hash", F.pmod(F.xxhash64("member"), F.lit(64)).alias("salt")).agg(F.sort_array(F.collect_list("member")).alias("some"))
        members = salted.groupBy("duplicate_type", "hash").agg(F.sort_array(F.flatten(F.collect_list("some"))).alias("members"))
    else:  # each task keeps its smallest ids before the shuffle, so no bucket is gathered
        place = F.row_number().over(Window.partitionBy("duplicate_type", "hash").orderBy("member"))
        few = member.withColumn("_place", place).where(F.col("_place") <= max_members)
        members = few.groupBy("duplicate_type", "hash").agg(F.sort_array(F.collect_list("member")).alias("members"))
    return shared.join(members, ["duplicate_type", "hash"]).select(
        "duplicate_type", "hash", "count", "splits", "members", "train_members",
        (F.col("_t") & F.col("_v")).alias("train_val_leakage_risk"), (F.col("_any") & F.col("_x")).alias("train_test_leakage_risk"),
    )


def leakage_rows(report: DataFrame, kind: str = "train_test") -> DataFrame:
    return report.where(F.col(f"{kind}_leakage_risk"))


def evidence_edges(df: DataFrame, key: str, hashes: Sequence[str]) -> DataFrame:
    """Star edges (a, b): every row to the smallest id that shares a hash with it; never all pairs of a bucket."""
    kinds = F.array(*(F.struct(F.lit(h).alias("kind"), F.col(h).alias("hash")) for h in hashes))
    long = df.select(F.col(key).alias("a"), F.explode(kinds).alias("k")).select("a", "k.*").where("hash IS NOT NULL")
    low = long.groupBy("kind", "hash").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").select("kind", "hash", "b")
    return long.join(low, ["kind", "hash"]).where("a <> b").select("a", "b").distinct()


def train_evidence(df: DataFrame, key: str, hashes: Sequence[str], pool: str = "pool") -> DataFrame:
    """(duplicate_type, hash, train_file_count): hashes that two or more training rows share; other rows are no evidence."""
    long = _by_hash(df.where(F.col(pool) == "train"), hashes, F.col(key).alias("member"))
    return long.groupBy("duplicate_type", "hash").agg(F.count("*").alias("train_file_count")).where("train_file_count > 1")


def assign_groups(df: DataFrame, groups: DataFrame, key: str, group: str = "group_id", name: str = "duplicate_group_id") -> DataFrame:
    """``df`` with dup_group_00001 and so on, numbered by the sorted group ids; rows that stand alone are groups too."""
    roots = ranked(groups.select(group).distinct().withColumn("_all", F.lit(0)), ["_all"], group, "_rank")
    named = roots.select(group, F.format_string("dup_group_%05d", F.col("_rank") + 1).alias(name))
    return df.join(groups.select(key, group).join(named, group).select(key, name), key)


#: A vertex is a hub from so many edges on, or from a 500,000th of all edges where that is more; so there are a million hubs at most.
HUB_EDGES, HUB_PARTS = 50_000, 500_000


def _with_least(edges: DataFrame, least: DataFrame, at: str, hub: int | None) -> DataFrame:
    """``edges`` with the least label of their end ``at``: hubs, a bounded number, by broadcast, all others by key."""
    names = least.withColumnRenamed("v", at)
    if hub is None:
        return edges.join(names.drop("n"), at)
    many = materialize(names.where(F.col("n") >= hub).drop("n"), "hubs")
    if many.isEmpty():
        return edges.join(names.drop("n"), at)
    marked = edges.join(F.broadcast(many.withColumnRenamed("m", "_hub")), at, "left")
    rest = marked.where("_hub IS NULL").drop("_hub").join(names.where(F.col("n") < hub).drop("n"), at)
    return rest.select("a", "b", "m").union(marked.where("_hub IS NOT NULL").select("a", "b", F.col("_hub").alias("m")))


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (a, b): the smallest vertex that the edges lead to.

    Large-star and small-star steps in turn. Large star: every vertex hands its larger neighbours to the least vertex around
    it. Small star: it hands its smaller neighbours, and itself, to the least of them. Both keep components whole and leave
    one star a component, in a number of rounds that grows with the logarithm of the vertices. Least neighbours are partial
    minima; no list of neighbours is built, and the edges of hubs are never shuffled by the hub. Every step is written to the
    shared folder. Loops and repeated edges count once, rows with a null end not at all; a vertex that has nothing but loops
    gives no row. More than ``max_rounds`` rounds raise.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(pairs, "edges")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(now)
    hub = max(HUB_EDGES, before[0] // HUB_PARTS) if before[0] >= HUB_EDGES else None  # fewer edges hold no hub
    for _ in range(max_rounds):
        ends = now.select(F.col("a").alias("v"), F.col("b").alias("w")).union(now.select("b", "a"))
        least = ends.groupBy("v").agg(F.min("w").alias("w"), F.count("*").alias("n")).select("v", F.least("v", "w").alias("m"), "n")
        large = materialize(_with_least(now, least, "b", hub).select("a", F.col("m").alias("b")).distinct(), "large-star")
        least = large.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, "a", hub).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.union(least.select("v", "m")).distinct(), "small-star")
        if (after := state(now)) == before:
            return now.select(F.col("a").alias("v"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(nodes: DataFrame, edges: DataFrame, key: str, max_rounds: int = 60) -> DataFrame:
    """(key, group_id): the smallest id that the edges lead to, the own id for rows without an edge.

    Repeated rows give repeated rows, a null key has a null group.
    """
    found = star_components(edges, max_rounds).select(F.col("v").alias(key), "component")
    return nodes.select(key).join(found, key, "left").select(key, F.coalesce("component", F.col(key)).alias("group_id"))


def with_group_size(df: DataFrame, group: str = "group_id") -> DataFrame:
    """Group size on every row, by a sum and a join, so that a very large group does not meet in one task. Null is a group."""
    return same(df, df.groupBy(group).agg(F.count("*").alias("group_size")), [group])


def exact_groups(df: DataFrame, key: str, hash_col: str) -> DataFrame:
    """(key, exact_id): the smallest id with the same content; null where a content stands alone."""
    n = df.groupBy(hash_col).agg(F.min(key).alias("exact_id"), F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    return df.join(n, hash_col, "left").select(key, "exact_id")


def strict_groups(df: DataFrame, exact: DataFrame, key: str, large: int = 50, audit: tuple[int, int] = (21, 50), split_audit: bool = False) -> DataFrame:
    """Policy and strict group of every row: small groups stay, large ones fall apart into exact copies and single rows."""
    sized = with_group_size(df).join(exact, key, "left")
    size = F.col("group_size")
    policy = F.when(size > large, "split_large").when(size.between(*audit), "split_audit" if split_audit else "audit_keep").otherwise("keep")
    apart = F.col("policy").isin("split_large", "split_audit")
    parts = F.when(F.col("exact_id").isNotNull(), F.concat(F.lit("exact_"), F.col("exact_id").cast("string"))).otherwise(F.concat(F.lit("single_"), F.col(key).cast("string")))
    return sized.withColumn("policy", policy).select(
        *df.columns, "group_size", "policy", F.when(apart, parts).otherwise(F.concat(F.lit("group_"), F.col("group_id").cast("string"))).alias("strict_group_id"),
        size.between(*audit).alias("audit_flag"),
    )


def group_summary(df: DataFrame, group: str = "group_id") -> DataFrame:
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("groups"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 1).alias("non_singletons"), F.max("n").alias("largest"))


def group_sizes(df: DataFrame, group: str = "group_id") -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def mixed_label_groups(df: DataFrame, group: str = "group_id", label: str = "label") -> DataFrame:
    g = df.groupBy(group).agg(F.count("*").alias("size"), F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives"))
    return g.where("negatives > 0 AND positives > 0")


def policy_counts(df: DataFrame, policy: str = "policy", group: str = "strict_group_id") -> DataFrame:
    g = df.groupBy(policy, group).agg(F.count("*").alias("n"))
    return g.groupBy(policy).agg(F.sum("n").alias("rows"), F.count("*").alias("groups"))


def top_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), group).limit(n)
