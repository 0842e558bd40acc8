"""Connected components by alternating large-star and small-star steps, and links found by stars in buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unstored


#: Edges that a task of the star steps writes at most.
EDGES = 100_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, component long) for every node in a link; the component is its smallest node.

    Each step is two aggregations (minima, added up before the shuffle) and a join with the links, whose hot keys
    Spark can split; every step's links are written to the shared folder. The steps end when the links no longer
    change. Null ends, links of a node with itself and repeated links don't matter; no links give no rows.
    """
    edges = stored(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo").distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        parts = -(-now[0] // EDGES)  # steps don't add edges; few need few tasks
        edges = _together(edges, parts)
        large = stored(_large_star(edges, parts), "large")
        unstored(edges)
        large = _together(large, parts)
        edges = stored(_small_star(large, parts), "small")
        unstored(large)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())


def _together(table: DataFrame, parts: int) -> DataFrame:
    """A stored table that is read as one partition if one task is enough: its aggregations and joins then need no shuffle."""
    if parts > 1:
        return table
    one = table.coalesce(1)
    one._stored_at = table._stored_at
    return one


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour (or itself)."""
    both = edges.select(F.col("lo").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    # The union of a single partition with another has two.
    least = _together(stored((both.coalesce(1) if parts == 1 else both).groupBy("u").agg(F.min("v").alias("m")).filter("m < u").coalesce(parts), "least"), parts)
    return edges.join(least, edges.lo == least.u, "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the smallest of them."""
    least = _together(stored(edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")).coalesce(parts), "least"), parts)
    several = least.filter("n > 1").select(F.col("hi").alias("u"), "m")
    rest = edges.join(several, edges.hi == several.u).filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    found = rest.union(least.select("hi", F.col("m").alias("lo")))
    return (found.coalesce(1) if parts == 1 else found).distinct().coalesce(parts)


#: Bytes of a mapper of a join within large buckets; members of a block of them, and blocks of a bucket at most.
MAPPED, BLOCK, BLOCKS = 16 << 20, 512, 16
#: Buckets of at most so many are broadcast (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Further rounds of stars before what is left is compared in full.
ROUNDS = 2
#: Pairs between components, as a multiple of the members, from which a further round of stars pays, and the share of the pairs that the last one may have left for another to follow.
WORTH, LEFT = 8, 0.75


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """The rows of `buckets` (bucket long, id long, and others) whose bucket has several members, with its smallest as `first`.

    Most buckets have one member; they are counted by their key alone and go no further.
    """
    several = stored(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "several")
    few = several.count() <= MOST_BROADCAST
    members = stored(buckets.join(F.broadcast(several) if few else several, "bucket", "left_semi"), "members")
    unstored(several)
    return with_first(members)


def with_first(rows: DataFrame) -> DataFrame:
    """Rows (bucket, id, and others) of a stored table, which goes, with the smallest id of their bucket as `first`."""
    first = stored(rows.groupBy("bucket").agg(F.min("id").alias("first")), "firsts")
    few = first.count() <= MOST_BROADCAST
    found = stored(rows.join(F.broadcast(first) if few else first, "bucket"), "shared")
    unstored(rows, first)
    return found


def star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b) with a > b: every member of a bucket with its smallest; as many as members, whatever the buckets' sizes."""
    return shared.filter("id > first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()


def mixed_buckets(shared: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of `shared`, with their component, whose bucket holds several components."""
    labelled = shared.drop("first").join(components.select(F.col("node").alias("id"), "component"), "id", "left")
    labelled = stored(labelled.withColumn("component", F.coalesce("component", "id")), "labelled")
    mixed = stored(labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("bucket"), "mixed")
    few = mixed.count() <= MOST_BROADCAST
    found = stored(labelled.join(F.broadcast(mixed) if few else mixed, "bucket", "left_semi"), "mixed-members")
    unstored(labelled, mixed)
    return found


def other_stars(members: DataFrame, salt: int) -> DataFrame:
    """(a, b) with a > b: every member of a mixed bucket with one that chance picks, unless they share a component."""
    chance = F.xxhash64(F.lit(salt), "id", "bucket")
    hubs = members.groupBy("bucket").agg(F.min(F.struct(chance.alias("chance"), F.col("id").alias("hub"), F.col("component").alias("of"))).alias("h"))
    hubs = stored(hubs.select("bucket", "h.hub", "h.of"), "hubs")
    few = hubs.count() <= MOST_BROADCAST
    met = members.join(F.broadcast(hubs) if few else hubs, "bucket").filter("component != of")
    return met.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()


def _between(members: DataFrame) -> tuple[int, int]:
    """How many pairs of members of a bucket lie in different components, and how many members there are."""
    each = members.groupBy("bucket", "component").agg(F.count("*").cast("double").alias("n"))
    whole = each.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    pairs, n = whole.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    return int(pairs), int(n)


def linked_members(shared: DataFrame, confirmed: Callable[[DataFrame], DataFrame], crossing: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): links that connect what links within buckets connect.

    Every round compares the members of a bucket with one of them, which is as many pairs as members, and merges what is linked. After
    the smallest member, chance picks another one of each bucket that still holds several components, since members of a large family
    that one centre misses are mostly linked by the next. Once rounds no longer pay, all pairs between different components of
    a bucket are compared, so no link is lost. `confirmed` takes pairs (a, b) and returns the linked ones; `crossing` takes members (the
    columns of `shared` and component) and returns the links between different components of a bucket.
    """
    links, before = confirmed(star_pairs(shared)), None
    for salt in range(ROUNDS + 1):
        members = mixed_buckets(shared, connected_components(links))
        pairs, n = _between(members)
        if not n:
            return links
        if pairs <= WORTH * n or salt == ROUNDS or before and pairs > LEFT * before:
            break
        before = pairs
        links = stored(links.union(confirmed(other_stars(members, salt))), "links-so-far")
        unstored(members)
    return links.union(crossing(members))


def by_families(members: DataFrame) -> DataFrame:
    """Members (bucket, id, component, and `band`, if it is there) with buckets that overlap made one where that is fewer pairs.

    A family of near copies meets in most of its bands: the same members in many buckets. Buckets that are connected by members are a
    family; if all pairs of its members are no more than those within its buckets together, its members are listed once, in a bucket named by the
    family and band 0. All pairs that a bucket held are still held, and rows are as many as members.
    """
    first = members.groupBy("bucket").agg(F.min("id").alias("first"))
    families = connected_components(members.join(first, "bucket"), "id", "first")
    labelled = stored(members.join(families.select(F.col("node").alias("id"), F.col("component").alias("family")), "id"), "of-families")
    each = labelled.groupBy("family", "bucket").agg(F.count("*").cast("double").alias("n")).groupBy("family").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    own = labelled.select("family", "id").distinct().groupBy("family").agg(F.count("*").cast("double").alias("n"))
    whole = stored(each.join(own, "family").filter(F.col("n") * F.col("n") <= F.col("pairs")).select("family"), "families")
    few = whole.count() <= MOST_BROADCAST
    whole_ = F.broadcast(whole) if few else whole
    of = {"bucket": F.col("family").alias("bucket"), "band": F.lit(0).alias("band")}
    once = labelled.join(whole_, "family", "left_semi").select(*[of.get(c, F.col(c)) for c in members.columns]).distinct()
    found = stored(labelled.join(whole_, "family", "left_anti").select(*members.columns).union(once), "family-members")
    unstored(labelled, whole)
    return found


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """The rows of buckets as blocks whose pairs are tasks' work, stored: `bucket` then names a pair of blocks (p, q), `block` the row's own.

    A bucket is cut into blocks of BLOCK members, at most BLOCKS of them; each row is listed once for every block that its own is compared with, so no key holds
    a whole family. Files have MAPPED bytes, but are as many as cores: adaptive execution splits what still is a hot key into as many parts as mappers at most.
    """
    sizes = rows.groupBy("bucket").agg(F.least(F.ceil(F.count("*") / BLOCK), F.lit(BLOCKS)).cast("int").alias("blocks")).filter("blocks > 1")
    cut = rows.join(sizes, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = stored(cut.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // MAPPED))), "sides")
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("bucket", F.struct("bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))).drop("blocks", "other")
    pairs._stored_at = cut._stored_at
    return pairs


def crossing_pairs(members: DataFrame, alike: Callable[[str, str], Column]) -> DataFrame:
    """(a, b) with a > b: members of a bucket that lie in different components and may be alike.

    `alike(x, y)` is a condition over the columns of two sides and part of the join, so pairs that it rejects are never made, and
    neither are those within one component. Members listed `in_blocks` meet their own block in one place only.
    """
    x, y = members.alias("x"), members.alias("y")
    met = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.id") > F.col("y.id"))
    if "block" in members.columns:
        met &= (F.col("x.block") != F.col("y.block")) | (F.col("x.bucket.p") == F.col("x.bucket.q"))
    return x.join(y, met & alike("x", "y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
