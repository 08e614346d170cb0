"""Connected components and bounded walks over edge DataFrames."""

from __future__ import annotations

from contextlib import nullcontext
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intel_spark.session import WorkTables, checkpoint_ready, shuffles_let_go

LARGE_ROUND = 1_000_000  # edges from which a round is written as tables; fewer are checkpointed, which takes less time


def _stirred(x: Column) -> Column:
    """A one-to-one map of longs that puts them in another order."""
    for turned, by in ((F.shiftleft, 13), (F.shiftrightunsigned, 7), (F.shiftleft, 17)):
        x = x.bitwiseXOR(turned(x, by))
    return x


def connected_components(edges: DataFrame, max_rounds: int = 200, as_tables: bool = True) -> DataFrame:
    """(node, component) where component is the least node of the connected part; edges are (src, dst).

    Nodes travel as 64-bit hashes, or as numbers if two of them have the same hash. Each round merges every node into the
    least one up to two steps away, in an order that changes from round to round, so a star is one node after a round; edges
    then run between merged nodes and those inside one are gone. At most three in four nodes are expected to be left, a third
    of a chain's, so all rounds together cost little more than the first. The merges are then followed from the last round back to the first. Minima are
    combined before the shuffle, and joining them back is one row against a hot node's edges, which adaptive execution may
    split. Rounds are cut in the shared folder so a lost executor never replays earlier ones; what a round leaves behind is
    deleted when the next one stands, so the disk holds little more than the largest step. Without ``as_tables`` all is
    checkpointed and left to Spark's cleaner.
    """
    spark = edges.sparkSession
    checkpoint_ready(spark)
    tables = WorkTables(spark, "components")
    store = tables.keep if as_tables else lambda name, df: df.checkpoint()
    with shuffles_let_go(spark) if as_tables else nullcontext():
        held = store("edges", edges.select("src", "dst"))
        nodes = store("nodes", held.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("id", F.xxhash64("node")))
        held = held.where("src <> dst")
        if nodes.groupBy("id").count().where("count > 1").isEmpty():
            numbered = held.select(F.xxhash64("src").alias("u"), F.xxhash64("dst").alias("v"))
        else:
            nodes = store("numbers", nodes.select("node", F.monotonically_increasing_id().alias("id")))
            end = lambda node, id: nodes.select(F.col("node").alias(node), F.col("id").alias(id))
            numbered = held.join(end("src", "u"), "src").join(end("dst", "v"), "dst").select("u", "v")

        pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
        current = store("round0", numbered.select(*pair).distinct())
        tables.drop("edges")
        first = left = current.count()
        merges = []
        while left:
            k = len(merges)
            if k == max_rounds:
                raise RuntimeError("components did not settle; raise max_rounds")
            large = as_tables and left >= LARGE_ROUND
            keep = tables.keep if large else lambda name, df: df.checkpoint()
            around = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = around.groupBy("u").agg(F.min(_stirred(F.col("v"))).alias("m")).select("u", F.least(_stirred(F.col("u")), "m").alias("m"))
            least = tables.keep(f"least{k}", least) if large else least
            further = lambda ends: ends.join(least.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("into"))  # noqa: B023, E731
            # the largest step: in turns, so that half of the edges lie in shuffle files at a time
            merge = reduce(DataFrame.union, [keep(f"merge{k}/{i}", further(around.where(F.pmod("u", F.lit(2)) == i))) for i in range(2)]) if large else keep("", further(around))
            tables.drop(f"least{k}")
            merges.append(merge)
            moved = current.join(merge, "u").select(F.col("into").alias("u"), "v").join(merge.select(F.col("u").alias("v"), F.col("into").alias("w")), "v").select("u", F.col("w").alias("v"))
            current = keep(f"round{k + 1}", moved.where("u <> v").select(*pair).distinct())
            tables.drop(f"round{k}")
            left = current.count()
        if not merges:
            return nodes.select("node", F.col("node").alias("component"))

        # a part is named by its last node and the round that ended it: names change from round to round
        parts = merges[-1].select("u", F.lit(len(merges) - 1).alias("round"), F.col("into").alias("last"))
        for k in range(len(merges) - 2, -1, -1):
            later = parts.select(F.col("u").alias("into"), F.col("round").alias("r"), F.col("last").alias("l"))
            parts = merges[k].join(later, "into", "left").select("u", F.coalesce("r", F.lit(k)).alias("round"), F.coalesce("l", "into").alias("last"))
        parts = tables.keep("parts", parts) if as_tables and first >= LARGE_ROUND else parts.checkpoint()
        tables.drop(*[f"merge{k}" for k in range(len(merges))])
        placed = nodes.join(parts.withColumnRenamed("u", "id"), "id", "left").select("node", "round", "last")
        placed = tables.keep("placed", placed) if as_tables else placed
        tables.drop("edges", "nodes", "numbers", "parts", f"round{len(merges)}")
    least = placed.where("round is not null").groupBy("round", "last").agg(F.min("node").alias("component"))
    return placed.join(least, ["round", "last"], "left").select("node", F.coalesce("component", "node").alias("component"))


def checkpointed_components(edges: DataFrame) -> DataFrame:
    """``connected_components`` whose rounds are all checkpointed."""
    return connected_components(edges, as_tables=False)


def reachable(links: DataFrame, heads: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Ids reached from ``heads`` (id) by following ``links`` (id, next), each id having at most one successor.

    Links double in length every round, so a chain of n hand-overs takes about log2(n) joins.
    """
    checkpoint_ready(links.sparkSession)
    reached = heads.select("id").distinct().checkpoint()
    jump = links.select("id", "next").checkpoint()
    size = reached.count()
    for _ in range(max_rounds):
        landed = reached.join(jump, "id").select(F.col("next").alias("id"))
        reached = reached.union(landed).distinct().checkpoint()
        grown = reached.count()
        if grown == size:
            return reached
        size = grown
        further = jump.select(F.col("id").alias("next"), F.col("next").alias("after"))
        jump = jump.join(further, "next").select("id", F.col("after").alias("next")).checkpoint()
    raise RuntimeError("links did not end; raise max_rounds")


def cospend_clusters(inputs: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Wallets (chain, address) clustered by spending together in a transaction (chain, tx_hash, address).

    With ``seeds`` (chain, address) only clusters that hold a seed are kept. Each transaction links its inputs to its
    least one, so a transaction with many inputs gives as many edges, not all pairs.
    """
    named = inputs.where(F.col("address").isNotNull() & (F.col("address") != "coinbase")).select("chain", "tx_hash", F.concat_ws(":", "chain", "address").alias("wallet")).distinct()
    hub = named.groupBy("chain", "tx_hash").agg(F.min("wallet").alias("src"))
    edges = named.join(hub, ["chain", "tx_hash"]).select("src", F.col("wallet").alias("dst"))
    parts = connected_components(edges)
    chain, address = F.split("node", ":", 2)[0], F.split("node", ":", 2)[1]
    out = parts.select(chain.alias("chain"), address.alias("address"), F.substring(F.sha1(F.col("component").cast("binary")), 1, 16).alias("cluster_id"))
    if seeds is not None:
        wanted = out.join(seeds.select("chain", "address").distinct(), ["chain", "address"], "left_semi").select("cluster_id").distinct()
        out = out.join(wanted, "cluster_id", "left_semi")
    return out


def owners(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(company, owner, steps): everyone who owns a company over any number of direct or ultimate edges.

    ``edges`` are (child, parent, kind); a company may have several parents, ``steps`` is the fewest edges up to the owner.
    Pairs within k steps and pairs joined by a walk of exactly k steps give those of 2k, so depth d takes about log2(d)
    rounds. In a ring of owners the walks never end, but no new pair is found; a company does not own itself.
    """
    checkpoint_ready(edges.sparkSession)
    exact = edges.where("child <> parent").select(F.col("child").alias("company"), F.col("parent").alias("owner")).distinct().checkpoint()
    within = exact.withColumn("steps", F.lit(1).cast("long"))
    size, k = exact.count(), 1
    for _ in range(max_rounds):
        beyond = exact.withColumnRenamed("owner", "mid").join(within.withColumnRenamed("company", "mid"), "mid").select("company", "owner", (F.col("steps") + k).alias("steps"))
        within = within.unionByName(beyond).where("company <> owner").groupBy("company", "owner").agg(F.min("steps").alias("steps")).checkpoint()
        exact = exact.withColumnRenamed("owner", "mid").join(exact.withColumnRenamed("company", "mid"), "mid").select("company", "owner").distinct().checkpoint()
        grown, k = within.count(), 2 * k
        if grown == size:
            return within
        size = grown
    raise RuntimeError("ownership did not settle; raise max_rounds")


def primary_paths(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(company, path): the ids above a company along its first parent, direct before ultimate and then the least, as
    array of struct(id, kind); a path ends at a company without a parent or before one it has passed.

    A path of k ids continues with that of its last one, so a chain of n takes about log2(n) rounds.
    """
    checkpoint_ready(edges.sparkSession)
    first = edges.where("child <> parent").groupBy("child").agg(F.min(F.struct((F.col("kind") != "direct").alias("late"), "parent", "kind")).alias("p"))
    paths = first.select(F.col("child").alias("company"), F.array(F.struct(F.col("p.parent").alias("id"), F.col("p.kind").alias("kind"))).alias("path"), F.col("p.parent").alias("at")).checkpoint()
    for _ in range(max_rounds):
        on = paths.select(F.col("company").alias("at"), F.col("path").alias("further"), F.col("at").alias("then"))
        joined = paths.join(on, "at", "left").select("company", F.concat("path", F.coalesce("further", F.expr("slice(path, 1, 0)"))).alias("path"), F.col("then").alias("at"))
        ids = F.concat(F.array("company"), F.col("path.id"))
        ring = F.size(F.array_distinct(ids)) < F.size(ids)
        once = F.filter("path", lambda p, i: F.array_position(ids, p["id"]) == i + 2)
        paths = joined.select("company", F.when(ring, once).otherwise(F.col("path")).alias("path"), F.when(~ring, F.col("at")).alias("at")).checkpoint()
        if paths.where("at is not null").isEmpty():
            return paths.select("company", "path")
    raise RuntimeError("an ownership path did not end; raise max_rounds")


def ownership_chains(companies: DataFrame, edges: DataFrame, secrecy: list[str] | None = None) -> DataFrame:
    """Each company's path up its first parents, and what is known of all its owners over either kind of edge.

    The path names the company, then owner after owner with the kind of the edge; ``owners`` counts all of them,
    ``involves_sanctioned`` and ``secrecy`` look at the company and all of them, and ``places`` are their countries.
    """
    from intel_spark.operators.corporate import SECRECY_JURISDICTIONS

    hidden = secrecy or SECRECY_JURISDICTIONS
    facts = companies.select("id", "name", "lei", "country", F.coalesce("listed", F.lit(False)).alias("listed"))
    up = edges.join(companies.select(F.col("id").alias("parent")), "parent", "left_semi")
    above = owners(up).join(facts.select(F.col("id").alias("owner"), "country", "listed"), "owner")
    about = above.groupBy("company").agg(F.count("*").alias("owners"), F.max("listed").alias("o_listed"), F.collect_set("country").alias("o_places"))  # as many as there are countries
    hops = primary_paths(up).select("company", F.posexplode("path").alias("at", "hop")).select("company", "at", "hop.id", F.concat("hop.kind", F.lit("_parent")).alias("relationship"))
    named = hops.join(facts.select("id", "name", "lei", "country"), "id").groupBy("company").agg(F.array_sort(F.collect_list(F.struct("at", "name", "lei", "country", "relationship"))).alias("hops"))
    rows = facts.withColumnRenamed("id", "company").join(named, "company", "left").join(about, "company", "left")
    subject = F.array(F.struct("name", "lei", "country", F.lit("subject").alias("relationship")))
    path = F.concat(subject, F.coalesce(F.transform("hops", lambda h: F.struct(h["name"].alias("name"), h["lei"].alias("lei"), h["country"].alias("country"), h["relationship"].alias("relationship"))), F.slice(subject, 1, 0)))
    places = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array("country"), F.coalesce("o_places", F.array().cast("array<string>"))))))
    out = rows.select("company", path.alias("chain_path"), F.coalesce("owners", F.lit(0)).alias("owners"), (F.col("listed") | F.coalesce("o_listed", F.lit(False))).alias("involves_sanctioned"), places.alias("places"))
    secret = F.exists("places", lambda c: c.isin(hidden))
    return out.select("company", "chain_path", F.size("chain_path").alias("chain_length"), F.element_at("chain_path", -1)["name"].alias("top_name"), "owners", "involves_sanctioned", secret.alias("secrecy"), "places")


def propagate_exposure(companies: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """Exposure carried along ownership: listed parent to subject x0.9 (ultimate x0.75), listed subject to child
    x0.9, listed child to subject 0.5. A direct match is never replaced; among others the strongest wins.

    ``companies`` carry (id, confidence, match_type) with null confidence where unlinked.
    """
    checkpoint_ready(companies.sparkSession)
    state = companies.select("id", "confidence", "match_type")
    down = F.when(F.col("kind") == "ultimate", 0.75).otherwise(0.9)
    down_type = F.when(F.col("kind") == "ultimate", "ultimate_parent").otherwise("parent")
    for hop in range(hops):
        linked = state.where(F.col("confidence").isNotNull())
        to_child = edges.join(linked, edges.parent == linked.id).select(F.col("child").alias("id"), F.round(F.col("confidence") * down, 3).alias("c"), down_type.alias("t"))
        direct = linked.where(F.col("match_type") == "direct")
        to_parent = edges.join(direct, edges.child == direct.id).select(F.col("parent").alias("id"), F.lit(0.5).alias("c"), F.lit("child").alias("t"))
        best = to_child.unionByName(to_parent).groupBy("id").agg(F.max_by(F.struct("c", "t"), F.struct("c", "t")).alias("n"))
        stays = (F.col("match_type") == "direct") | F.col("n").isNull() | (F.coalesce("confidence", F.lit(0.0)) >= F.col("n.c"))
        keeps = F.coalesce(stays, F.col("n").isNull())
        state = state.join(best, "id", "left").select("id", F.when(keeps, F.col("confidence")).otherwise(F.col("n.c")).alias("confidence"), F.when(keeps, F.col("match_type")).otherwise(F.col("n.t")).alias("match_type"))
        if hop + 1 < hops:
            state = state.checkpoint()
    return state


def relations(edges: DataFrame, companies: DataFrame, company: int) -> DataFrame:
    """Parents and subsidiaries of one company with their facts."""
    parents = edges.where(F.col("child") == company).select(F.col("parent").alias("id"), F.lit("parent").alias("relation"), "kind")
    children = edges.where(F.col("parent") == company).select(F.col("child").alias("id"), F.lit("subsidiary").alias("relation"), "kind")
    return parents.unionByName(children).join(companies.select("id", "name", "country"), "id")
