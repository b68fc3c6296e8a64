"""Parent-child links to full hierarchies: leaf peeling upwards with subtree sizes, ways up by doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscalspark.session import materialise, salted_join, stored, width

NODE = ("code", "parent", "level")
#: Where a unit on a loop or below one stands, see hierarchy.
RING = {"ring": "string", "place": "long", "trail": "string"}


def clean_links(rows: DataFrame) -> DataFrame:
    """code, parent, level: one row per code, parent null at a root.

    rows: code, parent string, level int and an ordering column ord; the largest ord of a code counts (then the largest
    parent and level, so that ties have a defined result). A parent that is null, the code itself or no code
    makes a root. Null codes are left out.
    """
    one = rows.where("code IS NOT NULL").groupBy("code").agg(F.max(F.struct("ord", "parent", "level")).alias("r")).select("code", "r.parent", "r.level")
    known = one.select(F.col("code").alias("parent"), F.lit(True).alias("known"))
    up = F.when(F.col("known") & (F.col("parent") != F.col("code")), F.col("parent"))
    return one.join(known, "parent", "left").select("code", up.alias("parent"), "level")


#: Levels that are peeled in one plan, and plans after which what is left is taken as a whole, see rest.
LEVELS, PLANS = 6, 6


def peel(nodes: DataFrame, parts: int) -> tuple[list[DataFrame], DataFrame, bool]:
    """Peel leaves level by level: each peeled leaf sends its parent the size of its subtree. Returns the peeled nodes with their number of
    descendants (below), what is left with the part of below that is known, and whether that is exactly the loops.

    A level is one aggregation: every node sends its state to itself and, if it is a leaf, its size to its parent. LEVELS of
    them make one plan, which reads only the nodes that are left. The peeling stops where a level finds no leaf, or after PLANS plans.
    """
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("code")).agg(F.count("*").alias("kids"))
    left = materialise(nodes.join(kids, "code", "left").select(*NODE, F.coalesce("kids", F.lit(0)).alias("kids"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("out")))
    peeled: list[DataFrame] = []
    for _ in range(PLANS):
        cur = left.coalesce(1) if parts == 1 else left
        for _ in range(LEVELS):
            leaf = (F.col("kids") == 0) & ~F.col("out")
            none = F.lit(None)
            own = F.struct(*NODE, "kids", "below", (F.col("out") | leaf).alias("out"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("size"))
            sent = F.struct(F.col("parent").alias("code"), none.cast("string").alias("parent"), none.cast("int").alias("level"), none.cast("long").alias("kids"), none.cast("long").alias("below"), none.cast("boolean").alias("out"), F.lit(1).cast("long").alias("n"), (F.col("below") + 1).alias("size"))
            both = cur.select(F.explode(F.array_compact(F.array(own, F.when(leaf & F.col("parent").isNotNull(), sent)))).alias("m")).select("m.*")
            cur = both.groupBy("code").agg(F.max("parent").alias("parent"), F.max("level").alias("level"), (F.max("kids") - F.sum("n")).alias("kids"), (F.max("below") + F.sum("size")).alias("below"), F.max("out").alias("out"))
        cur = materialise(cur)
        done, rest = cur.where("out"), cur.where("NOT out")
        n = {r.out: r.c for r in cur.groupBy("out").agg(F.count("*").alias("c")).collect()}
        if n.get(True):
            peeled.append(done.select(*NODE, "below"))
        left = rest
        if not n.get(False) or rest.where("kids = 0").isEmpty():
            return peeled, left, True
    return peeled, left, False


def on_loops(left: DataFrame) -> DataFrame:
    """code of the nodes that lie on loops: those where the way up from some node still is after as many links as there are nodes; links
    are followed by doubling."""
    jump = stored(left.select("code", F.col("parent").alias("to")))
    steps, n = 1, jump.count()
    while steps < n:
        going = jump.where("to IS NOT NULL")
        if going.isEmpty():
            break
        jump = stored(jump.where("to IS NULL").unionByName(going.join(jump.select(F.col("code").alias("to"), F.col("to").alias("to2")), "to").select("code", F.col("to2").alias("to"))))
        steps *= 2
    return stored(jump.where("to IS NOT NULL").select(F.col("to").alias("code")).distinct())


def rest(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What peeling left, if the tree is too high for it: nodes off the loops with their number of descendants, and the loops as peel
    leaves them. Sizes are summed by doubling: after k rounds a node has the sum over less than 2**k levels below it, and
    gives it to the node 2**k links above, so a chain of n nodes takes log2(n) rounds."""
    ring = on_loops(left).withColumn("ring", F.lit(True))
    marked = stored(left.join(ring, "code", "left").withColumn("ring", F.coalesce("ring", F.lit(False))))
    s = stored(marked.select("code", F.when(~F.col("ring"), F.col("parent")).alias("to"), (F.col("below") + 1).alias("s")))
    while not s.where("to IS NOT NULL").isEmpty():
        more = s.where("to IS NOT NULL").groupBy(F.col("to").alias("code")).agg(F.sum("s").alias("more"))
        up = s.select(F.col("code").alias("to"), F.col("to").alias("to2"))
        s = stored(s.join(more, "code", "left").join(up, "to", "left").select("code", F.col("to2").alias("to"), (F.col("s") + F.coalesce("more", F.lit(0))).alias("s")))
    told = marked.drop("below").join(s.select("code", (F.col("s") - 1).alias("below")), "code")
    told = stored(told)
    return told.where("NOT ring").select(*NODE, "below"), told.where("ring").select(*NODE, "below")


def loops(residue: DataFrame) -> DataFrame:
    """Loop nodes with below = other units reachable downwards (the rest of the loop and all that hangs on it), ring = the
    loop's name and place = links up from the unit to the one that names the loop.

    The smallest code of a loop names it; it is found by pointer doubling, so a loop of n units takes log2(n) rounds. Places
    are found alike, with the loop opened at its name.
    """
    jump = stored(residue.select(*NODE, "below", F.col("parent").alias("to"), F.least("code", "parent").alias("name")))
    while True:
        other = jump.select(F.col("code").alias("to"), F.col("to").alias("to2"), F.col("name").alias("name2"))
        nxt = stored(jump.join(other, "to").select(*NODE, "below", F.col("to2").alias("to"), F.least("name", "name2").alias("name"), (F.col("name2") < F.col("name")).alias("moved")))
        done = nxt.where("moved").isEmpty()
        jump = nxt.drop("moved")
        if done:
            break
    start = F.col("code") == F.col("name")
    rank = stored(jump.select(*NODE, "below", "name", F.when(start, F.col("code")).otherwise(F.col("parent")).alias("to"), F.when(start, 0).otherwise(1).cast("long").alias("place")))
    while not rank.where("to <> name").isEmpty():
        other = rank.select(F.col("code").alias("to"), F.col("to").alias("to2"), F.col("place").alias("place2"))
        rank = stored(rank.join(other, "to").select(*NODE, "below", "name", F.col("to2").alias("to"), (F.col("place") + F.col("place2")).alias("place")))
    total = rank.groupBy("name").agg(F.sum(F.col("below") + 1).alias("total"))
    return rank.join(total, "name").select(*NODE, (F.col("total") - 1).alias("below"), F.col("name").alias("ring"), "place")


def hierarchy(rows: DataFrame, per_partition: int = 50_000) -> DataFrame:
    """For every unit its root, depth, path and number of descendants, with loops reported.

    rows: see clean_links. Result: code, parent, level, root, depth, path, below, loop, ring, place, trail. A root has depth 1;
    path lists the codes from root to unit joined by '/'. loop is 1 on a loop, 2 below one, else 0; with loop > 0 root and path
    are '' and depth 0, and below counts the other units reachable downwards. ring, place and trail are null with loop 0, else
    the name of the loop, the place on it of the unit where the way up enters it, and the codes from that unit down
    joined by '/'. Empty rows give none; extra columns are ignored.

    Leaves are peeled upwards with the sizes of their subtrees, several levels a plan; what is left are the loops, or the upper
    part of a very high tree, whose sizes are then summed by doubling. Ways up are put together by doubling too: after k
    rounds each node knows the last 2**k codes of its path, so a tree of height h takes log2(h) rounds, each of which
    writes the nodes once. Units on a loop stand as roots meanwhile. Few units keep to one partition.
    """
    nodes = materialise(clean_links(rows))
    parts = min(width(rows.sparkSession), nodes.count() // per_partition + 1)
    peeled, left, only_loops = peel(nodes, parts)
    if not only_loops:
        upper, left = rest(left)
        peeled.append(upper)
    ringed = materialise(loops(left)) if not left.isEmpty() else None
    every = reduce(DataFrame.unionByName, peeled) if peeled else nodes.limit(0).withColumn("below", F.lit(0).cast("long"))
    if ringed is not None:
        every = every.unionByName(ringed.select(*NODE, "below"))
        every = salted_join(every, ringed.select("code", "ring", "place"), ["code"], "left")
    else:
        every = every.select("*", F.lit(None).cast("string").alias("ring"), F.lit(None).cast("long").alias("place"))
    on = F.col("ring").isNotNull()
    way = stored(every.select(*NODE, "below", "ring", "place", F.when(~on, F.col("parent")).alias("top"), F.col("code").alias("path"), F.lit(1).alias("depth")).coalesce(parts))
    while True:
        going = way.where("top IS NOT NULL")
        if going.isEmpty():
            break
        above = way.select(F.col("code").alias("top"), F.col("top").alias("top2"), F.col("path").alias("path2"), F.col("depth").alias("depth2"))
        longer = salted_join(going, above, ["top"]).select(*NODE, "below", "ring", "place", F.col("top2").alias("top"), F.concat_ws("/", "path2", "path").alias("path"), (F.col("depth") + F.col("depth2")).alias("depth"))
        way = stored(way.where("top IS NULL").unionByName(longer).coalesce(parts))
    placed = way.drop("top").withColumnRenamed("path", "trail").withColumn("root", F.substring_index("trail", "/", 1))
    if ringed is None:
        shown = [F.col("root"), F.col("depth"), F.col("trail").alias("path"), F.lit(0).alias("loop")]
        return placed.select(*NODE, "below", *shown, *[F.lit(None).cast(kind).alias(c) for c, kind in RING.items()])
    entries = ringed.select(F.col("code").alias("root"), F.col("ring").alias("e_ring"), F.col("place").alias("e_place"))
    j = salted_join(placed, entries, ["root"], "left").withColumn("loop", F.when(F.col("e_ring").isNull(), 0).when(F.col("ring").isNotNull(), 1).otherwise(2))
    free = F.col("loop") == 0
    return j.select(
        *NODE, "below", F.when(free, F.col("root")).otherwise("").alias("root"), F.when(free, F.col("depth")).otherwise(0).alias("depth"), F.when(free, F.col("trail")).otherwise("").alias("path"),
        "loop", F.col("e_ring").alias("ring"), F.col("e_place").alias("place"), F.when(~free, F.col("trail")).alias("trail"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every unit and every other unit above it: below of each unit is its number of rows.

    Off the loops they come from the paths, below a loop from the trails to it. Every unit of a loop is above each other one and
    above all that hangs on the loop, as many links up as lead to the loop and on along it.
    """
    way = F.when(F.col("loop") == 0, F.col("path")).otherwise(F.col("trail"))
    parts = tree.withColumn("way", F.split(way, "/")).select(F.col("code").alias("descendant"), F.size("way").alias("depth"), F.posexplode("way").alias("pos", "ancestor"))
    lined = parts.select("ancestor", "descendant", (F.col("depth") - 1 - F.col("pos")).alias("distance")).where("distance > 0")
    on = tree.where("loop = 1").select("ring", F.col("code").alias("ancestor"), F.col("place").alias("to"), F.count("*").over(Window.partitionBy("ring")).alias("n"))
    hung = tree.where("loop > 0").select("ring", "place", F.col("code").alias("descendant"), (F.size(F.split("trail", "/")) - 1).alias("up"))
    round_ = salted_join(hung, on, ["ring"]).where(F.col("place") != F.col("to"))
    return lined.unionByName(round_.select("ancestor", "descendant", (F.col("up") + F.pmod(F.col("place") - F.col("to"), F.col("n"))).cast("int").alias("distance")))
