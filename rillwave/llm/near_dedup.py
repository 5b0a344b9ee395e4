"""Near-duplicates: MinHash signatures posted by (coordinate, value), collisions counted by prefix and skip merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwave.llm.common import join_checked, schema_of, stage, unstage
from rillwave.llm.components import components
from rillwave.llm.shingles import MinHash, fingerprint, shingle_set
from rillwave.plans.workers import importable

#: Coordinates of a signature, and how many must agree. A pair of similarity 0.8 agrees on 38 of 48 in the mean;
#: fewer than 27 has a probability of 5e-5.
COORDINATES = 48
MATCHES = 27
PERCENT = 80
#: Turns in which each posting list compares its members with one pivot, before what is left is compared in cells.
PIVOT_TURNS = 2
#: Members of a list that is compared by a join; larger ones are compared in cells, of whose sides each holds about
#: as many. Entries of a cell's incidence matrix at most.
CELL = 128
DENSE = 30_000_000


def _sketched(k: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(coordinates)
        for batch in batches:
            sizes, prints, sigs = [], [], []
            for text in batch.column("text"):
                values = shingle_set((text.as_py() or "").encode(), k)
                sizes.append(len(values))
                prints.append(fingerprint(values) if len(values) else None)
                sigs.append(hasher.signature(values).view(np.int64) if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "fp", "sig"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set((t.as_py() or "").encode(), k).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["node", "members"])

    return run


def _colliding(pairs: DataFrame, sigs: DataFrame, matches: int) -> DataFrame:
    """Of pairs(a, b) that merging the prefix lists gave, those that collide in enough lists in all, with the sizes of their sets.

    The lists outside the prefixes are skipped while merging; whether a pair meets in them too is looked up in its signatures.
    """
    sa = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    sb = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return stage(pairs.join(sa, "a").join(sb, "b").where(agree >= matches).select("a", "b", "na", "nb"), "near-likely")


def _sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """pairs(a, b) with the sizes of their sets."""
    a, b = (sizes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}")) for x in ("a", "b"))
    return stage(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb"), "near-likely")


def _ends(pairs: DataFrame) -> DataFrame:
    return stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-nodes")


def _verified(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of likely pairs, those whose full sets are similar enough."""
    ma = sets.select(F.col("node").alias("a"), F.col("members").alias("ma"))
    mb = sets.select(F.col("node").alias("b"), F.col("members").alias("mb"))
    common = F.size(F.array_intersect("ma", "mb"))
    close = likely.join(ma, "a").join(mb, "b").withColumn("common", common)
    return stage(close.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), "near-edges")


def _reaching(placed: DataFrame, sigs: DataFrame, matches: int) -> DataFrame:
    """Of the nodes in placed (with comp), those that share enough signature values with other components.

    The nodes that drop out have no partner, so the others are counted again without them, twice.
    """
    nodes = placed.select("node", "comp").distinct()
    for _ in range(2):
        mine = nodes.withColumnsRenamed({"node": "rnode"})
        posts = stage(sigs.join(mine, F.col("node") == F.col("rnode")).select("node", "comp", F.explode("sig").alias("value")), "near-posts")
        shared = posts.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("value")
        shared = stage(shared, "near-shared")
        nodes = stage(
            posts.join(shared.hint("merge"), "value", "left_semi").groupBy("node", "comp").agg(F.count(F.lit(1)).alias("live")).where(F.col("live") >= matches).select("node", "comp"),
            "near-nodes",
        )
    return nodes.select("node")


def _only(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of df whose node is one of nodes."""
    return df.join(nodes.select(F.col("node").alias("wanted")), F.col("node") == F.col("wanted"), "left_semi")


def _meet(n1: Column, rank1: Column, n2: Column, rank2: Column, percent: int) -> Column:
    """Whether two sets can be similar enough if their first common member has these ranks in a common order.

    Ranks are from 1; 0 stands for a place of no meaning, which leaves the sizes to decide.
    """
    return (100 + percent) * (1 + F.least(n1 - rank1, n2 - rank2)) >= percent * (n1 + n2)


def _labelled(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """The postings in lists that reach into several components, with the smallest size in the list."""
    found = stage(components(edges).withColumnRenamed("node", "fnode"), "near-labels")
    placed = lists.join(found, F.col("node") == F.col("fnode"), "left").withColumn("comp", F.coalesce("comp", "node")).drop("fnode")
    several = placed.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least")).where("low <> high")
    several = stage(several, "near-several")
    return stage(placed.join(several.hint("merge"), "value").drop("low", "high"), "near-placed")


def _partners(placed: DataFrame) -> DataFrame:
    """node, n, least: the nodes in placed with the size of their set and the smallest size that a partner's may have."""
    return placed.groupBy("node").agg(F.first("n").alias("n"), F.min("least").alias("least"))


def _rarest_members(partners: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Postings of the nodes in partners under their rarest shingles: value, node, n, far, rank.

    Two sets of sizes n and m are similar enough only with percent / (100 + percent) of n + m in common. A node whose
    partners have at least m members thus shares one of its rarest n - common + 1 with each of them. far is lower the
    more common a node's shingles are.
    """
    least = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    common = F.ceil((F.col("n") + least) * percent / (100 + percent) - F.lit(1e-9))
    partners = partners.select(F.col("node").alias("pnode"), "n", (F.col("n") - common + 1).alias("prefix"))
    members = sets.select(F.explode("members").alias("value"), "node")
    df = stage(members.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "near-frequent")
    mine = Window.partitionBy("node")
    ranked = (
        members.join(df.hint("merge"), "value", "left")
        .withColumn("df", F.coalesce("df", F.lit(1)))
        .withColumn("rank", F.row_number().over(mine.orderBy("df", "value")))
        .withColumn("far", -F.sum(F.log("df")).over(mine))
    )
    ranked = ranked.join(partners, F.col("node") == F.col("pnode")).where((F.col("rank") <= F.col("prefix")) & (F.col("df") > 1))
    return ranked.select("value", "node", "n", (F.col("far") / F.col("n")).alias("far"), "rank")


def _similar(percent: int):
    """Of a cell's rows, the pairs of one of side a with one of side b that are of different components and similar."""

    def run(cell: pa.Table) -> pa.Table:
        side = cell.column("side").to_numpy()
        nodes, comps = cell.column("node").to_numpy(), cell.column("comp").to_numpy()
        sets = [np.asarray(m.values) for m in cell.column("members")]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        sizes = np.array([len(x) for x in sets])
        common = _overlaps([sets[i] for i in one], [sets[i] for i in two])
        enough = 100 * common >= percent * (sizes[one][:, None] + sizes[two][None, :] - common)
        x, y = np.nonzero(enough & (comps[one][:, None] != comps[two][None, :]))
        return pa.table({"a": nodes[one[x]], "b": nodes[two[y]]})

    return run


def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of one with each of two."""
    if not one or not two:
        return np.zeros((len(one), len(two)), dtype=np.int64)
    shared = np.intersect1d(np.concatenate(one), np.concatenate(two))
    out = np.zeros((len(one), len(two)), dtype=np.int64)
    step = max(1, DENSE // (len(one) + len(two)))
    for at in range(0, len(shared), step):
        part = shared[at : at + step]
        rows = []
        for sets in (one, two):
            held = np.zeros((len(sets), len(part)), dtype=np.float32)
            for k, members in enumerate(sets):
                mine = members[np.searchsorted(members, part[0]) : np.searchsorted(members, part[-1], side="right")]
                places = np.searchsorted(part, mine)
                held[k, places[part[np.minimum(places, len(part) - 1)] == mine]] = 1
            rows.append(held)
        out += np.rint(rows[0] @ rows[1].T).astype(np.int64)
    return out


def _in_cells(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All similar pairs within the lists whose components differ, without a row per pair.

    A list is cut into chunks of about CELL members; a cell is a chunk of those outside the pivot's component (side a)
    with a chunk of the whole list (side b). A member is sent once to each cell it belongs to, with its set.
    """
    outside = F.col("comp") != F.col("pcomp")
    sizes = lists.groupBy("value").agg(F.count(F.lit(1)).alias("m"), F.count_if(outside).alias("r"))
    sizes = sizes.select(F.col("value").alias("svalue"), F.ceil(F.col("m") / CELL).cast("int").alias("gb"), F.ceil(F.col("r") / CELL).cast("int").alias("ga"))
    rows = lists.join(sizes.hint("merge"), F.col("value") == F.col("svalue"))
    chunk = lambda g: F.pmod(F.xxhash64("node"), F.col(g)).cast("int")
    a = rows.where(outside).withColumn("side", F.lit(0)).withColumn("i", chunk("ga")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("gb") - 1)))
    b = rows.where("ga > 0").withColumn("side", F.lit(1)).withColumn("j", chunk("gb")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ga") - 1)))
    names = ["value", "i", "j", "side", "node", "comp"]
    cells = a.select(names).unionByName(b.select(names))
    held = cells.join(sets.select(F.col("node").alias("mnode"), "members"), F.col("node") == F.col("mnode")).select(*names, "members")
    return held.groupBy("value", "i", "j").applyInArrow(_similar(percent), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES, exact: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of word shingles (A-Z lowered) have percent of their union in common;
    component_id is the smallest doc_id reachable. Null, empty and blank texts have no shingles and no links; very long
    ones are read whole. Repeated rows fall into one component; two texts under one doc_id count as one document. A row
    without doc_id stays unlinked. Of ties the smallest doc_id is kept. Other columns are ignored; an empty table gives an empty result.

    Equal sets are first made one node (128-bit fingerprint). Each node is posted under each (coordinate, value) of its
    signature; a list that has one node is dropped, as are nodes with fewer lists left than must match. Of the rest a
    node needs merging only under its rarest (left - matches + 1), its prefix: a pair that collides in enough lists
    meets in one of these; its collisions in the lists that were skipped are then counted. In each turn a list compares
    its members with one pivot and forgets it: with every member
    of another component the pivot has then been compared, so a list of m copies costs m comparisons and not
    m * m / 2. Lists within one component are left out. What is open after the first turn, such as large groups of
    copies of copies that are less similar to each other, is posted anew under the rarest shingles of the full sets,
    with the node of the most common shingles as pivot. After the last turn the members of a list that are still in
    different components are paired by a join in short lists; in long ones each member outside the pivot's component
    is compared with its whole list, in cells of bounded size. So nothing is cut off. All pairs are confirmed on the
    full sets; from the second turn on, by these alone, in short lists as in long ones.

    A linked pair is missed only if it collides in fewer than matches lists. exact=True rules that out: after the first
    turn all nodes, and not just those that collide with another component, are posted under their rarest shingles, at
    the cost of a shuffle of all shingles.
    """
    importable(docs.sparkSession)
    sketch = stage(
        docs.select("doc_id", "text").mapInArrow(
            _sketched(shingle, coordinates), schema_of(docs, ["doc_id"], "n_shingles bigint, fp binary, sig array<bigint>")
        ),
        "near-sketch",
    )
    classes = stage(
        sketch.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")),
        "near-classes",
    )
    base = stage(sketch.select("doc_id", "n_shingles", "fp"), "near-documents")
    unstage(sketch)
    # What a join reads by a value that may be hot is staged before, here and below: then the join can be split.
    posts = classes.select("node", "n", F.explode("sig").alias("value"))
    live = stage(posts.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "near-live")
    mine = Window.partitionBy("node")
    ranked = (
        posts.join(live.hint("merge"), "value")
        .withColumn("left", F.count(F.lit(1)).over(mine))
        .withColumn("rank", F.row_number().over(mine.orderBy("df", "value")))
    )
    lists = stage(ranked.where((F.col("left") >= matches) & (F.col("rank") <= F.col("left") - matches + 1)).select("value", "node", "n"), "near-lists")
    nodes = stage(lists.select("node").distinct(), "near-nodes")
    sigs = stage(_only(classes.select("node", "n", "sig"), nodes), "near-signatures")
    sizes = stage(classes.select("node", "n"), "near-sizes")
    names = stage(classes.select("fp", "node"), "near-names")
    unstage(classes, live)

    def sets_of(some: DataFrame) -> DataFrame:
        texts = join_checked(docs.select("doc_id", "text"), some, F.col("doc_id") == F.col("node"), "left_semi", limit=1_000_000)
        return stage(texts.mapInArrow(_sets(shingle), "node bigint, members array<bigint>"), "near-sets")

    edges = stage(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false"), "near-edges")
    placed = lists.select("value", "node", "n", F.col("node").alias("comp"), F.lit(0.0).alias("far"), F.lit(0).alias("rank"))
    for turn in range(PIVOT_TURNS + 1):
        if turn and not (turn == 1 and exact):
            placed = _labelled(lists, edges)
        if turn == 1:
            if exact:
                nodes, partners = sizes.select("node"), sizes.withColumn("least", F.lit(1))
            else:
                nodes = _reaching(placed, sigs, matches)
                partners = _partners(_only(placed, nodes))
            sets = sets_of(nodes)
            lists = stage(_rarest_members(partners, sets, percent), "near-lists")
            placed = _labelled(lists, edges)
        pivots = (
            placed.groupBy("value")
            .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("far", F.xxhash64("node").alias("h"), "node", "comp", "n", "rank")).alias("p"), F.count(F.lit(1)).alias("m"))
            .where("low <> high")
            .select("value", "m", F.col("p.node").alias("pnode"), F.col("p.comp").alias("pcomp"), F.col("p.n").alias("pn"), F.col("p.rank").alias("prank"))
        )
        pivots = stage(pivots, "near-pivots")
        open_lists = stage(placed.join(pivots.hint("merge"), "value"), "near-open")
        if open_lists.isEmpty():
            if exact and not turn:
                continue
            break
        if turn < PIVOT_TURNS:
            fit = _meet(F.col("n"), F.col("rank"), F.col("pn"), F.col("prank"), percent)
            pairs = open_lists.where((F.col("comp") != F.col("pcomp")) & fit).select(F.least("node", "pnode").alias("a"), F.greatest("node", "pnode").alias("b"))
            lists = open_lists.where("node <> pnode").select("value", "node", "n", "far", "rank")
            likely = _sized(pairs.distinct(), sizes) if turn else _colliding(pairs.distinct(), sigs, matches)
            new = sets if turn else sets_of(_ends(likely))
            edges = edges.unionByName(_verified(likely, new, percent))
            unstage(likely, *([] if turn else [new]))
        else:
            small = open_lists.where(F.col("m") <= CELL)
            one = small.select("value", F.col("node").alias("a"), F.col("n").alias("n1"), F.col("comp").alias("c1"), F.col("rank").alias("r1"))
            two = small.select("value", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("comp").alias("c2"), F.col("rank").alias("r2"))
            fit = _meet(F.col("n1"), F.col("r1"), F.col("n2"), F.col("r2"), percent)
            pairs = one.join(two, "value").where((F.col("a") < F.col("b")) & (F.col("c1") != F.col("c2")) & fit).select("a", "b")
            new = _verified(_sized(pairs.distinct(), sizes), sets, percent)
            large = stage(_in_cells(open_lists.where(F.col("m") > CELL), sets, percent), "near-edges")
            edges = edges.unionByName(new).unionByName(large)
    found = components(edges).withColumnRenamed("node", "fnode")
    by_class = names.select("fp", "node").join(found, F.col("node") == F.col("fnode"), "left").select(F.col("fp").alias("cfp"), F.coalesce("comp", "node").alias("comp"))
    out = base.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp"))
    return out.join(stage(by_class, "near-components").hint("merge"), F.col("fp") == F.col("cfp"), "left").select(
        "doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("comp", "doc_id")).alias("kept")
    )


# All pairs by their common shingles, then all that is reachable: for tables of some thousand rows.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) AS n, count(*) AS k FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p WHERE 100 * k >= 80 * (n - k) UNION SELECT y, x FROM p WHERE 100 * k >= 80 * (n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON s.doc_id = c.x
"""
