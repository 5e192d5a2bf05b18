"""N-gram Jaccard self-join with a token-group matrix.

1. Texts become sets of word shingles; texts with equal sets are one class, represented by its least id.
2. By a common order of tokens, rare ones first, two sets at or above the threshold share at least
   ``margin`` tokens among the first n - needed + margin of each (their prefixes). Only tokens in
   several prefixes go on.
3. Representatives are partitioned into crowds by the prefix token they share with most others and by
   size, and a crowd of N into groups of about sqrt(64 N), so that the queries between N sets that
   never link grow with sqrt(N) each, while no group has over about 4 million tokens. The matrix
   lists, by token, the groups whose prefixes hold it.
4. A representative looks up its prefix tokens and gets the groups that share enough of them to hold a
   partner. In these, the union of the members' whole sets bounds the overlap with any member; only
   groups whose bound suffices are opened, and their members compared exactly.
5. This is done twice. First inside each group, and for a few hubs of every large crowd with a common
   seed in all groups that may hold a partner; links found make components. Then for what can still join two components:
   a query is left out if its group lies wholly in the component of the one who asks. So a cluster of
   many near copies costs about one query a member, and no link between components is lost.
6. Links of both rounds become the components of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.components import components
from driftwatch.llm.scratch import SMALL_BATCHES, kept, settings
from driftwatch.llm.words import chunks, mixed, shingle_sets

SIZE = 5
PERCENT = 80
ORDER_BUCKETS = 1 << 16
GROUP_ROWS = 64
GROUP_TOKENS = 1 << 22
QUERY_ROWS = 256
HUBS = 4
SECOND = np.uint64(0xD6E8FEB86659FD93)


def signatures(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(id, n, fp1, fp2) of every text, and (bucket, count) of tokens by hash bucket from every task."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "fp1", "fp2", "bucket", "count"]
        load = np.zeros(ORDER_BUCKETS, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                found, bounds = shingle_sets(chunk, size)
                load += np.bincount((found >> np.uint64(48)).astype(np.int64), minlength=ORDER_BUCKETS)
                prints = []
                for x in (mixed(found), mixed(found * SECOND)):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                    prints.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
                nulls = pa.nulls(len(chunk), pa.int64())
                ids = batch.column(0).slice(chunk.first, len(chunk))
                columns = [ids, pa.array(np.diff(bounds)), *map(pa.array, prints), nulls, nulls]
                yield pa.RecordBatch.from_arrays(columns, names)
        used = np.flatnonzero(load)
        nulls = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([nulls] * 4 + [pa.array(used), pa.array(load[used])], names)

    schema = "id long, n long, fp1 long, fp2 long, bucket long, count long"
    return docs.select(F.col(key).cast("long"), text).mapInArrow(sign, schema)


def _bucket_ranks(signed: DataFrame) -> np.ndarray:
    """Rank of every token bucket by how often its tokens occur (65,536 numbers, whatever the input)."""
    rows = signed.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("n")).toArrow()
    load = np.zeros(ORDER_BUCKETS, np.int64)
    load[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    ranks = np.empty(ORDER_BUCKETS, np.uint64)
    ranks[np.argsort(load, kind="stable")] = np.arange(ORDER_BUCKETS, dtype=np.uint64)
    return ranks


def ordered(tokens: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Tokens renamed so that their numeric order is rare first: the bucket's rank in the high bits."""
    return (ranks[(tokens >> np.uint64(48)).astype(np.int64)] << np.uint64(48)) | (tokens & np.uint64((1 << 48) - 1))


def needed(n, percent: int):
    """Least overlap of a set of n tokens with any partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def margin(n):
    """Tokens that prefixes share at least: a twentieth of the set, which rules out chance and passages."""
    return n // 20 + 1


def representative_sets(texts: DataFrame, size: int, ranks, percent: int | None = None) -> DataFrame:
    """(id, n, tokens) of every row: its renamed tokens in order, packed; with ``percent`` its prefix only."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                found, bounds = shingle_sets(chunk, size)
                found = ordered(found, ranks.value)
                rows = []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    own = np.sort(found[a:b])
                    rows.append((own if percent is None else own[: b - a - needed(b - a, percent) + margin(b - a)]).view(np.int64))
                sizes = np.diff(bounds)
                ids = batch.column(0).slice(chunk.first, len(chunk))
                if percent is None:
                    packed = pa.array([r.tobytes() for r in rows], pa.binary())
                else:
                    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                    packed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), packed], ["id", "n", "tokens"])

    kind = "binary" if percent is None else "array<bigint>"
    return texts.mapInArrow(pack, f"id long, n long, tokens {kind}")


def _least_common(percent: int, n: str = "n", least: str = "least") -> F.Column:
    """Prefix tokens that partners share: the smaller margin, or the whole overlap needed where a set is smaller than that."""
    smaller = F.least(F.col(n), F.col(least))
    return F.least(F.expr(f"{n} div 20 + 1"), F.expr(f"{least} div 20 + 1"), F.ceil(smaller * percent / 100))


def _matrix(placed: DataFrame, *more: str) -> DataFrame:
    """The groups that hold a token, with the least and largest size of the members that do."""
    return placed.groupBy("token", "gid", *more).agg(F.min("n").alias("low"), F.max("n").alias("high"))


def _enough(asks: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """(id, gid) of the groups that hold enough of a representative's prefix tokens; one row of ``asks`` a token."""
    common = asks.groupBy("id", "gid", "n").agg(F.count(F.lit(1)).alias("common"))
    return common.join(crowded, "gid").where(F.col("common") >= _least_common(percent)).select("id", "gid")


def _sizes_fit(percent: int) -> F.Column:
    return (F.col("high") * 100 >= F.col("n") * percent) & (F.col("low") * percent <= F.col("n") * 100)


def grouped(prefixes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, n, gid, hub, tokens) and their shared prefix tokens (id, token, n, gid, hub).

    A chunk is the crowd of members with one seed and size step. Hubs are about HUBS members of a chunk
    of several groups, by hash.
    """
    tasks = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = prefixes.select("id", "n", F.explode("tokens").alias("token")).repartition(tasks, "token")
    frequent = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = kept(entries.join(frequent, "token"), "shared-tokens")
    seeds = shared.groupBy("id", "n").agg(F.max(F.struct("df", "token")).alias("seed"), F.count(F.lit(1)).alias("tokens"))
    step = F.floor(F.log("n") / F.log(F.lit(100 / percent)))
    seeds = seeds.select("id", "n", "tokens", F.xxhash64("seed.token", step).alias("chunk"))
    crowd = seeds.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all"))
    by_rows = F.least(F.sqrt(F.col("rows") / GROUP_ROWS), F.col("rows") / GROUP_ROWS)
    crowd = crowd.select("chunk", "rows", F.ceil(F.greatest(by_rows, F.col("all") / GROUP_TOKENS)).alias("parts"))
    part = F.pmod(F.xxhash64("id"), "parts")
    hub = (F.col("parts") > 1) & (F.pmod(F.xxhash64("id", F.lit(HUBS)), F.col("rows")) < HUBS)
    members = seeds.join(crowd, "chunk").select("id", "n", F.xxhash64("chunk", part).alias("gid"), hub.alias("hub"), "tokens")
    members = kept(members, "groups")
    return members, shared.select("id", "token").join(members.drop("tokens"), "id")


def first_queries(members: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(id, gid): members ask their own groups, hubs all groups that may hold a partner."""
    crowded = members.groupBy("gid").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"))
    inside = members.join(crowded, "gid").where((F.col("rows") > 1) & (F.col("tokens") >= _least_common(percent)))
    hubs = placed.where("hub").select("id", "token", "n", F.col("gid").alias("own"))
    asks = hubs.join(_matrix(placed), "token").where((F.col("gid") != F.col("own")) & _sizes_fit(percent))
    return inside.select("id", "gid").unionByName(_enough(asks, crowded, percent))


def open_queries(members: DataFrame, placed: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """(id, gid) of the queries between groups that can still join two components of ``joined``.

    A pair is looked for by its group of higher number. Two that share a token and are of different
    components: either the one who asks is not of the token's main component, or the group is not
    wholly of it. So a token all of whose holders are of one component is left out.
    """
    nodes = joined.select(F.col("node").alias("id"), "component")
    labelled = members.join(nodes, "id", "left").select("id", "n", "gid", F.coalesce("component", "id").alias("component"))
    labelled = kept(labelled, "labelled-members")
    crowded = labelled.groupBy("gid").agg(
        F.min("n").alias("least"),
        F.when(F.min("component") == F.max("component"), F.min("component")).alias("whole"),
    )
    holders = placed.select("id", "token").join(labelled, "id")
    several = holders.groupBy("token", "component").agg(F.count(F.lit(1)).alias("rows")).groupBy("token")
    several = several.agg(F.max(F.struct("rows", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"))
    live = kept(holders.join(several.where("parts > 1").drop("parts"), "token"), "open-tokens")
    matrix = _matrix(live, "main").join(crowded.select("gid", "whole"), "gid")
    asking = live.select("id", "n", "token", "component", "main", F.col("gid").alias("own"))
    other = (F.col("gid") > F.col("own")) & _sizes_fit(percent) & ~F.col("whole").eqNullSafe(F.col("component"))
    strays = asking.where("component != main").drop("main").join(matrix.drop("main"), "token").where(other)
    mixed_groups = matrix.where(~F.col("whole").eqNullSafe(F.col("main"))).drop("main")
    mains = asking.where("component = main").drop("main").join(mixed_groups, "token").where(other)
    return _enough(strays.unionByName(mains).select("id", "n", "gid"), crowded.select("gid", "least"), percent)


class Group:
    """Members' tokens side by side, and their union."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sizes = ids, np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        self.first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.union = tokens[self.first]
        self.last = np.append(self.first[1:], len(tokens))

    def partners(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Members whose Jaccard similarity with the query reaches the threshold."""
        at = np.searchsorted(self.union, query)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == query]
        if len(at) < needed(len(query), percent):  # the bound: no member shares more than the union does
            return np.zeros(0, np.int64)
        counts = self.last[at] - self.first[at]
        flat = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        overlap = np.bincount(self.owner[flat], minlength=len(self.ids))
        return np.flatnonzero(100 * overlap >= percent * (len(query) + self.sizes - overlap))


def spanning(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those pairs that join parts not yet joined: as many links as connect the same ids."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def links(texts: DataFrame, members: DataFrame, queries: DataFrame, size: int, ranks, percent: int) -> DataFrame:
    """(a, b) links that connect the same representatives as all links do.

    Queries of one group are dealt into parts of about 256, each with a copy of the group's members,
    so no task gets more than a part.
    """
    queries = kept(queries, "group-queries")
    asked = queries.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts"))
    opened = members.join(asked, "gid").select("id", "gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("member"))
    asking = queries.join(asked, "gid").select("id", "gid", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(False).alias("member"))
    roles = kept(opened.unionByName(asking), "group-roles")
    # joined by sorting at every size: the ids of documents with candidates grow with the input
    wanted = texts.join(roles.select("id").distinct().hint("merge"), "id")
    sets = representative_sets(wanted.select("id", "text"), size, ranks)
    tasks = sets.join(roles.hint("merge"), "id").select("gid", "part", "member", "id", "tokens")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(t, np.uint64) for t in frame["tokens"]]
        ids, member = frame["id"].tolist(), frame["member"].tolist()
        inside = [i for i, m in enumerate(member) if m]
        pairs = []
        if inside:
            group = Group([ids[i] for i in inside], [sets[i] for i in inside])
            for i, m in enumerate(member):
                if not m:
                    pairs += [(ids[i], group.ids[j]) for j in group.partners(sets[i], percent) if group.ids[j] != ids[i]]
        return pd.DataFrame(spanning(pairs), columns=["a", "b"]).astype("int64")

    return tasks.groupBy("gid", "part").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    Words are lower-cased (A-Z) runs without white space; two texts link when 100 * intersection >=
    percent * union of their sets of ``size``-word shingles. A text with fewer words has its whole
    sequence as its one shingle; null, empty and blank texts have none, link with nothing and are their
    own component. Rows with equal sets are one class. A null id gets its class's least id (null if none);
    rows that repeat an id are one node. No rows give no rows.
    """
    spark = docs.sparkSession
    with settings(spark, SMALL_BATCHES):
        signed = kept(signatures(docs, size, key, text), "signatures")
    rows = signed.where("bucket is null").select("id", "n", "fp1", "fp2")
    ranks = spark.sparkContext.broadcast(_bucket_ranks(signed))
    classes = kept(rows.where("n > 0").groupBy("n", "fp1", "fp2").agg(F.min("id").alias("rep")), "classes")
    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    with settings(spark, SMALL_BATCHES):
        prefixes = kept(representative_sets(named, size, ranks, percent), "prefixes")  # small, so joined instead of the texts
    reps = classes.where("rep is not null").select(F.col("rep").alias("id")).distinct()
    members, placed = grouped(prefixes.where("n > 0").join(reps, "id"), percent)
    own = members.select("id", "gid")
    with settings(spark, SMALL_BATCHES):
        found = kept(links(named, own, first_queries(members, placed, percent), size, ranks, percent), "links")
    first = components(found)
    queries = open_queries(members, placed, first, percent)
    with settings(spark, SMALL_BATCHES):
        between = kept(links(named, own, queries, size, ranks, percent), "links-between")
    # stars instead of the first links: fewer rows, and joined in fewer rounds
    joined = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(between))
    labels = classes.join(joined, classes["rep"] == joined["node"], "left").select(
        "n", "fp1", "fp2", F.coalesce("component", "rep").alias("component_id")
    )
    labels = kept(labels, "class-components")
    matched = rows.join(labels, ["n", "fp1", "fp2"], "left")
    return matched.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
