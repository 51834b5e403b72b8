"""Relational building blocks: pages, upserts, delta copies, key cascades, nearest lines, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows by key, plus one that tells whether there are more."""
    page = df if after is None else df.where(F.col(key) > F.lit(after))
    return page.orderBy(key).limit(size + 1)


def offset_page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def id_scan(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in `ids`, whatever their number."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def upsert_greatest(old: DataFrame, new: DataFrame, keys: list[str], value: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per key with the greatest value of both tables; `carried` columns come from that row."""
    best = F.max(F.struct(value, *carried)).alias("_best")
    return old.select(*keys, value, *carried).unionByName(new.select(*keys, value, *carried)).groupBy(*keys).agg(best).select(*keys, "_best.*")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` plus the rows of `new` whose key it does not have."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def delta_files(parent: DataFrame, current: DataFrame, path: str = "path", content: str = "content_hash") -> DataFrame:
    """Files of both snapshots with status copied, changed, added or removed."""
    a = parent.select(path, F.col(content).alias("_old"))
    b = current.select(path, F.col(content).alias("_new"))
    status = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").when(F.col("_old") == F.col("_new"), "copied").otherwise("changed")
    return a.join(b, path, "full").select(path, status.alias("status"))


def delta_copy(rows: DataFrame, parent: DataFrame, current: DataFrame, path: str = "path", content: str = "content_hash") -> DataFrame:
    """Rows of the parent snapshot's files that are unchanged in the current one."""
    same = parent.select(path, content).join(current.select(path, content), [path, content])
    return rows.join(same.select(path), path, "left_semi")


def replace_paths(rows: DataFrame, fresh: DataFrame, touched: DataFrame, path: str = "path") -> DataFrame:
    """Re-index of touched paths: their old rows go, the fresh ones come."""
    return rows.join(touched.select(path).distinct(), path, "left_anti").unionByName(fresh)


def resolve_cascade(df: DataFrame, key: str, lookups: list[tuple[DataFrame, str, str]], out: str) -> DataFrame:
    """`df` with `out`: the first lookup, in order, that knows the key. A lookup is (table, its key, its id);
    of several ids the least counts."""
    found = []
    for i, (lookup, lookup_key, value) in enumerate(lookups):
        name = f"_found{i}"
        one = lookup.groupBy(F.col(lookup_key).alias(f"_key{i}")).agg(F.min(value).alias(name))
        df = df.join(one, F.col(key) == F.col(f"_key{i}"), "left").drop(f"_key{i}")
        found.append(name)
    return df.withColumn(out, F.coalesce(*found)).drop(*found)


#: Line offsets in the order in which they are tried.
LINE_OFFSETS = (0, -1, 1, -2, 2)


def nearest_line(probes: DataFrame, rows: DataFrame, file: str, line: str, value: str) -> DataFrame:
    """`probes` with the value of the row of the same file at the nearest line, two lines off at most.

    Each probe becomes five exact keys, so this is an equi-join instead of a range join.
    """
    tried = probes.select("*", F.posexplode(F.array(*[F.col(line) + d for d in LINE_OFFSETS])).alias("_turn", "_at"))
    known = rows.groupBy(F.col(file).alias("_file"), F.col(line).alias("_line")).agg(F.min(value).alias("_value"))
    hits = tried.join(known, (F.col(file) == F.col("_file")) & (F.col("_at") == F.col("_line")), "left")
    return hits.groupBy(*probes.columns).agg(F.min(F.when(F.col("_value").isNotNull(), F.struct("_turn", "_value"))).alias("_best")).select(*probes.columns, F.col("_best._value").alias(value))


def touching(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Edges with an end in `nodes`, as two equi-joins instead of one with OR; columns node and other first."""
    ids = nodes.select(F.col(node).alias("node")).distinct()
    out = edges.join(ids, edges.src == ids.node).select("node", F.col("dst").alias("other"), "*")
    back = edges.join(ids, edges.dst == ids.node).where("src <> dst").select("node", F.col("src").alias("other"), "*")
    return out.select(*dict.fromkeys(out.columns)).unionByName(back.select(*dict.fromkeys(back.columns)))


def members_by_prefix(owners: DataFrame, owner_key: str, members: DataFrame, member_key: str) -> DataFrame:
    """Pairs whose member key starts with the owner key and a dot: all dotted prefixes of a member are
    exploded, so that the prefix join is an equi-join."""
    cuts = F.expr(f"transform(sequence(1, size(split({member_key}, '[.]')) - 1), i -> substring_index({member_key}, '.', i))")
    cuts = F.when(F.instr(member_key, ".") > 0, cuts).otherwise(F.array().cast("array<string>"))
    return members.withColumn("_owner", F.explode(cuts)).join(owners, F.col("_owner") == F.col(owner_key)).drop("_owner")


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_of_each(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def greedy_budget(df: DataFrame, group: str, item: str, cost: str, order: list[str], budget: int) -> DataFrame:
    """Items of each group taken in order while they fit; one that does not fit is skipped and costs nothing.

    The fold runs over the group's sorted costs. A group is a list shown to one reader and is
    bounded by its caller.
    """
    row = F.struct(*order, F.col(cost).cast("long").alias("_cost"), F.col(item).alias("_item"))
    sorted_rows = F.array_sort(F.collect_list(row))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("taken"))
    step = lambda s, x: F.when(s["used"] + x["_cost"] <= budget, F.struct((s["used"] + x["_cost"]).alias("used"), F.concat(s["taken"], F.array(x["_item"].cast("long"))).alias("taken"))).otherwise(s)
    return df.groupBy(group).agg(F.aggregate(sorted_rows, zero, step).alias("_fold"), F.count(F.lit(1)).alias("n")).select(group, F.col("_fold.used").alias("used"), F.col("_fold.taken").alias("taken"), "n")
