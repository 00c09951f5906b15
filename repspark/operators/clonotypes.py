"""V clusters, CDR3 clusters, indel merging, ranked clonotype ids.

Python sees only distinct CDR3 of one pre-clonotype, or distinct genes of one unit, never the rows.
"""

from __future__ import annotations

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repspark.functions.sequences import v_genes
from repspark.kernels.alignment import composites, near_pairs, within
from repspark.kernels.graph import components
from repspark.kernels.linkage import clusters, density_valley, encode, forest, nearest, nearest_in
from repspark.operators.ranks import join_same
from repspark.runtime import map_arrow, map_groups, written


def v_cluster_map(df: DataFrame, unit: str = "unit", v_call: str = "v_call") -> DataFrame:
    """(unit, gene, v_cluster): genes called together in a unit, directly or through others, form one cluster.

    Its name is the sorted genes joined by ','. A gene never called with another is its own cluster.
    """
    pairs = (
        df.select(unit, v_genes(v_call).alias("g")).where(F.size("g") > 0).distinct()
        .select(unit, F.explode("g").alias("b"), F.col("g")[0].alias("a")).distinct()
    )

    def run(g: dict[str, list]) -> list[tuple]:
        root = components(zip(g["a"], g["b"]))
        groups: dict[str, list[str]] = {}
        for gene, r in root.items():
            groups.setdefault(r, []).append(gene)
        names = {r: ",".join(sorted(m)) for r, m in groups.items()}
        return [(g[unit][0], gene, names[root[gene]]) for gene in sorted(root)]

    return map_groups(pairs, [unit], run, f"{unit} string, gene string, v_cluster string")


def with_v_cluster(df: DataFrame, unit: str = "unit", v_call: str = "v_call") -> DataFrame:
    """Rows with the cluster of their first gene; 'NA' without a gene, as one more gene. The map has one row per unit and gene."""
    m = v_cluster_map(df, unit, v_call).withColumnRenamed("gene", "_gene")
    return df.withColumn("_gene", F.try_element_at(v_genes(v_call), F.lit(1))).join(m, [unit, "_gene"], "left").drop("_gene").withColumn("v_cluster", F.coalesce("v_cluster", F.lit("NA")))


#: A key of more distinct CDR3 than LOCAL is spread over tasks by pairs of blocks of about BLOCK.
LOCAL, BLOCK = 16_384, 2048


def _by_size(distinct: DataFrame, keys: list[str], local: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys of at most ``local`` rows, and those of the others (None if there are none)."""
    large = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > local).drop("_n")
    if large.isEmpty():
        return distinct, None
    here = join_same(distinct, large.withColumn("_large", F.lit(True)), keys)
    return here.where(F.col("_large").isNull()).drop("_large"), here.where("_large").drop("_large")


def _block_pairs(rows: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """Rows once for each pair (_p, _q) of blocks of their key that has their own block (_own); blocks are taken by hash of ``member``."""
    own = F.col("_own")
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_of"))
    rows = join_same(rows, sizes, keys).withColumn("_own", F.pmod(F.xxhash64(member), F.col("_of")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).drop("_of")
    return rows.withColumns({"_p": F.least(own, "_other"), "_q": F.greatest(own, "_other")}).drop("_other")


def _sides(g: dict[str, list], member: str) -> tuple[list, list | None]:
    """The members of the two blocks of a pair; the second is None for a block with itself."""
    p, q = g["_p"][0], g["_q"][0]
    one = [s for s, o in zip(g[member], g["_own"]) if o == p]
    return one, None if p == q else [s for s, o in zip(g[member], g["_own"]) if o == q]


def cdr3_clusters(df: DataFrame, keys: list[str], cdr3: str, cutoff: float = 0.2, mode: str = "average", order: str = "sequence_id", local: int = LOCAL, block: int = BLOCK) -> DataFrame:
    """(keys, cdr3, cluster): single, average or complete linkage over the distinct CDR3 of each key, numbered by first appearance.

    A key of up to ``local`` CDR3 is clustered in one task. Of a larger one the pairs of blocks are compared in parallel,
    each giving only the edges of a forest; what these tie together is a component, and each component is clustered alone.
    Both ways give the same clusters.
    """
    distinct = written(df.where(F.col(cdr3).isNotNull()).groupBy(*keys, cdr3).agg(F.min(order).alias("_first")), "cdr3")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, cdr3])

    def run(g: dict[str, list]) -> list[tuple]:
        seqs = [s for _, s in sorted(zip(g["_first"], g[cdr3]))]
        key = [g[k][0] for k in keys]
        return [(*key, s, c) for s, c in zip(seqs, clusters(seqs, cutoff, mode))]

    small, large = _by_size(distinct, keys, local)
    out = map_groups(small, keys, run, f"{schema}, cluster int")
    if large is None:
        return out

    def compare(g: dict[str, list]) -> list[tuple]:
        one, two = _sides(g, cdr3)
        every = one + (two or [])
        key = [g[k][0] for k in keys]
        return [(*key, every[i], every[j]) for i, j in forest(encode(one), None if two is None else encode(two), cutoff)] if one and two != [] else []

    def join(g: dict[str, list]) -> list[tuple]:
        return [(*[g[k][0] for k in keys], s, root) for s, root in components(zip(g["a"], g["b"])).items()]

    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    only = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    edges = map_groups(_block_pairs(large, keys, cdr3, block), [*keys, "_p", "_q"], compare, f"{only}, a string, b string", tasks)
    linked = map_groups(written(edges, "edges"), keys, join, f"{schema}, _root string")
    members = join_same(large, linked, [*keys, cdr3]).withColumn("_root", F.coalesce("_root", cdr3))
    if mode == "single":
        parts = members.withColumn("_k", F.lit(1))
    else:
        def split(g: dict[str, list]) -> list[tuple]:
            order = sorted(zip(g["_first"], g[cdr3]))
            key = [g[k][0] for k in keys]
            return [(*key, s, g["_root"][0], f, k) for (f, s), k in zip(order, clusters([s for _, s in order], cutoff, mode))]

        parts = map_groups(members, [*keys, "_root"], split, f"{schema}, _root string, _first {kinds[order]}, _k int", tasks)
    parts = written(parts, "parts")
    firsts = parts.groupBy(*keys, "_root", "_k").agg(F.min(F.struct("_first", cdr3)).alias("_f"))
    numbers = firsts.withColumn("cluster", F.row_number().over(Window.partitionBy(*keys).orderBy("_f"))).drop("_f")
    return out.unionByName(join_same(parts, numbers, [*keys, "_root", "_k"]).select(*keys, cdr3, "cluster"))


def with_clonotypes(df: DataFrame, unit: str = "unit", cdr3: str = "cdr3", cutoff: float = 0.2, mode: str = "average", by_v_length: bool = True) -> DataFrame:
    """Rows with Pre_Clonotype and Clonotype: V cluster, CDR3 length, V length, then CDR3 cluster."""
    parts = ["v_cluster", F.length(cdr3).cast("string"), *([F.col("len_no_CDR3").cast("string")] if by_v_length else [])]
    df = df.withColumn("Pre_Clonotype", F.concat_ws("_", *parts))
    numbers = cdr3_clusters(df, [unit, "Pre_Clonotype"], cdr3, cutoff, mode)
    return df.join(numbers, [unit, "Pre_Clonotype", cdr3], "left").withColumn("Clonotype", F.when(F.col("cluster").isNotNull(), F.concat_ws("_C", "Pre_Clonotype", F.col("cluster").cast("string")))).drop("cluster")


def near_clonotypes(seqs: DataFrame, keys: list[str], cdr3: str, cutoff: float, block: int = 2048) -> DataFrame:
    """(keys, a, b): clonotypes of a group of ``keys`` (one row each) whose CDR3 differ in length and are within the cutoff.

    A group is spread by hash over blocks of about ``block`` clonotypes; each pair of blocks is a task of its own,
    so a task holds two blocks, however large the group is.
    """
    kinds = {f.name: f.dataType.simpleString() for f in seqs.schema}
    rows = _block_pairs(seqs, keys, "Clonotype", block)

    def run(g: dict[str, list]) -> list[tuple]:
        key, of = [g[k][0] for k in keys], dict(zip(g["Clonotype"], g[cdr3]))
        one, two = _sides(g, "Clonotype")
        pairs = near_pairs([of[c] for c in one], None if two is None else [of[c] for c in two], cutoff)
        return [(*key, *sorted((one[i], (one if two is None else two)[j]))) for i, j in pairs]

    tasks = 4 * seqs.sparkSession.sparkContext.defaultParallelism
    return map_groups(rows, [*keys, "_p", "_q"], run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", a string, b string", tasks)


def _all_near(edges: DataFrame, seqs: DataFrame, keys: list[str], cdr3: str, cutoff: float) -> DataFrame:
    """The (keys, a, b) of which every sequence of ``a`` is within the cutoff of every one of ``b``."""
    pairs = edges
    for c in ("a", "b"):
        m = seqs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("Clonotype").alias("_c"), F.col(cdr3).alias(f"_s{c}"))
        on = F.col(c) == F.col("_c")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        pairs = pairs.join(m, on).drop("_c", *[f"_{k}" for k in keys])
    schema = pairs.drop("_sa", "_sb").withColumn("_near", F.lit(True)).schema

    def run(batches):
        for b in batches:
            near = [within(s, t, cutoff) for s, t in zip(b.column("_sa").to_pylist(), b.column("_sb").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*keys, "a", "b")], pa.array(near, pa.bool_())], names=[*keys, "a", "b", "_near"])

    tasks = 4 * seqs.sparkSession.sparkContext.defaultParallelism
    return map_arrow(pairs.repartition(tasks), run, schema).groupBy(*keys, "a", "b").agg(F.bool_and("_near").alias("_near")).where("_near").drop("_near")


def merge_indel_clonotypes(df: DataFrame, unit: str = "unit", cdr3: str = "cdr3", cutoff: float = 0.2, mode: str = "soft_filter", by_v_length: bool = True, block: int = 2048) -> DataFrame:
    """Rows with CorrectClt: clonotypes of one V cluster whose CDR3 differ by indels are joined.

    hard_filter compares all distinct CDR3, soft_filter the modal ones (one per clonotype), no skips the step.
    Pairs are found in parallel within a group (``near_clonotypes``); only the near ones meet in one task.
    """
    if mode == "no":
        return df.withColumn("CorrectClt", F.col("Clonotype"))
    if mode not in ("soft_filter", "hard_filter"):
        raise ValueError("mode is soft_filter, hard_filter or no")
    keys = [unit, "v_cluster", *(["len_no_CDR3"] if by_v_length else [])]
    seqs = df.where(F.col("Clonotype").isNotNull()).groupBy(*keys, "Clonotype", cdr3).agg(F.count(F.lit(1)).alias("n"))
    if mode == "soft_filter":
        edges = near_clonotypes(seqs.groupBy(*keys, "Clonotype").agg(F.max_by(cdr3, F.struct("n", F.reverse(cdr3))).alias(cdr3)), keys, cdr3, cutoff, block)
    else:
        seqs = written(seqs.drop("n"), "members")
        edges = _all_near(near_clonotypes(seqs.groupBy(*keys, "Clonotype").agg(F.min(cdr3).alias(cdr3)), keys, cdr3, cutoff, block), seqs, keys, cdr3, cutoff)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(g: dict[str, list]) -> list[tuple]:
        return [(g[unit][0], c, name) for c, name in composites(list(zip(g["a"], g["b"]))).items()]

    joined = map_groups(edges, keys, run, f"{unit} {kinds[unit]}, Clonotype string, _joined string")
    return df.join(joined, [unit, "Clonotype"], "left").withColumn("CorrectClt", F.coalesce("_joined", "Clonotype")).drop("_joined")


def dotted(*parts: Column | str) -> Column:
    """Parts joined by '.', null if any is null."""
    out = None
    for x in parts:
        c = F.col(x) if isinstance(x, str) else x
        out = c if out is None else F.concat(out, F.lit("."), c)
    return out


def rank_set(df: DataFrame, ranks: list[tuple[list[str], str, str, str]], by: str | None = None) -> DataFrame:
    """Rows with several ranks at once; each is (parents, key, name, prefix): name = prefix and rank of the key within its parents.

    The rank is by rows (or summed ``by``) descending, then key; a null key gives null. Rows are counted per
    combination of all keys before the shuffle, ranks are taken on those counts, and rows are joined back once.
    """
    keys = list(dict.fromkeys(c for parents, key, _, _ in ranks for c in [*parents, key]))
    n = df.groupBy(*keys).agg((F.count(F.lit(1)) if by is None else F.sum(by)).alias("_n"))

    def place(key: str, prefix: str, count: str, parents: list[str]) -> Column:
        w = Window.partitionBy(*parents).orderBy(F.col(key).isNull(), F.col(count).desc(), F.col(key))
        return F.when(F.col(key).isNotNull(), F.concat(F.lit(prefix), F.dense_rank().over(w).cast("string")))

    first, top = ranks[0], [*ranks[0][0], ranks[0][1]]
    inner = ranks[1:] if all(set(top) <= set(parents) for parents, *_ in ranks[1:]) else ranks
    if inner is not ranks:
        # the first rank is taken on its own keys; all others lie within one of these, so one shuffle serves them
        outer = n.groupBy(*top).agg(F.sum("_n").alias("_n0")).withColumn(first[2], place(first[1], first[3], "_n0", first[0])).drop("_n0")
        n = n.repartition(*top) if inner else n
    for i, (parents, key, _, _) in enumerate(inner):
        n = n.withColumn(f"_n{i}", F.sum("_n").over(Window.partitionBy(*parents, key)))
    for i, (parents, key, name, prefix) in enumerate(inner):
        n = n.withColumn(name, place(key, prefix, f"_n{i}", parents))
    n = n.select(*keys, *[name for _, _, name, _ in inner])
    if inner is not ranks:
        n = join_same(n, outer, top) if inner else outer
    return join_same(df, n, keys)


def nested_ranks(df: DataFrame, top: list[str], cv: str, sub: str, clonotypes: bool) -> DataFrame:
    """Rows with _v and _s: ranks of ``cv`` within ``top``, and of ``sub`` within both, by rows descending, then key; _cvk, the place of ``cv`` within ``top``.

    With ``clonotypes`` also _c, the rank of the last column of ``top`` (null has none) within the others. One shuffle of the rows
    by ``top`` serves all, so the rows should be narrow; keys are compared as one struct, null to null.
    """
    df = df.withColumn("_top", F.struct(*top)).repartition("_top")
    w = lambda *keys: Window.partitionBy("_top", *keys)
    df = df.withColumn("_n2", F.count(F.lit(1)).over(w(cv, sub))).withColumn("_n1", F.count(F.lit(1)).over(w(cv))).withColumn("_cvk", F.dense_rank().over(w().orderBy(cv)))
    df = df.withColumn("_s", F.dense_rank().over(w(cv).orderBy(F.col("_n2").desc(), sub))).withColumn("_v", F.dense_rank().over(w().orderBy(F.col("_n1").desc(), cv))).drop("_n1", "_n2")
    if clonotypes:
        last = F.col(f"_top.{top[-1]}")
        place = F.dense_rank().over(Window.partitionBy(*[f"_top.{c}" for c in top[:-1]]).orderBy(last.isNull(), F.col("_n").desc(), last))
        sizes = df.groupBy("_top").agg(F.count(F.lit(1)).alias("_n"))
        df = df.join(sizes.withColumn("_c", F.when(last.isNotNull(), place)).drop("_n"), "_top", "left")
    return df.drop("_top")


def rank_ids(df: DataFrame, parent: list[str], key: str, name: str, prefix: str, by: str | None = None) -> DataFrame:
    """Rows with one rank; see ``rank_set``."""
    return rank_set(df, [(parent, key, name, prefix)], by)


def nearest_distances(df: DataFrame, keys: list[str], cdr3: str, local: int = LOCAL, block: int = BLOCK) -> DataFrame:
    """(keys, cdr3, distance): distance of each distinct CDR3 to its nearest other one in the group; null if alone.

    A key of more than ``local`` CDR3 is compared by pairs of blocks, the least distances of which are then taken.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, cdr3]) + ", distance double"

    def run(g: dict[str, list]) -> list[tuple]:
        return list(zip(*[g[k] for k in keys], g[cdr3], nearest(g[cdr3])))

    small, large = _by_size(written(df.where(F.col(cdr3).isNotNull()).select(*keys, cdr3).distinct(), "cdr3"), keys, local)
    out = map_groups(small, keys, run, schema)
    if large is None:
        return out

    def compare(g: dict[str, list]) -> list[tuple]:
        one, two = _sides(g, cdr3)
        if not one or two == []:
            return []
        a, b = encode(one), encode(one if two is None else two)
        found = [(s, d) for s, d in zip(one, nearest_in(a, b).tolist())] + ([] if two is None else [(s, d) for s, d in zip(two, nearest_in(b, a).tolist())])
        n, key = max(1, a.shape[1]), [g[k][0] for k in keys]
        return [(*key, s, None if d == float("inf") else round(d * n) / n) for s, d in found]

    pairs = map_groups(_block_pairs(large, keys, cdr3, block), [*keys, "_p", "_q"], compare, schema, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return out.unionByName(pairs.groupBy(*keys, cdr3).agg(F.min("distance").alias("distance")))


def distance_histogram(distances: DataFrame, bins: int = 1000) -> DataFrame:
    """(cell, n): nearest distances per cell of width 1 / ``bins``; null and NaN are none."""
    return distances.where(F.col("distance").isNotNull() & ~F.isnan("distance")).groupBy(F.round(F.col("distance") * bins).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def automatic_cutoff(distances: DataFrame, cdr3_mode: str = "nt", bins: int = 1000) -> float:
    """The valley of the nearest-neighbour distances, at least 0.2 (nt) or 0.3 (aa). The driver sees a histogram of ``bins`` + 1 cells."""
    floor = 0.2 if cdr3_mode == "nt" else 0.3
    hist = distance_histogram(distances, bins).collect()
    return density_valley([r["cell"] / bins for r in hist], floor, [r["n"] for r in hist])
