"""Input of tree inference: of each clone its subclones with abundance, members and sequence, and the files of one clone.

Modes: of bulk contigs the subclones of a clonotype; of the cell table (one row a cell, with chain slots) heavy and light
chains together (HL, complete cells), or heavy (H) or light (L) chains alone (complete and rescued cells).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repspark.operators.ranks import columns, numbered
from repspark.runtime import file_system
from repspark.operators.wide import SLOTS

ROOT = "GL"
CHAINS = {"HL": SLOTS, "H": SLOTS[:2], "L": SLOTS[2:]}
#: Names fill so many characters; sequences stand in lines of 5 columns of 10.
NAME, COLUMN, PER_LINE = 9, 10, 5


def abundances(df: DataFrame, clone: str, subclone: str) -> DataFrame:
    """(clone, subclone, abundance) of all clones with at least two members, with a root row of 0 each."""
    n = df.where(F.col(clone).isNotNull() & F.col(subclone).isNotNull()).groupBy(F.col(clone).alias("clone"), F.col(subclone).alias("subclone")).agg(F.count(F.lit(1)).alias("abundance"))
    big = n.groupBy("clone").agg(F.sum("abundance").alias("t")).where("t > 1").select("clone")
    return n.join(big, "clone", "left_semi").unionByName(big.select("clone", F.lit(ROOT).alias("subclone"), F.lit(0).cast("bigint").alias("abundance")))


def _joined(names: list[Column], sep: str) -> Column:
    return F.nullif(F.concat_ws(sep, *names), F.lit(""))


def tree_rows(df: DataFrame, mode: str = "single_cell", chain: str = "HL", group: str | list[str] = "SampleID") -> DataFrame:
    """(group, clone, subclone, abundance, members, sequence, germline): the subclones of every clone, and its root GL with abundance 0.

    A subclone's sequence is that of its first member, and a clone's germline the smallest of its rows. Chains are named
    by the chain's clonotype and their place in name order. Clones of fewer than two rows are left out.
    """
    g = columns(group)
    if mode == "bulk":
        rows = df.select(*g, F.col("ClonotypeID").alias("clone"), F.col("SubcloneID_in_Clonotype").alias("subclone"), F.col("Subclone_nReads").alias("weight"), F.substring_index("contig_id", "_", 1).alias("member"), F.col("VDJ_sequence_correctedCDR3").alias("sequence"), F.col("Consensus_Germline").alias("germline"))
    elif mode == "single_cell":
        if chain not in CHAINS:
            raise ValueError("chain is HL, H or L")
        kept = df.where(F.col("completeBCR").isin(*(["Yes"] if chain == "HL" else ["Yes", "Yes_rescue"])) & F.col("igClonotypeID_num").isNotNull())
        slots = CHAINS[chain]
        name = F.col("igSubcloneID_in_Clonotype_num") if chain == "HL" else _joined([F.col(f"{s}_SubcloneID") for s in slots], "_")
        seq = F.concat(*[F.coalesce(F.col(f"{s}_VDJ_sequence_correctedCDR3"), F.lit("")) for s in slots])
        germ = F.concat(*[F.coalesce(F.col(f"{s}_Consensus_Germline"), F.lit("")) for s in slots])
        rows = kept.select(*g, F.col("igClonotypeID_num").alias("clone"), name.alias("subclone"), F.lit(1).cast("bigint").alias("weight"), F.col("barcode").alias("member"), seq.alias("sequence"), germ.alias("germline"))
    else:
        raise ValueError("mode is bulk or single_cell")
    rows = rows.where(F.col("clone").isNotNull() & F.col("subclone").isNotNull())
    out = rows.groupBy(*g, "clone", "subclone").agg(
        F.sum("weight").alias("abundance"), F.count(F.lit(1)).alias("_n"), F.array_join(F.array_sort(F.collect_list("member")), ":").alias("members"), F.min_by("sequence", F.struct("member", "sequence")).alias("sequence"), F.min("germline").alias("germline")
    )
    clones = out.groupBy(*g, "clone").agg(F.sum("_n").alias("_all"), F.min("germline").alias("germline")).where("_all > 1")
    out = out.drop("_n", "germline").join(clones.drop("_all"), [*g, "clone"])
    if mode == "single_cell" and chain != "HL":
        out = numbered(out, [*g, "clone"], [F.col("subclone")], "_k").withColumn("subclone", F.concat(F.regexp_replace("subclone", r"\.CV[0-9]+\.S[0-9]+", ""), F.lit("."), F.col("_k").cast("string"))).drop("_k")
    root = clones.select(*g, "clone", F.lit(ROOT).alias("subclone"), F.lit(0).cast("bigint").alias("abundance"), F.lit("").alias("members"), F.col("germline").alias("sequence"), "germline")
    return out.unionByName(root)


def fasta_text(name: Column, sequence: Column) -> Column:
    """A record, its name filled up with blanks."""
    return F.concat(F.lit(">"), F.rpad(name, F.greatest(F.length(name), F.lit(NAME)), F.lit(" ")), F.lit("\n"), sequence)


def phylip(rows: list[tuple[str, str]]) -> str:
    """Interleaved PHYLIP of (name, sequence); shorter sequences are filled up with '-'."""
    length = max(len(s) for _, s in rows)
    width = max(NAME, *(len(n) for n, _ in rows)) + 1
    step, out = COLUMN * PER_LINE, [f"{len(rows)} {length}"]
    for at in range(0, max(length, 1), step):
        for n, s in rows:
            part = s.ljust(length, "-")[at : at + step]
            out.append((n if at == 0 else "").ljust(width) + " ".join(part[k : k + COLUMN] for k in range(0, len(part), COLUMN)))
        out.append("")
    return "\n".join(out)


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, p = file_system(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def write_bundle(df: DataFrame, folder: str, clone: str, mode: str = "single_cell", chain: str = "HL", group: str | list[str] = "SampleID", largest: int = 100_000) -> dict[str, str]:
    """Write abundances.csv, idmap.txt, FASTA and interleaved PHYLIP of one clone; {name: path}, on any file system.

    One clone goes to the driver, its size checked. If it stands in several groups, restrict ``df`` to one first.
    """
    g, spark = columns(group), df.sparkSession
    rows = tree_rows(df, mode, chain, g).where(F.col("clone") == clone).orderBy(F.col("subclone") != ROOT, "subclone").limit(largest + 2).collect()
    if len(rows) > largest + 1:
        raise ValueError("the clone has too many subclones for one tree")
    if not rows:
        raise ValueError("the clone is not there, or has not enough sequences for a tree")
    if len({tuple(r[c] for c in g) for r in rows}) > 1:
        raise ValueError("the clone stands in several groups")
    name = f"{chain}_{clone}" if mode == "single_cell" else clone
    paths = {k: f"{folder}/{v}" for k, v in {"abundance": "abundances.csv", "idmap": "idmap.txt", "fasta": f"subclones_{name}.fasta", "phylip": "deduplicated.phylip"}.items()}
    _write(spark, paths["abundance"], "".join(f"{r['subclone']},{r['abundance']}\n" for r in rows))
    _write(spark, paths["idmap"], "".join(f"{r['subclone']},{r['members']}\n" for r in rows))
    seqs = [(r["subclone"], r["sequence"] or "") for r in rows]
    _write(spark, paths["fasta"], "".join(f">{n.ljust(NAME)}\n{s}\n" for n, s in seqs))
    _write(spark, paths["phylip"], phylip(seqs) + "\n")
    return paths
