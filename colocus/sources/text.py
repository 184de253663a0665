"""Readers of text inputs: annotated genomes, domain hits, ontology, clans and trees."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str, *patterns: str, line_sep: str | None = None, whole: bool = False) -> DataFrame:
    """Lines of all files under folder whose names hold every pattern, with organism_id and genome from the name.

    Folders are searched to any depth and gzip files unpacked. No fitting file is an error. whole gives each
    file as one row.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    fits = lambda name: reduce(lambda x, y: x & y, [name.contains(p) for p in patterns], F.lit(True))
    if listed.where(fits(F.col("name"))).isEmpty():
        raise FileNotFoundError(f"no file under {folder} whose name holds {patterns}")
    rows = spark.read.text(folder, wholetext=whole, lineSep=line_sep, recursiveFileLookup=True)
    name = F.col("_metadata.file_name")
    return rows.where(fits(name)).select("value", organism_of(name).alias("organism_id"), genome_of(name).alias("genome"))


def _stem(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def organism_of(name: Column) -> Column:
    """The organism in a file's name, which ends at the first dot or before the number of the genome."""
    return F.regexp_replace(_stem(name), r"_gen[0-9]+$", "")


def genome_of(name: Column) -> Column:
    """The number of the genome in a file's name; null where there is none."""
    return F.regexp_extract(_stem(name), r"^.*_gen([0-9]+)$", 1).try_cast("int")


def genome_name(organism: Column, genome: Column) -> Column:
    """The inverse of organism_of and genome_of, without the suffix."""
    return F.when(genome.isNull(), organism).otherwise(F.concat(organism, F.lit("_gen"), genome.cast("string")))


def domain_hits(lines: DataFrame) -> DataFrame:
    """Hit lines: the accession without version and PF, the gene and the e-value; # lines are comments."""
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select("organism_id", part[2].alias("gene_id"), F.regexp_replace(F.substring_index(part[1], ".", 1), "PF", "").alias("domain_id"), part[7].cast("double").alias("evalue"))


def coding_genes(records: DataFrame) -> DataFrame:
    """Genes of annotated records (one molecule each): least start and greatest end of each CDS's location.

    Records without CDS are not listed; of a repeated locus tag the last stays.
    """
    head = records.where(F.col("value").contains("LOCUS")).select(
        "organism_id", F.regexp_extract("value", r"LOCUS\s+(\S+)", 1).alias("molecule_id"), F.regexp_extract("value", r"LOCUS\s+\S+\s+(\d+)", 1).cast("long").alias("length"),
        F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)\n     CDS             (.*?)(?=\n     \S|\nORIGIN|$)"), F.lit(1))).alias("at", "cds"),
    )
    place = F.split("cds", r"\n\s+/", 2)[0]
    numbers = F.regexp_extract_all(place, F.lit(r"(\d+)"), F.lit(1)).cast("array<long>")
    genes = head.select(
        "organism_id", "molecule_id", "length", "at", F.regexp_extract("cds", r'/locus_tag="([^"]+)"', 1).alias("gene_id"),
        F.array_min(numbers).alias("gene_start"), F.array_max(numbers).alias("gene_end"), F.when(place.contains("complement"), -1).otherwise(1).alias("strand"),
    )
    last = F.max_by(F.struct("length", "gene_start", "gene_end", "strand"), "at")
    return genes.groupBy("organism_id", "molecule_id", "gene_id").agg(last.alias("g")).select("organism_id", "molecule_id", "gene_id", "g.*")


def ontology_terms(stanzas: DataFrame) -> DataFrame:
    """Terms of an ontology read with a blank line as separator; of a repeated key the last stays."""

    def last(key: str) -> Column:
        return F.element_at(F.regexp_extract_all("value", F.lit(rf"(?m)^{key}: ((?:(?!: ).)*)"), F.lit(1)), -1)

    keyed = stanzas.where(F.col("value").contains("[Term]")).withColumn("ids", F.regexp_extract_all("value", F.lit(r"(?m)^id: (.*)$"), F.lit(1)))
    return keyed.where("size(ids) > 0").select(F.element_at("ids", -1).alias("go_id"), *[F.when(F.col("value").rlike(rf"(?m)^{k}: "), last(k)).alias(k) for k in ("name", "namespace", "def")])


def domain_terms(lines: DataFrame) -> DataFrame:
    """Domain-to-term lines; ! lines are comments."""
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("!") & (F.trim("value") != ""))
    return rows.select(F.element_at(part, -1).alias("go_id"), F.regexp_replace(F.element_at(F.split(part[0], ":"), -1), "PF", "").alias("domain_id"))


def clan_table(lines: DataFrame) -> DataFrame:
    part = F.split("value", "\t")
    return lines.select(F.regexp_replace(part[0], "PF", "").alias("domain_id"), part[1].alias("clan_id")).where("length(clan_id) > 0")


def domain_details(lines: DataFrame) -> DataFrame:
    part = F.split("value", "\t")
    return lines.select(F.regexp_replace(part[0], "PF", "").alias("domain_id"), F.slice(part, F.lit(2), F.size(part)).alias("details"))


_TOKEN = re.compile(r"\(|\)|,|;|[^(),;]+")


def newick_edges(text: str) -> list[tuple[int, int | None, float, str, bool, int]]:
    """(node_id in reading order, parent_id, dist, name, is_leaf, depth) of a tree with branch lengths."""
    nodes: list[list] = [[0, None, 0.0, "", True, 0]]
    at = 0
    for token in _TOKEN.findall(text.strip()):
        if token in "(,":
            up = at if token == "(" else nodes[at][1]
            nodes[up][4] = False
            nodes.append([len(nodes), up, 0.0, "", True, nodes[up][5] + 1])
            at = len(nodes) - 1
        elif token == ")":
            at = nodes[at][1]
        elif token != ";" and token.strip():
            name, _, dist = token.strip().partition(":")
            nodes[at][2:4] = [float(dist or 0), name]
    return [tuple(n) for n in nodes]


def newick_tree(spark: SparkSession, text: str) -> DataFrame:
    """The edge table of a tree; leaves carry their names as organism_id."""
    rows = [(n, p, d, name if leaf else None, leaf, depth) for n, p, d, name, leaf, depth in newick_edges(text)]
    return spark.createDataFrame(rows, "node_id long, parent_id long, dist double, organism_id string, is_leaf boolean, depth int")


def labelled_tree(spark: SparkSession, text: str) -> DataFrame:
    """The edge table of a tree whose inner nodes bear their subclade's number and leaves number__organism.

    An empty name is the root's, 0.
    """
    rows = newick_edges(text)
    ids = {n: int(name.split("__")[0]) if name else 0 for n, _, _, name, _, _ in rows}
    out = [(ids[n], None if p is None else ids[p], d, name.split("__", 1)[1] if leaf else None, leaf, depth) for n, p, d, name, leaf, depth in rows]
    return spark.createDataFrame(out, "node_id long, parent_id long, dist double, organism_id string, is_leaf boolean, depth int")


def labelled_newick(tree: DataFrame) -> str:
    """The text that labelled_tree reads, of a numbered tree (small: it is put together on the driver)."""
    rows = {r["node_id"]: r for r in tree.select("node_id", "parent_id", "dist", "organism_id", "is_leaf", "depth").collect()}
    below: dict[int, list[str]] = {}
    for r in sorted(rows.values(), key=lambda r: (-r["depth"], -r["node_id"])):
        name = f"{r['node_id']}__{r['organism_id']}" if r["is_leaf"] else str(r["node_id"])
        text = (f"({','.join(below.pop(r['node_id']))})" if r["node_id"] in below else "") + f"{name}:{r['dist']!r}"
        if r["parent_id"] is None:
            return text + ";"
        below.setdefault(r["parent_id"], []).append(text)
    return ";"
