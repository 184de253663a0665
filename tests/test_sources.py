import gzip
import json

import pytest
from pyspark.sql import functions as F

from colocus.functions import scalar as h
from colocus.jobs import modes, predict
from colocus.operators import resample, tree
from colocus.sources import commits, sinks, stored, text

RECORD = """LOCUS       {0}   {1} bp    DNA
FEATURES             Location/Qualifiers
     gene            1..90
                     /locus_tag="{0}_1"
     CDS             11..90
                     /locus_tag="{0}_1"
     CDS             complement(join(200..260,300..{2}))
                     /locus_tag="{0}_2"
     CDS             500..590
                     /locus_tag="{0}_3"
     tRNA            700..770
                     /locus_tag="{0}_4"
ORIGIN
        1 acgt
//
"""


@pytest.fixture
def genomes(tmp_path):
    for folder in ("gbk/deep", "hits"):
        (tmp_path / folder).mkdir(parents=True)
    for k, name in enumerate(("one_gen2", "two", "three")):
        place = tmp_path / ("gbk/deep" if k else "gbk")
        (place / f"{name}.gbk").write_text(RECORD.format(f"m{k}", 9000, 350) + RECORD.format(f"p{k}", 800, 340) + "LOCUS       empty  50000 bp DNA\nORIGIN\n//\n")
        lines = [f"Dom_{d} PF0000{d}.3 m{k}_{g} - 1e-9 30 0.0 1e-6" for d, g in ((1, 1), (2, 2), (3, 2), (4, 3), (1, 3))]
        (tmp_path / f"hits/{name}.hits").write_text("# comment\n" + "\n".join(lines) + f"\nDom_1 PF00001.3 p{k}_1 - 1e-9 30 0.0 1e-6\n")
    (tmp_path / "clans.tsv").write_text("PF00002\tCL1\tx\nPF00003\tCL1\tx\nPF00001\t\tx\n")
    return tmp_path


def test_files(spark, genomes):
    got = text.files(spark, str(genomes), "gen", ".gbk", whole=True).collect()
    assert [(r["organism_id"], r["genome"]) for r in got] == [("one", 2)]
    assert {r["organism_id"]: r["genome"] for r in text.files(spark, str(genomes), ".hits", whole=True).collect()} == {"one": 2, "two": None, "three": None}
    name = text.genome_name(F.col("organism_id"), F.col("genome"))
    assert {r[0] for r in text.files(spark, str(genomes), ".hits", whole=True).select(name).collect()} == {"one_gen2", "two", "three"}
    with pytest.raises(FileNotFoundError):
        text.files(spark, str(genomes), ".none")


def test_genomes(spark, genomes):
    genes = text.coding_genes(text.files(spark, str(genomes / "gbk"), ".gbk", line_sep="\n//"))
    got = {r["gene_id"]: (r["organism_id"], r["molecule_id"], r["length"], r["gene_start"], r["gene_end"], r["strand"]) for r in genes.collect()}
    assert len(got) == 18 and got["m0_1"] == ("one", "m0", 9000, 11, 90, 1) and got["m1_2"] == ("two", "m1", 9000, 200, 350, -1)
    sinks.write_genomes(genes, str(genomes / "out"), as_json=True)
    assert spark.read.parquet(str(genomes / "out/molecules")).count() == 6 == spark.read.json(str(genomes / "out/molecules_json")).count()
    assert stored.genes_of(spark, str(genomes / "out/genes"), ["two"]).count() == 6


NEWICK = "((one:1,two:2):3,three:4);"


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def test_predict_goes_on(spark, genomes):
    """A second run computes only what came since: a new organism, and hits that came after their genome."""
    args = [str(genomes / x) for x in ("gbk", "hits", "clans.tsv", "out")]
    (genomes / "hits/three.hits").rename(genomes / "three.kept")
    (genomes / "gbk/deep/two.gbk").rename(genomes / "two.kept")
    assert {r["n_organisms"] for r in predict.predict(spark, *args).collect()} == {1}
    (genomes / "two.kept").rename(genomes / "gbk/deep/two.gbk")
    assert {r["n_organisms"] for r in predict.predict(spark, *args).collect()} == {2}
    (genomes / "three.kept").rename(genomes / "hits/three.hits")
    got = predict.predict(spark, *args, newick=NEWICK, weighted=True)
    fresh = predict.predict(spark, *args[:3], str(genomes / "fresh"), newick=NEWICK, weighted=True)
    assert rows_of(got) == rows_of(fresh) and max(r["n_organisms"] for r in got.collect()) == 3
    done = spark.read.parquet(args[3] + "/likelihoods/done")
    assert done.groupBy("at").agg(F.array_join(F.sort_array(F.collect_list("organism_id")), ",").alias("x")).orderBy("at").collect() == [(0, "one,three"), (1, "two"), (2, "three")]
    before = done.count()
    whole = rows_of(predict.predict(spark, *args))
    assert spark.read.parquet(args[3] + "/likelihoods/done").count() == before and rows_of(predict.predict(spark, *args, force=True)) == whole
    (genomes / "hits/two.hits").write_text("# none\n")  # changed inputs count, and so do files that are gone
    (genomes / "gbk/one_gen2.gbk").rename(genomes / "one.kept")
    assert {r["n_organisms"] for r in predict.predict(spark, *args).collect()} == {1}
    (genomes / "one.kept").rename(genomes / "gbk/one_gen2.gbk")
    with pytest.raises(ValueError, match="two"):
        predict.predict(spark, *args, newick=NEWICK, strict=True)
    assert sinks.subclades_done(spark, args[3] + "/composition").count() == 5 and not sinks.is_empty(spark, args[3] + "/conserved")
    read = text.labelled_tree(spark, spark.read.text(args[3] + "/tree").first()[0])
    assert read.where("is_leaf").count() == 3 and stored.root_weights(spark, args[3] + "/weights").count() == 3


@pytest.mark.parametrize("crash", ["pairs", "marker"])
def test_predict_after_a_crash(spark, genomes, monkeypatch, crash):
    """A run that dies after a table, or just before its marker, counts for nothing; the next one makes it good."""
    args = [str(genomes / x) for x in ("gbk", "hits", "clans.tsv", "out")]
    fresh = rows_of(predict.predict(spark, *args[:3], str(genomes / "fresh")))
    write, mark = commits.Batches.write, commits.Batches._mark
    with monkeypatch.context() as m:
        if crash == "marker":
            m.setattr(commits.Batches, "_mark", lambda *a: 1 / 0)
        else:
            m.setattr(commits.Batches, "write", lambda self, organisms, **tables: write(self, organisms, **{"pairs": tables["pairs"], "uniform": None}))
        with pytest.raises((ZeroDivisionError, AttributeError)):
            predict.predict(spark, *args)
    assert mark is commits.Batches._mark
    assert rows_of(predict.predict(spark, *args)) == fresh
    assert spark.read.parquet(args[3] + "/likelihoods/pairs").select("batch").distinct().count() == 2


def test_other_modes(spark, genomes):
    """Fit, sensitivity, bootstraps and permutations from files; a second run does only what is left."""
    at = lambda x: str(genomes / x)
    (genomes / "o.obo").write_text('head\n\n[Term]\nid: GO:1\nname: one\nnamespace: biological_process\ndef: "x"\n')
    (genomes / "map").write_text("".join(f"Pfam:PF0000{k} a > GO:x ; GO:1\n" for k in (1, 2, 3, 4)))
    args = [at("gbk"), at("hits"), at("clans.tsv"), at("o.obo"), at("map"), at("out")]
    (genomes / "gbk/deep/two.gbk").rename(genomes / "two.kept")
    modes.fit(spark, *args, starts=2)
    (genomes / "two.kept").rename(genomes / "gbk/deep/two.gbk")
    mean = modes.fit(spark, *args, newick=NEWICK, starts=2).first()
    done = spark.read.parquet(at("out/fit/done"))
    assert {(r["organism_id"], r["at"]) for r in done.collect()} == {("one", 0), ("three", 0), ("two", 1)}
    own = stored.organism_parameters(spark, at("out/parameters/organisms")).collect()
    assert len(own) == 3 and stored.parameters(spark, at("out/parameters/mean")).first()["rate"] == pytest.approx(mean["rate"])
    assert modes.sensitivity(spark, at("out")).count() == 3
    spread = {r["parameter"]: r for r in modes.bootstrap_parameters(spark, at("out"), weighted=True, samples=200).collect()}
    assert set(spread) == {"rate", "phi"} and spread["rate"]["mean"] == pytest.approx(mean["rate"], rel=0.2)
    predict.predict(spark, *args[:3], at("out"), newick=NEWICK)
    first = modes.permute(spark, at("out"), n_perm=20)
    bins = {(r["subclade_id"], r["bin"]) for r in first.collect()}
    conserved = spark.read.parquet(at("out/conserved"))
    assert bins == {(r["subclade_id"], r["bin"]) for r in resample.bin_counts(conserved).collect()} and {r["n"] for r in first.collect()} == {20}
    files = {p.name for p in (genomes / "out/permutations").glob("part-*")}
    assert rows_of(modes.permute(spark, at("out"), n_perm=20)) == rows_of(first) and {p.name for p in (genomes / "out/permutations").glob("part-*")} == files
    nulls = modes.resample_bins(spark, at("out"), samples=20).collect()
    assert {(r["subclade_id"], r["bin"]) for r in nulls} == bins and all(r["mean"] is None for r in nulls)


def test_mappings(spark, tmp_path):
    (tmp_path / "o.obo").write_text('head\n\n[Term]\nid: GO:1\nname: one\nnamespace: biological_process\ndef: "x"\n\n[Term]\nid: GO:2\nname: two\nnamespace: biological_process\ndef: "OBSOLETE. x"\n')
    (tmp_path / "map").write_text("!c\nPfam:PF00001 a > GO:x ; GO:1\nPfam:PF00002 a > GO:x ; GO:1\nPfam:PF00002 a > GO:x ; GO:2\n")
    predict.build_mappings(spark, str(tmp_path / "o.obo"), str(tmp_path / "map"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out/go_domains")).collect()] == [("GO:1", ["00001", "00002"])]
    assert spark.read.parquet(str(tmp_path / "out/domain_terms")).count() == 2


def test_stored_tables(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    with gzip.open(at("sizes.json.gz"), "wt") as f:
        json.dump({"a": [["m1", 900], ["m2", 50]], "b": [["m3", 70]]}, f)
    assert sorted(tuple(r) for r in stored.genome_sizes(spark, at("sizes.json.gz")).collect()) == [("a", "m1", 900, 0), ("a", "m2", 50, 1), ("b", "m3", 70, 0)]
    (tmp_path / "genes.json").write_text('{"g": [5, 9, -1], "k": [1, 2]}')
    assert sorted(tuple(r) for r in stored.gene_coordinates(spark, at("genes.json")).collect()) == [("g", 5, 9, -1), ("k", 1, 2, None)]
    params = spark.createDataFrame([("a", 450.0, 0.01, 0.2), ("b", 35.0, 0.03, 0.4)], "organism_id string, half double, rate double, phi double")
    sinks.write_parameters(params, params.selectExpr("avg(rate) rate", "avg(phi) phi"), at("params"))
    assert sorted(map(tuple, stored.organism_parameters(spark, at("params/organisms")).collect())) == sorted(map(tuple, params.collect()))
    assert tuple(stored.parameters(spark, at("params/mean")).first()) == pytest.approx((0.02, 0.3))
    stats = spark.createDataFrame([(0, 5, 0.5), (0, 10, None)], "subclade_id long, bin long, mean double")
    for _ in range(2):
        sinks.append_statistics(stats, at("stats"))
    assert stored.finished_bins(spark, at("stats")).count() == 2 and spark.read.option("sep", "\t").option("header", True).csv(at("stats")).where("mean = 'NA'").count() == 2
    bins = stats.select("subclade_id", "bin")
    assert sinks.todo(bins.union(spark.createDataFrame([(1, 5)], bins.schema)), stored.finished_bins(spark, at("stats")), ["subclade_id", "bin"]).count() == 1
    assert sinks.todo(bins, bins, ["bin"], force=True).count() == 2


def test_matrices_and_pairs(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    d = tree.leaf_distances(text.newick_tree(spark, "((GCF_a.1:1,GCF_b.1:2):3,GCF_c.1:4);"), 2)
    sinks.write_matrix(tree.normalised(d), at("norm"), "norm_distance")
    names = ["GCF_a.1", "GCF_b.1", "GCF_c.1"]
    sinks.write_matrix(d, at("square"), organisms=names)
    got = {(r["organism1"], r["organism2"]): r["distance"] for r in stored.distance_matrix(spark, at("square")).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 3, ("a", "c"): 8, ("b", "a"): 3, ("b", "b"): 0, ("b", "c"): 9, ("c", "a"): 8, ("c", "b"): 9, ("c", "c"): 0}
    assert spark.read.parquet(at("norm")).agg(F.max("norm_distance")).first()[0] == pytest.approx(1)
    index = spark.createDataFrame([(0, 1, 2), (1, 1, 3)], "pair_id long, domain1 int, domain2 int")
    sinks.write_pair_index(index, at("index"))
    assert sinks.index_of(spark.read.parquet(at("index")), index.where("domain2 = 3")).first()["pair_id"] == 1
    rows = spark.createDataFrame([("o", "g1", "g2", 7)], "organism_id string, gene1 string, gene2 string, distance long")
    sinks.write_distances(rows, rows.limit(0), at("dist"))
    assert spark.read.parquet(at("dist/go")).count() == 1 and spark.read.parquet(at("dist/non_go")).isEmpty()
    one = spark.range(1).select(h.label_code(F.lit("GCF_abc.1 x")).alias("code"), h.decimal_log(F.lit(1000.0)).alias("log"), h.decimal_log(F.lit(0.0)).alias("none")).first()
    assert tuple(one) == ("abc", pytest.approx(3), None)


def test_domain_details(spark):
    lines = spark.createDataFrame([("PF00001\tCL1\tclan\tname\ttext",), ("PF00002\t\t\tname2\tmore",)], "value string")
    got = {r["domain_id"]: r["details"] for r in text.domain_details(lines).collect()}
    assert got == {"00001": ["CL1", "clan", "name", "text"], "00002": ["", "", "name2", "more"]}
