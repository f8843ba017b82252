"""Further formats: PSL lines, array features, Nanostring counts, matrices with places, conserved elements, paired reads, aligned FASTA, indexed reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import intervals as iv
from tidemark.sources import text
from tidemark.sources.scratch import scratch_dir, written_text


def psl_lines(df: DataFrame, identity: float = 1.0) -> DataFrame:
    """PSL lines of models (name, chr, strand, start, end, blocks), ``identity`` of whose bases match."""
    size = iv.blocks_length(F.col("blocks"))
    hit = F.round(size * identity).cast("long")
    joined = lambda c: F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(","))
    lengths = F.transform("blocks", lambda b: b["end"] - b["start"])
    before = F.transform("blocks", lambda b, i: F.aggregate(F.slice(lengths, 1, i), F.lit(0).cast("long"), lambda s, x: s + x))
    zero = F.lit(0)
    cells = [hit, size - hit, zero, zero, zero, zero, F.size("blocks") - 1, F.col("end") - F.col("start") - size, F.col("strand"), F.col("name"), size, zero, size, F.col("chr"), F.col("end"), F.col("start"), F.col("end"), F.size("blocks")]
    return df.select(F.concat_ws("\t", *[c.cast("string") for c in cells], joined(lengths), joined(before), joined(F.transform("blocks", lambda b: b["start"]))).alias("value"))


def conserved_elements(spark: SparkSession, path: str) -> DataFrame:
    """``chr, start, end, log_odds, score`` of conserved elements: a BED line whose name is ``lod=`` and the log odds."""
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != ""))
    named = rows.select(*text.fields({"chr": "string", "start": "bigint", "end": "bigint", "name": "string", "score": "double"}))
    return named.select("chr", "start", "end", F.regexp_extract("name", r"lod=(-?[0-9.eE+-]+)", 1).try_cast("double").alias("log_odds"), "score")


def rate_windows(spark: SparkSession, path: str) -> DataFrame:
    """``chr, start, end, omega, log_odds, p`` of windows with a fitted rate of evolution."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(*text.fields({"chr": "string", "start": "bigint", "end": "bigint", "omega": "double", "log_odds": "double", "p": "double"}))


def base_composition(spark: SparkSession, path: str) -> DataFrame:
    """``chr, pos, a, c, g, t``: base composition fitted at each position."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(*text.fields({"chr": "string", "pos": "bigint", "a": "double", "c": "double", "g": "double", "t": "double"}))


def igv_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``chr, start, end, row, col, value`` of a matrix whose lines start with a place and a name; the header names the columns from the fifth on."""
    rows = text.lines(spark, path).where(~F.col("value").startswith("#")).withColumn("p", F.split("value", "\t"))
    heads = rows.where(F.lower(F.col("p")[0]) == "chromosome").select("file", F.posexplode(F.slice("p", 5, 1_000_000)).alias("i", "col"))
    cells = rows.where(F.lower(F.col("p")[0]) != "chromosome").select("file", F.col("p")[0].alias("chr"), F.col("p")[1].try_cast("bigint").alias("start"), F.col("p")[2].try_cast("bigint").alias("end"), F.col("p")[3].alias("row"), F.posexplode(F.slice("p", 5, 1_000_000)).alias("i", "v"))
    return cells.join(heads, ["file", "i"]).select("chr", "start", "end", "row", "col", F.col("v").try_cast("double").alias("value")).where("value is not null")


def nanostring(spark: SparkSession, path: str) -> DataFrame:
    """``sample, code_class, gene, accession, count`` of count files, one a sample: the sample's ID and the lines of the code summary."""
    rows = text.lines(spark, path)
    mark = lambda s: F.min(F.when(F.trim("value") == s, F.col("no")))
    known = rows.groupBy("file").agg(mark("<Code_Summary>").alias("a"), mark("</Code_Summary>").alias("z"), F.min_by("value", F.when(F.col("value").startswith("ID,"), F.col("no"))).alias("id"))
    inside = rows.join(known, "file").where((F.col("no") > F.col("a") + 1) & (F.col("no") < F.col("z")) & (F.trim("value") != ""))
    p = F.split("value", ",")
    return inside.select(F.regexp_extract("id", "^ID,([^,]*)", 1).alias("sample"), p[0].alias("code_class"), p[1].alias("gene"), p[2].alias("accession"), p[3].try_cast("double").alias("count"))


FEATURES = ("FEATURES", "FeatureNum", "ProbeName", "GeneName", "gProcessedSignal", "gIsSaturated", "gIsWellAboveBG", "gIsFeatNonUnifOL")


def array_file(df: DataFrame, probe: str, gene: str, signal: str, saturated: Column, above: Column) -> str:
    """Array features as a file of the scanner's form: a header line, then a DATA line a feature. Gives the folder."""
    head = df.sparkSession.createDataFrame([("TYPE\ttext\n" + "\t".join(FEATURES),)], "value string")
    flag = lambda c: F.when(c, "1").otherwise("0")
    rows = df.select(F.concat_ws("\t", F.lit("DATA"), F.lit("1"), F.col(probe), F.col(gene), F.col(signal).cast("string"), flag(saturated), flag(above), F.lit("0")).alias("value"))
    return written_text(head.unionByName(rows).coalesce(1), "array")


def array_features(spark: SparkSession, path: str) -> DataFrame:
    """``file, probe, gene, signal, saturated, above_background, non_uniform``: DATA lines by the names that the file's FEATURES line gives, wherever they stand."""
    rows = text.lines(spark, path).withColumn("p", F.split("value", "\t"))
    heads = rows.where(F.col("p")[0] == "FEATURES").groupBy("file").agg(F.max("p").alias("names"))
    data = rows.where(F.col("p")[0] == "DATA").join(heads, "file")
    cell = lambda name: F.get("p", F.array_position("names", name).cast("int") - 1)
    return data.select("file", cell(FEATURES[2]).alias("probe"), cell(FEATURES[3]).alias("gene"), cell(FEATURES[4]).try_cast("double").alias("signal"), (cell(FEATURES[5]) == "1").alias("saturated"), (cell(FEATURES[6]) == "1").alias("above_background"), (cell(FEATURES[7]) == "1").alias("non_uniform"))


def array_stats(features: DataFrame) -> DataFrame:
    """``features, saturated, signal_99, mean_signal``: counts, the 99th percentile and the mean of the signal."""
    return features.agg(F.count("*").alias("features"), F.count_if("saturated").alias("saturated"), F.percentile("signal", 0.99).alias("signal_99"), F.avg("signal").alias("mean_signal"))


def array_matrix(features: DataFrame, sample: str) -> DataFrame:
    """Long matrix of the mean signal of each gene's features that are neither saturated nor uneven."""
    good = features.where(~F.col("saturated") & ~F.coalesce("non_uniform", F.lit(False)))
    return good.groupBy(F.col("gene").alias("row")).agg(F.avg("signal").alias("value")).select("row", F.lit(sample).alias("col"), "value")


def paired_lines(mates: DataFrame) -> DataFrame:
    """Lines of pairs (pair, is_first, name, chr, start, end, nh; both mates on one reference): name, reference, first and last base of each mate, nh. The first mate names the pair."""
    a = mates.where("is_first").select("pair", "name", "chr", F.col("start").alias("s"), F.col("end").alias("e"), "nh")
    b = mates.where("not is_first").select("pair", "chr", F.col("start").alias("s2"), F.col("end").alias("e2"))
    return a.join(b, ["pair", "chr"]).select(F.concat_ws("\t", F.col("name").cast("string"), "chr", *[c.cast("string") for c in (F.col("s") + 1, F.col("e"), F.col("s2") + 1, F.col("e2"), F.col("nh"))]).alias("value"))


def paired_reads(spark: SparkSession, path: str, most_insert: int) -> DataFrame:
    """Fragments ``name, chr, start, end, nh`` of paired lines that span at most ``most_insert`` bases."""
    names = {"name": "string", "chr": "string", "s": "bigint", "e": "bigint", "s2": "bigint", "e2": "bigint", "nh": "int"}
    p = spark.read.text(path).select(*text.fields(names))
    out = p.select("name", "chr", (F.least("s", "s2") - 1).alias("start"), F.greatest("e", "e2").alias("end"), "nh")
    return out.where(F.col("end") - F.col("start") <= most_insert)


def multi_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``species, seq`` of an aligned FASTA file; sequences of different lengths are an error."""
    rows = text.fasta(spark, path).select(F.col("id").alias("species"), "seq")
    sizes = rows.agg(F.min(F.length("seq")).alias("a"), F.max(F.length("seq")).alias("z"))
    checked = F.when(F.col("a") == F.col("z"), F.col("seq")).otherwise(F.raise_error(F.lit("aligned sequences differ in length")))
    return rows.crossJoin(F.broadcast(sizes)).select("species", checked.alias("seq"))  # one row


def indexed_reads(reads: DataFrame, width: int) -> DataFrame:
    """Reads (chr, start, end, ...) laid out by reference and bin of ``width`` as Parquet, so that a region opens its own files only. A read over several bins lies in each."""
    import uuid

    place = f"{scratch_dir(reads.sparkSession)}/tidemark-reads-{uuid.uuid4().hex}"
    div = lambda x: F.floor(x / F.lit(width)).cast("long")
    binned = reads.withColumn("bin", F.explode(F.sequence(div(F.col("start")), div(F.greatest(F.col("start"), F.col("end") - 1)))))
    binned.withColumn("ref", F.col("chr")).repartition("ref", "bin").write.partitionBy("ref", "bin").parquet(place)
    return reads.sparkSession.read.parquet(place)


def region_reads(indexed: DataFrame, chr_: str, start: int, end: int, width: int) -> DataFrame:
    """The reads that overlap [start, end), each once: partition pruning by reference and bin, and each read from the first bin of the region that it touches."""
    near = indexed.where((F.col("ref") == chr_) & (F.col("bin") >= start // width) & (F.col("bin") <= (end - 1) // width))
    once = F.col("bin") == F.greatest(F.floor(F.col("start") / F.lit(width)), F.lit(start // width))
    return near.where(once & (F.col("start") < end) & (F.col("end") > start)).drop("ref", "bin")


def fasta_matching(records: DataFrame, pattern: str) -> DataFrame:
    """Records (id, seq, ...) whose id holds a match of the pattern."""
    return records.where(F.col("id").rlike(pattern))


def fasta_at_least(records: DataFrame, least: int) -> DataFrame:
    return records.where(F.length("seq") >= least)


def unchunked(chunks: DataFrame) -> DataFrame:
    """``id, seq`` from chunks (id, chunk, seq) in their order."""
    whole = chunks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk", "seq"))).alias("c"))
    return whole.select("id", F.array_join(F.transform("c", lambda x: x["seq"]), "").alias("seq"))


def size_lines(records: DataFrame) -> DataFrame:
    """Tab-separated id and length of each record."""
    return records.select(F.concat_ws("\t", "id", F.length("seq").cast("string")).alias("value"))


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """``file, no, id, length`` of FASTA records: where each one lies among its file's, so that wanted ones are found by a join."""
    rows = text.lines(spark, path, "\n>").withColumn("value", F.regexp_replace("value", "\r", ""))
    kept = rows.where((F.col("no") > 0) | F.col("value").startswith(">"))
    r = F.regexp_replace("value", "^>", "")
    return kept.select("file", "no", F.regexp_extract(r, r"^\S*", 0).alias("id"), F.length(F.regexp_replace(F.regexp_replace(r, "^[^\n]*", ""), r"\s", "")).alias("length"))


def block_index(alignment: DataFrame) -> DataFrame:
    """``species, chr, start, end, file, block`` of the rows of a multiple alignment: which block holds a stretch of a species."""
    return alignment.select("species", "chr", "start", (F.col("start") + F.col("size")).alias("end"), "file", "block")


def gct_and_cls(m: DataFrame, labels: dict[str, str], folder: str) -> None:
    """Writes a long matrix as ``matrix.gct`` and its columns' labels as ``matrix.cls`` below a folder, columns in alphabetical order in both."""
    from tidemark.sources import sinks

    sinks.write_text(sinks.gct(m), f"{folder}/matrix.gct", one_file=True)
    content = sinks.cls([labels[c] for c in sorted(labels)]).rstrip("\n")
    sinks.write_text(m.sparkSession.createDataFrame([(content,)], "value string"), f"{folder}/matrix.cls", one_file=True)
