"""Scores of windows against their surroundings and against permutations, relations of regions and subjects, coordinates without gaps, chunked sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import intervals as iv
from tidemark.functions import sequences as sq
from tidemark.functions import stats as st
from tidemark.operators import intervals as ops
from tidemark.operators.stats import seeded


def windows_with_genes(windows: DataFrame, genes: DataFrame, width: int, keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """Windows (keys, start, end) with the sorted names of the genes they contain, ``genes``. Two windows are equal, and sort, by key, place and genes."""
    found = ops.overlap_join(windows.select(*keys, "start", "end"), genes.select(*keys, "start", "end", "name"), width, keys, contained=True)
    inside = found.groupBy(*keys, "start", "end").agg(F.array_sort(F.collect_set("name")).alias("genes"))
    out = windows.join(inside, [*keys, "start", "end"], "left")
    return out.withColumn("genes", F.coalesce("genes", F.array().cast(dict(inside.dtypes)["genes"])))


def window_order(keys: tuple[str, ...] = ("chr",)) -> Column:
    """What ``windows_with_genes`` rows are compared by."""
    return F.struct(*keys, "start", "end", "genes")


def subject_pairs(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Two-subject annotations: overlapping ``a`` and ``b`` (name, chr, start, end, strand) as ``a, b, direct, chr, start, end``, the stretch they share, direct if their strands agree."""
    found = ops.overlap_join(a.select(F.col("name").alias("a"), "chr", "start", "end", "strand"), b.select(F.col("name").alias("b"), "chr", "start", "end", "strand"), width)
    return found.select("a", "b", (F.col("strand") == F.col("strand_r")).alias("direct"), "chr", F.greatest("start", "start_r").alias("start"), F.least("end", "end_r").alias("end"))


def transcript_counts(genes: DataFrame, windows: DataFrame, exons: DataFrame, width: int) -> DataFrame:
    """``name, strand, windows, best, exons, exon_length``: a gene's significant windows (chr, start, end, n) and the union of all its exons (name, chr, start, end)."""
    hits = ops.overlap_join(genes.select("name", "chr", "start", "end"), windows.select("chr", "start", "end", "n"), width)
    w = hits.groupBy("name").agg(F.count("*").alias("windows"), F.max("n").alias("best"))
    e = ops.merge(exons.select("name", "chr", "start", "end"), ("name", "chr")).groupBy("name").agg(F.count("*").alias("exons"), F.sum(F.col("end") - F.col("start")).alias("exon_length"))
    out = genes.select("name", "strand").join(w, "name", "left").join(e, "name", "left")
    return out.select("name", "strand", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("windows", "best", "exons", "exon_length")])


def local_scan(points: DataFrame, size: int, around: int, total: int) -> DataFrame:
    """Windows of ``size`` that hold points (chr, pos): ``n``, the global rate of the reference and the local one (of the ``around`` windows on each side and
    the window itself), ``enrichment`` over the local rate, and the scan p-values of both."""
    n = ops.window_counts(points, size, size, ("chr",), F.lit(1)).select("chr", "window_start", "n")
    span = 2 * around + 1
    near = n.withColumn("window_start", F.explode(F.sequence(F.col("window_start") - around * size, F.col("window_start") + around * size, F.lit(size).cast("long"))))
    near = near.groupBy("chr", "window_start").agg(F.sum("n").alias("local_n"))
    rates = n.groupBy("chr").agg((F.sum("n") / F.lit(float(total))).alias("rate"))
    out = n.join(near, ["chr", "window_start"]).join(F.broadcast(rates), "chr")  # a row a reference
    local = F.col("local_n") / F.lit(float(span * size))
    p = lambda rate, length: st.scan_pvalue(F.col("n"), rate, F.lit(size), F.lit(length))
    return out.select("chr", "window_start", "n", F.col("rate"), local.alias("local_rate"), (F.col("n") / size / local).alias("enrichment"), p(F.col("rate"), total).alias("p"), p(local, span * size).alias("local_p"))


def with_previous(df: DataFrame, keys: tuple[str, ...], order: str, score: str, width: int) -> DataFrame:
    """Rows with the score of the row ahead of them by ``order`` within the keys, ``previous`` (null for the first): what a processor that goes on from its last score gets."""
    met = ops.two_level(df, keys, [order], order, F.struct(F.col(order).alias("o"), F.col(score).alias("s")), "max", width, "__b", inclusive=False)
    return met.withColumn("previous", F.col("__b.s")).drop("__b")


def ratio_null(reads: DataFrame, label: str, one: str, size: int, permutations: int, seed: int) -> DataFrame:
    """``permutation, window_start, a, b, ratio``: labels dealt anew to the reads (name, chr, pos) by seeded coins, and the ratio (a + 1) / (b + 1) of each window.

    Permutation 0 is the labels as they are.
    """
    each = reads.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    coin = seeded([F.col("name"), F.col("permutation")], seed) % 2 == 0
    first = F.when(F.col("permutation") == 0, F.col(label) == one).otherwise(coin)
    n = each.groupBy("permutation", "chr", (F.floor(F.col("pos") / size) * size).cast("long").alias("window_start")).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    return n.withColumn("ratio", (F.col("a") + 1) / (F.col("b") + 1))


def ratio_peaks(null: DataFrame, size: int, share: float) -> DataFrame:
    """Windows of permutation 0 whose ratio is exceeded in at most ``share`` of the other permutations' windows, joined to regions: ``chr, start, end, windows, best``."""
    other = null.where("permutation > 0").groupBy("ratio").agg(F.count("*").alias("e"))
    seen = null.where("permutation = 0").groupBy("ratio").agg(F.count("*").alias("o"))
    from tidemark.operators.stats import running

    both = other.select("ratio", "e", F.lit(0).cast("long").alias("o")).unionByName(seen.select("ratio", F.lit(0).cast("long").alias("e"), "o")).groupBy("ratio").agg(F.sum("e").alias("e"), F.sum("o").alias("o"))
    total = other.agg(F.sum("e").alias("total"))
    ranked = running(both, "ratio", [], {"upto": "e"}, down=True).where("o > 0").crossJoin(F.broadcast(total))  # one row
    keep = ranked.where((F.col("upto") - F.col("e")) <= share * F.col("total")).select("ratio")
    hits = null.where("permutation = 0").join(keep, "ratio").select("chr", F.col("window_start").alias("start"), (F.col("window_start") + size).alias("end"), "ratio")
    return ops.islands(hits, ("chr",), gap=1).groupBy("chr", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("windows"), F.max("ratio").alias("best")).drop("island")


def annotation_enrichment(peaks: DataFrame, sets: DataFrame, lengths: DataFrame, permutations: int, seed: int, width: int) -> DataFrame:
    """Peaks (name, chr, start, end) over each annotation set (set_name, chr, start, end) against peaks moved to seeded places of their reference:
    ``name, statistic_name, method, statistic, p_value, total_count, region_count``."""
    size = F.col("end") - F.col("start")
    each = peaks.join(F.broadcast(lengths.select("chr", "length")), "chr").where(size <= F.col("length"))  # a row a reference
    each = each.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    at = F.when(F.col("permutation") == 0, F.col("start")).otherwise(F.pmod(seeded([F.col("name"), F.col("permutation")], seed), F.col("length") - size + 1))
    moved = each.select("name", "chr", "permutation", at.alias("start"), (at + size).alias("end"))
    hits = ops.overlap_join(moved, sets.select("set_name", "chr", "start", "end"), width).select("set_name", "permutation", "name").distinct()
    n = hits.groupBy("set_name", "permutation").agg(F.count("*").alias("n"))
    names = sets.select("set_name").distinct()
    grid = names.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations)))).join(n, ["set_name", "permutation"], "left").fillna(0, ["n"])
    seen = grid.where("permutation = 0").select("set_name", F.col("n").alias("seen"))
    null = grid.where("permutation > 0").join(seen, "set_name").groupBy("set_name", "seen").agg(F.avg("n").alias("mean"), F.count_if(F.col("n") >= F.col("seen")).alias("reach"))
    total = peaks.agg(F.count("*").alias("total"))
    out = null.crossJoin(F.broadcast(total))  # one row
    return out.select(
        F.col("set_name").alias("name"), F.lit("overlap").alias("statistic_name"), F.lit("shuffled").alias("method"), F.try_divide(F.col("seen").cast("double"), F.col("mean")).alias("statistic"),
        ((F.col("reach") + 1) / F.lit(permutations + 1)).alias("p_value"), F.col("total").alias("total_count"), F.col("seen").alias("region_count"),
    )


def metric_columns(metrics: DataFrame) -> DataFrame:
    """Metrics with what their accessors give: the id, ``get_method`` the statistic's name and ``get_submethod`` the method."""
    return metrics.withColumns({"id": F.concat_ws(".", "name", "statistic_name", "method"), "get_method": F.col("statistic_name"), "get_submethod": F.col("method")})


def metric_lines(metrics: DataFrame, type_1: str, type_2: str) -> DataFrame:
    """Tab-separated lines of metrics: name, id, the two data types, statistic's name, method, statistic, p-value, total and region count."""
    m = metric_columns(metrics)
    return m.select(F.concat_ws("\t", "name", "id", F.lit(type_1), F.lit(type_2), "statistic_name", "method", *[F.col(c).cast("string") for c in ("statistic", "p_value", "total_count", "region_count")]).alias("value"))


def without_gaps(positions: DataFrame, gaps: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Positions (chr, pos, ...) with ``relative``, the number of bases before them that no gap (chr, start, end) covers; null within a gap."""
    merged = ops.merge(gaps.select("chr", "start", "end"), width=width)
    others = [c for c in positions.columns if c not in ("chr", "pos")]
    rows = positions.select("chr", "pos", F.lit(1).alias("side"), F.lit(0).cast("long").alias("gone"), F.lit(None).cast("long").alias("stop"), F.struct(*[F.col(c) for c in others] or [F.lit(0).alias("x")]).alias("o"))
    marks = merged.select("chr", F.col("start").alias("pos"), F.lit(0).alias("side"), (F.col("end") - F.col("start")).alias("gone"), F.col("end").alias("stop"), F.lit(None).cast(rows.schema["o"].dataType).alias("o"))
    both = rows.unionByName(marks)
    met = ops.two_level(both, ("chr",), ["pos", "side"], "pos", F.col("gone"), "sum", width, "before")
    met = ops.two_level(met, ("chr",), ["pos", "side"], "pos", F.col("stop"), "max", width, "last").where("side = 1")
    return met.select("chr", "pos", *[F.col(f"o.{c}").alias(c) for c in others], F.when(F.col("last").isNull() | (F.col("pos") >= F.col("last")), F.col("pos") - F.col("before")).alias("relative"))


def end_distances(reads: DataFrame, genes: DataFrame, width: int) -> DataFrame:
    """``gene, read, distance`` from each read's oriented start to the 3' end of every gene on its strand that holds it, in bases of the reference."""
    pos = F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start"))
    points = reads.select(F.col("name").alias("read"), "chr", "strand", pos.alias("start"), (pos + 1).alias("end"))
    found = ops.overlap_join(genes.select(F.col("name").alias("gene"), "chr", "strand", "start", "end"), points, width, ("chr", "strand"))
    return found.select("gene", "read", F.when(F.col("strand") == "-", F.col("start_r") - F.col("start")).otherwise(F.col("end") - 1 - F.col("start_r")).alias("distance"))


def splice_support(introns: DataFrame, least: int, most: int, reads: int) -> DataFrame:
    """Introns (chr, start, end, strand, one row a read) of ``least`` to ``most`` bases that at least ``reads`` reads show: ``chr, start, end, strand, n``."""
    size = F.col("end") - F.col("start")
    return introns.where((size >= least) & (size <= most)).groupBy("chr", "start", "end", "strand").agg(F.count("*").alias("n")).where(F.col("n") >= reads)


def unmark_duplicates(reads: DataFrame) -> DataFrame:
    return reads.withColumn("is_duplicate", F.lit(False))


def compare_models(found: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """Found gene models (name, chr, strand, start, end, blocks) against known ones: ``name, kind``: ``equal`` (the same introns), ``contained`` (within a known one), ``overlapping`` or ``novel``."""
    chain = lambda d, n: d.select(F.col("name").alias(n), "chr", "strand", F.to_json(iv.introns(F.col("blocks"))).alias("chain"), F.size("blocks").alias("k"))
    equal = chain(found, "f").join(chain(known, "g"), ["chr", "strand", "chain", "k"]).where("k > 1").select(F.col("f").alias("name")).distinct().withColumn("equal", F.lit(True))
    near = ops.overlap_join(found.select("name", "chr", "strand", "start", "end"), known.select("chr", "strand", "start", "end"), width, ("chr", "strand"))
    near = near.groupBy("name").agg(F.max((F.col("start_r") <= F.col("start")) & (F.col("end") <= F.col("end_r"))).alias("inside"))
    out = found.select("name").join(equal, "name", "left").join(near, "name", "left")
    return out.select("name", F.when(F.col("equal"), "equal").when(F.col("inside"), "contained").when(F.col("inside").isNotNull(), "overlapping").otherwise("novel").alias("kind"))


def transcript_orientation(points: DataFrame, genes: DataFrame, width: int) -> DataFrame:
    """Points (name, chr, pos) with the ``orientation`` of the genes transcribed there: ``+``, ``-``, ``both`` or ``none``."""
    p = points.select("name", "chr", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    found = ops.overlap_join(p, genes.select("chr", "start", "end", F.col("strand").alias("s")), width).groupBy("name").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    out = points.join(found, "name", "left")
    return out.select(*points.columns, F.when(F.col("low").isNull(), "none").when(F.col("low") != F.col("high"), "both").otherwise(F.col("low")).alias("orientation"))


def scaled_windows(regions: DataFrame, points: DataFrame, parts: int, width: int) -> DataFrame:
    """``name, part, n``: each region (name, chr, start, end) in ``parts`` equal windows and the points (chr, pos) in each that has any."""
    p = points.select("chr", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    found = ops.overlap_join(regions.select("name", "chr", "start", "end"), p, width)
    part = F.floor((F.col("start_r") - F.col("start")) * parts / (F.col("end") - F.col("start"))).cast("int")
    return found.groupBy("name", part.alias("part")).agg(F.count("*").alias("n"))


def read_classes(reads: DataFrame, exons: DataFrame, genes: DataFrame, width: int) -> DataFrame:
    """``exp, exonic, intronic, intergenic``: reads (name, chr, start, end, exp) over an exon, over a gene only, or over neither."""
    r = reads.select("name", "chr", "start", "end", "exp")
    tagged = lambda d, n: ops.overlap_join(r, d.select("chr", "start", "end"), width).select("name").distinct().withColumn(n, F.lit(True))
    out = r.select("name", "exp").join(tagged(exons, "e"), "name", "left").join(tagged(genes, "g"), "name", "left")
    return out.groupBy("exp").agg(F.count_if(F.col("e").isNotNull()).alias("exonic"), F.count_if(F.col("e").isNull() & F.col("g").isNotNull()).alias("intronic"), F.count_if(F.col("e").isNull() & F.col("g").isNull()).alias("intergenic"))


def term_enrichment(study: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms (gene, term) of a study set (gene): ``term, hits, study, annotated, universe, p`` with the hypergeometric p-value of as many hits.

    The universe is the genes that have any term.
    """
    t = terms.select("gene", "term").distinct()
    inside = t.join(study.select("gene").distinct(), "gene", "left_semi")
    sizes = t.select("gene").distinct().agg(F.count("*").alias("universe")).crossJoin(inside.select("gene").distinct().agg(F.count("*").alias("study")))
    n = t.groupBy("term").agg(F.count("*").alias("annotated")).join(inside.groupBy("term").agg(F.count("*").alias("hits")), "term")
    out = n.crossJoin(F.broadcast(sizes))  # one row
    return out.select("term", "hits", "study", "annotated", "universe", st.hypergeometric_tail(F.col("hits"), F.col("study"), F.col("annotated"), F.col("universe")).alias("p"))


def binned_null(genes: DataFrame, study: DataFrame, permutations: int, seed: int, bin_size: int) -> DataFrame:
    """``permutation, name``: for each permutation and length bin (gene: name, length) as many genes as the study set has there, chosen by a seeded order."""
    from pyspark.sql import Window

    binned = genes.select("name", F.floor(F.col("length") / bin_size).cast("long").alias("bin"))
    wanted = binned.join(study.select("name").distinct(), "name", "left_semi").groupBy("bin").agg(F.count("*").alias("k"))
    each = binned.join(wanted, "bin").withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    order = Window.partitionBy("permutation", "bin").orderBy(seeded([F.col("name"), F.col("permutation")], seed), "name")
    return each.withColumn("place", F.row_number().over(order)).where("place <= k").select("permutation", "name")


def chunked(sequences: DataFrame, size: int = 1 << 16) -> DataFrame:
    """``id, chunk, seq``: sequences (id, seq) in chunks, so that a region fetches only what it lies in."""
    n = F.length("seq")
    each = sequences.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(n, F.lit(1)) - 1) / size).cast("long"))))
    return each.select("id", "chunk", F.substring("seq", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("seq"))


def chunk_regions(chunks: DataFrame, wanted: DataFrame, size: int = 1 << 16) -> DataFrame:
    """``name, chr, start, end, seq`` of regions (name, chr, start, end, strand) from a chunked assembly; the reverse strand is read backwards."""
    div = lambda x: F.floor(x / F.lit(size)).cast("long")
    need = wanted.where("start < end").withColumn("chunk", F.explode(F.sequence(div(F.col("start")), div(F.col("end") - 1))))
    met = need.join(chunks.withColumnRenamed("id", "chr"), ["chr", "chunk"])
    low = F.greatest(F.col("start") - F.col("chunk") * size, F.lit(0))
    part = F.substring("seq", (low + 1).cast("int"), (F.least(F.col("end") - F.col("chunk") * size, F.lit(size)) - low).cast("int"))
    whole = met.groupBy("name", "chr", "start", "end", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", part.alias("s")))), lambda x: x["s"]), "").alias("seq"))
    return whole.select("name", "chr", "start", "end", F.when(F.col("strand") == "-", sq.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def assembly_sizes(chunks: DataFrame) -> DataFrame:
    """``id, size, ungapped``: bases of each sequence, and those that aren't N."""
    bare = F.length(F.regexp_replace("seq", "[Nn]", ""))
    return chunks.groupBy("id").agg(F.sum(F.length("seq")).cast("long").alias("size"), F.sum(bare).cast("long").alias("ungapped"))


def random_regions(sizes: DataFrame, per: int, length: int, seed: int) -> DataFrame:
    """``name, chr, start, end, strand``: ``per`` seeded places of ``length`` bases on each sequence (id, size) that is long enough."""
    each = sizes.where(F.col("size") >= length).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    draw = seeded([F.col("id"), F.col("i")], seed)
    at = F.pmod(draw, F.col("size") - length + 1)
    return each.select(F.concat_ws(":", F.col("id").cast("string"), F.col("i").cast("string")).alias("name"), F.col("id").alias("chr"), at.alias("start"), (at + length).alias("end"), F.when(F.pmod(draw, F.lit(2)) == 0, "+").otherwise("-").alias("strand"))


def shared_kmers(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """``key, kmers, shared``: each sequence's distinct k-mers, and those that some other sequence has, too: what makes a primer unspecific."""
    each = df.select(key, F.explode(F.array_distinct(sq.kmers(F.col(seq), k))).alias("kmer"))
    n = each.groupBy("kmer").agg(F.count("*").alias("n"))
    return each.join(n, "kmer").groupBy(key).agg(F.count("*").alias("kmers"), F.count_if(F.col("n") > 1).alias("shared"))


def full_length_matches(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with ``at``, the first place (from 0) where the whole of ``a`` stands in ``b`` without gaps, N matching everything; -1 if nowhere."""
    n, m = F.length(a), F.length(b)
    x, y = F.split(F.upper(F.col(a)), ""), F.split(F.upper(F.col(b)), "")
    fits = lambda i: F.forall(F.zip_with(x, F.slice(y, i + 1, n), lambda p, q: (p == q) | (p == "N") | (q == "N")), lambda ok: ok)
    places = F.filter(F.when((n > 0) & (n <= m), F.sequence(F.lit(0), m - n)).otherwise(F.array().cast("array<int>")), fits)
    return pairs.withColumn("at", F.coalesce(F.get(places, F.lit(0)), F.lit(-1)))
