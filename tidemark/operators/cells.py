"""Genes met in stretches of a reference: reads over their exons or within their introns, counted without pairs of gene and read, and genes whose exons overlap, without an exchange of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the stretches that genes are dealt to by their start; longer genes are left to a join. Distinct widths of gaps that are counted one by one.
CELL, WIDTHS = 1 << 14, 64
#: Pairs that are made at once.
BLOCK = 1 << 18
#: Pairs of exons and of genes that are met at once, for genes that overlap; widths in one of their stretches.
MET, STRETCH = 1 << 17, 32


def _pairs(low: np.ndarray, high: np.ndarray):
    """Blocks of (row, place) for every place of [low, high) of each row; a block has at least one row."""
    n = np.maximum(high - low, 0)
    upto, first = np.cumsum(n), 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + BLOCK, "right")))
        k = n[first:last]
        row = np.repeat(np.arange(first, last), k)
        yield row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
        first = last


def _overlapping(s: np.ndarray, e: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Number and weight of the reads [s, e) that overlap each of [a, b): those that start before b less those that end by a."""
    by_s, by_e = np.argsort(s, kind="stable"), np.argsort(e, kind="stable")
    i, j = np.searchsorted(s[by_s], b, "left"), np.searchsorted(e[by_e], a, "right")
    up_s, up_e = np.concatenate([[0.0], np.cumsum(w[by_s])]), np.concatenate([[0.0], np.cumsum(w[by_e])])
    return i - j, up_s[i] - up_e[j]


def _inside(s: np.ndarray, e: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Number and weight of the reads within each of [a, b]. Of reads no longer than the gap, all that end by b lie within, but for those that start before a."""
    n, t = np.zeros(len(a), np.int64), np.zeros(len(a))
    widths, of = np.unique(b - a, return_inverse=True)
    if len(widths) <= WIDTHS:
        by_s, by_e = np.argsort(s, kind="stable"), np.argsort(e, kind="stable")
        for k, width in enumerate(widths):
            at, fits = np.flatnonzero(of == k), e - s <= width
            x, y = by_s[fits[by_s]], by_e[fits[by_e]]
            i, j = np.searchsorted(e[y], b[at], "right"), np.searchsorted(s[x], a[at], "left")
            n[at] = i - j
            t[at] = np.concatenate([[0.0], np.cumsum(w[y])])[i] - np.concatenate([[0.0], np.cumsum(w[x])])[j]
        return n, t
    order = np.argsort(s, kind="stable")
    s, e, w = s[order], e[order], w[order]
    for row, at in _pairs(np.searchsorted(s, a, "left"), np.searchsorted(s, b, "right")):
        ok = e[at] <= b[row]
        n += np.bincount(row[ok], minlength=len(a))
        t += np.bincount(row[ok], weights=w[at[ok]], minlength=len(a))
    return n, t


def _repeated(rows: pd.DataFrame, gs, ge, of, ga, gb, within: bool) -> pd.DataFrame:
    """``gene, code, n, w`` for reads of which one name has several rows: they are met gene by gene and counted once."""
    rows = rows.sort_values("s", kind="stable").reset_index(drop=True)
    s, e = rows["s"].to_numpy(), rows["e"].to_numpy()
    met, held = [], []
    for row, at in _pairs(np.zeros(len(gs), np.int64), np.searchsorted(s, ge, "left")):
        ok = e[at] > gs[row]
        met.append(row[ok] * len(s) + at[ok])
    for row, at in _pairs(np.searchsorted(s, ga, "left"), np.searchsorted(s, gb, "right")):
        ok = e[at] <= gb[row]
        held.append(of[row[ok]] * len(s) + at[ok])
    met = np.concatenate(met or [np.zeros(0, np.int64)])
    found = pd.DataFrame({"gene": met // len(s), "held": np.isin(met, np.concatenate(held or [np.zeros(0, np.int64)]))})
    found[["read", "code", "w"]] = rows.loc[met % len(s), ["read", "code", "w"]].to_numpy()
    each = found.groupby(["gene", "read", "code", "w"], as_index=False)["held"].agg(["all", "any"])
    return each[each["all"] if within else ~each["all"]].groupby(["gene", "code"], as_index=False).agg(n=("w", "size"), w=("w", "sum"))


def cell_counts(genes: DataFrame, reads: DataFrame, within: bool = False) -> DataFrame:
    """``name, exp, n, weight`` for genes (name, chr, start, end, gaps) no longer than ``CELL`` and reads (read, chr, start, end, exp, w).

    Counted are the reads over [start, end) that lie in none of the gaps (sorted, disjoint structs start, end), or with ``within`` those
    that lie in one and have no row elsewhere over the gene. Rows of a read that agree in ``exp`` and ``w`` count once. Genes are dealt
    by (chr, stretch of their start), reads to the stretches whose genes may reach them; a stretch is one task's.
    """
    names, exps = genes.schema["name"].dataType, reads.schema["exp"].dataType
    cell = lambda c: F.floor(c / F.lit(CELL)).cast("long")
    left = genes.where("chr IS NOT NULL").select("name", F.col("chr").alias("c"), cell(F.col("start")).alias("cell"), "start", "end", F.transform("gaps", lambda g: g["start"]).alias("ga"), F.transform("gaps", lambda g: g["end"]).alias("gb"))
    reach = F.sequence(cell(F.col("start")) - 1, cell(F.greatest("start", F.col("end") - 1)))
    right = reads.where("chr IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").select(F.col("chr").alias("c"), F.explode(reach).alias("cell"), F.xxhash64("read").alias("read"), "start", "end", "exp", F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))

    def count(g: pa.Table, r: pa.Table) -> pa.Table:
        gs, ge = (g[c].to_numpy() for c in ("start", "end"))
        ga, gb = g["ga"].combine_chunks(), g["gb"].combine_chunks()
        of = np.repeat(np.arange(len(gs)), np.diff(ga.offsets.to_numpy()))
        ga, gb = ga.flatten().to_numpy(zero_copy_only=False), gb.flatten().to_numpy(zero_copy_only=False)
        coded = r["exp"].combine_chunks().dictionary_encode(null_encoding="encode")
        rows = pd.DataFrame({"read": r["read"].to_numpy(), "s": r["start"].to_numpy(), "e": r["end"].to_numpy(), "code": coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), "w": r["w"].to_numpy()})
        twice = rows.duplicated(["read"], keep=False).to_numpy()
        single, out = rows[~twice], []
        for k in range(len(coded.dictionary)):
            s, e, w = (single.loc[single["code"] == k, c].to_numpy() for c in ("s", "e", "w"))
            n, t = np.zeros(len(gs), np.int64), np.zeros(len(gs))
            m, v = _inside(s, e, w, ga, gb)
            m, v = np.bincount(of, weights=m, minlength=len(gs)).astype(np.int64), np.bincount(of, weights=v, minlength=len(gs))
            if not within:
                n, t = _overlapping(s, e, w, gs, ge)
            out.append(pd.DataFrame({"gene": np.arange(len(gs)), "code": k, "n": m if within else n - m, "w": v if within else t - v}))
        if twice.any():
            out.append(_repeated(rows[twice], gs, ge, of, ga, gb, within))
        total = pd.concat(out) if out else pd.DataFrame({"gene": [], "code": [], "n": [], "w": []})
        total = total[total["n"] > 0]
        if twice.any():
            total = total.groupby(["gene", "code"], as_index=False).sum()
        code = pa.array(total["code"].to_numpy(np.int64))
        cols = [g["name"].take(pa.array(total["gene"].to_numpy(np.int64))), coded.dictionary.take(code), pa.array(total["n"].to_numpy(np.int64)), pa.array(total["w"].to_numpy(np.float64))]
        return pa.table(cols, names=["name", "exp", "n", "weight"])

    return left.groupBy("c", "cell").cogroup(right.groupBy("c", "cell")).applyInArrow(count, f"name {names.simpleString()}, exp {exps.simpleString()}, n long, weight double")


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, .. of ``n`` places each, one after the other."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


class _Side:
    """Genes in the order of their starts, with their exons one after the other."""

    def __init__(self, t: pa.Table, name: str):
        order = np.argsort(t["start"].to_numpy(), kind="stable")
        t = t.take(pa.array(order)).combine_chunks()
        self.names, self.start, self.end = t[name].combine_chunks(), t["start"].to_numpy(), t["end"].to_numpy()
        bs, be = t["bs"].combine_chunks(), t["be"].combine_chunks()
        self.s, self.e = bs.flatten().to_numpy(), be.flatten().to_numpy()
        self.off = np.concatenate([[0], np.cumsum(bs.value_lengths().to_numpy())]).astype(np.int64)
        self.of = np.repeat(np.arange(len(t)), np.diff(self.off))
        self.length = np.bincount(self.of, weights=self.e - self.s, minlength=len(t))

    def introns(self):
        """Offsets, starts and ends of the gaps between the exons of each gene."""
        same = self.of[1:] == self.of[:-1]
        return self.off - np.arange(len(self.off)), self.e[:-1][same], self.s[1:][same]


def _compatible(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, at_once: int) -> np.ndarray:
    """Whether the introns of both agree where the genes overlap."""
    inner_a, inner_b = a.introns(), b.introns()
    most = max(1, *(int(np.diff(x[0]).max(initial=0)) for x in (inner_a, inner_b)))
    out = np.ones(len(i), bool)
    for at in range(0, len(i), step := max(1, at_once // most)):
        p, q = i[at : at + step], j[at : at + step]
        low, high = np.maximum(a.start[p], b.start[q]), np.minimum(a.end[p], b.end[q])
        found = []
        for which, (off, s, e) in ((p, inner_a), (q, inner_b)):
            k = np.diff(off)[which]
            pair, x = np.repeat(np.arange(len(which)), k), _spread(off[which], k)
            ok = (s[x] < high[pair]) & (low[pair] < e[x])
            found.append((pair[ok], s[x[ok]], e[x[ok]]))
        (pa_, sa, ea), (pb, sb, eb) = found
        same = np.bincount(pa_, minlength=len(p)) == np.bincount(pb, minlength=len(p))
        x, y = same[pa_], same[pb]  # equally many in each such pair, so they lie side by side
        same[pa_[x][(sa[x] != sb[y]) | (ea[x] != eb[y])]] = False
        out[at : at + step] = same
    return out


def _met(a: _Side, b: _Side, first_a: int, last_a: int, first_b: int, at_once: int):
    """``i, j, exons, shared`` of the genes [first_a, last_a) of a and those from ``first_b`` of b that have another name and overlapping exons, in blocks of whole genes of a."""
    x0, y0 = a.off[first_a], b.off[first_b]
    sa, ea, own = a.s[x0 : a.off[last_a]], a.e[x0 : a.off[last_a]], a.of[x0 : a.off[last_a]] - first_a
    order = np.argsort(b.s[y0:], kind="stable")
    sb, eb, gb = b.s[y0:][order], b.e[y0:][order], b.of[y0:][order] - first_b
    if not len(sa) or not len(sb):
        return
    reach = np.maximum.accumulate(eb)
    plain = bool((reach == eb).all())  # then all candidates overlap
    low = np.searchsorted(reach, sa, "right")
    n = np.maximum(np.searchsorted(sb, ea, "left") - low, 0)
    # an exon of a that is longer than the gap between two of a gene of b may overlap both, and an exon may be there twice: then distinct ones are counted
    by = np.lexsort((b.e[y0:], b.s[y0:], b.of[y0:]))
    near = b.of[y0:][by][1:] == b.of[y0:][by][:-1]
    gap = (b.s[y0:][by][1:] - b.e[y0:][by][:-1])[near].min(initial=1 << 60)
    ids = np.lexsort((ea, sa, own))
    fresh = np.concatenate([[True], (np.diff(own[ids]) != 0) | (np.diff(sa[ids]) != 0) | (np.diff(ea[ids]) != 0)])
    distinct = np.empty(len(ids), np.int64)
    distinct[ids] = np.cumsum(fresh) - 1
    once = bool(fresh.all()) and max(0, (ea - sa).max()) <= gap
    # the genes of b that may overlap a gene of a lie in [lo, hi)
    starts_b, genes = b.start[first_b:], np.arange(last_a - first_a)
    lo = np.searchsorted(np.maximum.accumulate(b.end[first_b:]), a.start[first_a:last_a], "right")
    wide = np.maximum(np.searchsorted(starts_b, a.end[first_a:last_a], "left") - lo, 0)
    code = pa.chunked_array([a.names.slice(first_a, last_a - first_a), b.names.slice(first_b)]).dictionary_encode().combine_chunks().indices.to_numpy()
    code_a, code_b = code[: len(genes)], code[len(genes) :]
    named = np.argsort(code_b, kind="stable")
    namesake = np.searchsorted(code_b[named], code_a, "left"), np.searchsorted(code_b[named], code_a, "right")
    off = a.off[first_a : last_a + 1] - x0
    upto = np.cumsum(np.bincount(own, weights=n, minlength=len(genes)).astype(np.int64) + wide)
    first = 0
    while first < len(genes):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + at_once, "right")))
        f, e, w = off[first], off[last], wide[first:last]
        base = np.cumsum(w) - w - lo[first:last]
        k = n[f:e]
        at = _spread(low[f:e], k)
        shared = np.minimum(np.repeat(ea[f:e], k), eb[at]) - np.maximum(np.repeat(sa[f:e], k), sb[at])
        key = np.repeat(base[own[f:e] - first], k) + gb[at]
        if not plain:
            ok = eb[at] > np.repeat(sa[f:e], k)
            shared, key = shared[ok], key[ok]
        size = int(w.sum())
        count = np.bincount(key, minlength=size)
        if not once:
            d = np.repeat(distinct[f:e], k)
            d, many = (d if plain else d[ok]), int(distinct.max()) + 1
            count = np.bincount(np.unique(key * many + d) // many, minlength=size)
        same = namesake[1][first:last] - namesake[0][first:last]
        j = named[_spread(namesake[0][first:last], same)]
        i = np.repeat(np.arange(first, last), same)
        ok = (lo[i] <= j) & (j < lo[i] + wide[i])
        count[base[i[ok] - first] + j[ok]] = 0
        hit = np.flatnonzero(count)
        if len(hit):
            total = np.bincount(key, weights=shared, minlength=size)[hit].astype(np.int64)
            per = np.diff(np.searchsorted(hit, np.concatenate([[0], np.cumsum(w)])))
            yield np.repeat(np.arange(first, last) + first_a, per), hit - np.repeat(base, per) + first_b, count[hit], total
        first = last


def exon_pairs(a: DataFrame, b: DataFrame, width: int, keys: tuple[str, ...], compatible: bool) -> DataFrame:
    """``a, b, exons, shared, share`` and, if asked for, ``compatible`` as in ``genes.exon_overlaps``.

    Genes are dealt to all stretches that they touch, and two are met in the stretch of the later start only, where all their exons are:
    a pair is made whole in one task, with no exchange after it. The same frame as both sides is dealt once.
    """
    size = width * STRETCH
    kinds = [d.schema["name"].dataType.simpleString() for d in (a, b)]

    def side(d: DataFrame, n: str) -> DataFrame:
        known = " AND ".join(f"{k} IS NOT NULL" for k in ("name", *keys))
        x = F.filter("blocks", lambda x: x["start"].isNotNull() & x["end"].isNotNull())
        rows = d.where(known).select(F.col("name").alias(n), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.transform(x, lambda x: x["start"].cast("long")).alias("bs"), F.transform(x, lambda x: x["end"].cast("long")).alias("be")).where("size(bs) > 0")
        rows = rows.withColumns({"start": F.array_min("bs"), "end": F.array_max("be")})
        cell = lambda c: F.floor(c / F.lit(size)).cast("long")
        return rows.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.greatest("start", F.col("end") - 1)))))

    both, at_once = a is b, MET
    dealt = side(a, "a") if both else side(a, "a").unionByName(side(b, "b"), allowMissingColumns=True)
    columns = ["a", "b", "exons", "shared", "share", *["compatible"] * compatible]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        x = _Side(t.filter(pc.is_valid(t["a"])), "a")
        y = x if both else _Side(t.filter(pc.is_valid(t["b"])), "b")
        at = t["cell"][0].as_py() * size
        # two that begin before the stretch are met in an earlier one
        early = [int(np.searchsorted(d.start, at, "left")) for d in (x, y)]
        for first, last, from_b in ((0, early[0], early[1]), (early[0], len(x.start), 0)):
            for i, j, exons, shared in _met(x, y, first, last, from_b, at_once):
                length = x.length[i]
                cols = [x.names.take(pa.array(i)), y.names.take(pa.array(j)), pa.array(exons), pa.array(shared), pa.array(shared / np.where(length == 0, 1, length), mask=length == 0)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(_compatible(x, y, i, j, at_once))] * compatible, names=columns)

    kind = f"a {kinds[0]}, b {kinds[1]}, exons long, shared long, share double" + ", compatible boolean" * compatible
    return dealt.groupBy(*[f"k{i}" for i in range(len(keys))], "cell").applyInArrow(meet, kind)
