"""Column functions on sequences (strings), and Arrow functions for what needs dynamic programming."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgtUu", "TGCAtgcaAa")


def gc_content(seq: Column) -> Column:
    """Share of G and C, case aside; null for an empty sequence."""
    return F.try_divide(F.length(F.regexp_replace(seq, "[^GCgc]", "")), F.length(seq))


def with_letters(seq: Column, use) -> Column:
    """``use(letters)`` with the letters of a string split once: a place in an array is found at once, one in a string by counting up to it."""
    return F.transform(F.array(F.split(seq, "")), use)[0]


def piece(letters: Column, start: Column, size: int) -> Column:
    """``size`` letters from ``start`` (from 0) on as a string."""
    if size <= 32:
        return F.concat(*[F.get(letters, start + j) for j in range(size)])
    return F.array_join(F.slice(letters, start + 1, size), "")


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k, in order."""
    some = with_letters(seq, lambda c: F.transform(F.sequence(F.lit(0), F.length(seq) - k), lambda i: piece(c, i, k)))
    return F.when(F.length(seq) >= k, some).otherwise(F.array().cast("array<string>"))


def windows(seq: Column, size: int, step: int) -> Column:
    """Substrings of ``size`` at every ``step``; one that would end exactly at the end is left out."""
    starts = F.when(F.length(seq) > size, F.sequence(F.lit(0), F.length(seq) - size - 1, F.lit(step)))
    return with_letters(seq, lambda c: F.transform(starts, lambda i: F.struct(i.alias("start"), piece(c, i, size).alias("seq"))))


def soft_masked(seq: Column) -> Column:
    """Runs of lower-case letters."""
    return F.regexp_extract_all(seq, F.lit("[a-z]+"), F.lit(0))


def ungapped(seq: Column) -> Column:
    """Runs without N or gap characters."""
    return F.regexp_extract_all(seq, F.lit("[^Nn-]+"), F.lit(0))


def has_poly_a(seq: Column, least: int) -> Column:
    return seq.rlike(f"(A{{{least},}}$)|(^T{{{least},}})")


def trim_poly_a(seq: Column, least: int = 1) -> Column:
    """Without a run of at least ``least`` A at the end or T at the start."""
    return F.regexp_replace(F.regexp_replace(seq, f"A{{{least},}}$", ""), f"^T{{{least},}}", "")


def trim_linker(seq: Column, linker: str) -> Column:
    """What comes before the first occurrence of the linker."""
    at = F.locate(linker, seq)
    return F.when(at > 0, F.substring(seq, F.lit(1), at - 1)).otherwise(seq)


def motif_matches(seq: Column, pattern: str) -> Column:
    """Non-overlapping matches of a regular expression, upper-cased first."""
    return F.regexp_extract_all(F.upper(seq), F.lit(pattern), F.lit(0))


def cluster_pattern(cores: list[str], least: int, spacing: int) -> tuple[str, str]:
    """Patterns of ``least`` or more successive cores at most ``spacing`` apart: one with any of the cores at each place, and the strict
    one with some core repeated throughout."""
    any_core = "(?:" + "|".join(f"(?:{c})" for c in cores) + ")+"
    loose = f"(?:{any_core}.{{0,{spacing}}}){{{least - 1},}}{any_core}"
    strict = "|".join(f"(?:(?:{c}).{{0,{spacing}}}){{{least - 1},}}(?:{c})" for c in cores)
    return loose, strict


def motif_clusters(seq: Column, cores: list[str], least: int, spacing: int) -> Column:
    """Matches of the loose cluster pattern that hold the strict one."""
    loose, strict = cluster_pattern(cores, least, spacing)
    return F.filter(motif_matches(seq, loose), lambda m: m.rlike(strict))


def possible_kmers(pattern: str) -> int:
    """How many plain sequences a pattern of bases and bracketed choices stands for."""
    import re

    out = 1
    for choice, _ in re.findall(r"\[([ACGTacgt]+)\]|([ACGTNacgtn])", pattern):
        out *= len(set(choice.upper())) if choice else 1
    return out * 4 ** len(re.findall("[Nn]", pattern))


# position weight matrices: a list of columns, each with the probabilities of A, C, G, T


def information(pwm: list[list[float]]) -> list[float]:
    """Bits of each column against a uniform background."""
    return [2 + sum(p * float(np.log2(p)) for p in c if p > 0) for c in pwm]


def with_pseudocounts(pwm: list[list[float]], pseudo: float = 0.01) -> list[list[float]]:
    return [[(p + pseudo) / (sum(c) + 4 * pseudo) for p in c] for c in pwm]


def trim_by_information(pwm: list[list[float]], least: float) -> list[list[float]]:
    keep = [i for i, x in enumerate(information(pwm)) if x >= least]
    return pwm[keep[0] : keep[-1] + 1] if keep else []


def pwm_reverse_complement(pwm: list[list[float]]) -> list[list[float]]:
    return [c[::-1] for c in reversed(pwm)]


def consensus(pwm: list[list[float]]) -> str:
    return "".join("ACGT"[int(np.argmax(c))] for c in pwm)


def column_divergence(a: list[float], b: list[float]) -> float:
    """Kullback-Leibler divergence in bits."""
    return sum(p * float(np.log2(p / q)) for p, q in zip(a, b, strict=True) if p > 0)


def pwm_scores(seq: Column, pwm: list[list[float]], background: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)) -> Column:
    """Log2 likelihood ratio at each place where the matrix fits; other letters than A, C, G, T add 0."""
    logs = [[float(np.log2(p / q)) for p, q in zip(c, background, strict=True)] for c in with_pseudocounts(pwm)]
    width = len(logs)

    def at(letters: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for k, column in enumerate(logs):
            base = F.get(letters, i + k)
            part = F.lit(0.0)
            for letter, value in zip("TGCA", reversed(column), strict=True):
                part = F.when(base == letter, value).otherwise(part)
            total = total + part
        return total

    some = with_letters(F.upper(seq), lambda c: F.transform(F.sequence(F.lit(0), F.length(seq) - width), lambda i: at(c, i)))
    return F.when(F.length(seq) >= width, some).otherwise(F.array().cast("array<double>"))


ALIGNMENT = StructType([StructField("score", DoubleType()), StructField("a", StringType()), StructField("b", StringType()), StructField("start_a", IntegerType()), StructField("start_b", IntegerType()), StructField("identical", IntegerType()), StructField("gaps", IntegerType())])
NONE, DIAGONAL, LEFT, UP = 0, 1, 2, 3


def align(a: str, b: str, match: float = 1.0, mismatch: float = -1.0, open_gap: float = 2.0, extend: float = 0.5, local: bool = True) -> tuple:
    """Alignment with affine gaps (a gap of n costs open + (n-1) * extend): local, or global. N matches everything.

    Returns score, aligned strings, starts (from 0), identical places and gap places.
    """
    return align_all([(a, b)], match, mismatch, open_gap, extend, local)[0]


#: Cells of score matrices that are laid out at a time.
BATCH_CELLS = 4_000_000


def align_all(pairs: list[tuple[str, str]], match: float = 1.0, mismatch: float = -1.0, open_gap: float = 2.0, extend: float = 0.5, local: bool = True) -> list[tuple]:
    """``align`` of many pairs: their matrices are filled together, row by row, and each is traced back by itself."""
    out: list[tuple] = [()] * len(pairs)
    held: list[int] = []
    cells = 0
    for i in sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1]))):
        size = (len(pairs[i][0]) + 1) * (len(pairs[i][1]) + 1)
        if held and (len(held) + 1) * max(size, cells) > BATCH_CELLS:
            for k, x in zip(held, _align_batch([pairs[k] for k in held], match, mismatch, open_gap, extend, local), strict=True):
                out[k] = x
            held, cells = [], 0
        held.append(i)
        cells = max(cells, size)
    for k, x in zip(held, _align_batch([pairs[k] for k in held], match, mismatch, open_gap, extend, local) if held else [], strict=True):
        out[k] = x
    return out


def _align_batch(pairs: list[tuple[str, str]], match: float, mismatch: float, open_gap: float, extend: float, local: bool) -> list[tuple]:
    if open_gap < extend:
        raise ValueError("opening a gap must cost as much as making one longer, at least")
    many, n, m = len(pairs), max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    code = lambda s, size, pad: np.array([ord(c) for c in s] + [pad] * (size - len(s)), np.int32)
    x, y = np.array([code(a, n, -1) for a, _ in pairs]).reshape(many, n), np.array([code(b, m, -2) for _, b in pairs]).reshape(many, m)
    any_x, any_y = np.isin(x, (78, 110)), np.isin(y, (78, 110))
    low, step = -1e18, np.arange(m + 1) * extend
    h, e, f = (np.full((many, n + 1, m + 1), low) for _ in range(3))
    if local:
        h[:, 0, :], h[:, :, 0] = 0.0, 0.0
    else:
        h[:, 0, 0] = 0.0
        h[:, 0, 1:] = e[:, 0, 1:] = -open_gap - step[:m]
        h[:, 1:, 0] = f[:, 1:, 0] = -open_gap - np.arange(n) * extend
    for i in range(1, n + 1):
        gain = np.where((x[:, i - 1, None] == y) | any_x[:, i - 1, None] | any_y, match, mismatch)
        f[:, i, 1:] = np.maximum(h[:, i - 1, 1:] - open_gap, f[:, i - 1, 1:] - extend)
        best = np.maximum(h[:, i - 1, :-1] + gain, f[:, i, 1:])
        if local:
            best = np.maximum(best, 0.0)
        # a gap from each place to the left at once: opening a gap right after one is never better
        from_left = np.concatenate([h[:, i, :1], best], axis=1) + step
        e[:, i, 1:] = np.maximum.accumulate(from_left, axis=1)[:, :-1] - step[:-1] - open_gap
        h[:, i, 1:] = np.maximum(best, e[:, i, 1:])
        if local:  # what rounding leaves of nothing
            h[:, i] = np.where(h[:, i] < 1e-9, 0.0, h[:, i])
    return [_trace(a, b, h[k], e[k], f[k], match, mismatch, open_gap, local) for k, (a, b) in enumerate(pairs)]


def _trace(a: str, b: str, h: np.ndarray, e: np.ndarray, f: np.ndarray, match: float, mismatch: float, open_gap: float, local: bool) -> tuple:
    """The alignment of one pair, from its score matrices back: the diagonal first, then a gap in ``a``, then one in ``b``."""
    n, m = len(a), len(b)
    h, e, f = h[: n + 1, : m + 1], e[: n + 1, : m + 1], f[: n + 1, : m + 1]
    same = lambda x, y: x == y or x in "Nn" or y in "Nn"
    close = lambda p, q: abs(p - q) < 1e-6
    i, j = (int(x) for x in np.unravel_index(int(h.argmax()), h.shape)) if local else (n, m)
    score, out_a, out_b, state = float(h[i, j]), [], [], DIAGONAL
    while (i > 0 or j > 0) and not (local and state == DIAGONAL and h[i, j] == 0):
        if state == DIAGONAL:
            if i > 0 and j > 0 and close(h[i, j], h[i - 1, j - 1] + (match if same(a[i - 1], b[j - 1]) else mismatch)):
                i, j = i - 1, j - 1
                out_a.append(a[i])
                out_b.append(b[j])
            else:
                state = LEFT if close(h[i, j], e[i, j]) else UP
        elif state == LEFT:
            if close(e[i, j], h[i, j - 1] - open_gap) or j == 1:
                state = DIAGONAL
            j -= 1
            out_a.append("-")
            out_b.append(b[j])
        else:
            if close(f[i, j], h[i - 1, j] - open_gap) or i == 1:
                state = DIAGONAL
            i -= 1
            out_a.append(a[i])
            out_b.append("-")
    x, y = "".join(reversed(out_a)), "".join(reversed(out_b))
    return score, x, y, i, j, sum(p == q for p, q in zip(x, y, strict=True)), x.count("-") + y.count("-")


def aligner(local: bool = True, **costs: float):
    """A column function of two strings that gives an ``ALIGNMENT`` struct; null if one is null. Equal pairs in a batch are aligned once."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        wanted = list(dict.fromkeys((x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None))
        known = dict(zip(wanted, align_all(wanted, local=local, **costs), strict=True))
        rows = [known.get((x, y), (None,) * 7) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=ALIGNMENT.names)

    return F.pandas_udf(run, ALIGNMENT)


def markup(a: str, b: str) -> str:
    """One sign a column of an alignment: ``|`` identical, ``.`` different, blank for a gap."""
    return "".join(" " if "-" in (x, y) else "|" if x == y else "." for x, y in zip(a, b, strict=True))


def render_pair(name_a: str, name_b: str, a: str, b: str, start_a: int = 0, start_b: int = 0, width: int = 50) -> str:
    """Blocks of two aligned lines with names (13 wide), positions (6 wide) and the markup between them."""
    out, pa_, pb = [], start_a, start_b
    for k in range(0, len(a), width):
        x, y = a[k : k + width], b[k : k + width]
        ends = pa_ + sum(c != "-" for c in x), pb + sum(c != "-" for c in y)
        out.append(f"{name_a[:13]:<13} {pa_ + 1:>6} {x} {ends[0]:>6}\n{'':<20} {markup(x, y)}\n{name_b[:13]:<13} {pb + 1:>6} {y} {ends[1]:>6}\n")
        pa_, pb = ends
    return "\n".join(out)


def render_fasta(name: str, seq: str, width: int = 60) -> str:
    return f">{name}\n" + "".join(seq[i : i + width] + "\n" for i in range(0, len(seq), width))


def render_clustal(names: list[str], seqs: list[str], width: int = 50) -> str:
    """CLUSTAL blocks with names 36 wide."""
    out = ["CLUSTAL multiple sequence alignment\n"]
    for i in range(0, max(map(len, seqs), default=0), width):
        out.append("\n" + "".join(f"{n[:36]:<36}{s[i : i + width]}\n" for n, s in zip(names, seqs, strict=True)))
    return "".join(out)


RENDERERS = {"pair": render_pair, "fasta": render_fasta, "clustal": render_clustal}
