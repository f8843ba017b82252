"""Plain versions of operators, written from their definitions without the operators' code."""

import math
import unicodedata
import zlib

import numpy as np


def without_repeated_lines(texts):
    """id -> (text left, lines removed) for texts in the order of their ids; None stays None.

    A passage is two neighbouring lines that aren't blank, with the blank lines between them. Every occurrence of a passage goes but the
    first and those of the same text that overlap the first. Blank lines after a removed line go with it; with nothing else left, all go.
    """
    first, out = {}, {}
    for i, text in sorted(texts.items()):
        if text is None:
            out[i] = None, 0
            continue
        lines = text.split("\n")
        solid = [k for k, line in enumerate(lines) if line.strip(" \t\r\x0b\x0c")]
        drop = set()
        for a, b in zip(solid, solid[1:], strict=False):
            passage = tuple(lines[a : b + 1])
            if passage not in first:
                first[passage] = i, a
            elif first[passage][0] != i or a > first[passage][1] + b - a:
                drop |= set(range(a, b + 1))
        for k, line in enumerate(lines):
            if not line.strip(" \t\r\x0b\x0c") and k - 1 in drop:
                drop.add(k)
        left = [line for k, line in enumerate(lines) if k not in drop]
        if not any(line.strip(" \t\r\x0b\x0c") for line in left):
            left = [] if drop or text == "" else left
        out[i] = "\n".join(left), len(lines) - len(left)
    return out


def gram_counts(text, dim=2048):
    """Unit vector of square roots of the counts of hashed 1- to 3-grams of letters within words; None without letters."""
    mask, counts = (1 << 32) - 1, [0] * dim
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split(" ")
    found = False
    for word in filter(None, words):
        found = True
        marked = "\0" + word + "\0"
        for n in (1, 2, 3):
            for k in range(len(marked) - n + 1):
                gram = [ord(c) for c in marked[k : k + n]]
                # a gram of one letter lies in the word; one of two starts in it; one of three has its middle in it
                if gram[{1: 0, 2: 0, 3: 1}[n]] == 0:
                    continue
                h = gram[0] * 0x9E3779B1 & mask
                if n > 1:
                    h = (h ^ (gram[1] * 0x85EBCA77 & mask)) * 0xC2B2AE3D & mask
                if n > 2:
                    h = (h ^ (gram[2] * 0x27D4EB2F & mask)) * 0x165667B1 & mask
                counts[(h ^ h >> 15) % dim] += 1
    if not found:
        return None
    length = math.sqrt(sum(counts))
    return np.array([math.sqrt(c) / length for c in counts])


def languages(rows, ridge=1e-3, margin=0.05, floor=0.05):
    """doc_id -> (language, score, ambiguous) for rows (doc_id, text, lang); learned where crc32 of the id leaves another rest than 1.

    Up to six languages, each with a codeword of the exhaustive code; ridge regressions by least squares; leave-one-out by refitting is
    replaced by its closed form; the loss of each language is added up bit by bit.
    """
    learned = {(lang, text) for i, text, lang in rows if lang is not None and text is not None and i is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    pairs = [(v.astype(np.float32).astype(np.float16).astype(float), lang) for lang, text in sorted(learned) if (v := gram_counts(text)) is not None]
    names = sorted({lang for _, lang in pairs})
    n = len(names)
    bits = [[1 if k == 0 else 1 - 2 * (b >> (k - 1) & 1) for k in range(n)] for b in range(1, 1 << (n - 1))]
    x = np.array([[*v, 1.0] for v, _ in pairs])
    models = []
    for bit in bits:
        y = np.array([bit[names.index(lang)] for _, lang in pairs], float)
        weight = math.sqrt(ridge * len(pairs))
        stacked = np.vstack([x, weight * np.eye(x.shape[1])])
        w = np.linalg.lstsq(stacked, np.concatenate([y, np.zeros(x.shape[1])]), rcond=None)[0]
        leverage = ((x @ np.linalg.inv(x.T @ x + weight**2 * np.eye(x.shape[1]))) * x).sum(1)
        held = y - (y - x @ w) / (1 - leverage)
        models.append((w, max(floor, 2 * float(np.mean(np.sign(held) == y)) - 1)))
    out = {}
    for i, text, _ in rows:
        v = gram_counts(text)
        if v is None:
            out[i] = "und", 0.0, True
            continue
        losses = []
        for k in range(n):
            loss = 0.0
            for bit, (w, trust) in zip(bits, models, strict=True):
                value = max(-1.5, min(1.5, float(v @ w[:-1] + w[-1])))
                loss += trust * max(0.0, 1 - bit[k] * value)
            losses.append(loss / sum(t for _, t in models))
        powers = [math.exp(-6 * (x - min(losses))) for x in losses]
        shares = sorted(((p / sum(powers), name) for p, name in zip(powers, names, strict=True)), key=lambda s: (-s[0], s[1]))
        out[i] = shares[0][1], shares[0][0], n > 1 and shares[0][0] - shares[1][0] < margin
    return out
