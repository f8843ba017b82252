"""URL filters: pattern rules behind an index on each rule's rarest literal token.

Every rule names literal tokens that each url it fits must hold. How many urls hold each of these tokens is counted over the whole
table; the rule is filed under its rarest one. A url's own tokens then fetch the candidate rules, and only those run their regular
expressions. Of the rules that fit, the one of the highest ``weight`` wins, ties going to the earlier rule.

Defined results: a null url, or one without ``://``, has an empty host and an empty path and is judged like any other; repeated
rows give repeated results; an empty table gives an empty result; columns not named in ``keep`` are left out. Any number of rules
is served: rules are shipped in blocks of bounded size, one pass each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIDE_DATA_LIMIT, bound_batches, check_side_data, materialize

TOKEN = re.compile("[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``literals`` are tokens that every fitting url holds (none: always a candidate)."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    weight: int
    listed: bool = True


def host_rule(verdict: str, rule: str) -> Rule:
    """A rule like ``example.org/es/``: for the host and its subdomains, if the path starts with the rule's; the longer, the stronger."""
    host, slash, rest = rule.partition("/")
    whole = TOKEN.findall(host)
    if slash:  # the path's last token may go on in a url, so it is no literal
        whole += TOKEN.findall(rest[: max((i + 1 for i, c in enumerate(rest) if not TOKEN.match(c)), default=0)])
    end = re.escape(slash + rest) if slash else r"(?=/|\Z)"
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{end}", tuple(whole), 1_000 + len(rule))


def pattern_rule(verdict: str, pattern: str, *literals: str) -> Rule:
    """A rule of the filter's own, weaker than every host rule; ``$`` is the very end, not a place before a last line feed."""
    return Rule(pattern, verdict, pattern.replace("$", r"\Z"), literals, 0, listed=False)


#: Patterns of the filter's own: what hardly ever holds prose.
PATTERNS = [
    pattern_rule("block", r"(?:^|\.)ads\.", "ads"),
    pattern_rule("block", r"/login(?:/|$)", "login"),
    pattern_rule("block", r"/cart(?:/|$)", "cart"),
    pattern_rule("block", r"\.exe$", "exe"),
    pattern_rule("block", r"\.zip$", "zip"),
]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), slash + path


def rule_blocks(rules: list[Rule], limit: int) -> Iterator[list[tuple[int, Rule]]]:
    held, size = [], 0
    for i, rule in enumerate(rules):
        own = 64 + len(rule.pattern) + len(rule.name) + sum(map(len, rule.literals))
        if held and size + own > limit:
            yield held
            held, size = [], 0
        held.append((i, rule))
        size += own
    yield held


def token_counts(urls: DataFrame, wanted: set[str]) -> dict[str, int]:
    """Urls that hold each of the rules' tokens; the rules lie on the driver, and so does one number a token."""
    if not wanted:
        return {}
    tokens = urls.select(F.explode(F.array_distinct(F.expr("regexp_extract_all(url, '[A-Za-z0-9]+', 0)"))).alias("token"))
    tokens = tokens.select(F.explode(F.array_distinct(F.array(F.col("token"), F.lower("token")))).alias("token"))
    table = urls.sparkSession.createDataFrame([(t,) for t in sorted(wanted)], "token string")
    size = sum(map(len, wanted)) + 16 * len(wanted)
    table = F.broadcast(table) if size < SIDE_DATA_LIMIT // 8 else table
    return {r["token"]: r["n"] for r in tokens.join(table, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")).collect()}


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", keep: list[str] | None = None, default: str = "allow", limit: int = SIDE_DATA_LIMIT // 8) -> DataFrame:
    """Columns ``keep`` and ``host, path, rule, pattern, verdict`` for every row: ``rule`` the listed rule that won, ``pattern`` the filter's own.

    A block of rules, with the counts of its own tokens, takes about ``limit`` bytes; if there are several, each is a pass of its own
    that starts from what the one before it has written.
    """
    bound_batches(df)
    keep = keep or []
    chosen = df.select(*[F.col(c) for c in keep], F.col(url).cast("string").alias("url"))
    counts = token_counts(chosen.select("url"), {t for r in rules for t in r.literals})
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    schema = f"{kept}{', ' if kept else ''}host string, path string, rule string, pattern string, verdict string, weight long"
    out, blocks = None, list(rule_blocks(rules, limit))
    for k, block in enumerate(blocks):
        own = {t: counts[t] for _, r in block for t in r.literals if t in counts}
        check_side_data(sum(64 + len(r.pattern) + len(r.name) + 40 * len(r.literals) for _, r in block), "a block of rules")
        source = chosen if out is None else out.withColumn("url", F.concat(F.lit("x://"), "host", "path"))
        out = _judge(source, block, own, len(keep), schema, default, first=out is None)
        if k + 1 < len(blocks):  # the plan must not gather the blocks
            out = materialize(out, "urls-block")
    return out.drop("weight")


def _judge(chosen: DataFrame, block: list[tuple[int, Rule]], counts: dict[str, int], n_keep: int, schema: str, default: str, *, first: bool) -> DataFrame:
    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str | None, list[tuple[int, Rule, re.Pattern]]] = defaultdict(list)
        for i, rule in block:
            rarest = min(rule.literals, key=lambda t: (counts.get(t, 0), t), default=None)
            index[rarest].append((i, rule, re.compile(rule.pattern)))
        always = index.pop(None, [])
        for batch in parts:
            rows = []
            before = batch.select(["rule", "pattern", "verdict", "weight"]).to_pylist() if not first else [None] * batch.num_rows
            for at, (url, had) in enumerate(zip(batch.column(batch.schema.get_field_index("url")).to_pylist(), before, strict=True)):
                host, path = split_url(url) if first else (batch.column("host")[at].as_py(), batch.column("path")[at].as_py())
                whole = host + path
                found = always + [x for t in set(TOKEN.findall(whole)) & index.keys() for x in index[t]]
                fits = [(-r.weight, i, r) for i, r, p in found if p.search(whole)]
                best = min(fits, default=None, key=lambda x: x[:2])
                if had and (not best or had["weight"] >= best[2].weight):
                    rows.append((host, path, had["rule"], had["pattern"], had["verdict"], had["weight"]))
                elif best:
                    r = best[2]
                    rows.append((host, path, r.name if r.listed else None, None if r.listed else r.name, r.verdict, r.weight))
                else:
                    rows.append((host, path, None, None, default, -1))
            made = [pa.array([r[k] for r in rows], pa.int64() if k == 5 else pa.string()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *made], names=[*batch.schema.names[:n_keep], "host", "path", "rule", "pattern", "verdict", "weight"])

    return chosen.mapInArrow(task, schema)
