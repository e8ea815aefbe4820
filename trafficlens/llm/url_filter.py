"""URL filter: pattern rules indexed by their rarest literal token.

A rule is kept under one of the whole tokens (``[a-z0-9]+``) that every URL it
fits must hold, the one that fewest URLs of the table hold.  A URL's tokens
fetch the rules kept under them, and only those rules' regular expressions are
run on it.  Rules without such a token are tried on every URL.

Up to ``MAX_INLINE_RULES`` rules the index is a literal inside the projection,
so a URL is judged where it is scanned, without any shuffle.  Longer lists go
through a join on the token (``judge_by_join``), which Spark splits when one
token is in a third of the URLs.  Both ways give the same rows.

Defined results: null URL or no ``://``: host and path are empty and no rule
fits; repeated rows are each judged; other columns pass through, except that
columns named like a result are replaced.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

MAX_INLINE_RULES = 1000
DEFAULT_VERDICT = "allow"
RESULT = ("host", "path", "rule", "pattern", "verdict")


class Rule(NamedTuple):
    name: str
    verdict: str
    regex: str  # searched in host + path
    tokens: tuple[str, ...]  # each is a whole token of every host + path that the rule fits
    site: bool  # a site rule goes before pattern rules


def _tokens(text: str, start_open: bool) -> tuple[str, ...]:
    """Tokens of a glob's literal text with a delimiter (not ``*``) on either side."""
    found = []
    for m in re.finditer(r"[a-z0-9]+", text.translate({u: u + 32 for u in range(65, 91)})):
        before = text[m.start() - 1] if m.start() else ("*" if start_open else ".")
        after = text[m.end()] if m.end() < len(text) else "*"
        if "*" not in (before, after):
            found.append(m[0])
    return tuple(dict.fromkeys(found))


def _glob(text: str) -> str:
    return "(?s:.*)".join(re.sub(r"([^A-Za-z0-9/])", r"\\\1", part) for part in text.split("*"))


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path`` (which starts with a slash)."""
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{_glob(host)}{_glob(path)}", _tokens(host + path, False), True)


def pattern_rule(verdict: str, glob: str) -> Rule:
    """Fits where ``glob`` (``*``: any text) is found anywhere in host + path."""
    return Rule(glob, verdict, _glob(glob), _tokens(glob, True), False)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _url_tokens(target: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(target), "[^a-z0-9]+"))


def rarest_tokens(parts: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """token -> rules kept under it; '' holds the rules without a token.

    The counts cover every URL; what reaches the driver is one number for each
    token of the rules.
    """
    literal = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if literal:
        wanted = F.array_intersect(_url_tokens(F.concat("__llm_host", "__llm_path")), F.array(*map(F.lit, literal)))
        counts = {t: n for t, n in parts.select(F.explode(wanted).alias("t")).groupBy("t").count().collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        key = min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else ""
        index.setdefault(key, []).append(r)
    return index


def _rule_struct(r: Rule) -> Column:
    return F.struct(F.lit(r.site).alias("site"), F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"),
                    F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"))


def _verdict_columns(best: Column) -> dict[str, Column]:
    return {"rule": F.when(best["site"], best["name"]), "pattern": F.when(~best["site"], best["name"]),
            "verdict": F.coalesce(best["verdict"], F.lit(DEFAULT_VERDICT))}


def _parts(urls: DataFrame, column: str) -> DataFrame:
    host, path = url_parts(F.col(column))
    return urls.withColumns({"__llm_host": host, "__llm_path": path})


def _finish(judged: DataFrame, urls: DataFrame) -> DataFrame:
    keep = [c for c in urls.columns if c.lower() not in RESULT]
    best = F.col("__llm_best")
    return judged.select(*keep, F.col("__llm_host").alias("host"), F.col("__llm_path").alias("path"),
                         *[c.alias(k) for k, c in _verdict_columns(best).items()])


def judge_urls(urls: DataFrame, rules: list[Rule], column: str = "url") -> DataFrame:
    """Columns host, path, rule, pattern, verdict beside those of ``urls``.

    The longest site rule that fits wins; without one the longest pattern
    rule; without any ``DEFAULT_VERDICT``.
    """
    if len(rules) > MAX_INLINE_RULES:
        return judge_by_join(urls, rules, column)
    parts = _parts(urls, column)
    if not rules:
        none = F.lit(None).cast("struct<site:boolean,size:int,name:string,verdict:string,regex:string>")
        return _finish(parts.withColumn("__llm_best", none), urls)
    index = rarest_tokens(parts, rules)
    always = index.pop("", [])
    table = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(_rule_struct, rs)))]) \
        if index else None
    empty = F.array_except(F.array(_rule_struct(rules[0])), F.array(_rule_struct(rules[0])))

    def best(target: Column) -> Column:
        fetched = [F.array(*map(_rule_struct, always))] if always else []
        if table is not None:
            kept = F.array(*[F.lit(t) for t in sorted(index)])
            hits = F.array_intersect(_url_tokens(target), kept)
            fetched.append(F.flatten(F.transform(hits, lambda t: table[t])))
        rules_of_url = F.concat(*fetched) if fetched else empty
        return F.array_max(F.filter(rules_of_url, lambda r: F.rlike(target, r["regex"])))

    return _finish(parts.withColumn("__llm_best", let(F.concat("__llm_host", "__llm_path"), best)), urls)


def judge_by_join(urls: DataFrame, rules: list[Rule], column: str = "url") -> DataFrame:
    """The same by a join of URL tokens with the index, for rule lists too long for a literal."""
    spark = urls.sparkSession
    parts = _parts(urls, column).withColumn("__llm_target", F.concat("__llm_host", "__llm_path"))
    index = rarest_tokens(parts, rules)
    rows = [(t, r.site, len(r.name), r.name, r.verdict, r.regex) for t, rs in index.items() for r in rs]
    table = spark.createDataFrame(rows, "token string, site boolean, size int, name string, verdict string, regex string")
    targets = parts.select(F.col("__llm_target").alias("target")).distinct()
    tokens = targets.select("target", F.explode(F.array_append(_url_tokens(F.col("target")), F.lit(""))).alias("token"))
    tokens = tokens.distinct()
    best = tokens.join(table, "token").where(F.rlike("target", F.col("regex"))) \
        .groupBy(F.col("target").alias("__llm_target")) \
        .agg(F.max(F.struct("site", "size", "name", "verdict", "regex")).alias("__llm_best"))
    return _finish(parts.join(best, "__llm_target", "left"), urls)
