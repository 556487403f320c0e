"""URL filters: pattern rules indexed by their rarest literal token.

A rule's regular expression runs only on URLs that hold the rule's index token as a whole token.
All of it is DataFrame functions; the rules themselves are a small driver-side list.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules the token index is a literal in the plan; above, it is a table and is joined.
MAX_INLINE_RULES = 2_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """One pattern rule.

    name: what a result reports; regex: Java/RE2 syntax, run on `subject`; tokens: lower-case
    literal tokens that every matching URL holds between separators (none: the rule runs on all
    URLs); subject: "site" (lower-cased host, then path) or "url" (all after `://`, lower-cased);
    fixed: a host rule whose verdict goes before the patterns'.
    """

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    subject: str
    fixed: bool


def host_rule(verdict: str, rule: str) -> Rule:
    """Make a rule of `host/path`: it fits the host, all its subdomains, and paths that start so."""
    host, slash, path = rule.partition("/")
    path = slash + path
    # The last token of the path may go on in the URL, so it cannot serve as a whole token.
    tokens = re.findall(_TOKEN, host) + re.findall(rf"{_TOKEN}(?=[^a-z0-9])", path.lower())
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), "site", True)


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """Make a rule of a pattern: `^` is a separator or an end, `*` any text, all else literal."""
    regex = "".join({"^": "(?:^|[^a-z0-9]|$)", "*": ".*"}.get(c, re.escape(c)) for c in pattern.lower())
    tokens = re.findall(rf"(?<=[^a-z0-9*]){_TOKEN}(?=[^a-z0-9*])", pattern.lower())
    return Rule(pattern, verdict, regex, tuple(tokens), "url", False)


#: The host rules of the query contract.
CONTRACT_RULES = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)

#: Pattern rules for sites that a text corpus leaves out.
PATTERN_RULES = tuple(
    pattern_rule("block", p)
    for p in (
        "^ads^", "^adserver^", "^banner^", "^bets^", "^betting^", "^casino^", "^cheap^*^pills^", "^click^track^",
        "^doorway^", "^escort^", "^linkfarm^", "^pills^", "^poker^", "^porn^", "^spam^", "^torrent^", "^warez^", "^xxx^",
    )
)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Return (rest, host, path): all after the first `://`, the lower-cased host, the path; empty where null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return rest, host, path


def token_counts(tokens: DataFrame, wanted: set[str]) -> dict[str, int]:
    """Count the URLs that hold each wanted token. tokens: one array column `_tokens`; the result has a row per rule token at most."""
    rows = (
        tokens.select(F.explode(F.array_intersect("_tokens", F.array(*[F.lit(t) for t in sorted(wanted)]))).alias("_token"))
        .groupBy("_token")
        .count()
        .collect()
    )
    return {r["_token"]: r["count"] for r in rows}


def build_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Put each rule under its rarest token. Return token -> rule numbers, and the rules without a token."""
    index: dict[str, list[int]] = {}
    always: list[int] = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def _rule_column(i: int, rule: Rule) -> Column:
    return F.struct(
        F.lit(i).alias("i"), F.lit(rule.regex).alias("regex"), F.lit(rule.subject == "site").alias("site"),
        F.lit(rule.fixed).alias("fixed"), F.lit(len(rule.name)).alias("length"), F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"),
    )


def judge_urls(df: DataFrame, rules: list[Rule], url_col: str = "url", max_inline_rules: int = MAX_INLINE_RULES) -> DataFrame:
    """Add host, path, rule and verdict to every row of df.

    The longest fitting host rule decides; without one, the URL is blocked if a "block" pattern
    matches and no "allow" pattern does. Null URLs, empty ones and those without `://` have an empty
    host and path, no rule and the verdict allow. Columns of df named like the results are replaced;
    all others, repeated rows too, are kept. An empty table gives an empty table.
    """
    out = {"host", "path", "rule", "verdict", "_rest", "_tokens", "_hits", "_best"} - {url_col}
    df = df.drop(*[c for c in df.columns if c.lower() in out])
    rest, host, path = url_parts(F.col(url_col))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(rest), F.lit(f"({_TOKEN})"), F.lit(1)))
    wanted = {t for r in rules for t in r.tokens}
    counts = token_counts(df.select(tokens.alias("_tokens")), wanted) if wanted else {}
    index, always = build_index(rules, counts)
    df = df.withColumns({"_rest": rest, "host": host, "path": path, "_tokens": tokens})
    empty = F.array(_rule_column(0, rules[0])) if rules else None
    if not rules:
        hits = None
    elif len(rules) <= max_inline_rules:
        table = F.create_map(*[x for t, ids in sorted(index.items()) for x in (F.lit(t), F.array(*[_rule_column(i, rules[i]) for i in ids]))]) if index else None
        found = F.flatten(F.transform(F.array_intersect("_tokens", F.array(*[F.lit(t) for t in sorted(index)])), lambda t: F.try_element_at(table, t))) if index else F.slice(empty, 1, 0)
        if always:
            found = F.concat(found, F.array(*[_rule_column(i, rules[i]) for i in always]))
        hits = _run(found)
    else:
        df = _joined(df, rules, index, always, url_col)
        hits = F.coalesce(F.col("_hits"), F.slice(empty, 1, 0))
    if hits is None:
        return df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")}).drop("_rest", "_tokens")
    df = df.withColumn("_hits", hits)
    best = F.array_max(F.transform(F.filter("_hits", lambda h: h["fixed"]), lambda h: F.struct(h["length"].alias("length"), h["name"].alias("name"), h["verdict"].alias("verdict"))))
    blocked = F.exists("_hits", lambda h: ~h["fixed"] & (h["verdict"] == "block")) & ~F.exists("_hits", lambda h: ~h["fixed"] & (h["verdict"] == "allow"))
    df = df.withColumn("_best", best)
    return df.withColumns(
        {"rule": F.col("_best.name"), "verdict": F.coalesce("_best.verdict", F.when(blocked, "block").otherwise("allow"))}
    ).drop("_rest", "_tokens", "_hits", "_best")


def _run(found: Column) -> Column:
    return F.filter(found, lambda r: F.rlike(F.when(r["site"], F.concat("host", "path")).otherwise(F.lower("_rest")), r["regex"]))


def _joined(df: DataFrame, rules: list[Rule], index: dict[str, list[int]], always: list[int], url_col: str) -> DataFrame:
    """Fetch candidate rules by a join on the token, for rule lists too long for the plan; one lookup per distinct URL."""
    spark = df.sparkSession
    rows = [(t, i, r.regex, r.subject == "site", r.fixed, len(r.name), r.name, r.verdict) for t, ids in index.items() for i in ids for r in [rules[i]]]
    schema = "_token string, i int, regex string, site boolean, fixed boolean, length int, name string, verdict string"
    table = spark.createDataFrame(rows, schema)
    urls = df.select(F.col(url_col).alias("_url"), "_rest", "host", "path", "_tokens").distinct()
    pairs = urls.withColumn("_token", F.explode("_tokens")).drop("_tokens").join(table, "_token")
    pairs = pairs.where(F.rlike(F.when(F.col("site"), F.concat("host", "path")).otherwise(F.lower("_rest")), F.col("regex")))
    rule = F.struct("i", "regex", "site", "fixed", "length", "name", "verdict")
    hits = pairs.groupBy("_url").agg(F.collect_set(rule).alias("_hits"))
    out = df.join(hits, df[url_col].eqNullSafe(hits["_url"]), "left").drop("_url")
    if always:
        rest = _run(F.array(*[_rule_column(i, rules[i]) for i in always]))
        out = out.withColumn("_hits", F.concat(F.coalesce("_hits", F.slice(rest, 1, 0)), rest))
    return out


def op5_url_filter(pages: DataFrame) -> DataFrame:
    """Judge every page's URL by the contract's host rules and the library's patterns."""
    judged = judge_urls(pages.select("page_id", "url"), [*CONTRACT_RULES, *PATTERN_RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _sql_rules() -> str:
    rows = ", ".join(f"('{r.name}', '{r.verdict}', '{r.regex}', {str(r.fixed).lower()})" for r in [*CONTRACT_RULES, *PATTERN_RULES])
    return f"(VALUES {rows}) AS t(name, verdict, regex, fixed)"


ORACLE_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
                  row_number() OVER () AS row_id FROM pages),
p AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
fits AS (SELECT p.row_id, t.name, t.verdict,
                row_number() OVER (PARTITION BY p.row_id ORDER BY length(t.name) DESC) AS nr
         FROM p JOIN {_sql_rules()} ON t.fixed AND regexp_matches(p.host || p.path, t.regex)),
bad AS (SELECT DISTINCT p.row_id FROM p JOIN {_sql_rules()} ON NOT t.fixed AND regexp_matches(lower(p.rest), t.regex))
SELECT p.page_id, p.host, p.path, f.name AS rule,
       coalesce(f.verdict, CASE WHEN b.row_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN fits f ON f.row_id = p.row_id AND f.nr = 1 LEFT JOIN bad b ON b.row_id = p.row_id
"""
