"""URL filters: pattern rules indexed by their rarest literal token.

Rules are globs over the lower-cased URL: `||host` anchors at a host or subdomain,
`|` at either end, `*` stands for anything, `^` for a separator or the end. A token is
a run of letters and digits that the rule fixes at both ends, so a URL that fits the
rule holds it as a whole token. Each rule is filed under the one of its tokens that
fewest URLs hold; a URL's tokens fetch candidate rules, and only those run.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_clear, materialise, read, shared_dir, spare

#: (verdict, host and path prefix). A rule fits its host and subdomains; the longest wins.
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: (verdict, glob). Allowing rules are exceptions to blocking ones.
PATTERN_RULES = [
    ("block", "?utm_source=feed"),
    ("block", "?page=*&ref="),
    ("block", "||blog.*.example.org^es^"),
    ("block", "||m.*.example.com^fr^*.html|"),
    ("block", "^ads^"),
    ("block", "^tracker^"),
    ("block", "/click?"),
    ("block", "||doubleclick.net^"),
    ("block", ".php?id="),
    ("block", "|http://www.*^es^*#top|"),
    ("allow", "||www.*.example.com^en^"),
    ("allow", "||blog.*.example.org^fr^"),
    ("allow", "^robots.txt|"),
]
_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Up to this many rules (about 20 MB) travel with the tasks; more are a table that tokens are joined with.
MAX_RULES = 100_000


def rule_regex(glob: str, end: str = r"\Z") -> str:
    """The rule, in any case, as a regular expression over a lower-cased URL; `end` stands for the very end, after a last line feed too."""
    body, head, tail = glob.translate(_TO_LOWER), "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^[^:/?#]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], end
    parts = {"*": ".*", "^": f"(?:[^a-z0-9_.%-]|{end})"}
    return "(?s)" + head + "".join(parts.get(c) or (c if c.isalnum() or c == "_" else "\\" + c) for c in body) + tail


def rule_tokens(glob: str) -> list[str]:
    """Tokens that every fitting URL holds whole: both neighbours are fixed by the rule."""
    anchored_start, anchored_end = glob.startswith("|"), glob.endswith("|")
    body = glob.translate(_TO_LOWER).strip("|")
    out = []
    for m in re.finditer(r"[a-z0-9]+", body):
        left = anchored_start if m.start() == 0 else body[m.start() - 1] != "*"
        right = anchored_end if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            out.append(m[0])
    return out


def url_tokens(url: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the URL, A-Z lower-cased."""
    return F.array_distinct(F.array_remove(F.split(_lower(url), "[^a-z0-9]+"), ""))


def _lower(url: Column) -> Column:
    return F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """Number of URLs that hold each of the rules' tokens; all URLs are counted."""
    named = F.explode(F.array_intersect(url_tokens(F.col("url")), F.array(*[F.lit(t) for t in tokens]).cast("array<string>")))
    counted = urls.select(named.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}  # at most one row per token of a rule


def build_index(rules: list[tuple[str, str]], counts: dict[str, int]) -> tuple[dict[str, list[tuple[str, str]]], list[tuple[str, str]]]:
    """Token -> [(verdict, regex)], and the rules without a token, which every URL runs."""
    index, always = {}, []
    for verdict, glob in rules:
        tokens = rule_tokens(glob)
        entry = (verdict, rule_regex(glob))
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
        else:
            always.append(entry)
    return index, always


def pattern_verdict(url: Column, rules: list[tuple[str, str]], counts: dict[str, int]) -> Column:
    """allow or block, by the pattern rules alone; without a fitting rule: allow."""
    index, always = build_index(rules, counts)

    @F.arrow_udf("string")
    def verdict(urls: pa.Array) -> pa.Array:
        ready = {t: [(v, re.compile(x)) for v, x in entries] for t, entries in index.items()}
        rest = [(v, re.compile(x)) for v, x in always]
        find, out = re.compile("[a-z0-9]+").findall, []
        for u in urls.to_pylist():
            fits = {v for t in {*find(u)} & ready.keys() for v, x in ready[t] if x.search(u)} | {v for v, x in rest if x.search(u)}
            out.append("block" if fits == {"block"} else "allow")
        return pa.array(out, pa.string())

    return verdict(_lower(url))


def fits(urls: Column, regexes: Column) -> Column:
    """Whether each URL holds a match of the regular expression beside it."""

    @F.arrow_udf("boolean")
    def of(urls: pa.Array, regexes: pa.Array) -> pa.Array:
        ready: dict[str, re.Pattern] = {}
        out = []
        for u, x in zip(urls.to_pylist(), regexes.to_pylist(), strict=True):
            if x not in ready:
                ready[x] = re.compile(x)
            out.append(ready[x].search(u) is not None)
        return pa.array(out, pa.bool_())

    return of(urls, regexes)


def table_verdicts(urls: DataFrame, rules: DataFrame, block: int | None = None) -> DataFrame:
    """(u, verdict) of each URL of `urls` (distinct u, lower-cased) that a rule of `rules` (verdict, glob) fits; any number of rules.

    URL tokens are joined with the rules' rarest tokens; a rule whose rarest token no
    URL holds is left out. Rules without a token run on all URLs, `block` (MAX_RULES) at a time.
    """
    tokens = F.arrow_udf(lambda globs: pa.array([rule_tokens(g) for g in globs.to_pylist()], pa.list_(pa.string())), "array<string>")
    regexes = F.arrow_udf(lambda globs: pa.array([rule_regex(g) for g in globs.to_pylist()], pa.string()), "string")
    rules = rules.select("verdict", "glob").where("glob is not null").distinct()
    rules = materialise(rules.select("verdict", regexes("glob").alias("regex"), tokens("glob").alias("tokens"), F.monotonically_increasing_id().alias("id")), "url-rules")
    held = urls.select("u", F.explode(url_tokens(F.col("u"))).alias("token"))
    named = rules.select("id", F.explode("tokens").alias("token"))
    counts = materialise(held.join(named.select("token").distinct().hint("merge"), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")), "url-tokens")
    absent = named.join(counts.hint("merge"), "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    filed = materialise(absent.where("rarest.n > 0").select("id", "rarest.token").join(rules.hint("merge"), "id").select("token", "verdict", "regex"), "url-index")
    met = held.join(filed.hint("merge"), "token").where(fits(F.col("u"), F.col("regex"))).select("u", "verdict")
    always = materialise(rules.where("size(tokens) = 0").select("verdict", "regex", "id"), "url-always")
    blocks = -(-always.count() // (block or MAX_RULES))
    for part in range(blocks):
        some = always.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == part)
        met = met.unionAll(urls.join(F.broadcast(some)).where(fits(F.col("u"), F.col("regex"))).select("u", "verdict"))
    blocked = F.bool_and(F.col("verdict") == "block")
    return materialise(met.groupBy("u").agg(F.when(blocked, "block").otherwise("allow").alias("verdict")), "url-verdicts")


def host_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest host rule that fits, both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):  # the last, longest one is asked first
        name, slash, rest = text.partition("/")
        within = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(within, text).otherwise(rule), F.when(within, action).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, *, host_rules: list[tuple[str, str]] = HOST_RULES, pattern_rules: list[tuple[str, str]] | DataFrame = PATTERN_RULES) -> DataFrame:
    """`pages` with host, path, rule and verdict; with a list of rules, without any shuffle of pages.

    Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path:
    from there up to `?`, `#` or the end. Null URLs and those without `://` have
    empty ones. verdict: that of the longest fitting host rule, else block if only
    blocking patterns fit, else allow. Rules given as a table (verdict, glob), or more
    than MAX_RULES of them, are joined with the URLs' tokens, with the same verdicts.
    Repeated rows stay, and so do rows with a null page_id; very long URLs are read
    whole; an empty table gives no rows. Input columns of these names get the suffix `_in`.
    """
    pages = keep_clear(pages, "host", "path", "rule", "verdict")
    url, parts = F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    if isinstance(pattern_rules, list) and len(pattern_rules) > MAX_RULES:
        pattern_rules = pages.sparkSession.createDataFrame(pattern_rules, "verdict string, glob string")
    if isinstance(pattern_rules, list):
        tokens = sorted({t for _, glob in pattern_rules for t in rule_tokens(glob)})
        judged, pattern = pages, pattern_verdict(F.col("url"), pattern_rules, token_counts(pages, tokens))
    else:
        key, found = spare(pages, "_u"), spare(pages, "_found")
        verdicts = table_verdicts(materialise(pages.select(_lower(F.col("url")).alias("u")).distinct(), "urls"), pattern_rules)
        verdicts = verdicts.select(F.col("u").alias(key), F.col("verdict").alias(found))
        judged = pages.withColumn(key, _lower(F.col("url"))).join(verdicts.hint("merge"), key, "left")
        pattern = F.coalesce(F.col(found), F.lit("allow"))
    names = pages.columns
    judged = judged.withColumns({"host": F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": F.regexp_extract(url, parts, 2)})
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    return judged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, pattern)}).select(*names, "host", "path", "rule", "verdict")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    longest = sorted(HOST_RULES, key=lambda r: -len(r[1]))

    def fits(text: str) -> str:
        name, _, rest = text.partition("/")
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"

    def any_of(action: str) -> str:
        return " OR ".join(f"regexp_matches(u, '{rule_regex(glob, '$')}')" for verdict, glob in PATTERN_RULES if verdict == action)

    return rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {" ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in longest)} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{t}' THEN '{v}'" for v, t in longest)}
  WHEN ({any_of("block")}) AND NOT ({any_of("allow")}) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


SQL = _sql()
