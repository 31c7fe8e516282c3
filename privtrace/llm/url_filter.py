"""URL filter: longest matching rule, else logistic regression on hashed character n-grams.

A rule is a host and the beginning of a path, separated by the first slash. It
fits its host and all subdomains, for paths that start with the rule's, slash
included. The rules are a short list given as a parameter and become one
expression.

Urls without a rule go to a classifier. Its features are the n-grams of
"^host/" and of the path with its borders, counted in ``BUCKETS`` hashed
buckets and divided by their number. The weights are fitted to a small labelled
table of urls by full gradient steps; scoring is one expression per row.

Cases: a null url, and one without "://", has an empty host and path and no
rule; the classifier judges the empty strings. Of rules of equal length the one
with the longer host wins. Repeated rows give repeated results, an empty table
an empty one.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048
GRAMS = (3, 4)
STEPS = 400
RATE = 20.0
DECAY = 1e-4

# fixed values: the rules as (rule, verdict)
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)

# the labelled table the classifier learns from, as (url, 1 to block or 0 to allow)
LABELLED = (
    ("https://free-casino-bonus.example/win/jackpot", 1),
    ("http://www.casino-slots.example/free-spins", 1),
    ("https://online-poker.example/bet/now", 1),
    ("http://bets24.example/casino/roulette?ref=ad", 1),
    ("https://cheap-pills.example/buy/viagra", 1),
    ("http://pharma-discount.example/order-pills-online", 1),
    ("https://xxx-videos.example/porn/watch", 1),
    ("http://adult-cams.example/xxx/live", 1),
    ("https://hot-sex-chat.example/join", 1),
    ("http://porn-tube.example/adult/free", 1),
    ("https://win-prize-now.example/claim/gift-card", 1),
    ("http://get-rich-fast.example/crypto/double-money", 1),
    ("https://payday-loans.example/apply/fast-cash", 1),
    ("http://click-tracker.example/redirect?aff=77", 1),
    ("https://warez-crack.example/keygen/download", 1),
    ("http://torrent-free-movies.example/crack/serial", 1),
    ("https://ads.tracker.example/banner/popunder", 1),
    ("http://seo-backlinks.example/buy-cheap-links", 1),
    ("https://replica-watches.example/cheap/rolex", 1),
    ("http://spam-mailer.example/bulk/list", 1),
    ("https://news.example.com/en/2024/world/report", 0),
    ("https://www.example.com/en/131.html", 0),
    ("https://blog.example.com/fr/105", 0),
    ("http://m.example.org/en/62#top", 0),
    ("https://www.example.org/es/12?page=2", 0),
    ("https://docs.example.org/guide/install", 0),
    ("https://wiki.example.org/en/History_of_science", 0),
    ("http://library.example.com/books/catalog", 0),
    ("https://university.example.org/research/papers", 0),
    ("https://museum.example.org/de/collection", 0),
    ("http://blog.example.com/en/98?utm_source=feed", 0),
    ("https://www.example.com/es/151/", 0),
    ("https://forum.example.org/topic/garden-tips", 0),
    ("http://recipes.example.com/fr/soup.html", 0),
    ("https://health.example.org/en/article/sleep", 0),
    ("https://city.example.com/council/minutes", 0),
    ("http://school.example.org/lessons/algebra", 0),
    ("https://weather.example.com/fr/forecast", 0),
    ("https://science.example.org/journal/vol7", 0),
    ("http://travel.example.com/es/guide/lisbon", 0),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path up to the query or fragment."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % BUCKETS


def _grams(text: str) -> list[str]:
    return [text[i:i + n] for n in GRAMS for i in range(len(text) - n + 1)]


def _marked(host: str, path: str) -> str:
    return f"^{host}|{path}$"


def fit(labelled: Sequence[tuple[str, int]] = LABELLED) -> tuple[list[float], float]:
    """Weights and bias of the labelled table, which is small and plain Python."""
    import re

    rows = []
    for url, label in labelled:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        ids = [_bucket(g) for g in _grams(_marked(host, path))]
        rows.append((ids, label))
    weights, bias = [0.0] * BUCKETS, 0.0
    for _ in range(STEPS):
        down, down_bias = {}, 0.0
        for ids, label in rows:
            margin = bias + sum(weights[i] for i in ids) / max(1, len(ids))
            error = (1 / (1 + math.exp(-margin)) - label) / len(rows)
            down_bias += error
            for i in ids:
                down[i] = down.get(i, 0.0) + error / len(ids)
        for i, g in down.items():
            weights[i] -= RATE * (g + DECAY * weights[i])
        bias -= RATE * 0.05 * down_bias
    return [round(w, 6) for w in weights], round(bias, 6)


def margin(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    """The log odds that a url is to be blocked."""
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    total, count = F.lit(0.0), F.lit(0)
    for n in GRAMS:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        grams = F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        got = F.transform(grams, lambda g: F.element_at(table, (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long") % BUCKETS + 1).cast("int")))
        total = total + F.aggregate(got, F.lit(0.0), lambda a, x: a + x)
        count = count + F.size(grams)
    return F.lit(bias) + total / F.greatest(count, F.lit(1))


def match_rules(urls: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` to (host, path), null where no rule fits."""
    split = [(r, *r.split("/", 1), v) for r, v in rules]
    best = F.lit(None).cast("struct<size:int,host:int,rule:string,verdict:string>")
    for rule, host, path, verdict in sorted(split, key=lambda x: (len(x[0]), len(x[1]))):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{path}"))
        best = F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(len(host)).alias("host"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return urls.withColumn("__rule", best).withColumns({"rule": F.col("__rule.rule"), "rule_verdict": F.col("__rule.verdict")}).drop("__rule")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col(url_col))
    rows = match_rules(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")), rules)
    block = margin(F.col("host"), F.col("path"), *fit(labelled)) > 0
    verdict = F.coalesce(F.col("rule_verdict"), F.when(block, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def oracle_sql(rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED) -> str:
    weights, bias = fit(labelled)
    arms = ""
    for rule, verdict in sorted(rules, key=lambda x: (-len(x[0]), -len(x[0].split("/", 1)[0]))):
        host, path = rule.split("/", 1)
        arms += f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN {{'rule': '{rule}', 'verdict': '{verdict}'}} "
    sums = " + ".join(
        f"coalesce(list_sum([w[(('0x' || substr(md5(substr(t, i, {n})), 1, 8))::BIGINT % {BUCKETS} + 1)::INT] FOR i IN range(1, len(t) - {n - 2})]), 0)" for n in GRAMS)
    return f"""
WITH a AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {arms}END AS r, '^' || host || '|' || path || '$' AS t, {weights} AS w FROM b)
SELECT page_id, host, path, r.rule AS rule,
       coalesce(r.verdict, CASE WHEN {bias} + ({sums}) / greatest(1, {" + ".join(f"greatest(0, len(t) - {n - 1})" for n in GRAMS)}) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM c
"""
