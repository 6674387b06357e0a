"""URL filtering by rules, and by trust that spreads along links where no rule fits.

Links of the pages make a graph of hosts.  Two personalised PageRanks run on it:
trust starts at the hosts of pages that a rule allows and follows the links;
distrust starts at the hosts of blocked pages and goes against the links, since
who links to bad hosts is suspect.  Beside each runs the same walk from all
pages, so a host's trust and distrust are shares from 0 to 1 of what arrives
there, whatever its size.  A host is blocked if its distrust exceeds its trust by more than
a threshold.

Everything is built-in expressions, joins and groupings.  Masses are whole
numbers, so neither the partitioning nor a recomputed task changes a result.
Links are added up per pair of hosts before any of them is shuffled by host, and
the links of a host with very many neighbours are spread over several keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ascii_lower, others, quoted, text_or_empty
from lexmill.session import materialize

ROUNDS = 20
PAGE_MASS = 1 << 20
# the part of a host's mass that moves on along its links
DAMPING = (17, 20)
THRESHOLD = 0.5
FAN_OUT = 100_000  # links of one host that are joined under one key
BROADCAST_HOSTS = 1_000_000  # beyond it, blocked hosts meet their pages by a shuffle
SPREAD = 64  # keys that the pages of one host are spread over in that shuffle
NEW = ("host", "path", "rule", "verdict")
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


@dataclass(frozen=True)
class Rule:
    """Allows or blocks the urls of a host and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path of a url; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules: Sequence[Rule], url: str) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` and ``verdict`` (null where no rule fits).

    Of the rules that fit the longest wins; of equally long ones the first.
    """
    host, path = url_parts(F.col(quoted(url)))
    ordered = sorted(rules, key=lambda r: -len(r.name))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    placed = pages.select(*others(pages, NEW), host.alias("host"), path.alias("path"))
    for r in reversed(ordered):
        fits = r.fits(F.col("host"), F.col("path"))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return placed.select("*", name.alias("rule"), verdict.alias("verdict"))


def host_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``source``, ``target`` and ``n``: pages of one host that link to another host.

    A page counts once for a target; links inside a host and to nowhere do not.
    """
    host, _ = url_parts(F.col(quoted(url)))
    targets = F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty(F.col(quoted(html))), F.lit(LINK), F.lit(1)), ascii_lower))
    return (
        pages.select(host.alias("source"), F.explode(targets).alias("target"))
        .filter("source != '' and target != '' and source != target")
        .groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    )


def _seeds(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``way``, ``host`` and the masses that start there: ``special`` and ``plain``.

    Way 0 is trust along the links, way 1 distrust against them.
    """
    count = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, PAGE_MASS).otherwise(0)).alias(verdict)
    hosts = pages.filter("host != ''").groupBy("host").agg(F.sum(F.lit(PAGE_MASS)).alias("plain"), count("allow"), count("block"))
    linked = links.select(F.explode(F.array("source", "target")).alias("host")).distinct()
    zero = F.lit(0).cast("long")
    hosts = hosts.join(linked, "host", "full").select("host", *[F.coalesce(c, zero).alias(c) for c in ("plain", "allow", "block")])
    ways = F.inline(F.array(
        F.struct(F.lit(0).alias("way"), F.col("allow").alias("special")), F.struct(F.lit(1).alias("way"), F.col("block").alias("special"))
    ))
    return hosts.select("host", "plain", ways)


def _edges(links: DataFrame) -> DataFrame:
    """The links of both ways: ``way``, ``source``, ``target``, ``n``, the sum
    ``total`` of its source, and the key ``salt`` of ``salts`` they lie under."""
    both = links.select(F.lit(0).alias("way"), "source", "target", "n").unionByName(
        links.select(F.lit(1).alias("way"), F.col("target").alias("source"), F.col("source").alias("target"), "n")
    )
    sums = both.groupBy("way", "source").agg(
        F.sum("n").alias("total"), F.ceil(F.count(F.lit(1)) / FAN_OUT).cast("int").alias("salts")
    )
    return both.join(sums, ["way", "source"]).withColumn("salt", F.pmod(F.xxhash64("target"), F.col("salts")).cast("int"))


def host_ranks(pages: DataFrame, links: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` of all hosts of pages or links.

    ``pages`` has ``host`` and ``verdict``; ``links`` is as from ``host_links``.
    A round keeps 3/20 of what starts at a host and moves 17/20 of what it has
    along its links; a host without links keeps that too.  Rounds end early if
    nothing moves any more.
    """
    links = materialize(links, "host-links")
    edges = materialize(_edges(links), "host-edges")
    outs = edges.select("way", F.col("source").alias("host"), "salts").distinct()
    up, down = DAMPING
    moving = lambda c: F.expr(f"{c} * {up} div {down}")
    walks = ("special", "plain")
    state = materialize(
        _seeds(pages, links).join(outs, ["way", "host"], "left").select(
            "way", "host", "salts", *walks, *[(F.col(c) - moving(c)).alias(f"{c}_seed") for c in walks], F.lit(True).alias("changed")
        ),
        "seeds",
    )
    for _ in range(0 if edges.isEmpty() else rounds):
        sent = state.filter("salts is not null").select(
            "way", F.col("host").alias("source"), *[moving(c).alias(c) for c in walks],
            F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        )
        # mass * n / total without a product that could overflow
        part = lambda c: F.expr(f"({c} div total) * n + (({c} % total) * n) div total")
        arrived = sent.join(edges.drop("salts"), ["way", "source", "salt"]).select(
            "way", F.col("target").alias("host"), *[part(c).alias(f"{c}_in") for c in walks]
        )
        sums = arrived.groupBy("way", "host").agg(*[F.sum(f"{c}_in").alias(f"{c}_in") for c in walks])
        met = state.join(sums, ["way", "host"], "left")
        after = {
            c: F.col(f"{c}_seed") + F.coalesce(f"{c}_in", F.lit(0)) + F.when(F.col("salts").isNull(), moving(c)).otherwise(0)
            for c in walks
        }
        state = materialize(
            met.select(
                "way", "host", "salts", *[after[c].alias(c) for c in walks], *[f"{c}_seed" for c in walks],
                reduce(Column.__or__, [after[c] != F.col(c) for c in walks]).alias("changed"),
            ),
            "ranks",
        )
        if state.filter("changed").isEmpty():
            break
    share = F.when(F.col("plain") > 0, F.col("special") / F.col("plain")).otherwise(0.0)
    of = lambda way, name: F.max(F.when(F.col("way") == way, share)).alias(name)
    return state.groupBy("host").agg(of(0, "trust"), of(1, "distrust"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
    rounds: int = ROUNDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The pages, without ``html``, with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule's verdict holds; where none fits, a page is blocked if distrust of
    its host exceeds trust by more than ``threshold``, and allowed otherwise.

    Null urls and urls without ``://`` have an empty host, which no rule fits
    and no link reaches: they are allowed.  A null or empty page has no links.
    Repeated rows count as pages of their own and are all judged; columns that
    have the name of a new one are replaced, others stay.  ``rules`` are a short
    list that becomes literals of the plan.
    """
    rows = judged(pages.select(*others(pages, [html])), rules, url)
    ranks = host_ranks(rows.select("host", "verdict"), host_links(pages, url, html), rounds=rounds)
    blocked = materialize(ranks.filter(F.col("distrust") - F.col("trust") > threshold).select(F.col("host").alias("bad_host")), "blocked-hosts")
    if blocked.count() <= BROADCAST_HOSTS:
        met = rows.select(F.struct("*").alias("row")).join(F.broadcast(blocked), F.col("row.host") == F.col("bad_host"), "left")
    else:
        # a host may hold a third of all pages, so its pages are spread
        salted = rows.select(F.struct("*").alias("row"), F.pmod(F.xxhash64(quoted(id_col), quoted(url)), F.lit(SPREAD)).alias("salt"))
        copies = blocked.select("bad_host", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("bad_salt"))
        met = salted.join(copies, (F.col("row.host") == F.col("bad_host")) & (F.col("salt") == F.col("bad_salt")), "left")
    return met.select(
        *[F.col(f"row.{quoted(c)}") for c in rows.columns if c != "verdict"],
        F.coalesce("row.verdict", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )
