"""Breadth-first expansion over a table of links, and crawls of many sources at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.functions.urls import url_host, url_page
from lexivane.operators.pages import page_hrefs, page_quality, resolved
from lexivane.session import bounded_broadcast, materialize, scratch_dir


def frontier_step(links: DataFrame, seen: DataFrame) -> DataFrame:
    """Targets of ``links`` (``dst``) that are not in ``seen`` (``url``)."""
    return (
        links.select(F.col("dst").alias("url"))
        .distinct()
        .join(seen.select("url"), "url", "left_anti")
    )


def frontier_bfs(
    edges: DataFrame,
    start: DataFrame,
    max_pages: int | None = None,
    accepted: DataFrame | None = None,
) -> DataFrame:
    """``url, depth`` of pages reached from ``start``, by distance.

    ``accepted`` (``url``) limits which pages count and are followed. With
    ``max_pages`` exactly that many pages are kept: whole rounds, then the last
    round's first addresses in order. One loop turn is one round of the search;
    each is checkpointed to shared storage, so a lost executor costs one round.
    """
    scratch_dir(edges.sparkSession)
    edges = materialize(edges.select("src", "dst").distinct())  # read in every round

    def admit(found: DataFrame, depth: int) -> DataFrame:
        if accepted is not None:
            found = found.join(accepted.select("url"), "url", "left_semi")
        return found.select("url", F.lit(depth).alias("depth"))

    frontier = admit(start.select("url").distinct(), 0).checkpoint()
    visited = frontier
    total = frontier.count()
    depth = 0
    while max_pages is None or total < max_pages:
        depth += 1
        links = edges.join(frontier.select(F.col("url").alias("src")), "src", "left_semi")
        frontier = admit(frontier_step(links, visited), depth).checkpoint()
        grown = frontier.count()
        if grown == 0:
            break
        total += grown
        visited = visited.union(frontier)
        if depth % 10 == 0:
            visited = visited.checkpoint()
    if max_pages is not None and total > max_pages:
        visited = visited.orderBy("depth", "url").limit(max_pages)
    return visited


def crawl_sources(
    pages: DataFrame,
    sources: DataFrame,
    mode: str = "broad",
    accept: Callable[[DataFrame], DataFrame] | None = None,
    most: int | None = None,
) -> DataFrame:
    """``source, url, depth, place`` of the pages that each source's crawl takes.

    ``pages``: url, html. ``sources``: name, base_url, start_urls, allowed_patterns and
    max_pages (at most ``most`` of them). All sources go on in one loop, a round of it
    being one step from their newest pages. A page is taken if the quality test of
    ``mode`` accepts it, or ``accept``, which adds ``accepted``; rejected ones are not
    followed. Links are resolved against the source's base and kept if they hold one of
    its patterns (none given: all); ``broad`` drops query and fragment, ``focused`` stays on
    the base's host. A source that has its budget goes no further, and exactly
    ``max_pages`` are kept: whole rounds, then the last round's first addresses in order.

    Sources crawl independently, so a page may be taken by several. Sources with a null
    name, and start addresses and budgets that are null or not positive, take nothing.
    """
    scratch_dir(pages.sparkSession)
    if accept:
        judged = accept(pages)
    else:
        judged = page_quality(pages.select("url", "html"), mode).withColumnRenamed("is_doc", "accepted")
    known = judged.where("accepted").select("url", page_hrefs(F.col("html")).alias("hrefs")).dropDuplicates(["url"])
    known = materialize(known)  # addresses only; read in every round
    budget = F.col("max_pages") if most is None else F.least("max_pages", F.lit(most))
    rules = sources.where("name is not null").select(
        F.col("name").alias("source"), "base_url", F.coalesce("allowed_patterns", F.array().cast("array<string>")).alias("allowed"),
        budget.alias("budget"), "start_urls",
    )
    rules = bounded_broadcast(materialize(rules.where("budget > 0")))
    start = rules.select("source", F.explode("start_urls").alias("url")).where("url is not null").distinct()
    seen = frontier = start.checkpoint()
    taken, depth = None, 0
    while True:
        new = frontier.join(known.select("url"), "url", "left_semi").select("source", "url", F.lit(depth).alias("depth"))
        new = new.checkpoint()
        if not new.limit(1).count():
            break
        taken = new if taken is None else taken.union(new)
        if depth % 10 == 9:
            taken, seen = taken.checkpoint(), seen.checkpoint()
        totals = taken.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        going = rules.join(totals, "source").where("n < budget").drop("start_urls")
        target = F.explode(F.transform("hrefs", lambda h: resolved(F.col("base_url"), h)))
        links = new.join(known, "url").join(going, "source").select("source", "base_url", "allowed", target.alias("url"))
        if mode == "focused":
            links = links.where(url_host(F.col("url")) == url_host(F.col("base_url")))
        else:
            links = links.withColumn("url", url_page(F.col("url")))
        hit = (F.size("allowed") == 0) | F.exists("allowed", lambda a: F.contains(F.col("url"), a))
        frontier = links.where(hit).select("source", "url").distinct().join(seen, ["source", "url"], "left_anti").checkpoint()
        seen = seen.union(frontier)
        depth += 1
    if taken is None:
        return start.select("source", "url", F.lit(0).alias("depth"), F.lit(0).alias("place")).limit(0)
    order = Window.partitionBy("source").orderBy("depth", "url")
    ranked = taken.withColumn("place", F.row_number().over(order)).join(rules.select("source", "budget"), "source")
    return ranked.where("place <= budget").drop("budget")
