"""Discovery over landed pages: what is reached from a catalogue by links, each page once, within a number of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.classify import eligible_url
from lexmill.operators.ordered import first_wins
from lexmill.session import checkpointed
from lexmill.sources.landing import html_links


def reached(links: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """(url, depth) of what links (src, dst) reach from seeds (url) in at most so many steps, each at its least number of them.

    In each round only what was found in the last one is followed, and what is known already is not found again, so
    cycles end and every link is followed once. Nothing but "is anything new" reaches the driver.
    """
    edges = checkpointed(links.select("src", "dst").where("src is not null and dst is not null").distinct())
    new = checkpointed(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)))
    found = new
    for depth in range(1, steps + 1):
        further = new.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        new = checkpointed(further.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        found = found.unionAll(new)
    return found


def discover_site(pages: DataFrame, config: dict, steps: int = 3) -> DataFrame:
    """(url, depth, landed, href, text) of the pages of a portal that its catalogue leads to, with the documents that they link to.

    pages: (page_id, url, html) as landed; of equal links the page with the least id counts. config as in landing.discover():
    its strategy says which links of a page are documents: the first PDF (first_pdf, the default here), those whose text
    holds link_text (by_text) or all PDFs (all_pdfs). Eligible links but those to PDFs are followed, the catalogue itself is where it starts. A
    page without a document has a null href; one that has not landed leads nowhere.
    """
    landed = first_wins(pages.where("url is not null"), ["url"], [F.col("page_id")])
    links = html_links(landed, "page_id", "url").join(landed.select("page_id", F.col("url").alias("src")), "page_id")
    pdf = F.lower("href").rlike(r"\.pdf($|[?#])")
    follow = links.where(~pdf & eligible_url(F.col("href"), config["marker"], config["domain"], config["catalog_url"], config.get("depth"), config.get("excluded", [])))
    seeds = landed.sparkSession.createDataFrame([(config["catalog_url"],)], "url string")
    found = reached(follow.select("src", F.col("href").alias("dst")), seeds, steps)
    match config.get("strategy", "first_pdf"):
        case "by_text":
            chosen = links.where(F.lower("text").contains(config["link_text"].lower()))
        case "all_pdfs":
            chosen = first_wins(links.where(pdf), ["src", "href"], [F.col("ord")])
        case _:
            chosen = first_wins(links.where(pdf), ["src"], [F.col("ord")])
    there = found.join(landed.select("url", F.lit(True).alias("_there")), "url", "left")
    documents = chosen.select(F.col("src").alias("url"), "href", "text")
    return there.join(documents, "url", "left").select("url", "depth", F.coalesce("_there", F.lit(False)).alias("landed"), "href", "text")
