"""Pages and tables of contents: chapter ranges, pages in chapters, sub-chapters carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chapter_ranges(toc: DataFrame) -> DataFrame:
    """(level, num, name, start, end, subs) from toc rows (level, num, name, page, subchapters): a chapter ends before the next one's page; end is null (no bound) for the last
    and when the next has no page. subs: page -> sorted titles."""
    following = F.lead("page").over(Window.partitionBy("level").orderBy("num"))
    titles = toc.select("level", "num", F.explode("subchapters").alias("title", "at")).groupBy("level", "num", "at").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    subs = titles.groupBy("level", "num").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("at", "titles")))).alias("subs"))
    return toc.select("level", "num", "name", F.col("page").alias("start"), (following - 1).alias("end")).join(subs, ["level", "num"], "left")


def assign_chapters(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """pages (level, page, ...) with chapter_num, chapter_name and titles: the first chapter, by number, whose range holds the page; without one 0 and Intro.

    A level's ranges travel as one array, so each page meets one row and is neither multiplied nor regrouped.
    """
    chapter = F.struct("num", "name", "start", "end", F.map_entries("subs").alias("subs"))  # maps have no order, so they can't be sorted
    by_level = ranges.where("start is not null").groupBy("level").agg(F.array_sort(F.collect_list(chapter)).alias("chapters"))
    joined = pages.join(by_level, "level", "left")
    holding = F.filter("chapters", lambda c: (c["start"] <= F.col("page")) & (F.col("page") <= F.coalesce(c["end"], F.col("page"))))
    found = joined.withColumn("ch_", F.try_element_at(holding, F.lit(1)))
    here = F.try_element_at(F.filter("ch_.subs", lambda e: e["key"] == F.col("page")), F.lit(1))["value"]
    return found.select(*pages.columns, F.coalesce("ch_.num", F.lit(0)).alias("chapter_num"), F.coalesce("ch_.name", F.lit("Intro")).alias("chapter_name"), here.alias("titles"))


def carry_subchapters(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pages with subchapter_name: a page with titles has them all, joined by bars; later pages of the same chapter run carry its last title."""
    keys = by or [c for c in ("level", "book") if c in pages.columns]
    order = Window.partitionBy(*keys).orderBy("page")
    changed = F.coalesce((F.col("chapter_num") != F.lag("chapter_num").over(order)).cast("int"), F.lit(1))
    run = pages.withColumn("changed_", changed).withColumn("run_", F.sum("changed_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "run_").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.size("titles") > 0, F.col("titles"))
    carried = F.last(F.element_at(own, -1), True).over(inside)
    return run.withColumn("subchapter_name", F.coalesce(F.array_join(own, " | "), carried, F.lit(""))).drop("changed_", "run_")
