"""Where events stand on their pages.  The tables' pages speak of no events, so cards are put before what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.operators.places import page_texts, placed_events
from datebook.plans.derived import spread, table

#: The name that the cards share is longer than the prefix by which texts are looked for.
_NAME = "Lantern Evening Parade"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cards of one name, of two dates, the second with a time on odd pages; then a line that has a title and, on every third page, the name again."""
    n = F.col("page_id")
    cards = F.concat(
        F.lit(f"<article><h2>{_NAME} "), n.cast("string"), F.lit("</h2><p>2031-03-05</p></article><article><h2>"), F.lit(_NAME.upper()), F.lit("</h2><p>2031-03-06"),
        F.when(n % 2 == 1, "</p><p>7:45 PM").otherwise(""), F.lit("</p></article><div>Come to the <b>Zither open house</b>"), F.when(n % 3 == 0, f"<em>{_NAME.lower()}</em>").otherwise(""), F.lit("</div>"),
    )
    return spread(table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), cards)).alias("html")))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events of the one name, so one or two get none, and one of the other title, given as a preview."""
    null = F.lit(None).cast("string")
    event = lambda pos, title, date, time: F.struct(F.lit(pos).alias("pos"), title.alias("title"), F.lit("Zither open house").alias("preview"), date.alias("startDate"), time.alias("startTime"))
    name = F.lit(_NAME.replace(" ", "  "))
    made = F.array(event(0, name, F.lit("2031-03-06"), F.lit("7:45 PM")), event(1, F.lit(""), null, null), event(2, name, F.lit("2031-03-06"), null), event(3, name, null, null), event(4, name, null, null))
    return table(spark, sf_dir, "pages").filter(F.contains("html", F.lit("<body>"))).select("page_id", F.inline(made))


def event_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, pos, tag, text, score`` of each event that finds its element."""
    return placed_events(_events(spark, sf_dir), page_texts(_pages(spark, sf_dir))).select("page_id", "pos", "tag", "text", F.col("score").cast("long").alias("score"))


#: Event 0 takes the second card; 2 looks for that one's date in the others and finds none; so the rest go by place.  On every third page there are three of the name, and one event is left over.
EVENT_PLACES_SQL = f"""
WITH p AS (SELECT page_id FROM pages WHERE contains(html, '<body>'))
SELECT page_id, 0 AS pos, 'h2' AS tag, '{_NAME.upper()}' AS text, CAST(3 + 2 * (page_id % 2) AS BIGINT) AS score FROM p
UNION ALL SELECT page_id, 1, 'b', 'Zither open house', 1 FROM p
UNION ALL SELECT page_id, 2, 'h2', '{_NAME} ' || page_id, 1 FROM p
UNION ALL SELECT page_id, 3, 'em', '{_NAME.lower()}', 1 FROM p WHERE page_id % 3 = 0"""

QUERIES = {"event_places": (event_places, EVENT_PLACES_SQL)}
