"""Where on its page an event stands: texts that hold its title, and one element for each event.

A page becomes flat texts in one UDF, which parses markup and no more; all else are joins and windows.
Events of a page take elements in the order of their positions: the best that no event before took,
by score, then by place in the page.  That is the only matching in which no event would rather have an element
which a later event or none took, so it is found in rounds for all events at once: each asks for an element, of those
that ask for one the first event keeps it, the others ask for the next on their list.  Events that look for the same texts share a
list, and the k-th of them starts at its k-th element, since those before it take as many.

Edge cases: a title that is null or of under three characters is looked for nowhere; one of white space fits every text; of rows that
repeat a page and position the least title, date and time count; a null page or position has no element; lengths
are in code points.  A row a text and a row a place in it are the largest things made, and none holds a whole page.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from datebook.functions import patterns as P
from datebook.functions.text import marker_text
from datebook.operators.blocks import lists
from datebook.operators.html import CLOSES_P, PAGES, Node, Tree
from datebook.operators.stages import staged

#: Elements that a browser lays out as blocks, list items or cells.
BLOCKS = (CLOSES_P - {"table"}) | frozenset("li dt dd td th legend".split())
NODE = StructType([StructField(n, IntegerType() if n in ("node", "element", "first", "last") else StringType()) for n in ("node", "element", "tag", "first", "last", "text")])
#: Characters of the keys by which texts are found.
GRAM = 3
#: Terms of a page for which each of its texts is searched, one by one.
FEW = 64


def text_nodes(html: str | None) -> list[tuple]:
    """The texts below a page's body, in order, as ``NODE``.

    ``element`` numbers the nearest heading, inline element or block around a text; ``first`` and ``last`` are the texts that
    the nearest box around that element begins and ends with, or its parent if no box is around it.
    """
    if not html:
        return []
    tree = Tree(html)
    number, title, box, span = {}, {}, {}, {tree.root: [0, 0]}
    found: list[tuple[Node, str]] = []
    stack: list[tuple] = [(tree.body, tree.root)]
    while stack:
        x, parent = stack.pop()
        if x is None:
            span[parent][1] = len(found) - 1
        elif isinstance(x, str):
            if parent.tag not in P.MARK_SKIP:
                found.append((parent, x))
        else:
            number[x], span[x] = len(number), [len(found), 0]
            title[x] = x if x is not tree.body and (x.tag in P.MARK_TITLES or x.tag in BLOCKS) else title.get(parent)
            box[x] = x if x.tag in P.MARK_BOXES else box.get(parent)
            stack.append((None, x))
            stack += [(c, x) for c in reversed(x.children)]
    span[tree.root][1] = len(found) - 1
    rows = []
    for n, (parent, text) in enumerate(found):
        element = title[parent] or parent
        rows.append((n, number[element], element.tag, *span[box[element] or element.parent], text))
    # Without the way back to its parents a tree is freed at once.
    for x in number:
        x.parent = None
    return rows


@F.arrow_udf(ArrayType(NODE))
def _nodes(html: pa.Array) -> pa.Array:
    kind, parts = to_arrow_type(NODE), []
    for at in range(0, len(html), PAGES):
        pages = [text_nodes(x) for x in html.slice(at, PAGES).to_pylist()]
        columns = zip(*(row for page in pages for row in page)) if any(pages) else [()] * len(kind)
        rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
        parts.append(lists(rows, np.array(list(map(len, pages)))))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))


def page_texts(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """A row for each text of each page: the id and ``NODE``."""
    return pages.select(page, F.inline(_nodes(F.col("html"))))


def term(x: Column) -> Column:
    """What a text is looked for by: the start of its plain form."""
    return F.when(F.length(x) >= P.MARK_LEAST, F.substring(marker_text(x), 1, P.MARK_PREFIX))


def texts_with(terms: DataFrame, texts: DataFrame, page: str = "page_id") -> DataFrame:
    """``page, term, node``: the texts of its own page that hold each term; blank texts hold none.

    Each text is searched for its page's terms, where these are few.  On pages of many, texts are cut into all their runs of one to
    three and of fifteen characters, so a term meets the texts that hold it whole, or its first three characters, by
    an equality join; only terms in between are then looked for in the text.
    """
    plain = texts.select(page, "node", marker_text(F.col("text")).alias("plain")).filter("plain != ''")
    sizes = terms.groupBy(page).agg(F.count("*").alias("_n"))
    few = terms.join(sizes.filter(F.col("_n") <= FEW), page).groupBy(page).agg(F.collect_list("term").alias("_terms"))
    found = plain.join(few, page).select(page, "node", F.explode(F.filter("_terms", lambda t: F.contains(F.col("plain"), t))).alias("term"))
    many = terms.join(sizes.filter(F.col("_n") > FEW), page, "left_semi")
    plain = plain.join(many.select(page).distinct(), page, "left_semi")
    runs = [F.regexp_extract_all("plain", F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in (*range(1, GRAM + 1), P.MARK_PREFIX)]
    keyed = plain.select(page, "node", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *runs))).alias("key"))
    key = F.when(F.length("term") == P.MARK_PREFIX, F.col("term")).otherwise(F.substring("term", 1, GRAM))
    met = many.withColumn("key", key).join(keyed, [page, "key"]).drop("key")
    return found.select(page, "term", "node").union(met.join(plain, [page, "node"]).filter(F.contains("plain", "term")).select(page, "term", "node"))


def _nearby(rows: DataFrame, hits: DataFrame, by: str, page: str) -> DataFrame:
    """``rows`` with a flag: a text that holds the term ``by`` lies between ``first`` and ``last``.

    Rows and hits stand in one order, from the last text to the first, and each row looks at the last hit before it.
    """
    spots = rows.withColumns({"_spot": F.col("first"), "_hit": F.lit(0)}).unionByName(hits.select(page, F.col("term").alias(by), F.col("node").alias("_spot"), F.lit(1).alias("_hit")), allowMissingColumns=True)
    ahead = Window.partitionBy(page, by).orderBy(F.desc("_spot"), F.desc("_hit")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.coalesce(F.min(F.when(F.col("_hit") == 1, F.col("_spot"))).over(ahead) <= F.col("last"), F.lit(False))
    return spots.withColumn(f"{by}_near", near).filter("_hit = 0").drop("_spot", "_hit")


def candidates(asked: DataFrame, texts: DataFrame, page: str = "page_id") -> DataFrame:
    """``page, ask, at, element, tag, node, text, score``: for each distinct ``ask`` its elements, best first, counted from 1 by ``at``."""
    asks = asked.select(page, "ask", "title", "date", "time").distinct()
    terms = reduce(DataFrame.union, [asks.select(page, F.col(c).alias("term")) for c in ("title", "date", "time")]).filter("term IS NOT NULL").distinct()
    hits = staged(texts_with(terms, texts, page), "place-hits")
    rows = asks.join(hits.withColumnRenamed("term", "title"), [page, "title"]).join(texts, [page, "node"])
    for c in ("date", "time"):
        rows = _nearby(rows, hits, c, page)
    score = F.lit(1) + F.when(F.col("date_near"), 2).otherwise(0) + F.when(F.col("time_near"), 2).otherwise(0)
    found = rows.withColumn("score", score).groupBy(page, "ask", "element").agg(F.min_by(F.struct("node", "tag", "text", "score"), "node").alias("_t")).select(page, "ask", "element", "_t.*")
    return found.withColumn("at", F.row_number().over(Window.partitionBy(page, "ask").orderBy(F.desc("score"), "node")))


def placed_events(events: DataFrame, texts: DataFrame, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """``page, pos, element, tag, node, text, score`` of each event that gets an element.

    ``events`` has ``title, preview, startDate, startTime`` beside page and position; ``texts`` is :func:`page_texts`.
    """
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("preview"))
    wanted = events.select(page, pos, F.struct(term(title).alias("title"), term(F.col("startDate")).alias("date"), term(F.col("startTime")).alias("time")).alias("_w"))
    asked = wanted.filter(F.col("_w.title").isNotNull() & F.col(page).isNotNull() & F.col(pos).isNotNull()).groupBy(page, pos).agg(F.min("_w").alias("_w")).select(page, pos, F.to_json("_w").alias("ask"), "_w.*")
    # Markup is parsed once, not for each join that reads its texts.
    asked, texts = staged(asked, "place-asked"), staged(texts, "place-texts")
    listed = staged(candidates(asked, texts, page), "place-lists")
    order = Window.partitionBy(page, "ask").orderBy(pos)
    # The k-th event of a list of fewer elements can't get one.
    size = listed.groupBy(page, "ask").agg(F.max("at").alias("size"))
    held = asked.select(page, pos, "ask").withColumn("rank", F.row_number().over(order)).join(size, [page, "ask"]).filter("rank <= size").drop("size").withColumn("at", F.col("rank"))
    done: list[DataFrame] = []
    while True:
        first = F.min(pos).over(Window.partitionBy(page, "element"))
        asks = held.join(listed, [page, "ask", "at"]).withColumn("refused", (F.col(pos) > first).cast("int"))
        asks = staged(asks.withColumn("open", F.max("refused").over(Window.partitionBy(page)) == 1), "place-round")
        done.append(asks.filter("NOT open"))
        rest = asks.filter("open")
        if rest.isEmpty():
            break
        # A refused event asks for its next element, and those behind it on the same list for one after that.
        behind = F.max(F.col("at") + F.col("refused") - F.col("rank")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        held = rest.withColumn("next", (behind + F.col("rank")).cast("int")).select(page, pos, "ask", "rank", F.col("next").alias("at"))
    return reduce(DataFrame.union, done).select(page, pos, "element", "tag", "node", "text", "score")
