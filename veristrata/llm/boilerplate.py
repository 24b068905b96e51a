"""The main body of web pages by a site style tree.

The pages of a host are merged into one tree. Its upper nodes are the branches of a page
(before, in and after the page's own text, and its last line), its lower nodes the lines or
blocks by their normalised content. Two importances are taken for a node. Content: how
unevenly it spreads over the pages, one less the entropy of the node over pages against the
most it could be; a node on every page is worth nothing, one on a single page everything. It
is taken over the pages of the host and over those of all hosts, as templates are shared, and
the lesser one counts. Presentation: the share of the pages having it, of all hosts, on which
it hangs in the body branch, drawn to one half where a node was seen on few pages. A line is
removed if the weighted sum of both and of its look is low. Look is a feature like the others:
wording known from menus, notices and footers speaks against a line, the form of a sentence
or of an entry behind the page's head for it; neither decides alone. The page's title stays.

Each page is looked at by itself, once, and kept as a row with the hashes of its lines; what
is shuffled are these hashes. Node counts combine
on the map side, and lines meet their nodes by a join on (host, line), which AQE splits where
a host or a line is hot. No host is ever collected.

Defined results: blank lines and null blocks are neither body nor furniture and give no rows;
a null or blank page has no lines; very long pages are read whole; a page delivered twice
gives its rows once (it counts twice in the shares of its host).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm import lines as L
from veristrata.tables import broadcast_if_small, cut

#: Weights of the importances, and of a look against and for the line; the least sum that stays.
W_CONTENT, W_BRANCH, W_AGAINST, W_FOR, LEAST_IMPORTANCE = 0.3, 0.7, 0.55, 0.3, 0.36
PRIOR_PAGES = 2.0

#: Lines in a row; a longer page takes several rows.
ROW_LINES = 10_000

_LINE = pa.struct([("line_no", pa.int32()), ("key", pa.int64()), ("flags", pa.int32()), ("fresh", pa.int32())])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page with its lines that are not blank, part by part; a page without lines is a part too."""
    for b in L.pieces(batches):
        titles, pages = (b.column(i).to_pylist() for i in (3, 4))
        rep, part, ends, cols = [], [], [0], ([], [], [], [])
        for i, (page, title) in enumerate(zip(pages, titles)):
            start, seen = len(cols[0]), set()
            for j, (x, f) in enumerate(zip(page, L.page(page, title))):
                if not f & L.BLANK:
                    k = L.key(x)
                    for col, v in zip(cols, (j, k, f, int(k not in seen))):
                        col.append(v)
                    seen.add(k)
            end = len(cols[0])
            for n, at in enumerate(range(start, max(end, start + 1), ROW_LINES)):
                rep.append(i)
                part.append(n)
                ends.append(min(at + ROW_LINES, end))
        lines = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LINE)], fields=list(_LINE))
        own = [b.column(i).take(pa.array(rep, pa.int32())) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(part, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines)], names=["tab", "row_id", "host", "part", "lines"])


def remove(pages: DataFrame) -> DataFrame:
    """(tab, row_id, line_no) of pages(tab, row_id, host, title, lines array<string>) that is not main body; a row for each delivery of a page.

    Nodes are first counted over all hosts; those that no host could make poor, nearly all of
    the pages' own text, are done with. The others are counted by host, and lines meet them.
    """
    rows = pages.where("row_id is not null and tab is not null and lines is not null").select("tab", "row_id", F.coalesce("host", F.lit("")).alias("host"), "title", "lines")
    trees = cut(rows.mapInArrow(_nodes, "tab string, row_id bigint, host string, part int, lines array<struct<line_no:int,key:bigint,flags:int,fresh:int>>"))
    nodes = trees.select("tab", "row_id", "host", F.inline("lines"))
    flag = lambda m: F.col("flags").bitwiseAND(F.lit(m)) != 0
    look = F.when(flag(L.SENT | L.ENTRY | L.NUMBERED) & ~flag(L.HEAD), W_FOR).otherwise(0.0) - F.when(flag(L.FURN | L.NAV), W_AGAINST).otherwise(0.0)
    nodes = nodes.where(~flag(L.TITLE)).select("tab", "row_id", "host", "line_no", "key", "fresh", look.alias("look"), F.when(flag(L.BODY), 1).otherwise(0).alias("body"))
    # one less the entropy of an even spread over n of m pages
    content = lambda n, m: F.greatest(1 - F.log(F.col(n).cast("double")) / F.greatest(F.log(F.col(m).cast("double")), F.lit(0.7)), F.lit(0.0))
    branch = (F.col("body_all") + PRIOR_PAGES / 2) / (F.col("n_all") + PRIOR_PAGES)
    sizes = cut(trees.where("part = 0").groupBy("tab", "host").agg(F.count("*").alias("m")))
    every = F.broadcast(sizes.groupBy("tab").agg(F.sum("m").alias("m_all")))  # a row a table
    counted = nodes.groupBy("tab", "key").agg(F.sum("fresh").alias("n_all"), F.sum(F.col("fresh") * F.col("body")).alias("body_all"), F.min("look").alias("look"))
    open_ = counted.select("tab", "key", "n_all", "look", branch.alias("branch")).where(W_BRANCH * F.col("branch") + F.col("look") < LEAST_IMPORTANCE)
    open_ = cut(open_.join(every, "tab").select("tab", "key", content("n_all", "m_all").alias("c_all"), "branch"))
    own = nodes.join(broadcast_if_small(open_), ["tab", "key"])
    by_host = own.groupBy("tab", "host", "key", "c_all", "branch").agg(F.sum("fresh").alias("n_host"), F.min("look").alias("look")).join(broadcast_if_small(sizes), ["tab", "host"])
    base = W_CONTENT * F.least(content("n_host", "m"), F.col("c_all")) + W_BRANCH * F.col("branch")
    poor = cut(by_host.select("tab", "host", "key", "look", base.alias("base")).where(F.col("base") + F.col("look") < LEAST_IMPORTANCE).drop("look"))
    return nodes.join(broadcast_if_small(poor), ["tab", "host", "key"]).where(F.col("base") + F.col("look") < LEAST_IMPORTANCE).select("tab", "row_id", "line_no")
