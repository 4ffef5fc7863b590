"""Tables of HTML pages as rows of cells, and the index of reports that one of them holds.

Pages are read by a table function: a stack of open tables takes nested ones apart, cells that span columns or rows stand in
each place they span, and what a page forgets to close is closed where the next part begins.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tarn.functions import market as M

#: The longest spans that HTML allows.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
ROWS = "table_no: int, row_no: int, cells: array<struct<text: string, urls: array<string>>>"


def _span(value: str | None, most: int) -> int:
    return min(max(int(value), 1), most) if value and value.strip().isdigit() else 1


class _Parser(HTMLParser):
    """Tables in the order in which they begin; each is a list of rows of (text parts, urls, columns, rows)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list] = []
        self.open: list[dict] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.tables.append([])
            self.open.append({"rows": self.tables[-1], "cell": None})
        elif not self.open:
            return
        elif tag == "tr":
            self.open[-1]["rows"].append([])
            self.open[-1]["cell"] = None
        elif tag in ("td", "th"):
            given = dict(attrs)
            rows = self.open[-1]["rows"]
            if not rows:
                rows.append([])
            cell = ([], [], _span(given.get("colspan"), MOST_COLUMNS), _span(given.get("rowspan"), MOST_ROWS))
            rows[-1].append(cell)
            self.open[-1]["cell"] = cell
        elif tag == "a" and self.open[-1]["cell"]:
            href = (dict(attrs).get("href") or "").strip()
            if href and not href.startswith("#") and not href.lower().startswith("javascript:"):
                self.open[-1]["cell"][1].append(href)
        elif tag in ("br", "p", "div", "li"):
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.open and tag == "table":
            self.open.pop()
        elif self.open and tag in ("td", "th", "tr"):
            self.open[-1]["cell"] = None

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] and not self.silent:
            self.open[-1]["cell"][0].append(data)


def grid(rows: list) -> list[list]:
    """Rows with each cell in all the places it spans."""
    out, below = [], {}  # below: by column, the cell that hangs down and for how many rows
    for row in rows:
        line, at, cells = [], 0, iter(row)
        cell = next(cells, None)
        while cell is not None or at in below:
            if at in below:
                held, left = below.pop(at)
                if left > 1:
                    below[at] = (held, left - 1)
                line.append(held)
                at += 1
                continue
            for _ in range(cell[2]):
                line.append(cell)
                if cell[3] > 1:
                    below[at] = (cell, cell[3] - 1)
                at += 1
            cell = next(cells, None)
        out.append(line)
    return out


@udtf(returnType=ROWS)
class HtmlTables:
    """(table_no, row_no, cells) of the page ``html`` at ``base``; cells have their text and their links, made absolute."""

    def eval(self, html: str, base: str):
        if not html:
            return
        parser = _Parser()
        parser.feed(html)
        parser.close()
        for number, rows in enumerate(parser.tables):
            for at, row in enumerate(grid(rows)):
                yield number, at, [(" ".join("".join(c[0]).split()), list(dict.fromkeys(urljoin(base or "", u) for u in c[1]))) for c in row]


def tables(pages: DataFrame, html: str, base: Column | None = None) -> DataFrame:
    """The other columns of ``pages`` with table_no, row_no and cells: a row for each row of each table."""
    keys = [c for c in pages.columns if c != html]
    given = pages.withColumn("__base", F.lit("") if base is None else base)
    return given.lateralJoin(HtmlTables(F.col(html).outer(), F.col("__base").outer())).select(*keys, "table_no", "row_no", "cells")


def report_index(pages: DataFrame, html: str, divisions: dict[str, str], as_of: Column, label: str, base: Column | None = None, max_age_days: int = 0) -> DataFrame:
    """(..., report_date, division, urls, error): a row for each date and division with a link in a page's table of reports.

    That table is the first whose first three rows hold ``label`` and one of the ``divisions`` (alias: name). Its first row says
    which column is which division's. A page without it, or without a column for each division, has rows that say so (error)
    and no others. Dates after ``as_of``, or ``max_age_days`` before it, aren't taken.
    """
    keys = [c for c in pages.columns if c != html]
    rows = tables(pages, html, base)
    plain = lambda c: F.lower(M.normalize(c))
    names = F.create_map(*[F.lit(x) for a, n in divisions.items() for x in (a.lower(), n)])
    wanted = sorted(set(divisions.values()))
    text = plain(F.array_join(F.transform("cells", lambda c: c["text"]), " "))
    any_name = F.exists(F.array(*[F.lit(a.lower()) for a in divisions]), lambda a: F.contains(F.col("t"), a))
    heads = rows.where("row_no < 3").groupBy(*keys, "table_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", text.alias("t")))), lambda x: x["t"]), " ").alias("t"))
    chosen = heads.where(F.contains("t", plain(F.lit(label))) & any_name).groupBy(*keys).agg(F.min("table_no").alias("__table"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    mine = rows.alias("r").join(chosen.alias("c"), [*same, F.col("r.table_no") == F.col("c.__table")]).select("r.*")
    # a column for each division, the last of equals
    place = F.transform("cells", lambda c, i: F.struct(F.try_element_at(names, plain(c["text"])).alias("division"), i.alias("at")))
    first = mine.where("row_no = 0").select(*keys, F.filter(place, lambda x: x["division"].isNotNull()).alias("__columns"))
    missing = F.array_except(F.array(*[F.lit(w) for w in wanted]), F.transform("__columns", lambda x: x["division"]))
    judged = first.withColumn("__missing", missing)
    none = [F.lit(None).cast("date").alias("report_date")]
    no_column = judged.select(*keys, *none, F.explode("__missing").alias("division"), F.lit(None).cast("array<string>").alias("urls"), F.lit("no column of this division").alias("error"))
    no_table = pages.select(*keys).alias("r").join(chosen.alias("c"), same, "left_anti") if keys else pages.limit(0)
    no_table = no_table.select(*keys, *none, F.lit(None).cast("string").alias("division"), F.lit(None).cast("array<string>").alias("urls"), F.lit("no table of reports").alias("error"))
    whole = judged.where(F.size("__missing") == 0).select(*keys, F.map_from_entries(F.transform(F.array(*[F.lit(w) for w in wanted]), lambda w: F.struct(w, F.array_max(F.transform(F.filter("__columns", lambda x: x["division"] == w), lambda x: x["at"]))))).alias("__at"))
    dated = mine.where("row_no > 0").withColumn("report_date", M.parse_date(F.get("cells", F.lit(0))["text"])).where(F.col("report_date") <= as_of)
    if max_age_days:
        dated = dated.where(F.col("report_date") >= F.date_sub(as_of, max_age_days))
    met = dated.alias("r").join(whole.alias("c"), same).select(*[F.col(f"r.{k}").alias(k) for k in keys], "report_date", "cells", F.explode("__at").alias("division", "__i"))
    found = met.select(*keys, "report_date", "division", F.get("cells", F.col("__i"))["urls"].alias("urls"), F.lit(None).cast("string").alias("error")).where(F.size("urls") > 0)
    return found.unionByName(no_column).unionByName(no_table)
