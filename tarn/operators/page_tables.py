"""Tables of pages that several strategies have read: the first strategy that finds something, and each table once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import market as M
from tarn.sources.files import stored, tasks_of


def page_tables(found: DataFrame, document: str, page: str = "page", strategy: str = "strategy", tables: str = "tables", least_rows: int = 2, least_cells: int = 5) -> DataFrame:
    """(document, page, table_no, cells) of what a reader found: rows of (document, page, strategy, tables), tables being arrays
    of rows of cells; a strategy that failed has null tables.

    Cells are normalized and rows without any filled cell go; a table needs ``least_rows`` rows, one of them with ``least_cells``
    cells. Of a page's strategies only the first with such a table counts, as a later one reads the same table again, often
    torn. A document's tables are numbered in order; a table that stood before in it doesn't come again.
    """
    value = lambda c: M.normalize(F.coalesce(c, F.lit("")))
    rows = lambda t: F.filter(F.transform(t, lambda r: F.transform(r, value)), lambda r: F.exists(r, lambda c: c != ""))
    shaped = lambda t: (F.size(t) >= least_rows) & F.exists(t, lambda r: F.size(r) >= least_cells)
    good = F.filter(F.transform(F.coalesce(tables, F.array().cast(found.schema[tables].dataType)), rows), shaped)
    prints = F.transform("__tables", lambda t: F.sha2(F.to_json(t), 256)).alias("__prints")
    some = found.select(document, page, strategy, good.alias("__tables")).where(F.size("__tables") > 0)
    # cells are written once; what is sorted are rows' numbers and fingerprints, which are short
    some = stored(some.select("*", F.monotonically_increasing_id().alias("__row"), prints))
    n = tasks_of(some)
    narrow = some.select(document, page, strategy, "__row", "__prints").repartition(n, document)
    first = narrow.groupBy(document, page).agg(F.min_by(F.struct("__row", "__prints"), strategy).alias("x"))
    each = first.select(document, page, "x.__row", F.posexplode("x.__prints").alias("__at", "__print"))
    once = each.groupBy(document, "__print").agg(F.min_by(F.struct(page, "__at", "__row"), F.struct(page, "__at")).alias("x"))
    # a document's tables, by places alone
    place = once.select(document, f"x.{page}", "x.__at", "x.__row").withColumn("table_no", F.row_number().over(Window.partitionBy(document).orderBy(page, "__at")) - 1)
    # the places become the table that is looked up, so that rows with cells pass by it unsorted
    met = some.select("__row", "__tables").repartition(n, "__row").join(place.repartition(n, "__row").hint("shuffle_hash"), "__row")
    return met.select(document, page, "table_no", F.get("__tables", F.col("__at")).alias("cells"))
