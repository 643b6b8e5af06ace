"""Pages are worked on in lots of bounded bytes, whatever the size of an Arrow batch."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from belegwerk.functions import markup


@pytest.mark.parametrize("most", [1, 10, 1 << 20])
def test_lots_hold_all_pages_in_order(most):
    pages = pa.array(["<p>a</p>", None, "", "<h1>ü</h1>" * 5, "x"])
    cut = list(markup.lots(pages, most))
    assert [p for lot in cut for p in lot.to_pylist()] == pages.to_pylist()
    assert all(len(lot) == 1 or sum(len((p or "").encode()) for p in lot.to_pylist()) <= most for lot in cut)
    assert not list(markup.lots(pages[:0], most))


def test_markdown_of_more_than_a_lot(spark):
    body = "wort " * 2000
    df = spark.range(0, 400, 1, 1).select("id", F.when(F.col("id") % 7 != 3, F.concat(F.lit("<h1>"), "id", F.lit(f"</h1><p>{body}</p>"))).alias("html"))
    found = {r.id: r.md for r in df.select("id", markup.page_markdown(F.col("html")).alias("md")).collect()}
    assert found == {i: f"# {i}\n\n{body.strip()}" if i % 7 != 3 else None for i in range(400)}
