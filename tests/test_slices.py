import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import splitting


def test_pieces_are_sent_on_a_few_rows_at_a_time(spark):
    texts = pd.Series(["a b c. d\n\n# H\ne f", None, ""] * 500)
    sizes, marked = pd.Series([3] * 1500), pd.Series([True] * 1500)
    one = F.lit(1)
    for column, given in (
        (lambda: splitting.split_column(one, one, one, True), (texts, sizes, sizes * 0)),
        (lambda: splitting.parents_column(one, one, one), (texts, marked, sizes)),
        (lambda: splitting.sections_column(one), texts),
    ):
        kept, plain = [], F.pandas_udf
        F.pandas_udf = lambda kind: lambda f: kept.append(f) or (lambda *columns: one)  # noqa: B023
        try:
            column()
        finally:
            F.pandas_udf = plain
        out = list(kept[0](iter([given])))
        assert max(map(len, out)) <= 100 and sum(map(len, out)) == 1500
        whole = [x for part in out for x in part]
        assert whole[:3] * 500 == whole and whole[2] == []
