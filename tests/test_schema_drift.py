"""Edit scripts between schemas, and the one table."""

import itertools
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from alertloom.operators import schema_drift as S

SCHEMA = "file_id long, tab string, feed string, month string, fetched_at string, body string"


def file(i, month, rows, feed="f", fetched=None, nested=False):
    p = {"aaData": rows}
    return (i, "nsq", feed, month, fetched or f"2020-{i:02d}", json.dumps({"payload": json.dumps(p) if nested else p}))


def names(prefix, n=8):
    return [f"{prefix} {w} Tablets {i} mg" for i, w in zip(range(n), itertools.cycle(("Foo", "Bar", "Baz")))]


def month_rows(product="str_product_name", batch="str_batch_no", n=8, **more):
    return [{product: p, batch: f"AB/{i:02d}/{i * 37 % 1000:04d}", "srno": i} | {k: v(i) if callable(v) else v for k, v in more.items()} for i, p in enumerate(names("X", n))]


def changes(spark, files, nested=False):
    return sorted(map(tuple, S.schema_changes(spark.createDataFrame(files, SCHEMA), nested).collect()))


def test_a_feed(spark):
    files = [
        file(1, "Jan-2020", month_rows(src="State lab")),
        file(2, "Feb-2020", month_rows("product_name", src="State lab"), nested=True),
        file(3, "Mar-2020", month_rows("product_name", route="Oral")),
        file(4, "Apr-2020", month_rows("product_name", route="Oral", srno=lambda i: str(i))),
        file(5, "May-2020", []),
        file(6, None, month_rows("other")),
        file(7, "Jun-2020", month_rows("product_name", srno=lambda i: str(i), dt=lambda i: {"m": 1})),
        file(8, "Jun-2020", month_rows("product_name", route="IM", srno=lambda i: str(i)), fetched="2021-01"),
    ]
    assert changes(spark, files) == [(2, "renamed", "product_name", "str_product_name"), (3, "added", "route", ""), (3, "removed", "src", ""), (4, "retyped", "srno", "")]


def test_type_is_compared_with_the_last_one_known(spark):
    files = [file(1, "Jan-2020", month_rows(n1=5)), file(2, "Feb-2020", month_rows(n1=None)), file(3, "Mar-2020", month_rows(n1="x")), file(4, "Apr-2020", month_rows(n1=1.5)), file(5, "May-2020", month_rows(n1=True))]
    assert changes(spark, files) == [(3, "retyped", "n1", ""), (4, "retyped", "n1", ""), (5, "retyped", "n1", "")]


def test_feeds_are_apart_and_order_is_by_month(spark):
    files = [file(9, "Jan-2020", month_rows()), file(1, "Feb-2020", month_rows(extra="x")), file(2, "Feb-2020", month_rows(), feed="g"), file(3, "bad", month_rows("y"), feed="g")]
    assert changes(spark, files) == [(1, "added", "extra", "")]


def test_nested_changes_and_moves(spark):
    files = [file(1, "Jan-2020", month_rows(o={"a": 1, "b": "x"})), file(2, "Feb-2020", month_rows(o={"a": 1, "c": 2}, b="x"))]
    got = changes(spark, files, nested=True)
    assert (2, "moved", "b", "o.b") in got and (2, "added", "o.c", "") in got
    assert not any("." in x[2] for x in changes(spark, files))


def test_no_files_and_unreadable_ones(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(1, "nsq", "f", "Jan-2020", "x", "no json"), (2, "nsq", "f", "Feb-2020", "x", None), (3, None, None, "Mar-2020", None, '{"payload": {"aaData": [1, null, {}]}}')]) == []


def test_one_table(spark):
    files = [file(1, "Jan-2020", month_rows(n=2)), file(2, "Feb-2020", month_rows("product_name", n=2, file_id=[1]), nested=True), file(3, None, month_rows("product_name", n=1))]
    got = S.one_table(spark.createDataFrame(files, SCHEMA))
    assert set(got.columns) == {"file_id", "row_no", "str_product_name", "str_batch_no", "srno", "file_id_"}
    rows = got.collect()
    assert len(rows) == 5 and all(r["str_product_name"] for r in rows) and {r["file_id_"] for r in rows} == {None, "[1]"} and dict(got.dtypes)["srno"] == "bigint"


def table_values(spark, files):
    """Every value of the one table by file and column, and of the bodies."""
    got = S.one_table(spark.createDataFrame(files, SCHEMA))
    held = [(r["file_id"], c, r[c]) for r in got.collect() for c in got.columns if c not in ("file_id", "row_no") and r[c] is not None]
    return held, sum(1 for f in files for r in S.rows_of(f[5]) for _ in S.leaves(r))


def test_no_value_of_any_readable_body_is_lost(spark):
    odd = [{"A": 1, "a": "x", "x.y": 2, "x": {"y": 3, "z": {}}, "o": [{"p": 1}], "big": 1 << 80, "n": (1 << 53) + 1, "f": 0.5}, {"f": 2, "s": "\ud800"}]
    files = [
        file(1, "Jan-2020", month_rows()),
        file(2, "Feb-2020", month_rows(only_superseded="u"), fetched="2020-01"),
        file(3, "Feb-2020", month_rows("product_name"), fetched="2020-02"),
        file(4, None, month_rows(only_snapshot="v")),
        file(5, "no month", odd, feed="g"),
        file(6, "Mar-2020", month_rows("product_name", str_product_name="again")),
        (None, None, None, "Apr-2020", None, json.dumps({"payload": {"aaData": [{"k": 1}]}})),
        (7, "nsq", "f", "May-2020", "x", "no json"),
        file(1, "Jan-2020", [{"other": "same id"}]),
    ]
    held, n = table_values(spark, files)
    assert len(held) == n
    assert {c for i, c, _ in held if i == 5} == {"A", "a_", "x.y", "x.y_", "x.z", "o", "big", "n", "f", "s"}
    assert {v for i, c, v in held if c == "only_superseded"} == {"u"} and {v for i, c, v in held if c == "only_snapshot"} == {"v"}
    assert {(i, v) for i, c, v in held if c == "str_product_name_2" or v == "again"} == {(6, "again")}
    assert S.one_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_moved_fields_keep_their_column(spark):
    makers = [f"{w} {v}" for w in ("Foo", "Bar", "Baz", "Qux") for v in ("Works", "House")]
    files = [file(1, "Jan-2020", month_rows(info=lambda i: {"maker": makers[i % 8], "pin": i})), file(2, "Feb-2020", month_rows(info=lambda i: {"pin": i}, maker=lambda i: makers[i % 8]))]
    assert (2, "moved", "maker", "info.maker") in changes(spark, files, nested=True)
    assert changes(spark, files) == [(2, "added", "maker", "")]
    held, n = table_values(spark, files)
    assert len(held) == n and sum(c == "info.maker" for _, c, _ in held) == 16


def test_a_file_is_read_through_its_own_script(spark):
    # a name that stood for two fields in turn
    batch = lambda i: f"Q{i}/{i * 71 % 1000:04d}"
    files = [
        file(1, "Jan-2020", month_rows()),
        file(2, "Feb-2020", month_rows("product_name")),
        file(3, "Mar-2020", month_rows("product_name", str_product_name=batch)),
    ]
    held, n = table_values(spark, files)
    own = {i: {v for f, c, v in held if f == i and c == "str_product_name"} for i in (1, 2, 3)}
    assert len(held) == n and own[1] == own[2] == own[3] == set(names("X"))


def test_values_under_any_name(spark):
    files = [file(1, "Jan-2020", month_rows(n=2)), file(2, "Feb-2020", month_rows("product_name", n=3)), file(3, None, month_rows("product_name", n=1))]
    assert S.field_values(spark.createDataFrame(files, SCHEMA), "str_product_name").count() == 6


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4).flatmap(lambda n: st.lists(st.lists(st.integers(0, 9), min_size=n, max_size=n), min_size=1, max_size=n)))
def test_assignment_is_the_cheapest(cost):
    got = S.assign([[float(x) for x in r] for r in cost])
    assert len(set(got)) == len(cost)
    best = min(sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(cost[0])), len(cost)))
    assert sum(cost[i][j] for i, j in enumerate(got)) == best
