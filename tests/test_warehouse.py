"""Files to marts and back: ingest, clean, rebuild, roll back, stream."""

import csv

import pytest
from pyspark.sql import functions as F

from tillworks import session
from tillworks.functions.lookups import REVIEW_HEADERS, SALES_HEADERS
from tillworks.operators import cleaning
from tillworks.plans import warehouse
from tillworks.sources import files, tables, versions
from tillworks.sources.versions import Snapshot
from tillworks.streaming import ingest as streaming

SALES_1 = [
    ["o1", " Ann ", "Bakery", "Cakes", "Oslo", "OS", "North", "2020-01-05", "10.50", "0.1", "2.00"],
    ["o2", "Bob", "Snacks", "Chips", "Oslo", "OS", "North", "2020-02-07", "bad", "0.0", "1.00"],
    ["o3", "Ann", "Bakery", "Cakes", "Oslo", "OS", "North", "2020-02-09", "5.00", "", "0.50"],
]
SALES_2 = [
    ["o3", "Ann", "Bakery", "Cakes", "Oslo", "OS", "North", "2020-02-09", "7.00", "", "0.70"],
    ["o4", "Cid", "Snacks", "Nuts", "Rome", "RM", "South", "2020-03-01", "9.00", "0.2", "3.00"],
]
TIME_2018_03 = 1519862400  # 2018-03-01
REVIEWS = [
    ["p 1", "Rye", "u1", TIME_2018_03, 5, 'Great, "fresh"\nand good', "grocery gourmet food", "breads bakery", "breads"],
    ["p2", "Tea", "u2", TIME_2018_03, 2, "bad tea", "grocery gourmet food", "beverages", "tea"],
    ["p3", "Cat", "u3", TIME_2018_03, 4, "ok", "pet supplies", "toys", "toys"],
    ["p4", "Old", "u4", 0, 4, "ok", "grocery gourmet food", "beverages", "tea"],
]


def write(path, headers, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(headers)
        out.writerows(rows)
    return str(path)


@pytest.fixture
def loaded(spark, tmp_path):
    root = str(tmp_path / "store")
    first = write(tmp_path / "s1.csv", SALES_HEADERS, SALES_1)
    second = write(tmp_path / "s2.csv", SALES_HEADERS, SALES_2)
    rated = write(tmp_path / "r.csv", REVIEW_HEADERS, REVIEWS)
    for path, kind, batch in ((first, "sales", "b1"), (second, "sales", "b2"), (rated, "reviews", "r1")):
        warehouse.ingest(spark, root, path, kind, 2020, batch)
        warehouse.clean_batch(spark, root, kind, batch)
    return root


def growth(spark, root):
    return {r.sales_month.month: r.total_sales for r in warehouse.mart(spark, root, "sales_growth").collect()}


def test_files_to_marts_and_back(spark, loaded):
    warehouse.rebuild_marts(spark, loaded)
    # The later load of order o3 wins; the unreadable amount of o2 is NULL.
    assert growth(spark, loaded) == {1: 10.5, 2: 7.0, 3: 9.0}
    assert warehouse.mart(spark, loaded, "dim_customer").count() == 3
    assert {r.category for r in warehouse.mart(spark, loaded, "customer_review_matched").collect()} == {"Bakery", "Beverages"}
    summary = {r.category: r.total_reviews for r in warehouse.mart(spark, loaded, "sales_review_score_summary").collect()}
    assert summary == {"Bakery": 1, "Snacks": 0}
    months = {r.year_month for r in warehouse.mart(spark, loaded, "dim_month").collect()}
    assert months == {"2020-01", "2020-02", "2020-03", "2018-03"}

    warehouse.roll_back(spark, loaded, "b2")
    warehouse.rebuild_marts(spark, loaded)
    assert growth(spark, loaded) == {1: 10.5, 2: 5.0}
    assert {r.customer_id for r in warehouse.mart(spark, loaded, "dim_customer").collect()} == {"AnnOslo", "BobOslo"}
    status = {r.batch_id: r.status for r in tables.current_status(warehouse.ledger(spark, loaded)).collect()}
    assert status == {"b1": "clean_loaded", "b2": "rolled_back", "r1": "clean_loaded"}

    again = loaded.replace("store", "s2.csv")
    warehouse.ingest(spark, loaded, again, "sales", 2020, "b3")
    warehouse.clean_batch(spark, loaded, "sales", "b3")
    warehouse.rebuild_marts(spark, loaded)
    assert growth(spark, loaded) == {1: 10.5, 2: 7.0, 3: 9.0}


def test_review_content_and_segments(spark, loaded):
    warehouse.rebuild_marts(spark, loaded)
    sales = warehouse.mart(spark, loaded, "products_transactions")
    # Bring the sales to the review month, so that the two sides meet.
    moved = sales.withColumn("sales_month", F.lit("2018-03-01").cast("date")).collect()
    schema = sales.schema
    warehouse.save_mart(spark.createDataFrame(moved, schema), loaded, "products_transactions")
    matched = warehouse.mart(spark, loaded, "customer_review_matched")
    vectors = matched.select("review_id", F.array(F.lit(1.0), F.lit(0.2)).cast("array<float>").alias("embedding"))
    topics = spark.createDataFrame([(0, "Price", [1.0, 0.0]), (1, "Quality", [0.0, 1.0])], "topic_no int, topic string, vector array<double>")
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    warehouse.review_content(spark, loaded, vectors, topics, lexicon)
    processed = {r.product_id: r for r in warehouse.mart(spark, loaded, "review_processed").collect()}
    assert processed["p1"].sentiment_label == "Positive" and processed["p2"].sentiment_label == "Negative"
    assert processed["p1"].clean_review_text == "great fresh and good" and processed["p1"].primary_topic == "Price"
    warehouse.segmentation(spark, loaded)
    segments = warehouse.mart(spark, loaded, "monthly_category_segmentation").collect()
    assert [s.category for s in segments] == ["bakery"] * len(segments) and segments[0].segment == "Strong Performer"
    assert set(warehouse.score_analysis(spark, loaded)) >= {"kpi_summary", "correlations"}


def test_load_summary_and_batch_pruning(spark, loaded, capsys):
    rows = spark.read.parquet(f"{loaded}/raw_sales")
    summary = files.load_summary(rows, "b1").collect()[0]
    assert (summary.rows_inserted, summary.table_total_rows) == (3, 5)
    tables.read_batch(spark, f"{loaded}/raw_sales", "b1").explain("formatted")
    assert "PartitionFilters: [isnotnull(batch_id" in capsys.readouterr().out


def test_missing_headers_are_named(spark, tmp_path):
    path = write(tmp_path / "x.csv", ["Order ID", "Sales"], [["1", "2"]])
    with pytest.raises(ValueError, match="'Category', 'City'"):
        files.read_upload(spark, path, "sales", "b")
    with pytest.raises(ValueError):
        files.read_upload(spark, path, "stock", "b")
    with pytest.raises(ValueError):
        files.scan_csv(spark, str(tmp_path / "x.xlsx"))


def test_preview_is_clamped(spark):
    df = spark.range(500)
    assert [files.preview(df, n).count() for n in (-5, 0, 1, 20, 1000)] == [1, 1, 1, 20, 100]


def test_unknown_status_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.record_status(spark, str(tmp_path / "ledger"), "b", "lost", 1)


def test_duplicates_are_reported(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "order_id string")
    assert [tuple(r) for r in cleaning.duplicate_orders(df).collect()] == [("a", 2)]


def test_last_load_of_an_order_wins(spark):
    rows = [("a", 1, 5.0), ("a", 2, 7.0), ("b", 1, 1.0), (None, 1, 2.0), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "order_id string, loaded_at int, sales double")
    got = sorted(map(tuple, cleaning.last_per_order(df, "loaded_at").collect()), key=str)
    assert got == [("a", 2, 7.0), ("b", 1, 1.0), (None, 1, 2.0), (None, 1, 2.0)]


def test_streamed_uploads_load_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", SALES_HEADERS, SALES_1)
    raw, state = str(tmp_path / "raw"), str(tmp_path / "state")
    for _ in range(2):  # the second run finds nothing new
        streaming.stream_to_raw(spark, str(folder), "sales", raw, state).awaitTermination(120)
    assert spark.read.parquet(raw).count() == 3
    write(folder / "b.csv", SALES_HEADERS, SALES_2)
    streaming.stream_to_raw(spark, str(folder), "sales", raw, state).awaitTermination(120)
    rows = spark.read.parquet(raw)
    assert rows.count() == 5 and rows.select("batch_id").distinct().count() == 2


def test_files_with_reordered_headers_are_united_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", ["a", "b"], [["1", "2"]])
    write(tmp_path / "b.csv", ["b", "a"], [["20", "10"]])
    rows = files.scan_csv(spark, str(tmp_path)).select("a", "b").collect()
    assert sorted(map(tuple, rows)) == [("1", "2"), ("10", "20")]


def test_a_batch_stored_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        tables.append_rows(spark.createDataFrame([(1, "b1"), (2, "b1")], "x int, batch_id string"), path)
    tables.append_rows(spark.createDataFrame([(3, "b2")], "x int, batch_id string"), path)
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_one_run_with_sales_only_reviews_only_and_both(spark, loaded, tmp_path):
    assert warehouse.loaded_kinds(spark, loaded) == {"sales", "reviews"}
    assert warehouse.refresh(spark, loaded) == ["marts", "forecasts"]
    assert warehouse.mart(spark, loaded, "customer_review_matched").count() == 2
    warehouse.roll_back(spark, loaded, "r1")
    assert warehouse.loaded_kinds(spark, loaded) == {"sales"}
    assert warehouse.refresh(spark, loaded) == ["marts", "forecasts"]
    only = str(tmp_path / "only")
    rated = write(tmp_path / "again.csv", REVIEW_HEADERS, REVIEWS)
    for _ in range(2):
        warehouse.ingest(spark, only, rated, "reviews", 2020, "r1")
        warehouse.clean_batch(spark, only, "reviews", "r1")
    assert warehouse.refresh(spark, only) == []
    assert warehouse.active(spark, only, "reviews").count() == spark.read.parquet(f"{loaded}/reviews").count()


# --- partials, versions, streams --------------------------------------------


def order_rows(spark, rows):
    df = spark.createDataFrame(rows, "order_id string, batch_id string, loaded_at int, order_date string, category string, amount double, customer_id string")
    return df.select(
        "order_id", "batch_id", "loaded_at", F.col("order_date").cast("date").alias("order_date"), "category",
        F.col("amount").cast("decimal(18,2)").alias("sales"), F.lit(1).cast("decimal(18,2)").alias("profit"),
        "customer_id", F.col("customer_id").alias("customer_name"), F.lit("Oslo").alias("city"),
        F.concat("category", F.lit("x")).alias("product_id"), F.lit("x").alias("subcategory"),
    )


THREE_LOADS = [
    ("o1", "b1", 1, "2020-01-05", "Tea", 10.0, "Ann"),
    ("o2", "b1", 1, "2020-01-06", "Tea", 20.0, "Bob"),
    ("o2", "b1", 1, "2020-01-06", "Tea", 19.0, "Bob"),  # twice in one file: the larger row settles the tie
    (None, "b1", 1, "2020-01-07", "Rye", 1.0, "Cid"),
    (None, "b1", 1, "2020-01-07", "Rye", 1.0, "Cid"),
    ("o2", "b2", 2, "2020-02-06", "Rye", 30.0, "Bob"),
    ("o3", "b2", 2, None, None, 5.0, "Dan"),
    ("o2", "b3", 3, "2020-03-06", "Tea", 40.0, "Eve"),
    ("o1", "b3", 3, "2020-01-05", "Tea", 11.0, "Ann"),
]


def plain_marts(rows, active):
    """The growth mart, category months and first months from the rows themselves."""
    last, unnamed = {}, []
    for r in sorted((r for r in rows if r[1] in active), key=lambda r: (r[2], r[5])):
        if r[0] is None:
            unnamed.append(r)
        else:
            last[r[0]] = r
    counted = [*last.values(), *unnamed]
    months, firsts = {}, {}
    for _, _, _, day, category, amount, customer in counted:
        total, n = months.get((category, day and day[:7]), (0, 0))
        months[category, day and day[:7]] = (total + amount, n + (category is not None))
        firsts[customer] = min(filter(None, [firsts.get(customer), day]), default=None)
    return months, {c: d and d[:7] for c, d in firsts.items()}


def stored_marts(spark, root):
    seen = Snapshot(spark, root)
    months = {(r.category, r.sales_month and str(r.sales_month)[:7]): (float(r.total_sales), r.total_transactions) for r in seen.mart("products_transactions").collect()}
    return months, {r.customer_id: r.first_month and str(r.first_month)[:7] for r in seen.mart("dim_customer").collect()}


def note(spark, root, batch, status, number):
    tables.record_status(spark, f"{root}/ledger", batch, status, number, dataset_type="sales")


@pytest.fixture
def contested(spark, tmp_path):
    root = str(tmp_path / "contested")
    for batch in ("b1", "b2", "b3"):
        warehouse.store_sales(spark, root, order_rows(spark, [r for r in THREE_LOADS if r[1] == batch]), [batch])
        note(spark, root, batch, "clean_loaded", 2)
    return root


def test_orders_of_several_batches_count_once_whatever_is_rolled_back(spark, contested):
    active = {"b1", "b2", "b3"}
    for gone in (None, "b3", "b1"):
        if gone:
            warehouse.roll_back(spark, contested, gone)
            active.discard(gone)
        warehouse.rebuild_marts(spark, contested, with_reviews=False)
        assert stored_marts(spark, contested) == plain_marts(THREE_LOADS, active), gone
        assert {r.order_id for r in warehouse.sales_fact(spark, contested).collect()} == {r[0] for r in THREE_LOADS if r[1] in active}
    # A batch that is stored again replaces itself in every table.
    warehouse.store_sales(spark, contested, order_rows(spark, [("o2", "b2", 2, "2020-02-06", "Rye", 31.0, "Bob")]), ["b2"])
    warehouse.rebuild_marts(spark, contested, with_reviews=False)
    assert stored_marts(spark, contested) == ({("Rye", "2020-02"): (31.0, 1)}, {"Bob": "2020-02"})


def test_batches_stored_together_equal_batches_stored_one_by_one(spark, contested, tmp_path):
    root = str(tmp_path / "together")
    warehouse.store_sales(spark, root, order_rows(spark, THREE_LOADS), ["b1", "b2", "b3"])
    for batch in ("b1", "b2", "b3"):
        note(spark, root, batch, "clean_loaded", 2)
    for store in (root, contested):
        warehouse.rebuild_marts(spark, store, with_reviews=False)
    assert stored_marts(spark, root) == stored_marts(spark, contested)


def test_a_rebuild_reads_partials_and_no_fact(spark, contested):
    merged = warehouse.merged_sales(spark, contested, ["b1", "b3"])
    for name, frame in merged.items():
        assert {f.split(f"{contested}/")[1].split("/")[0] for f in frame.inputFiles()} <= {f"partial_{name}", "contested_sales"}
        assert "PartitionFilters: [concat_ws(/, load" in frame._jdf.queryExecution().executedPlan().toString()


def test_readers_see_whole_versions(spark, tmp_path):
    root = str(tmp_path / "versions")
    one, two = spark.range(3), spark.range(5)
    with pytest.raises(KeyError):
        Snapshot(spark, root).mart("a")
    with versions.rebuild(spark, root) as build:
        build.save(one, "a")
        build.save(one, "b")
        with pytest.raises(KeyError):  # nobody else sees it yet
            Snapshot(spark, root).mart("a")
    pinned = Snapshot(spark, root)
    with pytest.raises(RuntimeError):
        with versions.rebuild(spark, root) as broken:
            broken.save(two, "a")
            assert broken.mart("a").count() == 5 and broken.mart("b").count() == 3
            raise RuntimeError("executor lost")
    assert Snapshot(spark, root).version == pinned.version and Snapshot(spark, root).mart("a").count() == 3
    with versions.rebuild(spark, root) as build:
        build.save(two, "a")
    now = Snapshot(spark, root)
    assert (now.mart("a").count(), now.mart("b").count(), now.number) == (5, 3, 2)
    assert pinned.mart("a").count() == 3
    assert versions.expire(spark, root, keep=2) == [broken.version]
    assert versions.expire(spark, root, keep=1) == []  # b is still read from the first version
    assert Snapshot(spark, root).mart("b").count() == 3


def test_a_new_checkpoint_does_not_overwrite_earlier_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", SALES_HEADERS, SALES_1)
    raw = str(tmp_path / "raw")
    for state in ("one", "two"):
        streaming.stream_to_raw(spark, str(folder), "sales", raw, str(tmp_path / state)).awaitTermination(120)
    assert spark.read.parquet(raw).select("batch_id").distinct().count() == 2


def test_a_repeated_clean_step_gives_the_same_review_ids(spark, loaded):
    first = {r.review_id for r in spark.read.parquet(f"{loaded}/reviews").collect()}
    warehouse.clean_batch(spark, loaded, "reviews", "r1")
    assert first == {r.review_id for r in spark.read.parquet(f"{loaded}/reviews").collect()} and len(first) == 2


def test_a_local_session_needs_no_named_folder(spark, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "local[2]"

    class Session:
        conf, sparkContext = Conf(), Context()

    own = session.shared_folder(Session())
    assert session.shared_folder(Session()) == own and session.fresh_path(Session(), "x").startswith(own)
    Context.master = "spark://host:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_headers_of_many_files_are_found_in_one_pass(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    for i in range(60):
        head = [["a", "b"], ["b", "a"], ["a", 'say "b"', "c,d"]][i % 3]
        write(folder / f"f{i}.csv", head, [[f"{i}-{h}" for h in head]])
    (folder / "empty.csv").touch()
    found = files.headers_found(spark, str(folder))
    assert sorted((columns, len(paths)) for columns, paths in found.values()) == [(("a", "b"), 20), (("a", 'say "b"', "c,d"), 20), (("b", "a"), 20)]
    rows = files.scan_csv(spark, str(folder)).collect()
    assert sorted((r["a"], r["b"], r["c,d"]) for r in rows) == sorted(
        (f"{i}-a", f"{i}-b" if i % 3 < 2 else None, f"{i}-c,d" if i % 3 == 2 else None) for i in range(60)
    )


def test_missing_headers_of_every_upload(spark, tmp_path):
    heads = list(SALES_HEADERS)
    write(tmp_path / "whole.csv", heads, [["1"] * len(heads)])
    write(tmp_path / "more.csv", [*reversed(heads), "Extra"], [["1"] * (len(heads) + 1)])
    write(tmp_path / "short.csv", heads[2:], [["1"] * (len(heads) - 2)])
    found = files.missing_headers(spark, str(tmp_path), "sales").collect()
    assert {(r.file.rsplit("/", 1)[1], r.missing) for r in found} == {("short.csv", heads[0]), ("short.csv", heads[1])}


def test_only_orders_that_come_twice_are_compared_row_by_row(spark, tmp_path, monkeypatch):
    shared, root = tmp_path / "shared", str(tmp_path / "store")
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(shared))
    rows = [(f"o{i}", "b1", 1, i) for i in range(50)] + [("o7", "b1", 2, 70), ("o8", "b2", 3, 80), (None, "b1", 1, 5), (None, "b1", 1, 5)]
    warehouse.store_sales(spark, root, order_rows_of(spark, rows), ["b1", "b2"])
    # before, all rows were written once more, and all order ids
    settled = spark.read.parquet(*[str(p) for p in shared.glob("settled-sales-*")])
    assert {(r.order_id, r.batch_id) for r in settled.collect()} == {("o7", "b1"), ("o8", "b1"), ("o8", "b2")}
    assert not list(shared.glob("order-ids-*"))
    days = warehouse.merged_sales(spark, root, ["b1", "b2"])["day_category"].collect()
    # o7 counts 70 and o8 80, the last ones; rows without an id all count
    assert float(sum(r.sales for r in days)) == sum(range(50)) - 7 + 70 - 8 + 80 + 10 and sum(r["lines"] for r in days) == 52


def order_rows_of(spark, rows):
    frame = spark.createDataFrame([(o, b, at, float(s)) for o, b, at, s in rows], "order_id string, batch_id string, loaded_at int, amount double")
    return frame.select(
        "order_id", "batch_id", "loaded_at", F.col("amount").cast("decimal(18,2)").alias("sales"), F.lit(1).cast("decimal(18,2)").alias("profit"),
        *[F.lit(c).alias(c) for c in ("customer_id", "customer_name", "city", "category", "subcategory", "product_id")], F.lit("2020-01-05").cast("date").alias("order_date"),
    )


def test_rows_in_parts_replace_their_batches(spark, tmp_path):
    path = str(tmp_path / "rows")
    frame = lambda rows: spark.createDataFrame(rows, "x int, batch_id string")
    assert tables.append_parts(spark, [frame([(1, "a"), (2, "b 1/2")]), frame([]), frame([(3, "c")])], path) == ["a", "b 1/2", "c"]
    # "b 1/2" is only in the second frame
    assert tables.append_parts(spark, [frame([(4, "a")]), frame([(5, "a"), (6, "b 1/2")])], path) == ["a", "b 1/2"]
    assert sorted((r.x, r.batch_id) for r in spark.read.parquet(path).collect()) == [(3, "c"), (4, "a"), (5, "a"), (6, "b 1/2")]
    assert tables.append_parts(spark, [frame([])], path) == []


def test_the_lines_of_a_store_are_joined_in_parts(spark, sf_dir, monkeypatch):
    from tillworks.plans import catalog_store

    (whole,) = catalog_store.sales_parts(spark, sf_dir)
    monkeypatch.setattr(catalog_store, "PART_BYTES", 40_000)
    parts = [part.collect() for part in catalog_store.sales_parts(spark, sf_dir)]
    assert len(parts) > 2 and all(len(part) < 4_000 for part in parts)
    assert sorted(row for part in parts for row in part) == sorted(whole.collect())


@pytest.mark.parametrize("name", ["read_during_rebuild", "mart_rebuild", "batch_rollback"])
def test_a_store_loaded_in_parts_shows_the_same(spark, sf_dir, tmp_path, monkeypatch, name):
    from tillworks.plans import catalog_store

    show = getattr(catalog_store, name)
    plain = sorted(map(str, show(spark, sf_dir).collect()))
    monkeypatch.setattr(catalog_store, "_STORES", {})
    monkeypatch.setattr(catalog_store, "PART_BYTES", 60_000)
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    assert sorted(map(str, show(spark, sf_dir).collect())) == plain
    # before, the store's rows and order ids were written a second time; now only the corrected orders are, from both batches
    fixed = sum(catalog_store.corrected(part).count() for part in catalog_store.sales_parts(spark, sf_dir))
    assert spark.read.parquet(*[str(p) for p in tmp_path.glob("settled-sales-*")]).count() == 2 * fixed
