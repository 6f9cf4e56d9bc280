"""Committed stores, keyed tables, guarded lookups, drift, extracts, slicers, pages."""

import datetime as dt
import itertools
import re
import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens import catalog
from claimlens.operators import denials, lookup, paging, recovery, slicers
from claimlens.plans.build import build_all, read_mart
from claimlens.plans.inspect import physical_plan
from claimlens.sinks import commits, keyed, publish
from claimlens.sources import drift, extract

from conftest import SF_SMALL

USERS = "user_id long, org_id int, email string, user_role string"
RECORDS = ("org_id int, external_ref string, service_date date, procedure_code string, insurer_name string, charge_amount decimal(12,2), "
           "remit_amount decimal(12,2), record_status string, submitted_by long")


# ------------------------------------------------------------------ J5

def _facts(spark):
    return spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 8, "a"), (4, None, "a"), (5, 9, None)], "id int, k int, s string")


def test_scalar_lookup_gives_the_one_value_or_null(spark):
    rates = spark.createDataFrame([(7, "a", 1.5), (8, "b", 2.0), (None, "a", 9.0)], "k int, s string, rate double")
    got = lookup.scalar_lookup(_facts(spark), rates, ["k", "s"], ["rate"])
    assert got.columns == ["id", "k", "s", "rate"]
    assert {r["id"]: r["rate"] for r in got.collect()} == {1: 1.5, 2: None, 3: None, 4: None, 5: None}
    assert [r["id"] for r in lookup.scalar_lookup(_facts(spark), rates, ["k", "s"], ["rate"], required=True).collect()] == [1]
    with pytest.raises(lookup.AmbiguousLookup):
        lookup.scalar_lookup(_facts(spark), rates.withColumn("id", F.lit(1)), ["k", "s"], ["id"])


@pytest.mark.parametrize("second", [1.5, 1.6])
def test_two_rows_for_a_used_key_fail(spark, second):
    rates = spark.createDataFrame([(7, "a", 1.5), (7, "a", second), (8, "a", 2.0)], "k int, s string, rate double")
    for required in (False, True):
        got = lookup.scalar_lookup(_facts(spark), rates, ["k", "s"], ["rate"], what="rate", required=required)
        with pytest.raises(Exception, match="rate: more than one row for"):
            got.collect()
        with pytest.raises(Exception, match="rate: more than one row for"):
            got.filter("rate > 0").collect()


def test_two_rows_for_a_key_that_no_fact_has_do_no_harm(spark):
    rates = spark.createDataFrame([(7, "a", 1.5), (99, "z", 1.0), (99, "z", 2.0), (None, "a", 1.0), (None, "a", 2.0)], "k int, s string, rate double")
    assert lookup.scalar_lookup(_facts(spark), rates, ["k", "s"], ["rate"]).filter("rate is not null").count() == 1
    assert [tuple(r) for r in lookup.lookup_conflicts(_facts(spark), rates, ["k", "s"]).collect()] == []


def test_doubled_rate_fails_the_detection_instead_of_doubling_claims(spark):
    from claimlens.sources import fixture

    claims, rates = catalog.wh(spark, SF_SMALL), fixture.expected_rates(spark, SF_SMALL)
    joined = recovery.underpayment_detection(claims, rates).collect()
    assert recovery.underpayment_lookup(claims, rates).collect() == joined
    one = claims.filter("status = 'Paid'").select("payer_id", "specialty").first()
    doubled = rates.unionByName(rates.filter((F.col("payer_id") == one[0]) & (F.col("specialty") == one[1])))
    assert recovery.underpayment_detection(claims, doubled).count() > len(joined)
    with pytest.raises(Exception, match="contracted rate: more than one row"):
        recovery.underpayment_lookup(claims, doubled).collect()


# ------------------------------------------------------------------ the log

def test_only_one_writer_gets_a_version(spark, tmp_path):
    stores = [commits.Store(spark, str(tmp_path / "s")) for _ in range(6)]
    won, barrier = [], threading.Barrier(6)

    def write(k):
        barrier.wait()
        if stores[k].publish(commits.Entry(0, False, {"rows": [f"data/{k}"]}, {})):
            won.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and stores[0].entries()[0].folders == {"rows": [f"data/{won[0]}"]}
    assert [p.name for p in (tmp_path / "s" / "log").iterdir() if not p.name.startswith(".")] == [f"{0:020d}.json"]  # no drafts left


def test_a_failed_refresh_leaves_the_old_tables(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path / "s"))
    a, b = spark.range(5).toDF("x"), spark.range(3).toDF("y")
    store.refresh({"a": a, "b": b})
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).alias("y"))
    with pytest.raises(Exception, match="half way"):
        store.refresh({"a": spark.range(9).toDF("x"), "b": broken})
    assert store.version() == 0 and store.read("a").count() == 5 and store.read("b").count() == 3
    store.refresh({"a": spark.range(9).toDF("x"), "b": b})
    assert store.version() == 1 and store.read("a").count() == 9
    with pytest.raises(ValueError):
        store.read("c")


def test_readers_keep_the_version_they_resolved(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path / "s"))
    store.refresh({"a": spark.range(5).toDF("x")})
    before = store.read("a")
    store.refresh({"a": spark.range(9).toDF("x")})
    assert before.count() == 5 and store.read("a").count() == 9
    assert len(store.expire(keep=1)) == 1 and store.read("a").count() == 9 and store.expire(keep=1) == []


def test_appends_are_compacted_and_batches_stay_known(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path / "s"))
    df = lambda lo, hi: spark.range(lo, hi).select("id", (F.col("id") % 2).cast("int").alias("org_id"))
    assert store.append(df(0, 4), "one", partition_by=["org_id"]).version == 0
    assert store.append(df(4, 6), "two", partition_by=["org_id"]).version == 1
    assert store.append(df(0, 4), "one", partition_by=["org_id"]) is None
    assert sorted(tuple(r) for r in store.read().collect()) == [(k, k % 2) for k in range(6)]
    stray = store.stage(df(90, 95), "rows", ["org_id"])  # a write in flight
    assert store.compact(partition_by=["org_id"]).version == 2
    assert len(store.entries()) == 1 and store.append(df(4, 6), "two") is None
    assert store.read().count() == 6
    assert len(store.expire(keep=1)) == 2 and store.read().count() == 6 and (tmp_path / "s" / stray).exists()


def test_a_batch_is_named_by_its_rows(spark):
    rows = [(1, "a", None), (2, "b", 1.5), (2, "b", 1.5)]
    df = spark.createDataFrame(rows, "x int, y string, z double")
    name = commits.content_name(df)
    assert commits.content_name(df.repartition(3).select("z", "x", "y")) == name
    assert commits.content_name(df.distinct()) != name and commits.content_name(df.fillna(0.0)) != name
    assert commits.content_name(df.limit(0)) == "0-" + "0" * 32


def _record(ref, org=10, charge="5", by=1):
    return (org, ref, dt.date(2026, 1, 2), "90001", "A", Decimal(charge), Decimal("0"), "paid", by)


def _append_case(spark, path):
    users = spark.createDataFrame([(1, 10, "a@x", "admin"), (2, 20, "b@x", "analyst"), (3, 10, "c@x", "viewer")], USERS)
    schema = T.StructType.fromDDL(RECORDS)
    return users, schema, commits.Store(spark, str(path)), lambda *rows: spark.createDataFrame(list(rows), RECORDS)


def test_a_retried_batch_is_in_the_store_once(spark, tmp_path):
    users, schema, store, batch = _append_case(spark, tmp_path / "s")
    rows = batch(_record("R1"), _record("R2", 20, by=2), _record("R3", by=3), _record("R1", 20, by=2))
    entry, told = publish.append_records(rows, users, store, schema)
    assert entry.version == 0 and {(r["org_id"], r["external_ref"], r["reject_reason"]) for r in told.collect()} == {
        (10, "R1", None), (20, "R2", None), (20, "R1", None), (10, "R3", "not_writer")}
    again, told = publish.append_records(rows.repartition(4), users, store, schema)
    assert again is None and told.count() == 0
    assert store.read(schema=schema).count() == 3 and store.version() == 0
    entry, told = publish.append_records(batch(_record("R1", charge="9"), _record("R4")), users, store, schema)
    assert {(r["external_ref"], r["reject_reason"]) for r in told.collect()} == {("R1", "already_exists"), ("R4", None)}
    assert {(r["org_id"], r["external_ref"], float(r["charge_amount"])) for r in store.read(schema=schema).collect()} == {
        (10, "R1", 5.0), (20, "R1", 5.0), (20, "R2", 5.0), (10, "R4", 5.0)}


@pytest.mark.parametrize("compacted", [False, True])
def test_a_batch_that_loses_the_race_is_checked_again(spark, tmp_path, monkeypatch, compacted):
    users, schema, store, batch = _append_case(spark, tmp_path / "s")
    publish.append_records(batch(_record("OLD")), users, store, schema)
    rival, real, raced = commits.Store(spark, str(tmp_path / "s")), commits.Store.publish, []

    def publish_after_rival(self, entry):
        if self is store and not raced:  # another writer commits between this batch's check and its entry
            raced.append(1)
            publish.append_records(batch(_record("BOTH", charge="7"), _record("THEIRS")), users, rival, schema)
            if compacted:
                assert rival.compact(partition_by=["org_id"])
        return real(self, entry)

    monkeypatch.setattr(commits.Store, "publish", publish_after_rival)
    entry, told = publish.append_records(batch(_record("BOTH", charge="1"), _record("MINE")), users, store, schema)
    assert entry.version == (3 if compacted else 2)
    assert {(r["external_ref"], r["reject_reason"]) for r in told.collect()} == {("BOTH", "already_exists"), ("MINE", None)}
    assert sorted((r["external_ref"], float(r["charge_amount"])) for r in store.read(schema=schema).collect()) == [
        ("BOTH", 7.0), ("MINE", 5.0), ("OLD", 5.0), ("THEIRS", 5.0)]


def test_writers_at_once_leave_each_key_once(spark, tmp_path):
    users, schema, _, batch = _append_case(spark, tmp_path / "s")
    batches = [batch(*[_record(f"K{k}", charge=str(w + 1)) for k in range(w, w + 4)]) for w in range(4)]
    batches.append(batches[0])  # a retry of the first, at the same time
    failed = []

    def write(k):
        try:
            publish.append_records(batches[k], users, commits.Store(spark, str(tmp_path / "s")), schema)
        except Exception as e:  # shown by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = commits.Store(spark, str(tmp_path / "s")).read(schema=schema).collect()
    assert failed == [] and sorted(r["external_ref"] for r in rows) == [f"K{k}" for k in range(7)]


def test_a_build_replaces_all_marts_at_once(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    build_all(spark, SF_SMALL, out)
    first = {n: read_mart(spark, out, n).count() for n in ("payer_scorecard", "recovery_opportunities", "stg_claims")}
    assert first["stg_claims"] == 1500 and "claim_month" in read_mart(spark, out, "stg_claims").columns

    def fails(*a, **k):
        raise RuntimeError("the documents cannot be written")

    with monkeypatch.context() as m:
        m.setattr(publish, "publish_json", fails)
        with pytest.raises(RuntimeError):
            build_all(spark, SF_SMALL, out)
    assert commits.Store(spark, out).version() == 0
    assert {n: read_mart(spark, out, n).count() for n in first} == first
    build_all(spark, SF_SMALL, out, keep=1)
    assert commits.Store(spark, out).version() == 1 and {n: read_mart(spark, out, n).count() for n in first} == first


# ------------------------------------------------------------------ S3

def test_drift_at_every_depth(spark):
    want = T.StructType.fromDDL("a string, s struct<x: bigint, y: struct<z: double>>, l array<struct<p: string, q: array<double>>>, d double, n bigint")
    found = T.StructType.fromDDL("s struct<x: string, y: struct<w: double>>, l array<struct<p: string, q: array<string>, r: bigint>>, d bigint, n double, extra boolean")
    got = {(r["path"], r["kind"], r["expected"], r["found"]) for r in drift.schema_drift(spark, found, want).collect()}
    assert got == {("a", "missing", "string", None), ("s.x", "retyped", "bigint", "string"), ("s.y.z", "missing", "double", None), ("s.y.w", "extra", None, "double"),
                   ("l[].q[]", "retyped", "double", "string"), ("l[].r", "extra", None, "bigint"), ("n", "retyped", "bigint", "double"), ("extra", "extra", None, "boolean")}
    assert drift.schema_drift(spark, want, want).count() == 0
    whole = drift.schema_drift(spark, T.StructType.fromDDL("a array<string>"), T.StructType.fromDDL("a struct<x: int>")).collect()
    assert [r["kind"] for r in whole] == ["retyped"]


def test_inferred_document_conforms(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"n": 3, "s": {"x": 1, "more": [1]}, "l": [{"p": "u", "q": 2}, {"p": "v"}, null], "new": true}')
    df = drift.infer_document(spark, str(tmp_path / "d.json"))
    want = T.StructType.fromDDL("n double, s struct<x: bigint, y: string>, l array<struct<q: double, p: string>>, gone date")
    row = drift.conform(df, want).first()
    assert drift.conform(df, want).schema.simpleString() == want.simpleString()
    assert row["n"] == 3.0 and tuple(row["s"]) == (1, None) and row["gone"] is None
    assert [x and tuple(x) for x in row["l"]] == [(2.0, "u"), (None, "v"), None]


def test_unnest_takes_structs_apart(spark):
    df = spark.createDataFrame([([(1, ("a", (2, "b"))), (3, None)],)], "l array<struct<x: int, s: struct<y: string, t: struct<x: int, z: string>>>>")
    got = drift.unnest(df, "l")
    assert got.columns == ["x", "y", "t_x", "z"]
    assert [tuple(r) for r in got.collect()] == [(1, "a", 2, "b"), (3, None, None, None)]


# ------------------------------------------------------------------ Q1

def test_key_checks_move_no_fact_row(spark, tmp_path):
    facts = spark.range(1000).select(F.when(F.col("id") != 7, F.concat(F.lit("C"), (F.col("id") % 990).cast("string"))).alias("key"), F.col("id").alias("v"))
    table = keyed.write_keyed(facts, ["key"], str(tmp_path / "t"), buckets=4)
    twice = keyed.repeated_keys(table, ["key"])
    assert "Exchange" not in physical_plan(twice)
    assert {r["key"]: r["occurrences"] for r in twice.collect()} == {f"C{k}": 2 for k in range(10) if k != 7}
    batch = spark.createDataFrame([("C1",), ("C1",), ("none",), (None,)], "key string")
    known = keyed.known_keys(batch, table, ["key"])
    plan = physical_plan(known)
    below = plan[plan.index("LeftSemi"):]
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
    assert sorted((r["key"] or "", r["exists"]) for r in known.collect()) == [("", False), ("C1", True), ("C1", True), ("none", False)]
    assert below.count("Exchange") <= plan.count("Exchange")
    joined = table.join(spark.createDataFrame([("C1", 5)], "key string, w int").repartition(4, "key").hint("merge"), "key")
    assert physical_plan(joined).count("Exchange hashpartitioning") <= 2 and joined.count() == 2


def test_buckets_follow_from_bytes(spark, tmp_path):
    spark.range(100_000).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    assert keyed.buckets_for(df) == 1
    n = keyed.buckets_for(df, 50_000)
    assert n >= 4 and n & (n - 1) == 0


def test_a_bucket_is_small_enough_to_be_sorted(spark, tmp_path):
    """A task's rows do not grow with the table: twice the rows, twice the buckets, none much larger than the others."""
    def facts(n):
        path = str(tmp_path / f"facts{n}")
        spark.range(n, numPartitions=2).select(F.xxhash64("id").cast("string").alias("key"), "id").write.parquet(path)
        return spark.read.parquet(path)

    few, many = (keyed.write_keyed(facts(n), ["key"], str(tmp_path / f"t{n}")) for n in (600_000, 1_200_000))
    assert 2 <= keyed.buckets_for(few) < keyed.buckets_for(many)
    sizes = many.groupBy(F.input_file_name().alias("bucket")).count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) <= 330_000 and sum(r["count"] for r in sizes) == 1_200_000


# ------------------------------------------------------------------ F9

def test_every_slice_equals_the_direct_filter(spark, tmp_path):
    claims = recovery.with_recovery(catalog.stg(spark, SF_SMALL), catalog.seed(spark))
    claims = claims.withColumn("payer", F.when(F.col("payer") != "NATION_3", F.col("payer")))  # some have none
    cube = slicers.write_cube(slicers.slice_cube(claims), str(tmp_path / "cube"))
    found = {(r["payer"], r["specialty"], r["period"]) for r in claims.select("payer", "specialty", slicers.fiscal_period("claim_date").alias("period")).collect()}
    sample = sorted(found, key=str)[:: max(1, len(found) // 6)]
    for payer, specialty, period in sample:
        for a, b, c in itertools.product((slicers.ALL, payer), (slicers.ALL, specialty), (slicers.ALL, period)):
            direct = claims.filter(F.col("payer").isNull()) if a is None else denials.slice_claims(claims, payer=None if a is slicers.ALL else a)
            direct = denials.slice_claims(direct, specialty=None if b is slicers.ALL else b, period=None if c is slicers.ALL else slicers.period_bounds(c))
            want = denials.kpi_denial(direct)
            got = slicers.kpis(slicers.slice_of(cube, a, b, c)).select(*want.columns)
            assert got.collect() == want.collect()
    assert slicers.slice_of(cube, payer="nobody").count() == 0
    plan = physical_plan(slicers.slice_of(cube, payer="NATION_6"))
    assert re.search(r"PartitionFilters: \[.*slicers#\d+ = 3", plan) and re.search(r"PushedFilters: \[.*EqualNullSafe\(payer,NATION_6\)", plan)


def test_fiscal_periods(spark):
    days = ["1996-06-30", "1996-07-01", "1997-06-30", "1999-12-31"]
    got = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "d date").select(slicers.fiscal_period("d")).collect()
    assert [r[0] for r in got] == ["1995-07 1996-06", "1996-07 1997-06", "1996-07 1997-06", "1999-07 2000-06"]
    assert slicers.period_bounds("1996-07 1997-06") == (dt.date(1996, 7, 1), dt.date(1997, 7, 1))
    assert slicers.period_bounds("1996-01 1996-12") == (dt.date(1996, 1, 1), dt.date(1997, 1, 1))
    assert spark.range(1).select(slicers.fiscal_period(F.lit(dt.date(1996, 3, 1)), 1)).first()[0] == "1996-01 1996-12"


# ------------------------------------------------------------------ S1

def test_bad_lines_are_landed_with_their_reasons(spark, tmp_path):
    schema = T.StructType.fromDDL("id string, day date, amount decimal(8,2), note string")
    lines = ["id,day,amount,note", "a,2026-01-02,5.50,fine", 'b,2026-01-03,1.00,"quoted, comma"', ",2026-01-02,1,", "c,02/01/2026,1,x", "d,2026-01-02,12e,x",
             "e,2026-13-02,,", "f,2026-01-02", "g,2026-01-02,1,x,y", "h,2026-01-02,99999999999,bad", "i,2026-01-02,1,odd"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text("\n".join(lines) + "\n")
    landed = extract.land_extract(spark, str(tmp_path / "in"), str(tmp_path / "out"), schema, ["id", "amount"], {"note": ["fine", "quoted, comma", "x", "bad"]})
    assert sorted(tuple(r) for r in landed.accepted.collect()) == [("a", dt.date(2026, 1, 2), Decimal("5.50"), "fine"), ("b", dt.date(2026, 1, 3), Decimal("1.00"), "quoted, comma")]
    bad = {(r["id"], tuple(r["reasons"])) for r in landed.rejected.collect()}
    assert bad == {(None, ("missing:id",)), ("c", ("type:day",)), ("d", ("type:amount",)), ("e", ("type:day", "missing:amount")), ("f", ("columns",)), ("g", ("columns",)),
                   ("h", ("type:amount",)), ("i", ("value:note",))}
    kept = {r["id"]: (r["amount"], r["_line"]) for r in landed.rejected.collect()}
    assert kept["d"] == ("12e", None) and kept["g"][1] == "g,2026-01-02,1,x,y" and kept["f"][1] == "f,2026-01-02"
    assert {r["reason"]: r["lines"] for r in extract.reject_summary(landed.rejected).collect()} == {
        "missing:id": 1, "type:day": 2, "type:amount": 2, "missing:amount": 1, "columns": 2, "value:note": 1}
    assert "PartitionFilters" in physical_plan(landed.accepted)


def test_differences_row_by_row(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "z", 3.0), (4, "w", None)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.5), (4, "q", 1.0), (5, "n", 0.0)], "k int, s string, v double")
    got = sorted((r["k"], r["side"], r["columns"]) for r in extract.differences(a, b, ["k"]).collect())
    assert got == [(2, "both", ["v"]), (3, "left", None), (4, "both", ["s", "v"]), (5, "right", None)]
    assert extract.differences(a, a, ["k"]).count() == 0


# ------------------------------------------------------------------ K7

def _listing(spark, path, range_rows):
    rows = [(dt.date(2026, 1, 1 + k % 5) if k % 11 else None, f"R{k:03d}", k) for k in range(200)]
    df = spark.createDataFrame(rows, "service_date date, external_ref string, v int").repartition(3)
    want = [r[1] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or dt.date.min, r[1]))]
    return paging.lay_out(df, str(path), range_rows=range_rows), want


@pytest.mark.parametrize("range_rows, size", [(20, 7), (20, 50), (1000, 33), (3, 200)])
def test_pages_put_together_are_the_order(spark, tmp_path, range_rows, size):
    listing, want = _listing(spark, tmp_path / "l", range_rows)
    got = list(listing.pages(size))
    assert [r["external_ref"] for page in got for r in page] == want
    assert [len(p) for p in got] == [size] * (len(want) // size) + ([len(want) % size] if len(want) % size else [])
    placed = listing.placed().collect()
    assert [r["external_ref"] for r in sorted(placed, key=lambda r: r["place"])] == want and {r["place"] for r in placed} == set(range(1, 201))


def test_a_page_reads_few_ranges(spark, tmp_path):
    listing, want = _listing(spark, tmp_path / "l", 10)
    n = listing.manifest.count()
    assert n >= 15
    page = listing.page(10, (dt.date(2026, 1, 3), "R100"))
    ranges = re.search(r"PartitionFilters: \[.*range#\d+ (IN|=|INSET) (\S.*?)\]", physical_plan(page))
    assert ranges and 1 <= ranges.group(2).count(",") + 1 <= 4
    assert listing.page(5, (dt.date(2027, 1, 1), "")).collect() == []
    empty = paging.lay_out(listing.rows.drop("range").limit(0), str(tmp_path / "e"))
    assert empty.page(5).collect() == [] and list(empty.pages(5)) == []
