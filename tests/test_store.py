"""The bucketed store: what stays by reference, batches that come twice, and runs that are cut off."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from offerloom.operators import lifecycle, store
from offerloom.plans import lifecycle_queries as lq
from offerloom.streaming import streams


def rows(spark, offers):
    kind = "merchant_id string, pos long, title string, bank string, wallet string, discount string, valid_days string, store_types string, terms_raw string, brands string"
    raw = spark.createDataFrame([(m, p, t, "Banco " + t, None, d, "", "", f"Hasta el 5/3/2026. {t}", "") for m, p, t, d in offers], kind)
    return lq.as_batch(raw)


def small_store(spark, sf, path, buckets=8):
    return store.create_store(spark, str(path), lq.start_state(spark, sf), buckets)


def listed(found):
    return sorted((r.merchant_id, r.title, r.discount, r.is_active) for r in found.table("offers").collect())


def files(found, name="offers"):
    return {b: f for t, b, f, _ in found.folders if t == name}


def test_untouched_buckets_stay_the_same_folders(spark, sf, tmp_path):
    found = small_store(spark, sf, tmp_path)
    first = rows(spark, [(str(m), m, "a", "10%") for m in range(40)])
    one = store.apply_batch(found, 1, first, lq.runs_of(first), lq.NOW)
    second = rows(spark, [("3", 1, "b", "20%")])
    two = store.apply_batch(one, 2, second, lq.runs_of(second), lq.NOW)
    changed = {b for b in files(one) if files(one)[b] != files(two)[b]}
    assert len(changed) == 1 and len(files(one)) == 8
    for name in ("terms", "merchants"):
        assert {b for b in files(one, name) if files(one, name)[b] != files(two, name)[b]} == changed
    assert [f for _, _, f, _ in two.folders if f.startswith("history")] == ["history/batch=1/bucket=-1", "history/batch=2/bucket=-1"]
    assert ("3", "a", "10%", False) in listed(two) and ("3", "b", "20%", True) in listed(two) and len(listed(two)) == 41
    assert listed(store.open_store(spark, str(tmp_path), one.version)) == listed(one)
    assert two.table("terms").count() == 41 and two.table("history").count() == 41


def test_a_batch_counts_once_and_failed_sources_change_nothing(spark, sf, tmp_path):
    found = small_store(spark, sf, tmp_path)
    batch = rows(spark, [("1", 1, "a", "10%"), ("2", 2, "b", "10%")])
    runs = spark.createDataFrame([("1", None), ("2", "timeout"), ("9", None)], "merchant_id string, error string")
    one = store.apply_batch(found, "x", batch, runs, lq.NOW)
    again = store.apply_batch(one, "x", batch, runs, lq.NOW)
    assert again.version == one.version and listed(again) == [("1", "a", "10%", True)]
    notes = sorted((r.merchant_id, r.status, r.promotions_found, r.error_message) for r in one.table("history").collect())
    assert notes == [("1", "success", 1, "Method: traditional"), ("2", "error", 0, "timeout"), ("9", "success", 0, "No promotions found")]


def test_aggregator_offers_go_to_brands(spark, sf, tmp_path):
    found = small_store(spark, sf, tmp_path)
    old = rows(spark, [("7", 1, "own", "5%")])
    found = store.apply_batch(found, 1, old, lq.runs_of(old), lq.NOW)
    batch = rows(spark, [("7", 1, "a", "10%"), ("7", 2, "b", "20%"), ("7", 3, "c", "30%")])
    brands = F.when(F.col("title") == "a", F.array(F.lit("YPF"), F.lit("Shell"))).otherwise(F.array().cast("array<string>"))
    runs = spark.createDataFrame([("7", True, "Banco", "http://b", "Axion")], "merchant_id string, aggregator boolean, name string, url string, default_brand string")
    found = store.apply_batch(found, 2, batch.withColumn("merchant_brands", brands), runs, lq.NOW)
    names = {r.id: r.name for r in found.table("merchants").collect()}
    active = sorted((names[r.merchant_id], r.title, r.source) for r in found.table("offers").filter("is_active").collect())
    assert active == [("Axion", "b", "7"), ("Axion", "c", "7"), ("Shell", "a", "7"), ("YPF", "a", "7")]
    notes = {r.error_message for r in found.table("history").collect()}
    assert notes == {"Method: traditional", "Method: traditional (via Banco)", "Aggregator: routed to 3 brand(s)"}


def test_registering_merchants_touches_their_buckets(spark, sf, tmp_path):
    found = small_store(spark, sf, tmp_path)
    seen = spark.createDataFrame([("Nuevo", "http://n", "fuel", 1)], "name string, url string, category string, pos long")
    after = store.register_merchants(found, "seen", seen)
    assert after.table("merchants").filter("name = 'Nuevo'").count() == 1
    assert sum(files(found, "merchants")[b] != f for b, f in files(after, "merchants").items()) == 1
    assert after.table("merchants").count() == found.table("merchants").count() + 1


def test_stream_cut_off_between_write_and_pointer(spark, sf, tmp_path, monkeypatch):
    """Folders of a batch are written, its line of the log is not; the restarted stream merges the batch once."""
    batches = [lq.as_batch(lq.crawl(spark, sf, n)) for n in (1, 2)]
    small_store(spark, sf, tmp_path / "store")

    def ingest(batch):
        batch.repartition(2, "merchant_id").write.mode("append").parquet(f"{tmp_path}/in")
        run()

    def run():
        stream = streams.file_stream(spark, f"{tmp_path}/in", batches[0].schema)
        streams.stream_crawl_ingest(stream, f"{tmp_path}/store", f"{tmp_path}/state", lq.NOW)

    ingest(batches[0])
    publish = store._publish

    def stop(*_):
        raise RuntimeError("cut off")

    monkeypatch.setattr(store, "_publish", stop)
    with pytest.raises(StreamingQueryException, match="cut off"):
        ingest(batches[1])
    left = store.open_store(spark, str(tmp_path / "store"))
    assert not left.table("offers").filter("discount like '9%'").count()
    monkeypatch.setattr(store, "_publish", publish)
    run()
    run()
    found = store.open_store(spark, str(tmp_path / "store"))
    want = lq.after_batches(spark, sf, tables=("offers",))["offers"]
    assert found.version == left.version + 1
    assert listed(found) == sorted((r.merchant_id, r.title, r.discount, r.is_active) for r in want.collect())


def test_partition_overwrite_leaves_other_merchants_alone(spark, tmp_path):
    import glob

    path = f"{tmp_path}/offers"
    offers = spark.range(300).select((F.col("id") % 5).alias("merchant_id"), "id", F.lit("a").alias("title"))
    lifecycle.replace_merchant_offers(offers.repartition(7), path)
    before = {f for f in glob.glob(f"{path}/*/*.parquet")}
    assert len(before) == 5
    lifecycle.replace_merchant_offers(offers.filter("merchant_id = 2 and id < 100"), path)
    after = {f for f in glob.glob(f"{path}/*/*.parquet")}
    assert {f for f in before - after} == {f for f in before if "merchant_id=2" in f}
    assert spark.read.parquet(path).filter("merchant_id = 2").count() == 20
