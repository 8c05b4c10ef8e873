"""Cases that need the whole episode or table, not a part of it."""

from kinetrail.plans import catalog


def test_event_frame_precedence_reads_every_frame(spark, tmp_path):
    kinds = {1: "vvvvvpvp", 2: "ssvvsv", 3: "vvvvve", 4: "vvvvvv", 5: "svvvvp"}
    names = {"v": "view", "p": "purchase", "s": "signup", "e": "error"}
    rows = [(100 * u + i, u, f"2024-01-01 00:00:{i:02d}", names[c]) for u, text in kinds.items() for i, c in enumerate(text)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string")
    df.withColumn("ts", df.ts.cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["user_id"]: r["events"] for r in catalog.QUERIES["event_frame_precedence"](spark, str(tmp_path)).collect()}
    assert got == {1: [5, 7], 2: [0, 1, 4], 3: [5], 4: None, 5: [5]}


def test_big_numbers_has_a_row_for_every_document(spark, tmp_path):
    want = {0: "0", 500: "500", 999: "999", 1500: "2K", 2500: "2K", 3500: "4K", 2501: "3K", 999_499: "999K", 1_500_000: "2M", 2_500_000: "2M", None: None}
    rows = [(i, n) for i, n in enumerate(want)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["human"] for r in catalog.QUERIES["big_numbers"](spark, str(tmp_path)).collect()}
    assert got == {i: want[n] for i, n in rows}
