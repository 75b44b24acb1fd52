import json

from pyspark.sql import functions as F

from scholia.operators import mastery, srs
from scholia.sources import files
from scholia.streaming import learners


def drained(df, name, mode="update"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def events(spark, folder):
    rows = [(i, f"s{i % 3}", "c", f"ch_{i % 2}", i % 2, float(40 + i * 7 % 60), f"k{i % 2}", (i * 5) % 6) for i in range(60)]
    df = spark.createDataFrame(rows, "attempt_id long, student_id string, course_id string, chapter_id string, is_correct int, fuzzy_score double, card_id string, quality int")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("attempt_id") * 3600)).withColumn("review_id", F.col("attempt_id")).withColumn("review_ts", F.col("ts"))
    for k in range(3):
        df.filter(f"attempt_id div 20 = {k}").coalesce(1).write.mode("append").parquet(folder)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streams_end_as_batches(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "in"))
    by = [*mastery.KEY]
    got = drained(learners.mastery_stream(stream), "mastery").groupBy(*by).agg(F.max_by(F.struct("correct_attempts", "avg_fuzzy_score"), "total_attempts").alias("x"), F.max("total_attempts").alias("n"))
    want = {tuple(r[k] for k in by): (r["total_attempts"], r["correct_attempts"], r["avg_fuzzy_score"]) for r in mastery.chapter_mastery_exact(batch).collect()}
    assert {tuple(r[k] for k in by): (r["n"], r["x"]["correct_attempts"], r["x"]["avg_fuzzy_score"]) for r in got.collect()} == want
    state = ("repetitions", "interval_days", "easiness_factor", "last_review")
    cards = drained(learners.cards_stream(stream), "cards").groupBy("student_id", "card_id").agg(F.max_by(F.struct(*state), "last_review").alias("s"))
    want = {(r["student_id"], r["card_id"]): tuple(r[c] for c in state) for r in srs.schedules(batch.withColumn("course_id", F.lit("c"))).collect()}
    assert {(r["student_id"], r["card_id"]): tuple(r["s"]) for r in cards.collect()} == want
    means = drained(learners.mastery_means_stream(stream), "means").groupBy(*by).agg(F.max_by("avg_fuzzy_score", "total_attempts").alias("m"))
    want = {tuple(r[k] for k in by): r["avg_fuzzy_score"] for r in mastery.chapter_mastery(batch).collect()}
    assert {tuple(r[k] for k in by): r["m"] for r in means.collect()} == want
    hours = drained(learners.attempts_per_hour(stream), "hours", "append")
    assert hours.agg(F.max("attempts")).first()[0] == 1


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = tmp_path / "t"
    rows = [(f"k{i % 4}", f"c{i % 4 // 2}", i, i) for i in range(6)]
    df = spark.createDataFrame(rows, "chunk_key string, course_id string, v int, b int")
    write = learners.upsert_partitions(str(path), "chunk_key", "course_id", "v")
    write(df.filter("b < 4"), 0)
    files_of = lambda c: sorted(p.name for p in (path / f"course_id={c}").glob("*.parquet"))
    before = files_of("c1")
    for number in (1, 7, 7):  # numbers may be skipped, a batch may come again
        write(df.filter("b >= 4"), number)
    assert {r["chunk_key"]: r["v"] for r in spark.read.parquet(str(path)).collect()} == {"k0": 4, "k1": 5, "k2": 2, "k3": 3}
    assert files_of("c1") == before and files_of("c0")


def test_late_repeats_stay_out_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder, table = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "course_id string, chapter_id string, content_hash string, ts timestamp, v int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def run():
        q = learners.new_chunks_stream(stream).writeStream.foreachBatch(learners.upsert_partitions(table, "content_hash", "course_id")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None

    put = lambda rows: spark.createDataFrame(rows, "course_id string, chapter_id string, content_hash string, day string, v int").select("course_id", "chapter_id", "content_hash", F.to_timestamp("day").alias("ts"), "v").coalesce(1).write.mode("append").parquet(folder)
    put([("c", "1", "a", "2024-01-01", 1), ("c", "1", "a", "2024-01-01", 1), ("d", "1", "b", "2024-06-01", 2)])
    run()
    put([("c", "1", "a", "2020-01-01", 3), ("c", "1", "z", "2020-01-01", 4)])
    run()
    assert {(r["course_id"], r["content_hash"], r["v"]) for r in spark.read.parquet(table).collect()} == {("c", "a", 1), ("d", "b", 2), ("c", "z", 4)}


def test_files(spark, tmp_path):
    (tmp_path / "books").mkdir()
    (tmp_path / "books/world_history_textbook.txt").write_bytes("é text".encode())
    (tmp_path / "books/old.md").write_bytes("é".encode("latin-1"))
    (tmp_path / "books/x.pdf").write_bytes(b"no")
    got = {r["book_id"]: (r["subject"], r["text"]) for r in files.read_books(spark, str(tmp_path / "books")).collect()}
    assert got == {"world_history_textbook.txt": ("World History", "é text"), "old.md": ("Old", "é")}
    (tmp_path / "courses").mkdir()
    (tmp_path / "courses/a.json").write_text(json.dumps({"course_id": "a", "title": "T", "chapters": []}))
    (tmp_path / "courses/b.json").write_text("{broken")
    assert [r["course_id"] for r in files.read_courses(spark, str(tmp_path / "courses")).collect()] == ["a"]
    (tmp_path / "d.json").write_text(json.dumps([{"background_info": {"topic": "t"}, "conversation": [{"role": "Teacher", "text": "x"}, {"role": "Student", "text": "y"}]}]))
    assert [(r["topic"], r["turn"], r["role"]) for r in files.read_dialogues(spark, str(tmp_path / "d.json")).collect()] == [("t", 0, "Teacher"), ("t", 1, "Student")]
    (tmp_path / "log.csv").write_text("student_id,elapsed_time\nu,5\n")
    assert [(r["user"], r["action"]) for r in files.read_interactions(spark, str(tmp_path / "log.csv")).collect()] == [("u", "QA")]
    m = spark.createDataFrame([([("user", "ü")],)], "messages array<struct<role string, content string>>")
    files.write_messages(m, str(tmp_path / "out"))
    files.write_messages(m, str(tmp_path / "out"), append=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"messages":[{"role":"user","content":"ü"}]}'] * 2
