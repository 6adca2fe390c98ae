from tempora.streaming import runs

SCHEMA = "clip string, frame long, gray array<float>, done boolean"


def feed(spark, tmp_path, batches, build, name):
    """Runs that a stream of one file a batch gives out."""
    src = tmp_path / "in"
    src.mkdir()
    frames = build(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src)))
    q = frames.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
            for f in (tmp_path / f"b{k}").glob("*.parquet"):
                f.rename(src / f"{k}.parquet")
            q.processAllAvailable()
        return sorted((r.clip, r.frame_from, r.frame_to) for r in spark.table(name).collect())
    finally:
        q.stop()


def clip(name, tones, done=True):
    return [(name, i, [float(t)] * 50, done and i == len(tones) - 1) for i, t in enumerate(tones)]


def test_black(spark, tmp_path):
    a = clip("a", [200] * 3 + [0] * 6 + [200] + [0] * 2 + [200] + [5] * 4)
    b = clip("b", [0] * 5 + [90])
    batches = [a[:5] + b[:2], a[3:9] + b[2:], a[9:]]  # frames 3 and 4 come twice
    got = feed(spark, tmp_path, batches, lambda f: runs.black_runs(f, 10, 0.3), "black")
    assert got == [("a", 3, 9), ("a", 13, 17), ("b", 0, 5)]


def test_freezes(spark, tmp_path):
    tones = [(i * 37) % 256 for i in range(8)] + [90] * 12 + [(i * 41) % 256 for i in range(5)] + [77] * 9
    a = clip("a", tones)
    got = feed(spark, tmp_path, [a[:10], a[10:13], a[13:]], lambda f: runs.freeze_runs(f, 10, 0.8), "frozen")
    assert got == [("a", 8, 19), ("a", 25, 33)]
