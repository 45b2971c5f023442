from stepweave.streaming.features import errors, repeated_steps, watch


def test_stream(spark, tmp_path):
    source = tmp_path / "in" / "proj"
    source.mkdir(parents=True)
    (source / "a.feature").write_text("Feature: f\nScenario: s\nGiven a <gone> cow\nWhen it moos\nScenario: t\nWhen it moos\n")
    for name, build, mode in (("errors", errors, "append"), ("steps", repeated_steps, "complete")):
        stream = build(watch(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        stream.awaitTermination(120)
    assert [(r["project"], r["undefined"]) for r in spark.table("errors").collect()] == [("proj", ["gone"])]
    assert [(r["text"], r["occurrences"]) for r in spark.table("steps").collect()] == [("it moos", 2)]
