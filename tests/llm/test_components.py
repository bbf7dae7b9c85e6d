"""What a round of star contraction costs."""

from lexmill.llm import components as C


def test_a_round_is_five_stages(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(C, "cut", lambda df, cut=C.cut: rounds.append(1) or cut(df))
    spark.sparkContext.setJobGroup("components", "stages of all rounds")
    try:
        got = {r.node: r.label for r in C.components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")).collect()}
        tracker = spark.sparkContext.statusTracker()
        ran = [s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s) and tracker.getStageInfo(s).numCompletedTasks]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict.fromkeys(range(61), 0) and len(rounds) > 3
    # four shuffles and what writes the round; 76 stages in 8 rounds when each part shuffled for itself
    assert len(set(ran)) <= 5 * len(rounds) + 2
