"""Votes over video frames and plates from character detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstone.functions.plates import plate_vote_key, score_plate

# Sampling and stop settings, character classes.
SAMPLE_SECONDS, MAX_FRAMES, MIN_VOTES, STOP_SCORE = 0.5, 30, 2, 0.72
GLYPHS = {"a": "أ", "b": "ب", "d": "د", "h": "ه", "w": "و", "waw": "و", "ch": "ش"}


def sample_frames(frames: DataFrame, fps: float = 24.0) -> DataFrame:
    """Every step-th frame of a video, at most ``MAX_FRAMES`` of them (the sampling is the feature)."""
    step = max(1, round(fps * SAMPLE_SECONDS))
    limit = step * MAX_FRAMES
    return frames.filter((F.col("frame_index") % step == 0) & (F.col("frame_index") < limit))


def votes(frames: DataFrame) -> DataFrame:
    """Frames with vote key and score; frames after the early stop of their video are out."""
    score = F.least(F.lit(1.0), score_plate(F.trim("plate_text")) * 0.7 + F.least(F.col("detection_conf"), F.lit(1.0)) * 0.3)
    rows = frames.filter(F.trim("plate_text") != "").withColumn("vote_key", plate_vote_key(F.col("plate_text"))).withColumn("score", score)
    w = Window.partitionBy("video_id", "vote_key").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = (F.count("*").over(w) >= MIN_VOTES) & (F.avg("score").over(w) >= STOP_SCORE)
    rows = rows.withColumn("_done", done)
    stop = rows.filter("_done").groupBy("video_id").agg(F.min("frame_index").alias("stop"))
    return rows.drop("_done").join(stop, "video_id", "left").filter(
        F.col("stop").isNull() | (F.col("frame_index") <= F.col("stop"))).drop("stop")


def plate_votes(frames: DataFrame) -> DataFrame:
    return votes(frames).groupBy("video_id", "vote_key").agg(
        F.count("*").alias("votes"), F.sum("score").alias("total_score"), F.max("score").alias("best_score"),
        F.max_by("frame_index", F.struct("score", (-F.col("frame_index")).alias("f"))).alias("best_frame"),
        F.min("frame_index").alias("first_frame"))


def winner(frames: DataFrame) -> DataFrame:
    rows = plate_votes(frames).withColumn("avg_score", F.col("total_score") / F.col("votes"))
    rank = F.struct("votes", "avg_score", "best_score", (-F.col("first_frame")).alias("f"))
    best = F.max_by(F.struct("vote_key", "votes", "avg_score", "best_score", "best_frame"), rank)
    return rows.groupBy("video_id").agg(best.alias("b")).select("video_id", "b.*")


def plate_from_glyphs(glyphs: DataFrame) -> DataFrame:
    """``left | letter | right`` from characters in x order; plain text where no letter is known."""
    labels = F.transform(F.array_sort(F.collect_list(F.struct("x", "label"))), lambda g: g["label"])
    rows = glyphs.groupBy("plate_id").agg(labels.alias("t"))  # the characters of one plate
    at = F.array_min(F.filter(F.transform("t", lambda t, i: F.when(t.isin(*GLYPHS), i + 1)), lambda i: i.isNotNull()))
    rows = rows.withColumn("at", at)
    table = F.create_map(*[F.lit(v) for pair in GLYPHS.items() for v in pair])
    part = lambda a, n: F.array_join(F.slice("t", a, F.greatest(n, F.lit(0))), "")
    text = F.concat_ws(" | ", part(F.lit(1), F.col("at") - 1), F.try_element_at(table, F.element_at("t", F.col("at"))),
                       part(F.col("at") + 1, F.size("t") - F.col("at")))
    return rows.select("plate_id", F.when(F.col("at").isNull(), F.array_join("t", "")).otherwise(text).alias("plate_text"))
